"""dockyard: a PySpark analytics engine for drug-target interaction studies and text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
