"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a local session, as in tests, uses a temporary folder; on a cluster that is an error, as executors
    don't share one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="dockyard-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> str:
    """Write a table to the shared folder, partitioned by columns so that readers of a part read that alone; its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.repartition(*by).write.partitionBy(*by).parquet(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, for rounds of many joins.

    A checkpoint keeps its plan's estimated size, and joins multiply estimates: after some twenty rounds they are numbers of
    millions of digits. A table's size is that of its files.
    """
    return kept_at(df)[0]


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The same and the table's path, for ``forget``."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark, path: str) -> None:
    """Delete a table of an earlier round that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
