"""Sequence descriptors from lagged products: autocorrelations, sequence-order numbers and pseudo compositions.

A sequence is an array of numbers for each property of its residues; a lag pairs it with itself, shifted. All is arithmetic on the
arrays of a row, so nothing is shuffled. What is no residue is left out first. Properties are standardised over the 20 residues.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
# Fixed values, in the order of RESIDUES: hydropathy (Kyte and Doolittle), hydrophilicity (Hopp and Woods), side-chain mass.
HYDROPATHY = (1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3)
HYDROPHILICITY = (-0.5, -1.0, 3.0, 3.0, -2.5, 0.0, -0.5, -1.8, 3.0, -1.8, -1.3, 0.2, 0.0, 0.2, 3.0, 0.3, -0.4, -1.5, -3.4, -2.3)
MASS = (15.0, 47.0, 59.0, 73.0, 91.0, 1.0, 82.0, 57.0, 73.0, 57.0, 75.0, 58.0, 42.0, 72.0, 101.0, 31.0, 45.0, 43.0, 130.0, 107.0)


def standardised(values: Sequence[float]) -> tuple[float, ...]:
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return tuple(round((v - mean) / spread, 9) for v in values)


PROPERTIES: Mapping[str, tuple[float, ...]] = {"hydropathy": standardised(HYDROPATHY), "hydrophilicity": standardised(HYDROPHILICITY), "mass": standardised(MASS)}


def residues(seq: Column) -> Column:
    """The residues of a sequence, in either case; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(seq, F.lit("")), RESIDUES.lower(), RESIDUES), ""), lambda c: F.instr(F.lit(RESIDUES), c) > 0)


def values(own: Column, table: Sequence[float]) -> Column:
    look = F.array(*[F.lit(float(v)) for v in table])
    return F.transform(own, lambda c: F.element_at(look, F.instr(F.lit(RESIDUES), c)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def lagged(a: Column, b: Column, d: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The sum of f(a_i, b_(i + d)) over a sequence."""
    n = F.size(a) - d
    return total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, d + 1, n), f))


def _prepared(df: DataFrame, key: str, seq: str, lags: int, names: Sequence[str]) -> DataFrame:
    own = df.select(key, residues(F.col(seq)).alias("_r")).withColumn("n", F.size("_r"))
    told = own.select(key, "n", "_r", *[values(F.col("_r"), PROPERTIES[p]).alias(f"_p{k}") for k, p in enumerate(names)])
    return told.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(lags)))).where("n > d")


def autocorrelations(df: DataFrame, key: str, seq: str, prop: str = "hydropathy", lags: int = 30) -> DataFrame:
    """``key``, ``lag``, ``moreau_broto``, ``moran`` and ``geary`` of sequences longer than the lag.

    A sequence of equal values has no spread: Moran and Geary are null. Null and empty sequences have no rows.
    """
    p = F.col("_p0")
    rows = _prepared(df, key, seq, lags, [prop]).withColumn("m", total(p) / F.col("n"))
    spread = total(F.transform(p, lambda x: (x - F.col("m")) * (x - F.col("m"))))
    centred = F.transform(p, lambda x: x - F.col("m"))
    told = rows.select(key, F.col("d").alias("lag"), "n", "d", "_p0", centred.alias("c"), spread.alias("v"))
    pairs = (F.col("n") - F.col("d")).cast("double")
    flat = F.col("v") > 1e-12
    return told.select(
        key,
        "lag",
        (lagged(p, p, F.col("d"), lambda a, b: a * b) / pairs).alias("moreau_broto"),
        F.when(flat, lagged(F.col("c"), F.col("c"), F.col("d"), lambda a, b: a * b) / pairs / (F.col("v") / F.col("n"))).alias("moran"),
        F.when(flat, lagged(p, p, F.col("d"), lambda a, b: (a - b) * (a - b)) / (2 * pairs) / (F.col("v") / (F.col("n") - 1))).alias("geary"),
    )


def order_numbers(df: DataFrame, key: str, seq: str, lags: int = 30) -> DataFrame:
    """``key``, ``lag``, ``n`` and three numbers of sequence order: ``coupling`` (the sum of squared distances between residues a lag
    apart, a distance being that of the standardised properties), ``theta`` (a third of its mean) and ``hydropathy`` and
    ``hydrophilicity``, the mean products of the properties themselves."""
    rows = _prepared(df, key, seq, lags, list(PROPERTIES))
    square = sum((lagged(F.col(f"_p{k}"), F.col(f"_p{k}"), F.col("d"), lambda a, b: (a - b) * (a - b)) for k in range(len(PROPERTIES))), F.lit(0.0))
    pairs = (F.col("n") - F.col("d")).cast("double")
    product = lambda k: lagged(F.col(f"_p{k}"), F.col(f"_p{k}"), F.col("d"), lambda a, b: a * b) / pairs
    told = rows.select(key, F.col("d").alias("lag"), "n", square.alias("coupling"), product(0).alias("hydropathy"), product(1).alias("hydrophilicity"), pairs.alias("_pairs"))
    return told.select(key, "lag", "n", "coupling", (F.col("coupling") / len(PROPERTIES) / F.col("_pairs")).alias("theta"), "hydropathy", "hydrophilicity")


def pseudo_composition(df: DataFrame, key: str, seq: str, lags: int = 10, weight: float = 0.05, kind: str = "theta") -> DataFrame:
    """Shares of the 20 residues and of ``lags`` order numbers as one vector ``x``, for sequences longer than ``lags``.

    ``kind``: ``theta`` (pseudo amino-acid composition), ``coupling`` (quasi-sequence order), or ``amphiphilic`` (the products of
    hydropathy and of hydrophilicity in turn, twice as many numbers).
    """
    names = {"theta": ["theta"], "coupling": ["coupling"], "amphiphilic": ["hydropathy", "hydrophilicity"]}[kind]
    numbers = order_numbers(df, key, seq, lags).where(F.col("n") > lags)
    lists = numbers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lag", F.array(*names).alias("v")))).alias("t"))  # lags rows
    own = df.select(key, residues(F.col(seq)).alias("r")).where(F.size("r") > lags).dropDuplicates([key])
    shares = F.transform(F.array(*map(F.lit, RESIDUES)), lambda x: F.size(F.filter("r", lambda c: c == x)) / F.size("r"))
    met = own.select(key, shares.alias("f")).join(lists.select(key, F.flatten(F.col("t.v")).alias("t")), key)
    scale = 1 + weight * total(F.col("t"))
    return met.withColumn("_s", scale).select(key, F.concat(F.transform("f", lambda v: v / F.col("_s")), F.transform("t", lambda v: v * weight / F.col("_s"))).alias("x"))
