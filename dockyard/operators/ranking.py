"""Ranks over whole tables without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(*columns, seed: int = 324) -> Column:
    """A shuffle order that any engine can repeat: md5 of the key and the seed."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))


def global_rank(df: DataFrame, order: list[str], bucket: Column, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """``row_number() - 1`` over ``order`` within ``by``, in two levels.

    ``bucket`` must rise with the order; rows are ranked within their bucket, and the sizes of the buckets before
    are added. Only the sizes, one row a bucket, pass through one window over all buckets. Null groups are groups of
    their own, and rows with a null order key or bucket come first.
    """
    by = by or []
    keyed = df.withColumn("_g", F.struct(*[F.col(c) for c in by], bucket.alias("_b")))  # never null itself: nulls meet in joins
    sizes = keyed.groupBy("_g").agg(F.count("*").alias("_n"))
    total = Window.partitionBy(*[F.col("_g")[c] for c in by]) if by else Window.partitionBy(F.lit(0))
    begins = sizes.select("_g", (F.sum("_n").over(total.orderBy(F.col("_g")["_b"])) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order)) - 1)
    return ranked.join(begins, "_g").withColumn(name, F.col("_before") + F.col("_r")).select(*[c for c in df.columns if c != name], name)


def numbered(df: DataFrame, key: str, seed: int = 324, by: list[str] | None = None, name: str = "number") -> DataFrame:
    """Numbers from 0 in a hash order of ``key``, whatever its type, within ``by``."""
    h = df.withColumn("_h", hashed(key, seed=seed))
    return global_rank(h, ["_h", key], F.substring("_h", 1, 4), name, by).drop("_h")


def kfold(df: DataFrame, key: str, k: int, seed: int = 324, by: list[str] | None = None) -> DataFrame:
    """Fold 0 to k - 1 by position in a hash order, within ``by`` if the folds are to be stratified: sizes differ by one at most."""
    ranked = numbered(df, key, seed, by, "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")
