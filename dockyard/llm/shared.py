"""Helpers shared by the corpus operators: tables, checkpoints and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.operators.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many links the rounds of ``components`` run in one partition.
SMALL = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: columns ``a`` and ``b`` (long, not null; loops and repeats are fine). Returns ``node`` and
    ``component`` (the smallest reachable id), one row for each node that has an edge to another node;
    an empty input gives an empty result. Stars are formed with a minimum per node (combined before the
    shuffle) and a join, so a node with very many neighbours is never collected into one task.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """Hook neighbours to the smallest one: of all neighbours (large star) or of the smaller ones (small star)."""
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        seen = pairs.select(ends.alias("e")).select("e.a", "e.b") if larger else pairs
        least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        met = seen.join(least, "a")
        if larger:
            linked = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            both = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
            linked = met.select(both.alias("e")).select("e.a", "e.b")
        return linked.where("a <> b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(
            pairs.agg(
                F.count("*"),
                F.sum(F.hash("a", "b").cast("long")),
                F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit((1 << 31) - 1))),
            ).first()
        )

    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = mark(pairs)
    if before[0] <= SMALL:  # so few links, by count, that a round of jobs over many partitions would only cost time
        pairs = pairs.coalesce(1)
    for _ in range(rounds):
        if not before[0]:
            break
        pairs = cut(star(star(pairs, True), False))
        pairs = pairs.coalesce(1) if before[0] <= SMALL else pairs
        now = mark(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
