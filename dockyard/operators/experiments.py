"""Experiments: runs as a table, done once each, whatever is started again.

A run is a row of keys: data set, setting, ratios, test fold ``ite``, validation fold ``ival`` and a try. Its scores and predictions
replace what the same run wrote before, and only when both are written does a mark say that it is finished, so a run that
was killed half-way is made again and one that is marked is not. Which runs are left is an anti-join of the two tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.functions.metrics import report
from dockyard.operators import training as N
from dockyard.sources.files import read_folds, replace_results

KEYS = ["dataset", "setting", "ratio_tr", "ratio_te", "ite", "ival", "attempt"]
SCHEMA = "dataset string, setting int, ratio_tr int, ratio_te int, ite int, ival int, attempt int"


def rotations(spark: SparkSession, dataset: str, setting: int, ratios_tr: list[int], ratios_te: list[int], k: int = 5, attempts: int = 1) -> DataFrame:
    """All runs of a setting: each fold tests once, with the next one for validation; setting 4 has k * k blocks."""
    n = k * k if setting == 4 else k
    one = spark.range(n).select(F.lit(dataset).alias("dataset"), F.lit(setting).alias("setting"), F.col("id").cast("int").alias("ite"))
    for name, values in (("ratio_tr", ratios_tr), ("ratio_te", ratios_te), ("attempt", list(range(attempts)))):
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return one.withColumn("ival", ((F.col("ite") + 1) % n).cast("int")).select(*KEYS)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of runs, empty where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def left(spark: SparkSession, runs: DataFrame, out: str) -> DataFrame:
    """The runs that no mark says are finished."""
    done = stored(spark, f"{out}/finished", f"{SCHEMA}, rows long").select(*[F.col(c).cast(dict(runs.dtypes)[c]).alias(c) for c in KEYS])
    return runs.join(done, KEYS, "left_anti")


def run_missing(spark: SparkSession, runs: DataFrame, out: str, body: Callable[[dict], dict[str, DataFrame]], most: int | None = None) -> int:
    """Do the runs that are left, in order; returns how many were done.

    ``body`` takes a run's keys and returns tables by name (``scores``, ``predictions``, ``log``, ...), each written to ``out``/name
    under the run's keys. The runs, not their data, are listed on the driver.
    """
    todo = left(spark, runs, out).orderBy(*KEYS).limit(most or 1 << 20).collect()
    for row in todo:
        run = row.asDict()
        keys = [F.lit(v).cast(dict(runs.dtypes)[c]).alias(c) for c, v in run.items()]
        for name, made in body(run).items():
            replace_results(made.select(*[c for c in made.columns if c not in KEYS], *keys), f"{out}/{name}", KEYS)
        rows = spark.range(1).select(F.lit(len(todo)).cast("long").alias("rows"), *keys)
        replace_results(rows, f"{out}/finished", KEYS)
    return len(todo)


def pair_net_run(spark: SparkSession, folds: str, prot: DataFrame, mol: DataFrame, net: N.Net, **options) -> Callable[[dict], dict[str, DataFrame]]:
    """A run of a net on joined features of pairs: train without the test and validation folds, stop by the validation fold, and
    report on the test fold. ``folds`` is a table of ``write_folds``; ``prot`` and ``mol`` give ``pf`` and ``mf`` arrays by id."""

    def rows(split: DataFrame) -> DataFrame:
        met = split.join(prot.hint("merge"), "prot_id").join(mol.hint("merge"), "mol_id")  # features of all entities are never broadcast
        return met.select(F.concat_ws("-", "prot_id", "mol_id").alias("pair"), "prot_id", "mol_id", "y", F.concat("pf", "mf").alias("x"), F.array(F.col("y").cast("double")).alias("t"))

    def body(run: dict) -> dict[str, DataFrame]:
        own = read_folds(spark, folds, run["ratio_tr"], run["ite"], run["ival"])
        test = read_folds(spark, folds, run["ratio_te"], run["ite"], run["ival"])["test"]
        fitted = N.fit(rows(own["train"]), net, "pair", y="t", val=rows(own["val"]), seed=92 + run["attempt"], **options)
        scored = fitted.predict(rows(test), keep=("prot_id", "mol_id", "y")).select("prot_id", "mol_id", "y", F.col("score")[0].alias("score"))
        told = report(scored.withColumn("part", F.lit("test")), ["part"]).drop("part")
        best = spark.range(1).select(F.lit("val").alias("score_name"), F.lit(float(fitted.log[fitted.best_epoch]["val_score"])).alias("value"))
        return {"predictions": scored, "scores": told.unionByName(best), "log": fitted.log_rows(spark)}

    return body


def best_attempts(scores: DataFrame) -> DataFrame:
    """Of each run's attempts the one with the best validation score, ties to the first: the rows of its test scores."""
    own = [c for c in KEYS if c != "attempt"]
    best = scores.where("score_name = 'val'").groupBy(*own).agg(F.max(F.struct("value", (-F.col("attempt")).alias("a"))).alias("b"))
    return scores.where("score_name <> 'val'").join(best.select(*own, (-F.col("b.a")).alias("attempt")), KEYS, "left_semi")
