"""The tables that stand in for molecules, proteins, assays and experiment results, as DataFrames and as SQL.

The engine's own data model is: molecule(mol_id, structure), protein(prot_id, seq, species), interaction(prot_id,
mol_id), label(id, task, y), prediction(id, task, y, score) and result(dataset, setting, ..., score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def molecule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mol_id"), F.col("p_name").alias("structure"))


def protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation as the species; the nations are a small dimension that the engine may broadcast."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("species"))
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("s_suppkey").alias("prot_id"), F.col("s_name").alias("name"), "species"
    )


def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse relation, never a dense matrix."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 50")
    return lines.select(F.col("l_suppkey").alias("prot_id"), F.col("l_partkey").alias("mol_id")).distinct()


def label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-task labels in long form; null where a document has no label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    wide = docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return wide.unpivot(["doc_id", "lang", "n_chars"], ["quality", "toxic"], "task", "y").withColumnRenamed("doc_id", "id")


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up score beside each label."""
    score = ((F.col("id") * 7919 + F.col("n_chars")) % 1000) / F.lit(1000.0)
    return label(spark, sf_dir).select("id", "task", "y", score.alias("score"))


def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form experiment results: parameters and one score a row."""
    e = table(spark, sf_dir, "events")
    ite = (F.col("user_id") % 5).cast("int")
    return e.select(
        "event_id",
        F.col("event_type").alias("algo"),
        ite.alias("ite"),
        ((ite + 1 + F.col("event_id") % 2) % 5).cast("int").alias("ival"),
        (1 + F.col("event_id") % 4).cast("int").alias("setting"),
        F.element_at(F.array(F.lit(1), F.lit(2), F.lit(5)), (F.col("event_id") % 3 + 1).cast("int")).alias("ratio_te"),
        F.element_at(F.array(F.lit(1), F.lit(5)), (F.col("event_id") % 2 + 1).cast("int")).alias("ratio_tr"),
        F.col("value").alias("score"),
        F.col("props").alias("params"),
    )


# The same in SQL, as common table expressions.
INTER = "inter AS (SELECT DISTINCT l_suppkey AS prot_id, l_partkey AS mol_id FROM lineitem WHERE l_quantity >= 50)"
PROT = "prot AS (SELECT s_suppkey AS prot_id, s_name AS name, n_name AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
LABEL = """lab AS (SELECT d.doc_id AS id, d.lang, d.n_chars, t.task, CASE t.task WHEN 'quality' THEN l.quality ELSE l.toxic END AS y
  FROM documents d LEFT JOIN labels l USING (doc_id) CROSS JOIN (VALUES ('quality'), ('toxic')) t(task))"""
PRED = LABEL + ", pred AS (SELECT id, task, y, ((id * 7919 + n_chars) % 1000) / 1000.0::DOUBLE AS score FROM lab)"
RES = """res AS (SELECT event_id, event_type AS algo, (user_id % 5)::INT AS ite, ((user_id % 5 + 1 + event_id % 2) % 5)::INT AS ival,
  (1 + event_id % 4)::INT AS setting, [1, 2, 5][(event_id % 3 + 1)::INT]::INT AS ratio_te, [1, 5][(event_id % 2 + 1)::INT]::INT AS ratio_tr,
  value AS score, props AS params FROM events)"""
