"""The corpus pipeline: toxicity, near-dedup, PII, mixing to target weights, packing.

Each stage takes the session, the documents its predecessor kept and the folder of the tables, works on all of
them and returns documents in the same columns; the last one returns the pieces of the packed sequences.

All stages read texts whole, whatever their length, take null and empty ones, and give an empty result for an empty
table. Columns beside ``doc_id``, ``text``, ``lang`` and ``n_chars`` are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm import minhash, mixing, packing, pii, toxicity
from dockyard.llm.shared import cut, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject (a score of at least 0.5) go.

    A null or empty text has a score like any other. Repeated rows have equal scores, so all stay or all go.
    """
    scorer = toxicity.scorer(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(scorer(F.col("text")) < 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, 0.8): that with the smallest id.

    Of rows with equal id and text one stays; where they differ in other columns, that of the smallest md5 of these as
    JSON. Null and empty texts are no one's duplicates. Rows without an id are compared with nothing and all stay.
    """
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = F.struct(*[F.col(c) for c in docs.columns])
    first = F.min_by(rest, F.md5(F.to_json(rest.dropFields("text")))).alias("row")
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text").agg(first).select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms; the count of characters follows the text.

    A null text stays null. Repeated rows stay repeated.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text")
    named = pii.pseudonymise(rows, keep=["row"])
    kept = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in kept:
        changed = F.when(F.col("n_replaced") > 0, F.length("text")).otherwise(kept["n_chars"])
        kept["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return named.select(*[x.alias(c) for c, x in kept.items()])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rates say: at least once each, and so often in all that the targets are met.

    A null or empty text comes once. Repeated rows are each repeated alike; rows without an id by a hash of their text.
    """
    labelled = mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.repeated(docs, labelled, mixing.TARGETS, budget=None, least=1.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as can be.

    A null or empty text is a piece of the end token alone. Repeated rows and rows without an id are packed each.
    """
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("pii_pseudonyms", pii_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL can't express the language models, the tokenizer or the packing; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
