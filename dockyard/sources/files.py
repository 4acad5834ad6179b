"""Readers and writers of the file layouts that assay and sequence collections come in.

Every reader is lazy and splits its input over tasks: text readers cut records with Spark's own line separator, so a
file is not read whole anywhere. Rejected records are dropped by an explicit filter, never by an exception.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockyard.functions.columns import ALPHABET
from dockyard.functions.metrics import range_of
from dockyard.operators.ranking import global_rank

# Fixed value: the order of the residues in the one-hot arrays; the place after the last means no residue.
ARRAY_ORDER = "ACEDGFIHKMLNQPSRTWVYX"


def csv_by_position(spark: SparkSession, path: str, fields: dict[int, str], width: int) -> DataFrame:
    """A CSV file with a header whose columns count by position: ``fields`` names the wanted ones; empty is null."""
    names = [fields.get(i, f"_skip{i}") for i in range(width)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True).select(*fields.values())


def csv_by_header(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file of which columns are wanted by their names in the header."""
    return spark.read.csv(path, header=True).select(*columns)


def csv_with_row_ids(spark: SparkSession, path: str, fields: dict[int, str], width: int, keep: str) -> DataFrame:
    """Rows get their number in the file as ``id`` before rows with an empty ``keep`` are left out: ids have gaps.

    The number is the row's place among its partition's rows plus the rows of the partitions before it.
    """
    rows = csv_by_position(spark, path, fields, width).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # one row a partition
    at = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = rows.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("id", at.cast("string"))
    return numbered.where(F.col(keep).isNotNull() & (F.col(keep) != "")).select("id", *fields.values())


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """Tagged records parted by ``$$$$``: ``id``, ``smiles`` and ``weight``; the value is the line after its tag."""
    records = spark.read.text(path, lineSep="$$$$\n")
    value = lambda tag: F.nullif(F.regexp_extract("value", rf"> *<{tag}>[^\n]*\n([^\n]*)", 1), F.lit(""))
    found = records.select(value("DATABASE_ID").alias("id"), value("SMILES").alias("smiles"), value("MOLECULAR_WEIGHT").try_cast("double").alias("weight"))
    return found.where("id is not null")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records that begin with ``>``: ``header``, ``seq`` (lines joined, upper case) and ``source`` (the file). The last record is kept."""
    records = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_name").alias("source"))
    text = F.regexp_replace("value", "^>", "")
    header = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, text.substr(F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    return records.select(F.trim(header).alias("header"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"), "source").where("header <> ''")


def target_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Proteins (``prot_id``, ``seq``) and their ligands (``prot_id``, ``mol_id``): the accession is the second token between
    bars, the ligands stand in the first parentheses, parted by semicolons."""
    rows = fasta(spark, path).withColumn("prot_id", F.substring_index(F.get(F.split("header", r"\|"), F.lit(1)), " ", 1))
    ligands = F.split(F.regexp_extract("header", r"\(([^)]*)\)", 1), "; ?")
    return rows.select("prot_id", "seq"), rows.select("prot_id", F.explode(ligands).alias("mol_id")).where("mol_id <> ''")


def class_fasta(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """One file a class (``classes`` names them in order), or the first letter of the header's second token as the class."""
    rows = fasta(spark, path).withColumn("id", F.substring_index("header", " ", 1))
    if classes:
        y = F.array_position(F.array(*map(F.lit, classes)), F.col("source")) - 1
    else:
        y = F.ascii(F.get(F.split("header", " "), F.lit(1))) - F.ascii(F.lit("a"))
    return rows.select("id", "seq", y.cast("int").alias("y")).where(F.col("seq").rlike(f"^[{ALPHABET}]+$"))


def variants(spark: SparkSession, path: str) -> DataFrame:
    """Fixed text lines with an accession, a variant id, a change like ``p.Lys2Glu`` and a label word."""
    line = spark.read.text(path)
    pick = lambda p, i=1: F.regexp_extract("value", p, i)
    change = pick(r"(p\.[A-Z][a-z]{2}\d+[A-Z][a-z]{2})")
    rows = line.select(
        pick(r"(VAR_\d+)").alias("var_id"), pick(r"\b([A-NR-Z][0-9][A-Z0-9]{3}[0-9]|[OPQ][0-9][A-Z0-9]{3}[0-9])\b").alias("gene"),
        change.alias("change"), pick(r"\b(Disease|Polymorphism|Unclassified|LP/P|LB/B|US)\b").alias("label"),
    )
    return rows.where((F.col("var_id") != "") & (F.col("change") != "")).withColumn("pos", F.regexp_extract("change", r"(\d+)", 1).cast("int"))


def annotated(spark: SparkSession, path: str) -> DataFrame:
    """Records whose header line begins with a blank, then sequence lines, then annotation lines of as many characters.

    The second half of a record's characters annotates the first; ``t`` counts as ``T``; the last record is kept.
    """
    records = spark.read.text(path, lineSep="\n ").withColumn("value", F.ltrim("value"))
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.col("value").substr(F.length(head) + 1, F.length("value")), r"\s", "")
    half = F.floor(F.length(body) / 2).cast("int")
    rows = records.select(
        F.regexp_extract(head, r"(\S+)\s*$", 1).alias("id"), body.substr(F.lit(1), half).alias("seq"),
        F.translate(body.substr(half + 1, F.length(body)), "t", "T").alias("labels"), (F.length(body) % 2 == 0).alias("even"),
    )
    return rows.where("even and seq <> ''").drop("even")


def residue_arrays(spark: SparkSession, path: str, length: int = 700, width: int = 57) -> DataFrame:
    """Gzipped ``.npy`` arrays of one-hot residues and classes: ``id`` (file and row), ``seq`` and ``y``.

    Columns 0-21 are the residue (21 for none), 22-30 the class; the first row of padding ends a sequence.
    """
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                data = np.load(io.BytesIO(gzip.decompress(raw))).reshape(-1, length, width)
                rows = []
                for i, x in enumerate(data):
                    code = x[:, :22].argmax(1)
                    n = int(np.argmax(code == 21)) if (code == 21).any() else length
                    rows.append((f"{name.rsplit('/', 1)[-1]}-{i}", "".join(ARRAY_ORDER[c] for c in code[:n]), x[:n, 22:31].argmax(1).tolist()))
                yield pd.DataFrame(rows, columns=["id", "seq", "y"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(made, "id string, seq string, y array<int>")


def kernel_rows(spark: SparkSession, path: str, prefix: str = "LA_") -> DataFrame:
    """Row files ``LA_<i>.txt`` of an upper triangle, one number a line: ``i``, ``j``, ``k``. Each file is read by one task, as
    the place of a line in its file is its column."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f"))
    i = F.regexp_extract("f", rf"{prefix}(\d+)", 1).cast("int")
    lines = files.select(i.alias("i"), F.posexplode(F.split(F.rtrim("value"), r"\s+")).alias("p", "v"))
    return lines.select("i", (F.col("i") + F.col("p")).alias("j"), F.col("v").try_cast("double").alias("k"))


def incomplete_rows(kernel: DataFrame, n: int) -> DataFrame:
    """Rows of a triangle that lack entries (row i has n - i), to be computed again."""
    counts = kernel.where("k is not null").groupBy("i").agg(F.count("*").alias("found"))
    every = kernel.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    return every.join(counts, "i", "left").where(F.coalesce("found", F.lit(0)) != n - F.col("i")).select("i")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=False, mode="overwrite")


def write_fasta(df: DataFrame, path: str, key: str = "id", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(seq))).write.mode("overwrite").text(path)


def write_folds(split: DataFrame, path: str) -> None:
    """Partitioned by setting (where there is one), ratio and fold, so loading a fold reads its files alone."""
    split.write.partitionBy(*[c for c in ("setting", "ratio", "fold") if c in split.columns]).parquet(path, mode="overwrite")


def read_folds(spark: SparkSession, path: str, ratio: int, test: int, val: int) -> dict[str, DataFrame]:
    own = spark.read.parquet(path).where(F.col("ratio") == ratio)
    return {
        "test": own.where(F.col("fold") == test),
        "val": own.where(F.col("fold") == val),
        "train": own.where(~F.col("fold").isin(test, val)),
    }


RESULT_KEYS = ["dataset", "setting", "ratio_tr", "ratio_te", "ite", "ival"]


def write_results(results: DataFrame, path: str) -> None:
    """Append runs' scores, predictions or epoch logs: partitioned by the run's keys, so a scan reads the runs it needs alone.

    A run that is written twice is there twice; ``replace_results`` is for runs that may be made again.
    """
    results.write.partitionBy(*[c for c in RESULT_KEYS if c in results.columns]).parquet(path, mode="append")


def replace_results(results: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """The same, but a run that is written again replaces its own rows and no others."""
    own = [c for c in keys or RESULT_KEYS if c in results.columns]
    if not own:
        raise ValueError(f"results have none of the keys {keys or RESULT_KEYS}")
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*own).parquet(path)


def scan_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Score files (``name value`` a line) of runs in directories named like ``DB_ite,ival_set_rtr_rte``, a prefix part more
    or less: the run's keys come from the path, unreadable names and lines are left out."""
    name = r"([^/]+)_(\d+),(\d+)_(\d+)_(\d+)_(\d+)/[^/]+$"
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"))
    part = lambda i: F.regexp_extract("path", name, i)
    keys = [part(i).cast("int").alias(k) for k, i in (("ite", 2), ("ival", 3), ("setting", 4), ("ratio_tr", 5), ("ratio_te", 6))]
    told = lines.where(F.col("path").rlike(name) & F.col("value").rlike(r"^\S+ -?[0-9.eE+-]+$"))
    return told.select(part(1).alias("dataset"), *keys, F.substring_index("value", " ", 1).alias("score_name"), F.substring_index("value", " ", -1).try_cast("double").alias("score"))


def within(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose ``column`` (a weight, a length) lies within the bounds that are given; without any, all rows."""
    df = df if low is None else df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def write_weights(layers: DataFrame, path: str, names: str = ".*") -> None:
    """A model's layers (``layer``, ``shape`` array<int>, ``values`` array<float>; any other columns) whose name has the pattern ``names``."""
    layers.where(F.col("layer").rlike(names)).write.parquet(path, mode="overwrite")


def load_weights(layers: DataFrame, stored: DataFrame, names: str = ".*") -> DataFrame:
    """``layers`` with the stored values of those layers that have the pattern ``names``, a stored layer of that name and the
    same shape; the others keep their own. ``loaded`` tells which: what a transfer freezes at first."""
    found = stored.where(F.col("layer").rlike(names)).select("layer", "shape", F.col("values").alias("_stored"))
    met = layers.join(found, ["layer", "shape"], "left")
    return met.select("layer", "shape", F.coalesce("_stored", "values").alias("values"), F.col("_stored").isNotNull().alias("loaded"))


def write_matrix(cells: DataFrame, path: str, ranged: bool = False) -> None:
    """Cells (``i``, ``j``, ``k``) of a matrix as an edge list in ranges of rows; cells of 0 are left out, as absent ones mean 0.

    ``ranged`` says that the cells' partitions are ranges of rows already, as those of ``overlap_pairs``, whose tiles come in order: then
    none is shuffled or sorted, so no cell touches a disk before its file.
    """
    found = cells.where("k <> 0")
    (found if ranged else found.repartitionByRange("i").sortWithinPartitions("i", "j")).write.parquet(path, mode="overwrite")


def save_dataset(molecule: DataFrame, protein: DataFrame, interaction: DataFrame, path: str) -> None:
    """A data set's artefacts as tables of one folder: ``molecule`` (mol_id, structure), ``protein`` (prot_id, seq), the numbers of both
    (``mol_index``: mol_id, j; ``prot_index``: prot_id, i; from 0 in the order of the ids) and the ``relation`` by numbers."""
    spark = molecule.sparkSession
    for df, key, name in ((molecule, "mol_id", "molecule"), (protein, "prot_id", "protein")):
        df.write.parquet(f"{path}/{name}", mode="overwrite")
        own = df.select(key).distinct()
        index = {"molecule": "j", "protein": "i"}[name]
        ranked = global_rank(own, [key], range_of(own, key), index) if dict(own.dtypes)[key] != "string" else global_rank(own, [key], F.substring(key, 1, 4), index)
        ranked.write.parquet(f"{path}/{'mol' if name == 'molecule' else 'prot'}_index", mode="overwrite")
    numbers = [spark.read.parquet(f"{path}/{n}_index") for n in ("prot", "mol")]
    interaction.join(numbers[0], "prot_id").join(numbers[1], "mol_id").select("i", "j").write.parquet(f"{path}/relation", mode="overwrite")


def load_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The artefacts of ``save_dataset`` by name; an index is read in either direction."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("molecule", "protein", "relation", "prot_index", "mol_index")}
