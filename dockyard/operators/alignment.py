"""Local alignment of sequences by blocks of pairs, and its kernel, resumable row by row.

Sequences are numbered by falling length and packed into blocks of ``BLOCK``, so those of a block are about as long. A block of
rows meets the blocks of columns from its own on (the half of a symmetric kernel); a task fills the tables of many pairs at
once along anti-diagonals, a few array operations each. Scores of residues are a parameter; without one, equal residues score
``SAME``, residues of one physico-chemical group ``NEAR`` and others ``FAR``.

Rows of a kernel are written by blocks into a table partitioned by block. A start first looks which blocks are complete in it and
computes only the others, so a killed run goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.operators.lineage import cut
from dockyard.operators.ranking import global_rank, hashed

BLOCK, CELLS = 32, 2_000_000
SAME, NEAR, FAR, OPEN, EXTEND = 4.0, 1.0, -1.0, 11.0, 1.0
#: Residues by physico-chemical group.
RESIDUE_GROUPS = ("AGV", "ILFP", "YMTS", "HNQW", "RK", "DE", "C")
#: Code of what is no letter, and of padding.
OTHER, PAD = 26, 27


def default_scores() -> np.ndarray:
    out = np.full((28, 28), FAR)
    for group in RESIDUE_GROUPS:
        at = [ord(c) - 65 for c in group]
        out[np.ix_(at, at)] = NEAR
    out[np.arange(27), np.arange(27)] = SAME
    return out


def score_table(rows: DataFrame | None) -> np.ndarray:
    """A 28 x 28 table from rows (``a``, ``b``, ``score``) of residues, in either order; what is not given scores ``FAR``."""
    if rows is None:
        return default_scores()
    out = np.full((28, 28), FAR)
    for r in rows.limit(28 * 28).collect():  # letters by letters
        i, j = codes(r.a)[0], codes(r.b)[0]
        out[i, j] = out[j, i] = r.score
    return out


def codes(seq: str | None) -> np.ndarray:
    """Letters as 0 to 25 in either case, all else as 26."""
    raw = np.array([ord(c) for c in seq or ""], dtype=np.int64)
    upper = np.where((raw >= 97) & (raw <= 122), raw - 32, raw)
    return np.where((upper >= 65) & (upper <= 90), upper - 65, OTHER)


def _padded(seqs: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(seqs), max((len(s) for s in seqs), default=0)), PAD, dtype=np.int64)
    for k, s in enumerate(seqs):
        out[k, : len(s)] = s
    return out


def _diagonals(a: np.ndarray, b: np.ndarray, table: np.ndarray, band: int | None):
    """Yields the first row, the last one and the residue scores of each anti-diagonal of all pairs' tables."""
    m, n = a.shape[1], b.shape[1]
    for d in range(2, m + n + 1):
        low, high = max(1, d - n), min(m, d - 1)
        if band is not None:
            low, high = max(low, -((band - d) // 2)), min(high, (d + band) // 2)
        if low <= high:
            i = np.arange(low, high + 1)
            yield d, low, high, table[a[:, i - 1], b[:, d - i - 1]]


def smith_waterman(a: np.ndarray, b: np.ndarray, table: np.ndarray, open_: float = OPEN, extend: float = EXTEND, band: int | None = None) -> np.ndarray:
    """Best local alignment scores of padded pairs; a gap of length g costs ``open_`` + (g - 1) ``extend``."""
    size, m = a.shape
    table = table.copy()
    table[PAD, :] = table[:, PAD] = -1e9
    blank = lambda v: np.full((size, m + 1), v)
    h1, h2, e1, f1 = blank(0.0), blank(0.0), blank(-1e9), blank(-1e9)  # one and two diagonals back, by row
    best = np.zeros(size)
    for _, low, high, s in _diagonals(a, b, table, band):
        at, up = slice(low, high + 1), slice(low - 1, high)
        e = np.maximum(e1[:, at] - extend, h1[:, at] - open_)
        f = np.maximum(f1[:, up] - extend, h1[:, up] - open_)
        h = np.maximum(np.maximum(h2[:, up] + s, 0), np.maximum(e, f))
        best = np.maximum(best, h.max(1))
        h2, h1, e1, f1 = h1, blank(0.0), blank(-1e9), blank(-1e9)
        h1[:, at], e1[:, at], f1[:, at] = h, e, f
    return best


def log_kernel(a: np.ndarray, b: np.ndarray, table: np.ndarray, open_: float = OPEN, extend: float = EXTEND, beta: float = 0.5, band: int | None = None) -> np.ndarray:
    """ln K / beta of padded pairs, K being the sum over all local alignments of exp(beta score), the empty one included."""
    size, m = a.shape
    table = table * beta
    table[PAD, :] = table[:, PAD] = -np.inf
    none = lambda: np.full((size, m + 1), -np.inf)
    more, first = -beta * extend, -beta * open_
    m1, m2, x1, x2, y1, y2 = none(), none(), none(), none(), none(), none()
    total = np.zeros(size)  # the logarithm of 1
    with np.errstate(invalid="ignore", divide="ignore"):
        for _, low, high, s in _diagonals(a, b, table, band):
            at, up = slice(low, high + 1), slice(low - 1, high)
            before = np.logaddexp(np.logaddexp(0.0, m2[:, up]), np.logaddexp(x2[:, up], y2[:, up]))
            own = s + before
            x = np.logaddexp(first + m1[:, up], more + x1[:, up])
            y = np.logaddexp(first + np.logaddexp(m1[:, at], x1[:, at]), more + y1[:, at])
            total = np.logaddexp(total, np.logaddexp.reduce(own, axis=1))
            m2, x2, y2 = m1, x1, y1
            m1, x1, y1 = none(), none(), none()
            m1[:, at], x1[:, at], y1[:, at] = own, x, y
    return total / beta


def scores(left: list[np.ndarray], right: list[np.ndarray], table: np.ndarray, kind: str = "score", **options) -> np.ndarray:
    """Scores of pairs (left[k], right[k]) of coded sequences, as many at once as ``CELLS`` allow; an empty sequence scores 0."""
    f = {"score": smith_waterman, "kernel": log_kernel}[kind]
    out = np.zeros(len(left))
    order = sorted(range(len(left)), key=lambda k: (len(left[k]), len(right[k])))
    at = 0
    while at < len(order):
        room = 1
        while at + room < len(order) and (room + 1) * (len(left[order[at + room]]) + 1) <= CELLS:
            room += 1
        part = order[at : at + room]
        a, b = _padded([left[k] for k in part]), _padded([right[k] for k in part])
        if a.shape[1] and b.shape[1]:
            out[part] = f(a, b, table, **options)
        at += room
    return out


def aligned(pairs: DataFrame, sequences: DataFrame, kind: str = "score", residues: DataFrame | None = None, **options) -> DataFrame:
    """Given pairs (``i``, ``j``; such as those of a similarity join of words) with ``k``, their local alignment.

    ``sequences`` has ``id`` and ``seq``; pairs with an unknown id are left out; a null or empty sequence scores 0.
    """
    table = score_table(residues)
    a, b = sequences.select(F.col("id").alias("i"), F.col("seq").alias("a")), sequences.select(F.col("id").alias("j"), F.col("seq").alias("b"))

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(scores([codes(v) for v in x], [codes(v) for v in y], table, kind, **options), dtype="float64")

    return pairs.select("i", "j").join(a, "i").join(b, "j").select("i", "j", score("a", "b").alias("k"))


# --- all rows of a kernel, resumable ------------------------------------------------------------------------------------


def blocks_of(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """Packed blocks of sequences by falling length: ``b``, ``ids``, ``seqs``. Rows with a null id are left out, repeated ids are one."""
    own = sequences.where("id is not null").groupBy("id").agg(F.max(F.coalesce("seq", F.lit(""))).alias("seq")).withColumn("len", -F.length("seq")).withColumn("h", hashed("id"))
    ranked = global_rank(own, ["len", "h", "id"], F.struct("len", F.substring("h", 1, 3)), "number")
    packed = ranked.withColumn("b", F.floor(F.col("number") / block)).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("number", "id", "seq"))).alias("rows"))
    return packed.select("b", F.col("rows.id").alias("ids"), F.col("rows.seq").alias("seqs"))


def kernel_blocks(blocks: DataFrame, rows: DataFrame, n_blocks: int, kind: str = "score", residues: DataFrame | None = None, **options) -> DataFrame:
    """``b``, ``i``, ``j``, ``k`` of the row blocks ``b`` in ``rows``: each against the columns from its own place on."""
    table = score_table(residues)
    a = blocks.join(rows, "b", "left_semi").select("b", "ids", "seqs", F.explode(F.sequence(F.col("b"), F.lit(n_blocks - 1).cast("long"))).alias("c"))
    met = a.join(blocks.toDF("c", "ids2", "seqs2"), "c")
    kind_of = dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, c, ids, seqs, ids2, seqs2 in zip(*(batch[x] for x in ("b", "c", "ids", "seqs", "ids2", "seqs2"))):
                own = [(p, q) for p in range(len(ids)) for q in range(p if b == c else 0, len(ids2))]
                x, y = [codes(s) for s in seqs], [codes(s) for s in seqs2]
                k = scores([x[p] for p, _ in own], [y[q] for _, q in own], table, kind, **options)
                yield pd.DataFrame({"b": b, "i": [ids[p] for p, _ in own], "j": [ids2[q] for _, q in own], "k": k})

    tasks = max(1, met.sparkSession.sparkContext.defaultParallelism)
    return met.repartition(4 * tasks, "b", "c").mapInPandas(filled, f"b long, i {kind_of}, j {kind_of}, k double")


def finished_blocks(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """Row blocks whose cells are all in the table at ``path``: none where there is no table yet."""
    sizes = blocks.select("b", F.size("ids").alias("n"))
    total, first = sizes.agg(F.sum("n"), F.max("n")).first()  # all blocks but the last have the largest size
    behind = F.lit(total or 0) - F.col("b") * F.lit(first or 0)
    expected = sizes.select("b", (F.col("n") * behind - F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("cells"))
    try:
        have = spark.read.parquet(path).groupBy(F.col("b").cast("long").alias("b")).agg(F.count("*").alias("have"))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return sizes.select("b").limit(0)
    return expected.join(have, "b").where("cells = have").select("b")


def kernel_table(sequences: DataFrame, path: str, kind: str = "score", block: int = BLOCK, at_once: int = 64, most: int | None = None, **options) -> DataFrame:
    """The half kernel of all sequences in a table at ``path`` (partitioned by row block), computed where it isn't complete yet.

    ``at_once`` row blocks are written by one job, and a block that is written again replaces what was there, so a run that was
    killed loses at most one job's work; ``most`` ends a call after that many jobs. The sequences must be the same in each run.
    """
    spark = sequences.sparkSession
    blocks = cut(blocks_of(sequences, block))
    n_blocks = blocks.count()
    jobs = 0
    while most is None or jobs < most:
        todo = blocks.select("b").join(finished_blocks(spark, path, blocks), "b", "left_anti").orderBy("b").limit(at_once)
        rows = cut(todo)
        if rows.isEmpty():
            break
        made = kernel_blocks(blocks, rows, n_blocks, kind, **options)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b").parquet(path)
        jobs += 1
    return spark.read.parquet(path)
