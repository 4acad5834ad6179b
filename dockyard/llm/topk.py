"""Exact top-k inner products over norm-sorted vectors.

Components are turned into whole numbers, floor(256 * x), so scores are exact. The matrix of second moments of
all vectors (a sum over map tasks, as large as the square of the dimension) gives the rotation of its singular
vectors; it packs most of every inner product into the first few coordinates. Vectors are processed by
descending length, in blocks of ``block`` rows: the longest block alone sets each query's first threshold, its
k-th best score so far. A block is left out for a query where the lengths' product can't reach the threshold;
within a block the partial sum over the first coordinates plus the product of the lengths of the rest (Cauchy and
Schwarz) bounds each score, and only what may reach the threshold is computed, in whole numbers. Bounds are
widened by more than the rounding error, and equality is kept, so ties are settled by id and nothing is lost.

Queries travel in blocks too, to those blocks of vectors they can't rule out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockyard.llm.shared import cut, table

BLOCK, QUERIES, HEAD = 2048, 256, 16
PAIR = "query_id long, vec_id long, score long"


def whole(vectors, width: int) -> np.ndarray:
    """floor(256 * x) in rows padded with zeros; Python numbers where 64 bits might not hold the scores."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = np.asarray(v, dtype=np.float64)
    x = np.floor(256 * x)
    if x.size and np.abs(x).max() >= 2.0**28:
        return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b: in doubles where they hold them, kept within 64 bits."""
    width = a.shape[1]
    if a.dtype != object and b.dtype != object:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
        if most < 2.0**53:
            return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
        if most < 2.0**63:
            return a @ b.T
    s = a.astype(object) @ b.T.astype(object) if width else np.zeros((len(a), len(b)), dtype=object)
    top = (1 << 63) - 1
    return np.array([[max(-top - 1, min(top, int(v))) for v in row] for row in s], dtype=np.int64).reshape(s.shape)


def _pack(ids: np.ndarray, x: np.ndarray, low: np.ndarray) -> bytes:
    """Ids, vectors (``x``) and thresholds as bytes: one row of a table for a block."""
    wide = x.dtype == object
    body = repr(x.tolist()).encode() if wide else x.astype("<i8").tobytes()
    return struct.pack("<qqq", len(ids), x.shape[1], wide) + ids.astype("<i8").tobytes() + low.astype("<i8").tobytes() + body


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width, wide = struct.unpack_from("<qqq", raw)
    ids = np.frombuffer(raw, "<i8", n, 24)
    low = np.frombuffer(raw, "<i8", n, 24 + 8 * n)
    body = raw[24 + 16 * n :]
    if wide:
        import ast

        return ids, np.array(ast.literal_eval(body.decode()), dtype=object).reshape(n, width), low
    return ids, np.frombuffer(body, "<i8").reshape(n, width), low


NONE = np.iinfo(np.int64).min


def search(q_ids, q, low, c_ids, c, turn: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """For each query its k best of the candidates that score at least ``low``: rows of query, id and score."""
    qf, cf = q.astype(np.float64) @ turn, c.astype(np.float64) @ turn
    h = min(HEAD, turn.shape[1])
    q_rest, c_rest = np.linalg.norm(qf[:, h:], axis=1), np.linalg.norm(cf[:, h:], axis=1)
    q_all, c_all = np.linalg.norm(qf, axis=1), np.linalg.norm(cf, axis=1)
    slack = 1.0 + 1e-9 * q_all[:, None] * c_all.max(initial=0.0)
    floor = np.where(low == NONE, -np.inf, low.astype(np.float64))
    out = []
    live = np.flatnonzero(q_all * c_all.max(initial=0.0) + slack[:, 0] >= floor)
    if not len(live):
        return out
    bound = qf[live, :h] @ cf[:, :h].T + q_rest[live, None] * c_rest[None, :] + slack[live]
    may = bound >= floor[live, None]
    for r in np.flatnonzero(may.any(1)):
        i = live[r]
        at = np.flatnonzero(may[r] & (c_ids != q_ids[i]))
        # Best bounds first: once k exact scores are known, what is bounded below the k-th needn't be computed.
        at = at[np.argsort(-bound[r, at], kind="stable")]
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for s in range(0, len(at), 256):
            part = at[s : s + 256]
            if len(scores) >= k and bound[r, part[0]] < scores[k - 1]:
                break
            ids = np.r_[ids, c_ids[part]]
            scores = np.r_[scores, exact(q[i : i + 1], c[part])[0]]
            best = np.lexsort((ids, -scores))[:k] if scores.min(initial=0) > NONE else sorted(
                range(len(ids)), key=lambda j: (-int(scores[j]), ids[j])
            )[:k]
            ids, scores = ids[best], scores[best]
        out += [(int(q_ids[i]), int(a), int(b)) for a, b in zip(ids, scores) if b >= low[i]]
    return out


def top_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """For each row of ``queries`` the k rows of ``vectors`` with another id and the highest inner products.

    Columns ``query_id``, ``rank`` (int, from 1), ``vec_id`` and ``score`` (long); equal scores go by the smaller id;
    all candidates, if there are fewer than k. Vectors that are null or hold null, NaN or infinite components,
    and rows without an id, take no part. Vectors of different lengths are padded with zeros. Repeated rows are
    one vector; of rows that share an id but differ, the best score counts. Scores beyond 64 bits are the nearest
    long. Empty inputs give an empty result; other columns are not read.
    """

    def rows(df: DataFrame) -> DataFrame:
        fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        own = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)))
        return own.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates()

    own = rows(vectors)
    width = own.agg(F.max(F.size("v"))).first()[0]
    spark = vectors.sparkSession
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256).cast("double"), F.lit(2.0)))
    sized = cut(own.withColumn("norm", F.sqrt(norm)).repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id"))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((width, width))
        for b in batches:
            if len(b):
                x = whole(list(b["v"]), width).astype(np.float64)
                m += x.T @ x
        i, j = np.indices(m.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "m": m.ravel()})

    gram = np.zeros((width, width))
    for r in sized.mapInPandas(moments, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect():
        gram[r.i, r.j] = r.m
    turn = np.eye(width)
    if width and np.isfinite(gram).all():
        turn = np.ascontiguousarray(np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by descending length: each block is a range of lengths."""
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= block:
                yield made(pd.concat(held))
                held = []
        if held and sum(map(len, held)):
            yield made(pd.concat(held))

    def made(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in range(0, len(b), block):
            part = b.iloc[s : s + block]
            x = whole(list(part["v"]), width)
            ids = part["id"].to_numpy()
            out.append((int(ids[0]), int(ids[-1]), float(part["norm"].max()), _pack(ids, x, np.full(len(ids), NONE))))
        return pd.DataFrame(out, columns=["first", "last", "most", "raw"])

    kept = cut(sized.mapInPandas(blocks, "first long, last long, most double, raw binary"))

    # The longest block alone, at most ``block`` rows, gives each query a threshold to begin with.
    longest = sized.orderBy(F.desc("norm"), "id").limit(block).collect()
    head_ids = np.array([r.id for r in longest], dtype=np.int64)
    head = whole([r.v for r in longest], width)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), QUERIES):
                part = b.iloc[s : s + QUERIES]
                x = whole(list(part["v"]), width)
                ids = part["id"].to_numpy()
                found: dict[int, dict[int, int]] = {}
                for q, c, v in search(ids, x, np.full(len(ids), NONE), head_ids, head, turn, k):
                    found.setdefault(q, {})[c] = max(v, found.get(q, {}).get(c, NONE))
                low = np.array([sorted(found.get(int(i), {}).values())[-k] if len(found.get(int(i), {})) >= k else NONE for i in ids])
                size = np.linalg.norm(x.astype(np.float64), axis=1)
                # A block of vectors no longer than this can't reach any threshold of these queries.
                need = np.where(low == NONE, -1.0, np.where(low <= 0, -1.0, (low - 1.0) / np.maximum(size, 1e-300)))
                out = pd.DataFrame({"least": [float(need.min()) * (1 - 1e-9)], "queries": [_pack(ids, x, low)]})
                yield out

    own_queries = rows(queries)
    q_blocks = cut(own_queries.mapInPandas(asked, "least double, queries binary"))
    # Which block of vectors meets which block of queries: blocks of vectors are dealt to buckets, a block of queries
    # visits each bucket, and the lengths alone rule out most pairs.
    buckets = max(1, min(1024, kept.count()))
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("first", "last", "most"), F.lit(buckets)).cast("int"))
    visits = q_blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    met = visits.join(dealt, "bucket").where(F.col("most") >= F.col("least"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw_q, raw_c in zip(b["queries"], b["raw"]):
                q_ids, q, low = _unpack(raw_q)
                c_ids, c, _ = _unpack(raw_c)
                found = search(q_ids, q, low, c_ids, c, turn, k)
                if found:
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    scored = met.select("queries", "raw").mapInPandas(compared, PAIR)
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
