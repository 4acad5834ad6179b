"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A sketch has ``t`` coordinates. In each of the first t rounds every shingle is hashed to one bin with a value of
that round, and a bin keeps its least value; in t further rounds round i offers all shingles to bin i, so every
coordinate is filled whatever the size of the set, mostly after few rounds. Coordinates of two sets agree with
the Jaccard similarity, with the concentration of independent samples. Bands of ``r`` coordinates are hashed to
buckets; with 32 bands of 5, two sets at a similarity of 0.8 share no bucket once in about 300,000 times.

Equal sets are one class from the start. In each bucket every class is paired with the bucket's leader, the class that
meets the most others over all bands and so lies near the middle of a group of near copies; these pairs, linear in
the bucket's size, are verified on the full sets and connected. What is between classes of one component can't change
the result any more. Buckets that then still hold several components are dealt into blocks of a bounded number of
shingles, and pairs of blocks meet in tasks: first with the sketches alone, which leaves the classes that may have a
partner in another component, then these with their full sets. A task hands on at most one link for each class, as
many as connect what it has found, so neither step makes a row for each pair; no candidate is dropped.

Before full sets are compared, a pair must agree in as many coordinates of the sketches (of which a byte each is
kept) as a similarity of 0.8 gives but about 3 in a million times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockyard.llm.shared import components, cut, table

BANDS, ROWS = 32, 5
#: Shingles in a block of a bucket; more are dealt into more blocks. Standard deviations allowed to an agreement of sketches.
BLOCK, SPREAD = 250_000, 4.5


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence, if it has fewer words than ``width``.

    Words are what stands between ASCII white space, with A-Z lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k])
    return np.unique(out)


def sketch(hashes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a set that isn't empty: round in the upper 32 bits, value in the lower."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, full, dtype=np.uint64)
    salts = seeds(2 * t, 17)
    step = max(1, 4096 // len(hashes))
    low = np.uint64(0xFFFFFFFF)
    for at in range(0, t, step):
        rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
        x = _mix(hashes[None, :] ^ salts[at : at + len(rounds), None])
        bins = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, bins.ravel().astype(np.intp), ((rounds[:, None] << np.uint64(32)) | (x & low)).ravel())
        if out.max() != full:
            return out
    for b in np.flatnonzero(out == full):
        i = t + int(b)
        out[b] = (np.uint64(i) << np.uint64(32)) | (_mix(hashes ^ salts[i]) & low).min()
    return out


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """From ``id`` and ``text``: ``id``, ``n`` (set size), ``f`` and ``g`` (128 bits that tell sets apart), ``w``, a byte of
    each coordinate, and ``bands``, a hash of the bytes of each band."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s1, s2 = seeds(2, 5)
        tell = seeds(bands, 23)
        for batch in batches:
            out = []
            for k, t in zip(batch["id"], batch["text"]):
                h = shingles(t, width)
                if not len(h):
                    out.append((k, 0, 0, 0, None, None))
                    continue
                w = _mix(sketch(h, bands * rows)).astype(np.uint8)
                parts = w.reshape(bands, rows).astype(np.uint64)
                b = tell
                for j in range(rows):
                    b = _mix(b * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
                f, g = _mix(h ^ s1).sum(dtype=np.uint64), _mix(h ^ s2).sum(dtype=np.uint64)
                out.append((k, len(h), int(f.astype(np.int64)), int(g.astype(np.int64)), b.astype(np.int64), w.tobytes()))
            yield pd.DataFrame(out, columns=["id", "n", "f", "g", "bands", "w"]).astype({"id": "Int64"})

    return docs.mapInPandas(made, "id long, n long, f long, g long, bands array<long>, w binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """From ``id`` and ``text``: ``id``, ``s``, the full sorted set of shingle hashes, and its ``f`` as in ``signatures``."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = seeds(2, 5)[0]
        for batch in batches:
            for at in range(0, len(batch), 1000):
                b = batch.iloc[at : at + 1000]
                sets = [shingles(t, width) for t in b["text"]]
                f = [int(_mix(s ^ salt).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                yield pd.DataFrame({"id": b["id"], "s": [np.sort(s.astype(np.int64)) for s in sets], "f": f})

    return docs.mapInPandas(made, "id long, s array<long>, f long")


def _alike(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


@F.pandas_udf(T.IntegerType())
def _agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
    """In how many bytes two sketches agree."""
    if not len(x):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(len(v), -1) for v in (x, y))
    return pd.Series((a == b).sum(1, dtype=np.int32))


def _least(t: int, percent: int) -> int:
    """Coordinates in which sketches of sets at the threshold agree but in few cases."""
    p = percent / 100
    return int(t * p - SPREAD * np.sqrt(t * p * (1 - p)))


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, t: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets have 100 * intersection >= percent * union."""
    x, y = (sketches.select(F.col("id").alias(k), F.col("w").alias("w" + k)) for k in "ab")
    likely = cut(pairs.join(x, "a").join(y, "b").where(_agreeing("wa", "wb") >= _least(t, percent)).select("a", "b"))
    left = likely.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _led(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member of a bucket with the bucket's leader: the member whose buckets hold the most in all."""
    met = members.groupBy("m").agg(F.sum("size").alias("met"))
    heads = members.join(met, "m").groupBy("bucket").agg(F.min(F.struct(-F.col("met"), "m", "n")).alias("l"))
    apart = members.join(heads, "bucket").where((F.col("m") != F.col("l.m")) & _alike(F.col("n"), F.col("l.n"), percent))
    return apart.select(F.least("m", F.col("l.m")).alias("a"), F.greatest("m", F.col("l.m")).alias("b")).distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """Members in the groups ``part``, ``i``, ``j`` that are compared: pairs of blocks of a large bucket, or many small buckets.
    ``own`` is a member's block."""
    parts = max(1, (members.agg(F.sum("n")).first()[0] or 0) // BLOCK)
    blocks = members.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("m"), "blocks").cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(parts))).otherwise(F.col("bucket")).alias("part")
    return other.select(*members.columns, "own", part, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _partners(d: pd.DataFrame, least: int, bands: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a group (ordered by bucket) with those later rows that they may link with: of the same bucket, another component
    and a fitting size, with alike sketches that share no band before the bucket's (in which they meet as well)."""
    w = np.frombuffer(b"".join(d["w"]), dtype=np.uint8).reshape(len(d), -1)
    n, c, own, band, bucket = (d[k].to_numpy() for k in ("n", "c", "own", "k", "bucket"))
    two = d["i"].iat[0] != d["j"].iat[0]
    starts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(d)]
    for end, x in ((e, x) for s, e in zip(starts[:-1], starts[1:]) for x in range(s, e - 1)):
        fit = (c[x + 1 : end] != c[x]) & (100 * np.minimum(n[x], n[x + 1 : end]) >= percent * np.maximum(n[x], n[x + 1 : end]))
        if two:
            fit &= own[x + 1 : end] != own[x]
        at = x + 1 + np.flatnonzero(fit)
        if not len(at):
            continue
        same = w[at] == w[x]
        enough = same.sum(1) >= least
        if band[x] and enough.any():
            enough &= ~same.reshape(len(at), bands, -1)[:, : band[x]].all(2).any(1)
        if enough.any():
            yield x, at[enough]


def _apart(members: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, bands: int, t: int) -> DataFrame:
    """Links ``a``, ``b`` that connect classes of a bucket in different components as all their verified pairs do."""
    least = _least(t, percent)

    def hopeful(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bucket", ignore_index=True)
        rows = np.zeros(len(d), dtype=bool)
        for x, at in _partners(d, least, bands, percent):
            rows[x] = rows[at] = True
        return d.loc[rows, ["bucket", "k", "m", "f", "n", "c"]]

    def linked(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bucket", ignore_index=True)
        root = {c: c for c in d["c"]}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        c, m, sets, out = d["c"].tolist(), d["m"].tolist(), d["s"].tolist(), []
        n = d["n"].to_numpy()
        for x, at in _partners(d, least, bands, percent):
            mine = sets[x]
            for start in range(0, len(at), 256):
                some = at[start : start + 256]
                every = np.concatenate([sets[y] for y in some])
                found = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
                shared = np.add.reduceat(found.astype(np.int64), np.r_[0, np.cumsum(n[some])[:-1]])
                for y in some[100 * shared >= percent * (n[x] + n[some] - shared)]:
                    if (u := top(c[x])) != (v := top(c[y])):
                        root[u] = v
                        out.append((min(m[x], m[y]), max(m[x], m[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    met = _dealt(members).join(sketches.withColumnRenamed("id", "m"), ["m", "f"]).groupBy("part", "i", "j")
    some = cut(met.applyInPandas(hopeful, "bucket long, k int, m long, f long, n long, c long").distinct())
    whole = sketches.join(sets, ["id", "f"]).withColumnRenamed("id", "m")
    return cut(_dealt(some).join(whole, ["m", "f"]).groupBy("part", "i", "j").applyInPandas(linked, "a long, b long"))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Columns ``key``, ``n_shingles``, ``component_id`` and ``kept``, one row for each row of ``docs``.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets. A null or empty
    text, or one of white space, has no shingles and links with nothing. Rows that share an id are one document:
    what is linked to one is linked to the others. A row without an id links with nothing; its component is null
    and it is kept. Of a component the document with the smallest id is kept; its repeated rows all are. An
    empty table gives an empty result; other columns are not read.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    marked = cut(signatures(own, width, bands, rows))
    usable = marked.where("id is not null and n > 0")
    # One class for each set; its id is the smallest of its documents'.
    classes = usable.groupBy("n", "f", "g").agg(F.min("id").alias("c"))
    first = cut(usable.join(classes.withColumnRenamed("c", "id"), ["n", "f", "g", "id"]).dropDuplicates(["n", "f", "g"]))
    sketches = first.select("id", "f", "w")
    spread = first.select(F.col("id").alias("m"), "f", "n", F.posexplode("bands").alias("k", "h")).select(
        "m", "f", "n", "k", F.xxhash64("k", "h").alias("bucket")
    )
    several = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(spread.join(several, "bucket"))
    # The texts are shuffled once, for the sets of all classes that meet another one.
    meeting = members.select(F.col("m").alias("id")).distinct()
    sets = cut(_sets(own.join(meeting, "id", "left_semi").dropDuplicates(["id", "text"]), width))

    # Rows of one document with different texts tie their classes together.
    own_class = usable.join(classes, ["n", "f", "g"]).select("id", "c")
    tied = own_class.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z")
    linked = own_class.join(tied, "id").where("c <> a").select("a", F.col("c").alias("b"))
    near = cut(_verified(_led(members, percent), sketches, sets, percent, bands * rows).union(linked))
    roots = components(near)
    # Go on with the buckets that hold several components.
    placed = members.drop("size").join(roots.withColumnRenamed("node", "m"), "m", "left")
    placed = placed.select("bucket", "k", "m", "f", "n", F.coalesce("component", "m").alias("c"))
    split = placed.groupBy("bucket").agg(F.min("c").alias("u"), F.max("c").alias("v")).where("u <> v").select("bucket")
    more = _apart(cut(placed.join(split, "bucket")), sketches, sets, percent, bands, bands * rows)
    roots = components(roots.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    rooted = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select(
        "n", "f", "g", F.coalesce("component", "c").alias("component_id")
    )
    named = marked.join(rooted, ["n", "f", "g"], "left").withColumn(
        "component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    )
    return named.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i
           FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (n + m - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
