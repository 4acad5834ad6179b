"""Ranked lexical search over a length-stratified index.

Documents with an equal normaliser m form a stratum; a large one is split into blocks of about ``BLOCK`` documents. A
block holds, by term and then by term frequency, the numbers of its documents: within a stratum a term's impact depends
on the frequency alone, so it is computed once for all documents of a posting. The highest frequency of each term gives a
block's bound for a query. Blocks are visited by falling bounds, in waves: a wave takes the blocks whose bounds lie between
two limits, and its results raise the query's threshold, the k-th best score so far; blocks bounded below it are never
visited. Equal bounds are visited, so ties are settled by id and nothing is lost.

Queries are taken in lots whose terms fit a bound, and each lot makes its own index of the lot's terms over all documents
in one pass. Counts (documents, lengths, document frequencies) are of all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockyard.llm.shared import cut, table

#: Documents of a block; terms of a lot of queries; blocks of a query's first wave, and how many times more the next ones take.
BLOCK, TERMS, WAVE, GROWTH, WAVES = 4096, 500_000, 4, 16, 3
#: Cells of scores that a task holds at once, about; parts in which rows meet the sizes of their strata.
CELLS, SALT = 1_000_000, 64
#: In UTF-8: runs of ASCII letters, digits and any other character.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SCALE = 1_000_000_000


def terms(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 20 * m)


class Queries:
    """A lot of queries: their numbers, the weights of their terms and, by term, who asks."""

    def __init__(self, ids: list[int], asked: list[np.ndarray], weights: np.ndarray):
        self.ids, self.weights, self.n_terms = ids, weights, len(weights)
        self.who = np.concatenate([np.full(len(a), i) for i, a in enumerate(asked)]) if asked else np.zeros(0, int)
        self.what = np.concatenate(asked) if asked else np.zeros(0, int)
        order = np.argsort(self.what, kind="stable")
        self.by_term, self.askers = np.searchsorted(self.what[order], np.arange(self.n_terms + 1)), self.who[order]
        self.asked = asked


class Block:
    """Postings of documents with one normaliser: by term, then by frequency."""

    def __init__(self, raw: bytes, m: int):
        n_docs, n_post, n_terms = np.frombuffer(raw, "<i8", 3)
        at = 24
        parts = []
        for kind, n in (("<i8", n_docs), ("<i4", n_terms), ("<i8", n_terms + 1), ("<i8", n_post), ("<i4", n_post)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += int(n) * int(kind[2])
        self.docs, self.terms, self.begins, self.tf, self.row = parts
        self.m, self._gains = m, None
        self.most = self.tf[self.begins[1:] - 1] if n_terms else np.zeros(0, np.int64)

    def bounds(self, q: Queries) -> np.ndarray:
        """For each query of the lot the score that no document of the block can exceed."""
        best = np.zeros(q.n_terms, dtype=np.int64)
        best[self.terms] = q.weights[self.terms] * impact(self.most, self.m)
        out = np.zeros(len(q.ids), dtype=np.int64)
        np.add.at(out, q.who, best[q.what])
        return out

    def gains(self, q: Queries) -> np.ndarray:
        """What each posting adds to a score: a frequency's impact is computed once, whatever its terms and documents."""
        if self._gains is None:
            tf, at = np.unique(self.tf, return_inverse=True)
            self._gains = np.repeat(q.weights[self.terms], np.diff(self.begins)) * impact(tf, self.m)[at]
        return self._gains

    def scores(self, items: np.ndarray, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Scores of all documents of the block (columns) for queries of the lot (rows), some queries at a time."""
        own = [q.asked[i] for i in items]
        who, what = np.repeat(np.arange(len(items)), [len(x) for x in own]), np.concatenate(own)
        at = np.minimum(np.searchsorted(self.terms, what), len(self.terms) - 1)
        held = self.terms[at] == what
        who, at = who[held], at[held]
        first, n = self.begins[at], self.begins[at + 1] - self.begins[at]
        size = np.maximum(np.bincount(who, weights=n, minlength=len(items)), len(self.docs))
        part = (np.cumsum(size) // CELLS).astype(np.int64)
        for k in np.unique(part):
            rows = np.flatnonzero(part == k)
            mine = (who >= rows[0]) & (who <= rows[-1])
            f, c = first[mine], n[mine]
            post = np.repeat(f - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
            out = np.zeros(len(rows) * len(self.docs), dtype=np.int64)
            np.add.at(out, np.repeat(who[mine] - rows[0], c) * len(self.docs) + self.row[post], self.gains(q)[post])
            yield items[rows], out.reshape(len(rows), -1)


def pack(docs: np.ndarray, term: np.ndarray, tf: np.ndarray, row: np.ndarray) -> bytes:
    order = np.lexsort((row, tf, term))
    term, tf, row = term[order], tf[order], row[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    head = np.array([len(docs), len(term), len(first)], "<i8")
    body = (docs.astype("<i8"), term[first].astype("<i4"), np.r_[first, len(term)].astype("<i8"), tf.astype("<i8"), row.astype("<i4"))
    return head.tobytes() + b"".join(x.tobytes() for x in body)


def forward(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """One row for each document with a term: id, n, numbers of the vocabulary's terms it holds, and how often."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"]):
                found = Counter(terms(t))
                n = sum(found.values())
                if n:
                    own = sorted((vocabulary[w], found[w]) for w in found.keys() & vocabulary.keys())
                    x = np.array(own, dtype="<i8").reshape(-1, 2)
                    out.append((None if i is None else int(i), n, x[:, 0].astype("<i4").tobytes(), x[:, 1].tobytes()))
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(("id", "n", "terms", "tfs"), zip(*out))} if out else {"id": [], "n": [], "terms": [], "tfs": []})

    rows = docs.select(F.col(key).cast("long").cast("string").alias("id"), F.col(text).alias("text"))  # pandas has no null longs
    return rows.mapInPandas(counted, "id long, n long, terms binary, tfs binary")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """For each item its ``k`` best documents with a score above 0: ``item_id``, ``rank`` (int, from 1), ``doc_id``, ``score``.

    Equal scores go by the smaller id. Documents without an id count in the statistics but are not returned; repeated rows
    are documents of their own. Null and empty texts have no terms: such a document counts nowhere, such an item has no
    results, nor has one without an id. Rows that repeat an item's id are one item with the terms of all of them. Texts of any
    length are read whole. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(int(i), w) for i, t in zip(b["item"], b["text"]) for w in set(terms(t))]
            yield pd.DataFrame(rows, columns=["item", "term"])

    own = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(query).alias("text"))
    asked = cut(own.mapInPandas(listed, "item long, term binary").distinct())
    lots = math.ceil(asked.count() / TERMS)
    out = empty
    for i in range(lots):  # each lot of about TERMS terms is a pass of its own over all documents
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == i)
        found = _lot(docs, part.collect(), k, key, text)
        out = found if i == 0 else out.unionByName(found)
    return out


def _lot(docs: DataFrame, asked: list, k: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({bytes(r.term) for r in asked}))}
    by_item: dict[int, list[int]] = {}
    for r in asked:
        by_item.setdefault(r.item, []).append(vocabulary[bytes(r.term)])
    ids = sorted(by_item)
    rows = cut(forward(docs, vocabulary, key, text))

    # Statistics of all documents: lengths, then document frequencies summed within tasks.
    lengths = rows.groupBy("n").agg(F.count("*").alias("c"))
    total = lengths.agg(F.sum("c").alias("docs"), F.sum(F.col("n") * F.col("c")).alias("words")).first()
    n_docs, n_words = total.docs or 0, total.words or 1
    n_terms = len(vocabulary)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(n_terms, dtype=np.int64)
        for b in batches:
            if len(b):
                df += np.bincount(np.frombuffer(b"".join(b["terms"]), "<i4"), minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"t": seen, "df": df[seen]})

    df = np.zeros(n_terms, dtype=np.int64)
    for r in rows.select("terms").mapInPandas(frequencies, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r.t] = r.df
    weights = np.array([weight(n_docs, int(d)) for d in df], dtype=np.int64)
    lot = Queries(ids, [np.array(sorted(by_item[i])) for i in ids], weights)

    # Strata and their blocks. Rows are numbered, so that copies and repeated ids spread over a stratum's blocks.
    normal = F.expr(f"50 + (50 * n * {n_docs}L) div {n_words}L")
    strata = lengths.groupBy(normal.alias("m")).agg(F.sum("c").alias("c")).select("m", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    # The sizes are joined in SALT parts, and blocks are dealt by stratum and part, so no task sees a whole large stratum.
    posted = rows.where("id is not null and length(terms) > 0").withColumn("m", normal).withColumn("i", F.xxhash64(F.monotonically_increasing_id()))
    salted = strata.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = posted.withColumn("salt", F.pmod("i", F.lit(SALT)).cast("int")).join(salted, ["m", "salt"])
    dealt = met.withColumn("part", F.pmod(F.shiftright("i", 8), F.col("blocks")))

    def built(key_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, "<i4") for x in group["terms"]]
        row = np.repeat(np.arange(len(held)), [len(x) for x in held])
        raw = pack(group["id"].to_numpy(), np.concatenate(held), np.frombuffer(b"".join(group["tfs"]), "<i8"), row)
        return pd.DataFrame({"m": [key_[0]], "raw": [raw]})

    index = cut(dealt.select("m", "part", "id", "terms", "tfs").groupBy("m", "part").applyInPandas(built, "m long, raw binary"))
    sent = spark.sparkContext.broadcast(lot)  # at most TERMS terms

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bounds of each query's best blocks, as many as all waves but the last may take."""
        q, most = sent.value, WAVE * GROWTH ** (WAVES - 2)
        held: list[list[int]] = [[] for _ in q.ids]
        for b in batches:
            for m, raw in zip(b["m"], b["raw"]):
                for i, x in enumerate(Block(raw, m).bounds(q).tolist()):
                    if x > 0:
                        heapq.heappush(held[i], x) if len(held[i]) < most else heapq.heappushpop(held[i], x)
        yield pd.DataFrame([(i, x) for i, own in enumerate(held) for x in own], columns=["q", "bound"])

    order = Window.partitionBy("q").orderBy(F.desc("bound"))
    ranks = [WAVE * GROWTH**w for w in range(WAVES - 1)]
    limits = index.mapInPandas(highest, "q int, bound long").withColumn("r", F.row_number().over(order)).where(F.col("r").isin(ranks)).collect()
    begin = {(r.q, r.r): r.bound for r in limits}

    def visit(low: np.ndarray, high: np.ndarray, least: np.ndarray) -> DataFrame:
        """The best documents, scoring ``least`` or more, of the blocks bounded at least ``low`` and below ``high``."""

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = sent.value
            best: list[list[tuple[int, int]]] = [[] for _ in q.ids]
            need = least.copy()  # rises with what the task has found
            for b in batches:
                for m, raw in zip(b["m"], b["raw"]):
                    block = Block(raw, m)
                    bound = block.bounds(q)
                    items = np.flatnonzero((bound >= np.maximum(low, need)) & (bound < high))
                    if not len(items) or not len(block.terms):
                        continue
                    for own, score in block.scores(items, q):
                        may = score >= need[own][:, None]
                        for r in np.flatnonzero(may.any(1)):
                            i, at = own[r], np.flatnonzero(may[r])
                            best[i] = heapq.nsmallest(k, best[i] + list(zip((-score[r, at]).tolist(), block.docs[at].tolist())))
                            if len(best[i]) >= k:
                                need[i] = max(need[i], -best[i][-1][0])
            out = [(q.ids[i], d, -s) for i, own in enumerate(best) for s, d in own]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "score"])

        return index.mapInPandas(search, "item_id long, doc_id long, score long")

    place = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    number = {x: i for i, x in enumerate(ids)}
    threshold, high, best = np.ones(len(ids), dtype=np.int64), np.full(len(ids), np.iinfo(np.int64).max), None
    for w in range(WAVES):
        asked_from = np.array([begin.get((i, ranks[w]), 1) for i in range(len(ids))]) if w < WAVES - 1 else np.ones(len(ids), dtype=np.int64)
        low = np.minimum(np.maximum(threshold, asked_from), high)  # what lies below the threshold is never visited
        found = visit(low, high, threshold.copy())
        best = found if best is None else best.select("item_id", "doc_id", "score").unionByName(found)
        best = cut(top(best)) if w < WAVES - 1 else top(best)
        if w < WAVES - 1:
            for r in best.where(F.col("rank") == k).select("item_id", "score").collect():
                threshold[number[r.item_id]] = r.score
            high = low
    return best.select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS ws FROM documents),
docs AS (SELECT id, doc_id, ws, len(ws) AS n FROM w WHERE len(ws) > 0),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
tf AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(ws) AS t FROM docs) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, doc_id, id, sum(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT
               * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
      FROM q JOIN df USING (t) JOIN tf USING (t) JOIN docs USING (id), totals WHERE doc_id IS NOT NULL GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
