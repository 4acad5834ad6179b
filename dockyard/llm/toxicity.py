"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, share everything they have no class evidence for. The probability of a word
after another backs off, with absolute discounts, from the pair's counts in the class to the word's continuation count
there (in how many different contexts of the class it stands), from there to the prefix's continuation count in the
class (how many different words of the class begin with it), and from there to continuation counts shared by both
classes, gathered exactly over the whole corpus. A count of its own is kept only where the classes differ
significantly (by a likelihood-ratio statistic over documents); all else is left to the shared backoff, so a rare
expression weighs nothing until it is known to be telling. (With the counts of all words and pairs kept, the many words
that one class has by chance outweigh the few that matter: on ``check_s`` 46 of 427 held-out toxic texts were found.)

A text's toxic and ordinary log-likelihoods are compared per token, ``PAD`` tokens without evidence added, so that a
short text needs more than a long one of the same rate; a logistic curve of this one difference, fitted on labelled
rows that the models have not seen, gives the score.

The models are fitted on at most about ``max_rows`` labelled rows of each class, drawn by a hash of the id, which bounds
what is broadcast whatever the corpus. Texts never move between machines but for the words that shared counts are of:
fitting and scoring are map-side passes, and only counts and distinct words are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockyard.llm.shared import cut, table

WORD = re.compile(r"[^\W_]+")
PREFIX = 4
DISCOUNT = 0.75
#: Entries a task counts before it passes them on, and ratios it remembers.
FLUSH, REMEMBER = 100_000, 300_000
#: Tokens without evidence that each text's difference is spread over besides its own.
PAD, LEAST = 100, 1e-3
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


class Model:
    """Log ratios of toxic to ordinary probability, by order; ``score`` needs ``weights`` too."""

    def __init__(self, words, word_rest, prefixes, prefix_rest, pairs, contexts):
        self.words, self.word_rest, self.prefixes, self.prefix_rest = words, word_rest, prefixes, prefix_rest
        self.pairs, self.contexts = pairs, contexts
        self.weights: np.ndarray | None = None
        self._seen: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def ratio(self, word: str) -> float:
        found = self._seen.get(word)
        if found is None:
            found = self.words.get(word)
            if found is None:
                found = self.word_rest + self.prefixes.get(word[:PREFIX], self.prefix_rest)
            if len(self._seen) >= REMEMBER:
                self._seen.clear()
            self._seen[word] = found
        return found

    def features(self, text: str | None) -> tuple[float]:
        """The difference of the log-likelihoods per token, ``PAD`` tokens added."""
        words = WORD.findall(text.lower()) if text else []
        total = sum(map(self.ratio, words))
        if self.contexts:
            for v, w in zip(["", *words], words):
                if v in self.contexts:
                    total += self.pairs.get((v, w), self.contexts[v])
        return (total / (PAD + len(words)),)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge. The half lies at a difference of ``LEAST`` at least, so a
        text without evidence, such as an empty one, is not toxic."""
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.clip((x - mean) / scale, -20, 20), np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
            w -= step
            if np.abs(step).max() < 1e-10:
                break
        if w[0] > 0:
            w[1] = min(w[1], -w[0] * (LEAST - mean[0]) / scale[0])
        self.weights = np.vstack([np.r_[mean, 0], np.r_[scale, 1], w])

    def score(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w = self.weights
        z = np.c_[np.clip((x - mean[:-1]) / scale[:-1], -20, 20), np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))


class Constant:
    """What stands in for a model where a class has no labelled row: no evidence for the other one."""

    def __init__(self, value: float):
        self.value = value

    def features(self, text):
        return (0.0,)

    def score(self, x):
        return np.full(len(x), self.value)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per word (kind 1), prefix (0) and pair (2; the first word follows an empty one): tokens and documents of either
    class, summed within the task."""
    held: dict[tuple[int, str], list[int]] = {}

    def out() -> pd.DataFrame:
        made = pd.DataFrame([(k, t, *v) for (k, t), v in held.items()], columns=["kind", "term", "c0", "c1", "d0", "d1"])
        held.clear()
        return made

    for batch in batches:
        for text, y in zip(batch["text"], batch["y"]):
            words = WORD.findall(text.lower()) if text else []
            for kind, terms in (
                (1, Counter(words)),
                (0, Counter({w[:PREFIX] for w in words})),
                (2, Counter(f"{v} {w}" for v, w in zip(["", *words], words))),
            ):
                for t, n in terms.items():
                    row = held.get((kind, t))
                    if row is None:
                        row = held[kind, t] = [0, 0, 0, 0]
                    row[y] += n
                    row[2 + y] += 1
            if len(held) >= FLUSH:
                yield out()
    yield out()


def _evidence(n0: int, n1: int) -> Column:
    """Likelihood-ratio statistic of a term's documents d0 of n0 against d1 of n1."""
    k, n = F.col("d0") + F.col("d1"), float(n0 + n1)
    total = F.lit(0.0)
    for d, of in ((F.col("d0"), n0), (F.col("d1"), n1)):
        for seen, expected in ((d, k * of / n), (of - d, (n - k) * of / n)):
            total = total + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    return total


def _shared(docs: DataFrame, text: str, prefixes: DataFrame) -> tuple[dict[str, int], int]:
    """Continuation counts over the whole corpus: different words by the given prefixes (column ``p``), and of all."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            for t in batch["text"]:
                if t:
                    seen.update(WORD.findall(t.lower()))
                    if len(seen) >= FLUSH:
                        yield pd.DataFrame({"w": list(seen)})
                        seen.clear()
        yield pd.DataFrame({"w": list(seen)}, dtype=object)

    found = docs.select(F.col(text).alias("text")).mapInPandas(words, "w string").distinct()
    met = found.withColumn("p", F.substring("w", 1, PREFIX)).join(F.broadcast(prefixes.withColumn("asked", F.lit(True))), "p", "left")
    rows = met.groupBy(F.when(F.col("asked"), F.col("p")).alias("p")).agg(F.count("*").alias("n")).collect()  # one row a prefix asked for, one for the rest
    return {r.p: r.n for r in rows if r.p is not None}, max(1, sum(r.n for r in rows))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    max_rows: int = 20_000,
    evidence: float | None = None,
) -> Model | Constant:
    """Fit on the labelled rows outside fold 0; fold 4 sets the curve, the others the counts.

    A document labelled more than once is toxic if any label says so; null ids and labels are left out. Equal
    texts count once. ``evidence`` is by default 2 ln(m), m being the number of words in at least 5 documents, and 12 at
    least: by chance, about one word of all reaches it. Pairs of words need three times as much, as there are many
    more of them and near copies repeat them. With no labelled row of one class the score is a constant (0 without toxic
    rows, else 1). Texts of any length are read whole; null and empty ones count as documents without words. Documents
    without an id are scored and counted in the shared counts, but have no label. Empty tables give the constant. Other
    columns are not read, so their names can't clash.
    """
    known = (
        labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
        .where("id is not null and y is not null")
        .groupBy("id")
        .agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
        .where(fold(F.col("id")) != 0)
    )
    sizes = {r.y: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return Constant(0.0)
    if not sizes.get(0):
        return Constant(1.0)
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, F.lit(max_rows / sizes[1])).otherwise(F.lit(max_rows / sizes[0]))
    drawn = known.where(part < share)  # about 2 * max_rows short rows at most: broadcast
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    met = rows.join(F.broadcast(drawn), "id")
    # At most about 2 * max_rows documents, each text once: the only ones that are moved.
    first = F.min(F.struct("id", "text")).alias("m")
    own = cut(met.groupBy(F.xxhash64("text").alias("h"), "y").agg(first).select("m.id", "m.text", "y"))
    rest, last = own.where(fold(F.col("id")) != FOLDS - 1), own.where(fold(F.col("id")) == FOLDS - 1)

    n = {r.y: r["n"] for r in own.where(fold(F.col("id")) != FOLDS - 1).groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n1 or not n0:
        return Constant(float(n1 > 0))
    seen_in = F.col("d0") + F.col("d1")
    sums = [F.sum(c).alias(c) for c in ("c0", "c1", "d0", "d1")]
    counts = cut(
        rest.select("text", "y")
        .mapInPandas(_counts, "kind int, term string, c0 long, c1 long, d0 long, d1 long")
        .groupBy("kind", "term")
        .agg(*sums)
    )
    one, two = counts.where("kind = 1"), counts.where("kind = 2")
    types = one.agg(F.count_if(F.col("c0") > 0), F.count_if(F.col("c1") > 0)).first()
    bigrams = two.agg(F.count_if(F.col("c0") > 0), F.count_if(F.col("c1") > 0)).first()
    if not types[0] or not types[1]:
        return Constant(0.0)
    if evidence is None:
        evidence = max(12.0, 2 * math.log(max(1, one.where(seen_in >= 5).count())))

    def kept(df: DataFrame, least: float) -> list:
        return sorted(df.withColumn("g", _evidence(n0, n1)).where(F.col("g") >= least).collect(), key=lambda r: r.term)

    def table_of(terms, name: str) -> DataFrame:
        return F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in sorted(terms)], f"{name} string"))

    words, prefixes, pairs = kept(one, evidence), kept(counts.where("kind = 0"), evidence), kept(two, 3 * evidence)
    # Continuation counts in the class: contexts of the telling words, words of their prefixes.
    second = F.substring_index("term", " ", -1).alias("w")
    stands = {
        r.w: (r.k0, r.k1)
        for r in two.select(second, "c0", "c1")
        .join(table_of({r.term for r in words}, "w"), "w")
        .groupBy("w")
        .agg(F.count_if(F.col("c0") > 0).alias("k0"), F.count_if(F.col("c1") > 0).alias("k1"))
        .collect()
    }
    asked = table_of({r.term for r in prefixes} | {r.term[:PREFIX] for r in words} | {r.term.split(" ")[1][:PREFIX] for r in pairs}, "p")
    by_prefix = {
        r.p: r
        for r in one.withColumn("p", F.substring("term", 1, PREFIX))
        .join(asked, "p")
        .groupBy("p")
        .agg(F.count_if(F.col("c0") > 0).alias("t0"), F.count_if(F.col("c1") > 0).alias("t1"))
        .collect()
    }
    shared, all_types = _shared(docs, text, asked)

    # Prefixes: continuation counts of each class, discounted, then the shared ones.
    less = lambda c: max(c - DISCOUNT, 0.0)
    own_prefix = [{r.term: less(by_prefix[r.term][f"t{y}"]) / types[y] for r in prefixes if r.term in by_prefix} for y in (0, 1)]
    left_prefix = [max(1e-6, 1 - sum(q.values())) for q in own_prefix]
    share_of = lambda p: max(1, shared.get(p, 1)) / all_types
    prefix = lambda p, y: own_prefix[y].get(p, 0.0) + left_prefix[y] * share_of(p)
    # Words: contexts in each class, discounted, then the prefix's share, even among the words that begin with it.
    own_word = [{r.term: less(stands[r.term][y]) / bigrams[y] for r in words} for y in (0, 1)]
    left_word = [max(1e-6, 1 - sum(q.values())) for q in own_word]
    word = lambda w, y: own_word[y][w] + left_word[y] * prefix(w[:PREFIX], y) / max(1, shared.get(w[:PREFIX], 1))
    model = Model(
        {r.term: math.log(word(r.term, 1) / word(r.term, 0)) for r in words},
        math.log(left_word[1] / left_word[0]),
        {p: math.log(prefix(p, 1) / prefix(p, 0)) for p in own_prefix[0]},
        math.log(left_prefix[1] / left_prefix[0]),
        {},
        {},
    )
    # Pairs: counts given the first word, discounted, then the word's own probability.
    firsts = {r.term.split(" ")[0] for r in pairs}
    if firsts:
        totals = {
            r.v: (r.c0, r.c1)
            for r in two.select(F.substring_index("term", " ", 1).alias("v"), "c0", "c1")
            .join(table_of(firsts, "v"), "v")
            .groupBy("v")
            .agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
            .collect()
        }
        apart: dict[str, list] = {}
        for r in pairs:
            v, w = r.term.split(" ")
            apart.setdefault(v, []).append((w, [less(r[f"c{y}"]) / max(1, totals[v][y]) for y in (0, 1)]))
        rest_of = lambda w, y: left_word[y] * prefix(w[:PREFIX], y) / max(1, shared.get(w[:PREFIX], 1))
        for v, rows_of in apart.items():
            left = [max(1e-6, 1 - sum(k[y] for _, k in rows_of)) for y in (0, 1)]
            model.contexts[v] = math.log(left[1] / left[0])
            for w, k in rows_of:
                low = [k[y] + left[y] * (word(w, y) if w in own_word[0] else rest_of(w, y)) for y in (0, 1)]
                model.pairs[v, w] = math.log(low[1] / low[0]) - model.ratio(w)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [model.features(t) for t in b["text"]]
            yield pd.DataFrame(f, columns=["a"]).assign(y=b["y"].to_numpy())

    seen = last.select("text", "y").mapInPandas(features, "a double, y int").collect()
    if len({r.y for r in seen}) < 2:  # too few labelled rows for one fold more: the counts' own rows must do
        seen = rest.select("text", "y").mapInPandas(features, "a double, y int").collect()
    seen.sort()
    model.calibrate(np.array([r[:1] for r in seen]), np.array([r.y for r in seen], dtype=float))
    return model


def scorer(model: Model | Constant):
    """A pandas UDF that scores texts."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([model.features(t) for t in texts])))

    return scored


def score(docs: DataFrame, model: Model | Constant, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns ``key``, ``score`` and ``predicted`` for each row of ``docs``; a null or empty text has no evidence."""
    rows = docs.select(key, scorer(model)(F.col(text)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
