"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives each document posterior
probabilities of the domains. A document then counts towards every domain with its tokens times its posterior.
Distributed projected-gradient least squares finds nonnegative rates r that bring the expected token totals of the
domains to the targets and else stay near 1:

    minimise  1/2 sum_k (S_k - b_k)^2 / c_k + hold/2 sum_d t_d (r_d - 1)^2   over r >= 0 (or ``least``),
    S_k = sum_d p_dk t_d r_d,

where t_d are a document's tokens, b_k the target totals and c_k the totals at r = 1. In the metric of the tokens
the gradient of a document is sum_k p_dk (S_k - b_k) / c_k + hold (r_d - 1), and its largest eigenvalue is at most
1 + hold, so steps of 1 / (1 + hold) descend; each iteration is one sum over the documents, of as many numbers as
there are domains.

These steps are short, and with a fixed hold the totals stay between the present ones and the targets. So the query measures
the totals' deviation in the metric of the domains' Gram matrix G = sum_d t_d p_d p_d' instead of c, without a hold: the
gradient is sum_k p_dk y_k with G y = S - b, and where no rate is at its bound one step brings every total to its target by
rates as near to 1 as can be. Where rates are at their bound, G is taken over the free documents, and a step is halved until the
deviation falls; steps go on until every total is within ``near`` of its target. Rates are kept as the steps that made
them, and written as a column every few steps. Only sums over the documents and the classifier's table of ``buckets``
rows, all of fixed size, reach the driver or are broadcast.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm.shared import cut, table

BUCKETS = 1 << 12
log = logging.getLogger(__name__)


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass
class Classifier:
    """Naive Bayes over hashed words: ``table`` has one row, ``weights``, with the domains' log weights of each bucket."""

    table: DataFrame
    prior: list[float]
    buckets: int


def classifier(
    docs: DataFrame,
    labelled: DataFrame,
    domains: list[str],
    text: str = "text",
    key: str = "doc_id",
    max_rows: int = 20_000,
    buckets: int = BUCKETS,
) -> Classifier:
    """Fit on about ``max_rows`` rows of ``labelled`` (columns ``key`` and ``domain``), drawn by a hash of the id.

    A document labelled more than once goes by the domain that sorts first; rows without an id or of other domains are
    left out. Counts are smoothed towards the frequencies of all domains together, so a bucket of few words weighs little.
    """
    known = (
        labelled.select(F.col(key).alias("id"), "domain")
        .where(F.col("id").isNotNull() & F.col("domain").isin(domains))
        .groupBy("id")
        .agg(F.min("domain").alias("domain"))
    )
    size = max(1, known.count())
    drawn = cut(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < max_rows / size * (1 << 30)))
    count = {r.domain: r.n for r in drawn.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    prior = [(count.get(d, 0) + 1) / (total + len(domains)) for d in domains]

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    learnt = rows.join(F.broadcast(drawn), "id").select("domain", F.explode(_words(F.col("t"))).alias("w"))
    sums = learnt.groupBy(_bucket(F.col("w"), buckets).alias("b")).agg(
        *[F.count_if(F.col("domain") == d).cast("double").alias(f"n{k}") for k, d in enumerate(domains)]
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    filled = cut(every.join(sums, "b", "left").na.fill(0.0))
    names = range(len(domains))
    full = filled.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in names]).first()
    pool = sum((F.col(f"n{k}") for k in names), F.lit(0.0))
    base = (pool + 1.0) / (sum(full) + buckets)
    weights = F.array(*[F.log((F.col(f"n{k}") + 50.0 * base) / (full[k] + 50.0) / base) for k in names])
    one = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", weights.alias("w")))), lambda x: x["w"]).alias("weights"))
    return Classifier(cut(one), prior, buckets)


def memberships(docs: DataFrame, model: Classifier, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row of ``docs``: ``row`` (all its columns in a struct), ``id``, ``draw`` (a number from 0 to 1 by a hash of
    the id or, without one, of the text), ``tokens`` and the posteriors ``p0`` .. ``pK-1``.

    Words are looked up and added up within the row, so no text and no word is shuffled. A null or empty text has no
    tokens and the posteriors of the labelled rows' frequencies.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("id"), F.col(text).alias("t"))
    own = F.coalesce(F.transform(_words(F.col("t")), lambda w: _bucket(w, model.buckets) + 1), F.array().cast("array<int>"))
    looked = rows.join(F.broadcast(model.table)).withColumn("buckets", own)  # the table has one row of a fixed size
    none = F.array(*[F.lit(0.0) for _ in model.prior])
    add = lambda s, b: F.zip_with(s, F.element_at("weights", b), lambda x, y: x + y)
    summed = looked.withColumn("s", F.aggregate("buckets", none, add))
    logs = [F.lit(math.log(q)) + F.col("s")[k] for k, q in enumerate(model.prior)]
    drawn = F.pmod(F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("t")), F.lit(1 << 30)) / float(1 << 30)
    told = summed.select("row", "id", drawn.alias("draw"), F.size("buckets").cast("double").alias("tokens"), F.array(*logs).alias("l"))
    raised = told.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    shares = [F.col("e")[k] / F.aggregate("e", F.lit(0.0), lambda s, x: s + x) for k in range(len(model.prior))]
    return raised.select("row", "id", "draw", "tokens", *[q.alias(f"p{k}") for k, q in enumerate(shares)])


def _pulled(r: Column, pull: Sequence[float], names: Sequence[int], least: float, hold: float = 0.0) -> Column:
    """One step: ``hold`` of the way back to 1, and down by the posteriors times ``pull``, not below ``least``."""
    down = sum((F.col(f"p{k}") * float(x) for k, x in zip(names, pull)), F.lit(0.0))
    return F.greatest(F.lit(float(least)), r * (1 - hold) + (F.lit(float(hold)) - down))


def _stepped(pulls: Sequence[Sequence[float]], names: Sequence[int], least: float) -> Column:
    """The rate after all steps, from 1, as one expression of fixed depth over the posteriors."""
    if not pulls:
        return F.lit(max(1.0, float(least)))
    p = F.array(*[F.col(f"p{k}") for k in names])
    dot = lambda y: F.aggregate(F.zip_with(p, y, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in pull]) for pull in pulls])
    return F.aggregate(steps, F.lit(1.0), lambda s, y: F.greatest(F.lit(float(least)), s - dot(y)))


def _totals(members: DataFrame, r: Column, names: Sequence[int], least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The domains' expected tokens at the rates ``r``; with ``least``, also the Gram matrix of the documents above it."""
    t = F.col("tokens")
    sums = [F.sum(F.col(f"p{k}") * t * F.col("_now")) for k in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))] if least is not None else []
    free = F.when(F.col("_now") > (least or 0.0), t).otherwise(0.0)
    sums += [F.sum(F.col(f"p{names[i]}") * F.col(f"p{names[j]}") * free) for i, j in pairs]
    row = [v or 0.0 for v in members.withColumn("_now", r).agg(*sums).first()]
    gram = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row[len(names) :]):
        gram[i, j] = gram[j, i] = v
    return np.array(row[: len(names)]), gram


def rates(
    members: DataFrame,
    targets: list[float],
    hold: float = 0.05,
    rounds: int = 40,
    close: float = 1e-4,
    budget: float = 1.0,
    least: float = 0.0,
) -> tuple[DataFrame, list[list[float]]]:
    """Add ``rate`` to ``members`` (``tokens`` and ``p0`` ..) in the metric of the totals; also the totals before and after.

    ``targets`` are shares of the expected tokens, and ``budget`` is their total in terms of the present one.
    ``least`` is what no rate falls below: with 1, what is scarce is repeated and nothing goes. Each round is one step of
    fixed length; ``reach`` takes the same steps in the Gram matrix's metric.
    """
    names = list(range(len(targets)))
    before, _ = _totals(members, F.lit(1.0), names)
    total = before.sum()
    if not total:
        return members.withColumn("rate", F.lit(1.0)), [before.tolist()] * 2
    goal = np.array(targets) / sum(targets) * total * budget
    step, r, now = 1 / (1 + hold), F.lit(1.0), before
    for _ in range(rounds):
        r = _pulled(r, step * (now - goal) / np.maximum(before, 1e-9 * total), names, least, step * hold)
        after, _ = _totals(members, r, names)
        moved, now = np.abs(after - now).max() / total, after
        if moved < close:
            break
    return members.withColumn("rate", r), [before.tolist(), now.tolist()]


def reach(
    members: DataFrame,
    targets: list[float],
    budget: float = 1.0,
    least: float = 0.0,
    near: float = 1e-3,
    rounds: int = 100,
    names: Sequence[int] | None = None,
    every: int = 4,
) -> tuple[Column, list[list[float]], float]:
    """Projected-gradient steps in the metric of the Gram matrix until each total is within ``near`` of its target.

    Returns the rate as an expression over the columns of ``members``, the totals before and after, and the largest deviation,
    relative to a total's target (to all tokens where the target is 0). If it stays over ``near``, no step of at least a
    thousandth of its length brings the totals closer, or ``rounds`` passes are over. ``names`` are the numbers of the domains
    that ``targets`` are of; every ``every`` steps the rates are written as a column. Documents without tokens keep a rate of 1.
    """
    names = list(range(len(targets)) if names is None else names)
    now, first = _totals(members, F.lit(1.0), names, -1.0)
    total = now.sum()
    if not total:
        return F.lit(1.0), [now.tolist()] * 2, 0.0
    start, goal, pulls = now, np.array(targets, dtype=float) / sum(targets) * total * budget, []
    outer = np.linalg.pinv(first, hermitian=True)
    cost = lambda s: float((s - goal) @ outer @ (s - goal))
    off = lambda s: float(np.max(np.abs(s - goal) / np.where(goal > 0, goal, total)))
    gram, own, r, passes = first, members.withColumn("_r", F.lit(1.0)), F.col("_r"), 1
    while off(now) > near and passes < rounds:
        y, length = np.linalg.lstsq(gram + 1e-6 * first, now - goal, rcond=None)[0], 1.0
        while True:
            tried = _pulled(r, length * y, names, least)
            there, free = _totals(own, tried, names, least)
            passes += 1
            lower = cost(there) < cost(now) * (1 - 1e-4 * length)
            if lower or length < 1e-3 or passes >= rounds:
                break
            length /= 2
        if not lower:
            break
        pulls.append((length * y).tolist())
        now, gram, r = there, free, tried
        if len(pulls) % every == 0:
            own, r = cut(own.withColumn("_r", r)), F.col("_r")
    rate = F.greatest(F.lit(float(least)), F.when(F.col("tokens") > 0, _stepped(pulls, names, least)).otherwise(1.0))
    return rate, [start.tolist(), now.tolist()], off(now)


def _room(members: DataFrame, targets: list[float], names: Sequence[int], least: float) -> float:
    """The least budget at which no total of the rates ``least`` is over its target; at least 1."""
    row = members.agg(*[F.sum(F.col(f"p{k}") * F.col("tokens")) for k in names]).first()
    total = sum(v or 0.0 for v in row)
    return max(1.0, *[least * (v or 0.0) / total * sum(targets) / t for v, t in zip(row, targets) if t > 0]) if total else 1.0


@dataclass
class Mixture:
    """A fitted mixture: ``rate`` is an expression over ``memberships``; shares of the expected tokens by domain."""

    domains: list[str]
    model: Classifier
    members: DataFrame
    rate: Column
    before: dict[str, float]
    after: dict[str, float]
    off: float


def fit(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float],
    text: str = "text",
    key: str = "doc_id",
    budget: float | None = 1.0,
    least: float = 0.0,
    near: float = 1e-3,
    **options,
) -> Mixture:
    """The classifier, the rates and the shares they reach.

    Domains without labelled rows get the smoothed prior; no document can be told to be of them, so their targets go
    to the others in proportion, with a warning. Another warning tells the deviation where it stays over ``near``.
    Without a ``budget`` it is what the present totals times ``least`` need at the targets, and a little more at a
    time, up to twice that, until the targets are reached.
    """
    domains = sorted(targets)
    model = classifier(docs, labelled, domains, text, key, **options)
    members = cut(memberships(docs, model, text, key).drop("row"))
    known = labelled.join(docs.select(key), key, "left_semi").where(F.col("domain").isin(domains))
    seen = {r.domain for r in known.select("domain").distinct().collect()}
    names = [k for k, d in enumerate(domains) if d in seen]
    if len(names) < len(domains):
        log.warning("domains without labelled rows are left out of the targets: %s", [d for d in domains if d not in seen])
    wanted = [targets[domains[k]] for k in names]
    rate, totals, off = F.lit(max(1.0, float(least))), [[], []], 0.0
    if sum(wanted):
        tries = [budget] if budget is not None else [_room(members, wanted, names, least) * x for x in (1.02, 1.1, 1.25, 1.5, 2.0)]
        for tried in tries:
            rate, totals, off = reach(members, wanted, budget=tried, least=least, near=near, names=names)
            if off <= near:
                break
        else:
            log.warning("the targets are not reached: a total is off by %.4f of its target; totals are %s", off, totals[1])
    before, after = ({domains[k]: v / max(sum(t), 1e-300) for k, v in zip(names, t)} for t in totals)
    return Mixture(domains, model, members, rate, before, after, off)


def _copies(rate: Column) -> Column:
    """The rate rounded up or down by the draw, so that its expectation is the rate."""
    return (F.floor(rate) + F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Columns ``key``, ``tokens`` (long), ``posteriors`` (by domain), ``rate``, ``copies`` and ``reached``, a row for each of ``docs``.

    ``reached`` has the shares of the expected tokens that the rates give the domains, the same for all rows.

    ``copies`` is the rate rounded up or down by a hash of the id (of the text, where the id is null): a document
    with rate 0 goes, one with rate 2.3 comes two or three times. A null or empty text has no tokens and a rate of 1;
    texts of any length are read whole. Repeated rows each count and get the same copies. An empty table gives an
    empty result; other columns are not read, so their names can't clash. ``options`` are those of ``fit``.
    """
    found = fit(docs, labelled, targets, text, key, **options)
    return found.members.select(
        F.col("id").alias(key),
        F.col("tokens").cast("long").alias("tokens"),
        F.create_map(*[x for k, d in enumerate(found.domains) for x in (F.lit(d), F.col(f"p{k}"))]).alias("posteriors"),
        found.rate.alias("rate"),
        _copies(found.rate).alias("copies"),
        F.create_map(*[x for d, v in found.after.items() for x in (F.lit(d), F.lit(float(v)))]).cast("map<string,double>").alias("reached"),
    )


def repeated(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` says, in the same columns whatever their names.

    Rates are found over all rows first; then each row is scored once more and repeated where it is, so no text moves.
    """
    found = fit(docs, labelled, targets, text, key, **options)
    times = F.explode(F.array_repeat(F.lit(1), _copies(found.rate))).alias("time")
    return memberships(docs, found.model, text, key).select("row", times).select("row.*")


#: Shares of the expected tokens by language and quality: more of the smaller languages, less of poor text.
TARGETS = {
    "de-0": 0.005, "de-1": 0.195, "en-0": 0.015, "en-1": 0.485, "es-0": 0.005, "es-1": 0.145, "fr-0": 0.005, "fr-1": 0.145,
}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table: documents with a quality label, by language and quality."""
    marked = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    found = docs.select("doc_id", "lang").join(marked, "doc_id")
    return found.select("doc_id", F.concat_ws("-", "lang", F.col("quality").cast("string")).alias("domain"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)
