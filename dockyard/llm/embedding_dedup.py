"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label are merged into one class first; its members are linked to it and counted by their number.
Groups (equal labels, equal length) of at most ``window`` + 1 classes are compared pair by pair. In the larger ones
each class gets a key of 64 random hashes in each pass, the signs of random projections of its unit vector less the
group's mean, and the classes of a group are sorted by the key: near vectors share long prefixes. Within the sorted
partitions each vector is compared with the ``window`` vectors before it, by cosine in double precision, and
verified pairs are united within the task, so a task sends on a spanning forest of its links and not all pairs.
The forests of all passes are connected. Pairs that a partition border parts in one pass meet in another one,
where other hashes set other borders.

The components then hold the links the passes found and more; all links between classes of a component are
counted exactly, in cells of two chunks of classes, so a component that holds a third of all vectors is spread
over many small tasks.

With s the mean squared distance of a group's unit vectors from their mean, a pair at the threshold has a cosine of
1 - (1 - least) / s after centring (for a cone of typical cosine 0.9, s is 0.1 and that is 0.8) and agrees in a sign
with probability 1 - acos(that) / pi. With n classes it shares the log2(n / window) signs that bring it into one
window in a share q of the passes, that probability to this power, less a tenth for borders; the number of passes is
what brings a link's chance to be missed, (1 - q) ** passes, to 1 - ``recall``. s counts as 2 * (1 - least) at least:
below that, most pairs of the group are links or nearly so. As s is a mean and a group may be dense in places, the
passes are made in rounds, and a group goes on until a round has joined no components in it, beyond that number too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm.shared import components, cut, table

RECALL, WINDOW, CHUNK = 0.99999, 64, 256
#: Passes that a group makes in a round at most.
ROUND = 16


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def unit(vectors) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that nothing overflows or vanishes."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count and sum of the unit vectors of each group in a batch."""
    for batch in batches:
        made = [(label, size, len(b), unit(b["v"]).sum(0)) for (label, size), b in batch.groupby(["label", batch["v"].map(len)])]
        if made:
            yield pd.DataFrame(made, columns=["label", "size", "n", "total"])


def groups(classes: DataFrame, least: float, recall: float, window: int) -> DataFrame:
    """``label``, ``size``, ``n``, ``mean``, ``spread`` and ``passes``: a row for each group of ``classes``."""
    parts = classes.mapInPandas(_sums, "label string, size int, n long, total array<double>")
    each = parts.select("label", "size", "n", F.posexplode("total").alias("at", "x"))
    sums = each.groupBy("label", "size", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    told = sums.groupBy("label", "size").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x"))))["x"].alias("mean")
    )
    spread = 1 - F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)
    far = max(1 - least, 1e-9)
    agree = 1 - F.acos(1 - far / F.greatest("spread", F.lit(2 * far))) / np.pi
    share = 0.9 * F.pow(agree, F.log2(F.col("n") / window))
    enough = F.ceil(F.lit(float(np.log(1 - recall))) / F.log1p(-share)).cast("int")
    return told.withColumn("spread", spread).withColumn("passes", F.when(F.col("n") > window + 1, enough).otherwise(1))


def _keyed(turn: int):
    """Keys of a group's passes in round ``turn``."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        power = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
        for batch in batches:
            for (_, size), b in batch.groupby(["label", "size"]):
                x, step = unit(b["v"]) - np.asarray(b["mean"].iloc[0]), int(b["step"].iloc[0])
                for p in range(turn * step, (turn + 1) * step):
                    if (p, size) not in planes:
                        planes[p, size] = np.random.default_rng([7, size, p]).standard_normal((size, 64))
                    key = ((x @ planes[p, size] > 0) * power).sum(1, dtype=np.uint64) ^ np.uint64(1 << 63)
                    yield b.assign(p=np.int32(p), key=key.astype(np.int64))[["p", "label", "size", "key", "id", "v"]]

    return made


def _windows(window: int, least: float):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            whole = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            edges = []
            for (_, label, size), b in whole.groupby(["p", "label", "size"], sort=False):
                x, ids = unit(b["v"]), b["id"].to_numpy()
                root = np.arange(len(b))

                def find(i: int) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for k in range(1, min(window, len(b) - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", x[:-k], x[k:]) >= least)
                    for i in near[root[near] != root[near + k]].tolist():
                        u, v = find(i), find(i + k)
                        if u != v:
                            root[v] = u
                            edges.append((ids[i], ids[i + k], label, size))
                    while (root[root] != root).any():
                        root = root[root]
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b", "label", "size"])
            tail = whole.iloc[-window:].reset_index(drop=True)

    return made


def _links(least: float):
    """Count links in cells: rows come sorted by cell; ``side`` is 0 for the first chunk of the cell, 1 for the second.

    A row links with the ``n`` members of each near row.
    """

    def count(cell: pd.DataFrame) -> pd.DataFrame:
        x, ids, side = unit(cell["v"]), cell["id"].to_numpy(), cell["side"].to_numpy()
        near = (x @ x.T >= least) & (ids[:, None] != ids[None, :])
        if side.any():
            near &= side[:, None] != side[None, :]
        return pd.DataFrame({"id": ids, "links": near @ cell["n"].to_numpy()})

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            whole = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(whole):
                continue
            keys = whole[["c", "i", "j", "size"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            starts = [0, *cuts.tolist()]
            out = [count(whole.iloc[a:b]) for a, b in zip(starts, starts[1:])]
            if out:
                yield pd.concat(out)
            held = whole.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield count(held)

    return made


def near_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    recall: float = RECALL,
    window: int = WINDOW,
) -> DataFrame:
    """Columns ``key``, ``n_links``, ``component_id`` and ``kept``, one row for each row of ``vectors``.

    Only vectors with equal labels, not null, and of equal length are compared. Vectors that are null, empty or
    zero or hold null, NaN or infinite components link with nothing, nor does a row without an id, whose component
    is null and which is kept. Equal rows count once in the links of others; of rows that share an id but differ,
    each is compared and their links add up. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    valid = cut(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).dropDuplicates())

    # An id with several vectors counts by itself, as it doesn't link with its other vectors.
    several = cut(valid.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("several")))
    repeated = not several.isEmpty()
    told = valid.join(several, "id", "left") if repeated else valid.withColumn("several", F.lit(None).cast("boolean"))
    told = told.withColumn("own", F.when(F.col("several"), F.col("id")))
    merged = cut(told.groupBy("label", "v", "own").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    many = merged.where("own is null and n > 1").select("label", "v", F.col("id").alias("class"), (F.col("n") - 1).alias("others"))
    copies = cut(told.where("own is null").join(many, ["label", "v"]).select("id", "class", "others"))
    classes, links = merged.select("id", "label", "v"), copies.select(F.col("class").alias("a"), F.col("id").alias("b"))
    if repeated:
        first = cut(merged.groupBy("label", "v").agg(F.min("id").alias("first")))
        links = links.unionByName(merged.join(first, ["label", "v"]).select(F.col("first").alias("a"), F.col("id").alias("b")))
        classes = first.select(F.col("first").alias("id"), "label", "v")
    roots = _joined(classes.withColumn("size", F.size("v")), links, least, recall, window)

    held = merged.join(roots.withColumnRenamed("node", "id"), "id").select("id", "v", "n", F.col("component").alias("c"))
    sizes = held.groupBy("c").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cells = (
        held.join(sizes, "c")
        .withColumn("q", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "c",
            F.least("q", "o").alias("i"),
            F.greatest("q", "o").alias("j"),
            F.size("v").alias("size"),
            F.when(F.col("q") > F.col("o"), 1).otherwise(0).alias("side"),
            "id",
            "n",
            "v",
        )
    )
    cell = ["c", "i", "j", "size"]
    counted = cells.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(_links(least), "id long, links long")
    found = cut(counted.groupBy("id").agg(F.sum("links").alias("links")))
    linked = (
        roots.withColumnRenamed("node", "id")
        .join(copies, "id", "left")
        .withColumn("class", F.coalesce("class", "id"))
        .join(found.withColumnRenamed("id", "class"), "class", "left")
        .select("id", "component", (F.coalesce("links", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    return (
        rows.select("id")
        .join(linked, "id", "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )


def _joined(classes: DataFrame, links: DataFrame, least: float, recall: float, window: int) -> DataFrame:
    """``node`` and ``component`` of ``links`` and of what the rounds of passes find between ``classes``."""
    kind = dict(classes.dtypes)["v"]
    every = cut(groups(classes, least, recall, window))
    edges = "a long, b long, label string, size int"
    small = classes.join(every.where(F.col("n") <= window + 1).select("label", "size"), ["label", "size"])
    small = small.select(F.lit(0).alias("p"), "label", "size", "id", "v").repartition("label", "size")
    near = small.sortWithinPartitions("label", "size", "id").mapInPandas(_windows(window, least), edges)
    roots = components(links.unionByName(near.select("a", "b")))

    step = F.least(F.lit(ROUND), F.ceil(F.col("passes") / 2)).cast("int")
    large = every.where(F.col("n") > window + 1).select("label", "size", "mean", "passes", step.alias("step"))
    order, turn, on = ["p", "label", "size", "key", "id"], 0, large
    while not on.isEmpty():
        keyed = classes.join(on, ["label", "size"]).mapInPandas(_keyed(turn), f"p int, label string, size int, key long, id long, v {kind}")
        sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        found = cut(sorted_rows.mapInPandas(_windows(window, least), edges).distinct())
        of = lambda end: roots.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))  # noqa: B023, E731
        apart = found.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        met = cut(apart.select("label", "size").distinct().withColumn("met", F.lit(True)))
        known = roots.select(F.col("component").alias("a"), F.col("node").alias("b"))
        roots = components(known.unionByName(apart.select("a", "b")))
        turn += 1
        on = cut(large.join(met, ["label", "size"], "left").where(F.col("met") | (F.col("passes") > turn * F.col("step"))).drop("met"))
    return roots


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
