"""Similarity joins against the inverted index, alignments against tables written out."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockyard.functions.kernels import overlap_pairs
from dockyard.operators import alignment as A
from dockyard.operators import similarity as S


def bags(spark, n=300, hot=True, seed=1):
    draw, rows = random.Random(seed), []
    for i in range(n):
        base = draw.randrange(40)
        items = [f"c{base}-{x}" for x in range(6)] + [f"r{draw.randrange(400)}" for _ in range(draw.randrange(4))]
        rows += [(i, x, draw.choice([1, 1, 2, 5])) for x in set(items)]
        if hot and draw.random() < 0.8:
            rows.append((i, "hot", draw.choice([1, 3])))
    rows += [(n + i, "hot", 3) for i in range(60)]  # bags of the hot item alone: it stands in their prefixes
    return spark.createDataFrame(rows, "id long, item string, n int")


@pytest.mark.parametrize("least,block", [(0.5, 2048), (0.5, 20), (0.8, 7), (0.25, 50), (1.0, 16)])
def test_similarity_join(spark, least, block):
    bag = bags(spark)
    got = {(r.i, r.j): round(r.k, 9) for r in S.similarity_join(bag, least, block).collect()}
    expected = {(r.i, r.j): round(r.k, 9) for r in overlap_pairs(bag, least).collect()}
    assert got == expected and len(got) > 400


def test_hot_token_is_spread(spark):
    bag = bags(spark, 2000)
    sets = S.token_sets(bag).cache()
    size = F.col("s") - F.ceil(F.col("s") * 0.5).cast("int") + 1
    first = sets.select("id", F.explode(F.slice("tokens", F.lit(1), size)).alias("t"))
    assert first.groupBy("t.item", "t.nth").count().agg(F.max("count")).first()[0] < 300  # rarest first: hot only where alone
    assert S.candidates(sets, 0.5, 16).count() == S.candidates(sets, 0.5, 5000).count() > 1000


def test_odd_bags(spark):
    rows = [(1, "a", 1), (1, "a", 1), (2, "a", 2), (3, None, 1), (None, "a", 1), (4, "a", 0), (5, "b", 1)]
    bag = spark.createDataFrame(rows, "id long, item string, n int")
    got = {(r.i, r.j, r.k) for r in S.similarity_join(bag, 0.5).collect()}
    assert got == {(1, 1, 1.0), (2, 2, 1.0), (5, 5, 1.0), (1, 2, 1.0)}
    assert S.similarity_join(bag.limit(0)).count() == 0


def plain_score(a, b, table, open_, extend):
    m, n = len(a), len(b)
    h, e, f = ([[v] * (n + 1) for _ in range(m + 1)] for v in (0.0, -1e9, -1e9))
    best = 0.0
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(e[i][j - 1] - extend, h[i][j - 1] - open_)
            f[i][j] = max(f[i - 1][j] - extend, h[i - 1][j] - open_)
            h[i][j] = max(0.0, h[i - 1][j - 1] + table[a[i - 1]][b[j - 1]], e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def plain_kernel(a, b, table, open_, extend, beta):
    """All local alignments, by recursion on where the last pair of residues is."""
    from functools import cache

    @cache
    def ending(i, j):
        own = 1.0
        for p in range(i):
            for q in range(j):
                gap = lambda g: 0.0 if g == 0 else open_ + (g - 1) * extend
                own += ending(p, q) * math.exp(-beta * (gap(i - p - 1) + gap(j - q - 1)))
        return own * math.exp(beta * table[a[i]][b[j]])

    return math.log(1 + sum(ending(i, j) for i in range(len(a)) for j in range(len(b)))) / beta


def test_scores_of_random_pairs():
    draw, table = random.Random(2), A.default_scores()
    seq = lambda n: A.codes("".join(draw.choice("ACDEFGHIKLMNPQRSTVWYx-") for _ in range(n)))
    pairs = [(seq(draw.randrange(40)), seq(draw.randrange(40))) for _ in range(60)]
    pairs += [(a, np.r_[a[: len(a) // 2], seq(3), a[len(a) // 2 :]]) for a in (seq(30) for _ in range(10))]
    got = A.scores([p for p, _ in pairs], [q for _, q in pairs], table)
    assert np.allclose(got, [plain_score(p, q, table, A.OPEN, A.EXTEND) for p, q in pairs])
    got = A.scores([p for p, _ in pairs], [q for _, q in pairs], table, open_=2.0, extend=0.5)
    assert np.allclose(got, [plain_score(p, q, table, 2.0, 0.5) for p, q in pairs])
    short = [(p[:7], q[:7]) for p, q in pairs[:20]]
    got = A.scores([p for p, _ in short], [q for _, q in short], table, "kernel", open_=3.0, extend=1.0, beta=0.4)
    assert np.allclose(got, [plain_kernel(p, q, table, 3.0, 1.0, 0.4) for p, q in short])
    wide = A.scores([p for p, _ in pairs], [q for _, q in pairs], table, band=80)
    assert np.allclose(wide, [plain_score(p, q, table, A.OPEN, A.EXTEND) for p, q in pairs])
    long = A.codes("W" * 3000)
    assert A.scores([long], [long], table)[0] == 3000 * A.SAME and np.isfinite(A.scores([long], [long], table, "kernel"))[0]


def test_kernel_table_resumes(spark, tmp_path):
    draw = random.Random(3)
    rows = [(f"P{i}", "".join(draw.choice("ACDEFGHIKL") for _ in range(draw.randrange(1, 25))), 1) for i in range(45)]
    df = spark.createDataFrame(rows + [("P0", rows[0][1], 2), (None, "AAA", 3), ("E", None, 4)], "id string, seq string, k int")
    path = str(tmp_path / "kernel")
    A.kernel_table(df, path, block=8, at_once=2, most=1)  # stopped after one job
    first = spark.read.parquet(path).count()
    assert first < 46 * 47 / 2
    (spark.read.parquet(path).where("b = 1").limit(3).withColumn("b", F.lit(3).cast("long"))  # a block of which a part is there
        .write.mode("append").partitionBy("b").parquet(path))
    whole = A.kernel_table(df, path, block=8, at_once=2)
    cells = [(min(r.i, r.j), max(r.i, r.j), r.k) for r in whole.collect()]
    seqs = {i: A.codes(s) for i, s, _ in rows} | {"E": A.codes("")}
    table = A.default_scores()
    assert Counter((i, j) for i, j, _ in cells) == Counter((i, j) for i in seqs for j in seqs if i <= j)
    assert all(abs(k - plain_score(seqs[i], seqs[j], table, A.OPEN, A.EXTEND)) < 1e-9 for i, j, k in cells)
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "kernel").rglob("*.parquet")}
    A.kernel_table(df, path, block=8, at_once=2)
    assert times == {p: p.stat().st_mtime_ns for p in (tmp_path / "kernel").rglob("*.parquet")}  # nothing is done twice


def test_given_pairs_and_given_scores(spark):
    seqs = spark.createDataFrame([(1, "AAB"), (2, "BAAB"), (3, None)], "id long, seq string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "i long, j long")
    table = spark.createDataFrame([("A", "A", 5.0), ("B", "B", 7.0), ("A", "B", -2.0)], "a string, b string, score double")
    assert {(r.i, r.j): r.k for r in A.aligned(pairs, seqs, residues=table).collect()} == {(1, 2): 17.0, (1, 3): 0.0}


def test_pairs_that_meet_are_not_shuffled(spark):
    """Only sets are exchanged, below the join: nothing is made distinct and no tokens are joined to pairs afterwards."""
    plan = S.similarity_join(bags(spark, 50), 0.5, 20, diagonal=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 2 and plan.index("SortMergeJoin") < plan.index("Exchange hash")


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_hot_tokens_make_tiles(spark, monkeypatch, least):
    """Bags of few items, which all meet: the same cells by tiles, without a join of sets."""
    draw = random.Random(5)
    rows = [(i, f"b{draw.randrange(6)}", draw.randrange(0, 4)) for i in range(150) for _ in range(5)] + [(7, None, 2)]
    bag = spark.createDataFrame(rows, "id long, item string, n int")
    told = lambda df: {(r.i, r.j): round(r.k, 9) for r in df.collect()}
    by_prefixes = [told(S.similarity_join(bag, least, diagonal=d)) for d in (True, False)]
    monkeypatch.setattr(S, "MEETINGS", 100)
    hot = S.similarity_join(bag, least)
    assert "MapInArrow" in hot._jdf.queryExecution().executedPlan().toString()
    assert [told(hot), told(S.similarity_join(bag, least, diagonal=False))] == by_prefixes


def test_tiles_by_products_and_by_items(spark, monkeypatch):
    """Whole counts go by a product of tokens, others by items; both give the same, and blocks carry no cell of their own."""
    from dockyard.functions import kernels

    bag = bags(spark, 200)
    told = lambda df: {(r.i, r.j): round(r.k, 9) for r in df.collect()}
    whole = told(overlap_pairs(bag, block=64))
    assert whole == told(overlap_pairs(bag.withColumn("n", F.col("n").cast("double")), block=64)) and len(whole) > 10_000
    packed, count = kernels._packed(bag, None)
    assert count == 1 and {f.name for f in packed.schema["held"].dataType.elementType.fields} == {"item", "at", "n"}
