"""Splits of skewed relations, ids of any type, ranks and curves with nulls."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dockyard.functions import metrics as M
from dockyard.functions.kernels import mirrored, overlap_between, overlap_pairs
from dockyard.operators import splits as S
from dockyard.operators.ranking import global_rank, kfold
from dockyard.sources import files


def tables(spark, pairs, n_p, n_m, name=lambda kind, i: i, kind="long"):
    prots = spark.createDataFrame([(name("P", i),) for i in range(n_p)], f"prot_id {kind}")
    mols = spark.createDataFrame([(name("DB", i),) for i in range(n_m)], f"mol_id {kind}")
    inter = spark.createDataFrame([(name("P", p), name("DB", m)) for p, m in pairs], f"prot_id {kind}, mol_id {kind}")
    return inter, prots, mols


def checked(rows, pairs, group):
    """Nested, disjoint and clean; returns positives and negatives by group and ratio."""
    seen = Counter((group(r), r.ratio, r.y) for r in rows)
    taken = {}
    for r in rows:
        assert ((r.prot_id, r.mol_id) in pairs) == (r.y == 1)
        taken.setdefault((r.ratio, r.prot_id, r.mol_id), []).append(group(r))
    assert all(len(v) == 1 for v in taken.values())  # each pair once a ratio
    own = {q: {(p, m) for (r, p, m) in taken if r == q} for q in (10, 5, 2, 1)}
    assert own[1] <= own[2] <= own[5] <= own[10]
    return seen


def test_hot_fold_gets_all_its_negatives(spark):
    pairs = {(0, m) for m in range(60)}  # one protein with 60 positives among 1,000 x 600
    found = S.by_entity(*tables(spark, pairs, 1000, 600), "protein").collect()
    seen = checked(found, pairs, lambda r: r.fold)
    (fold,) = {r.fold for r in found}
    assert seen[fold, 10, 0] == 600 and seen[fold, 1, 0] == 60 and {r.missing for r in found} == {0}


def test_hot_cell_gets_all_its_negatives(spark):
    draw = random.Random(1)
    names = kfold(spark.range(1000).withColumnRenamed("id", "prot_id"), "prot_id", 5).where("fold = 2").limit(40).collect()
    mols = kfold(spark.range(600).withColumnRenamed("id", "mol_id"), "mol_id", 5).where("fold = 3").limit(40).collect()
    pairs = set()
    while len(pairs) < 120:
        pairs.add((draw.choice(names).prot_id, draw.choice(mols).mol_id))
    found = S.double_orphan(*tables(spark, pairs, 1000, 600)).collect()
    seen = checked(found, pairs, lambda r: (r.pf, r.mf))
    assert seen[(2, 3), 10, 0] == 1200 and seen[(2, 3), 10, 1] == 120 and len({(r.pf, r.mf) for r in found}) == 1


def test_small_complement_is_told(spark):
    pairs = {(p, m) for p in range(10) for m in range(12) if (p + m) % 3 == 0}
    for entity in ("protein", "molecule"):
        found = S.by_entity(*tables(spark, pairs, 10, 12), entity).collect()
        seen = checked(found, pairs, lambda r: r.fold)
        size = 12 if entity == "protein" else 10
        for f in {r.fold for r in found}:
            n, own = seen[f, 10, 1], {(r.prot_id if entity == "protein" else r.mol_id) for r in found if r.fold == f}
            assert {r.missing for r in found if r.fold == f and r.ratio == 10} == {10 * n - seen[f, 10, 0]} and 10 * n > seen[f, 10, 0]
            assert seen[f, 10, 0] == size * len(own) - n  # all that is free was taken
    one = S.setting1(*tables(spark, pairs, 10, 12)).collect()
    assert {r.missing for r in one if r.ratio == 10} == {10 * len(pairs) - (120 - len(pairs))}


def test_ids_of_text(spark):
    draw = random.Random(2)
    pairs = {(draw.randrange(80), draw.randrange(90)) for _ in range(60)}
    args = tables(spark, pairs, 80, 90, lambda kind, i: f"{kind}{i}", "string")
    named = {(f"P{p}", f"DB{m}") for p, m in pairs}
    for setting, group in ((1, lambda r: r.fold), (2, lambda r: r.fold), (3, lambda r: r.fold), (4, lambda r: (r.pf, r.mf))):
        seen = checked(S.make_split(setting, *args).collect(), named, group)
        assert sum(n for (_, q, y), n in seen.items() if q == 10 and y == 1) == len(named)
        assert sum(n for (_, q, y), n in seen.items() if q == 10 and y == 0) == 10 * len(named)


def test_odd_relations(spark):
    inter, prots, mols = tables(spark, [(1, 2), (1, 2), (3, 4)], 30, 30)
    odd = inter.unionByName(spark.createDataFrame([(None, 1), (1, None)], "prot_id long, mol_id long"))
    found = S.setting1(odd, prots.unionByName(prots), mols).collect()
    assert sum(r.y == 1 and r.ratio == 10 for r in found) == 2 and sum(r.y == 0 and r.ratio == 10 for r in found) == 20
    for setting in (1, 2, 3, 4):
        assert S.make_split(setting, inter.limit(0), prots, mols).count() == 0


def test_draws_are_enough():
    for need, cells, free in ((10, 100_000, 99_000), (1000, 4000, 3500), (5000, 10**9, 10**9 - 500)):
        n, listed = S.n_draws(need, cells, free)
        assert not listed and n < 2.2 * (need + 6 * need**0.5 + 10) * cells / free
    assert S.n_draws(60, 110, 100) == (110, True)


def test_null_strata_and_null_orders(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, None, 1.0), (3, None, None), (4, "a", 2.0), (5, "b", None)], "id long, label string, v double")
    assert kfold(df, "id", 2, by=["label"]).count() == 5
    assert S.assign_folds(df, "id", 2, "stratified", by=["label"]).count() == 5
    got = {r.id: r.rank for r in global_rank(df, ["v", "id"], F.floor("v"), by=["label"]).collect()}
    assert got == {4: 0, 1: 1, 3: 0, 2: 1, 5: 0}
    assert {r.id: r.rank for r in global_rank(df, ["v", "id"], F.floor("v")).collect()} == {3: 0, 5: 1, 2: 2, 4: 3, 1: 4}


def test_quantiles(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.random(), draw.random() * 1e-6, 0.5])) for _ in range(700)] + [("a", None), ("c", 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in M.quantiles(df, ["g"], "v", [0.25, 0.5, 0.9]).collect()}
    for g in ("a", "b", None, "c"):
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g], np.quantile(v, [0.25, 0.5, 0.9]))
    assert set(got) == {"a", "b", None, "c"}


def test_slices_of_kernels(spark):
    draw = random.Random(6)
    bag = spark.createDataFrame([(i, draw.randrange(9), draw.randrange(1, 4)) for i in range(40) for _ in range(3)], "id int, item int, n int").dropDuplicates(["id", "item"])
    whole = mirrored(overlap_pairs(bag))
    got = {(r.i, r.j): r.k for r in overlap_between(bag.where("id < 10"), bag.where("id >= 10")).collect()}
    assert got == {(r.i, r.j): r.k for r in whole.where("i < 10 and j >= 10").collect()}


def plain_areas(rows):
    known = [(s, y) for y, s in rows if y is not None and s is not None]
    p, t = sum(y for _, y in known), len(known)
    wins = sum((a > b) + 0.5 * (a == b) for a, y in known for b, z in known if y == 1 and z == 0)
    ap = ctp = cn = 0
    for s in sorted({s for s, _ in known}, reverse=True):
        at = [y for v, y in known if v == s]
        ctp, cn = ctp + sum(at), cn + len(at)
        ap += sum(at) / p * ctp / cn
    return round(100 * ap, 2), round(100 * wins / (p * (t - p)), 2)


def test_curves_with_nulls_and_close_scores(spark):
    draw = random.Random(4)
    rows = [(int(draw.random() < 0.2), draw.random() * 1e-4) for _ in range(800)] + [(1, 5e-5)] * 20 + [(0, 5e-5)] * 30
    rows += [(1, None), (0, None), (None, 0.5), (None, None), (1, 0.0), (0, -3.0), (1, 1e9)]
    df = spark.createDataFrame([(y, s, "g") for y, s in rows], "y int, score double, g string")
    r = M.areas_of(df, ["g"], ["aupr", "rocauc"]).first()
    assert (r.aupr, r.rocauc) == plain_areas(rows)
    assert M.ranges(df).select("_b").distinct().count() > 50
    assert M.areas_of(df.limit(0), ["g"], ["aupr"]).count() == 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_kernels_are_not_shuffled(spark):
    """Several blocks give the cells of one written out; what is exchanged is the blocks, below the step that makes the cells."""
    draw, bags = random.Random(8), {}
    for i in range(60):
        bags[f"P{i}"] = {f"x{draw.randrange(12)}": draw.randrange(1, 5) for _ in range(3)}
    rows = [(i, x, n) for i, b in bags.items() for x, n in b.items()] + [("P1", None, 2), (None, "x1", 1)]
    bags["P1"][None] = 2
    bag = spark.createDataFrame(rows, "id string, item string, n int")
    shared = lambda a, b: sum(min(n, b[x]) for x, n in a.items() if x is not None and x in b)
    expected = {(i, j): shared(a, b) / (sum(a.values()) + sum(b.values()) - shared(a, b)) for i, a in bags.items() for j, b in bags.items() if i <= j and shared(a, b)}
    got = overlap_pairs(bag, block=7)
    assert sorted((r.i, r.j, r.k) for r in got.collect()) == sorted((*p, k) for p, k in expected.items())
    some = {(r.i, r.j) for r in overlap_pairs(bag, 0.5, block=7).collect()}
    assert some == {p for p, k in expected.items() if k >= 0.5}
    between = overlap_between(bag.where("id < 'P3'"), bag.where("id >= 'P3'"), block=7)
    assert {(r.i, r.j): r.k for r in between.collect()} == {p: k for p, k in expected.items() if p[0] < "P3" <= p[1]}
    for df in (got, between):
        assert plan_of(df).index("MapInArrow") < plan_of(df).index("Exchange")
    assert overlap_pairs(bag.limit(0)).count() == 0


def test_matrix_in_ranges_is_written_without_a_shuffle(spark, tmp_path):
    bag = spark.createDataFrame([(i, i % 5 + x, 1) for i in range(50) for x in (0, 1)], "id long, item int, n int")
    cells = overlap_pairs(bag, block=10)
    files.write_matrix(cells, str(tmp_path / "m"), ranged=True)
    found = spark.read.parquet(str(tmp_path / "m")).select("*", F.col("_metadata.file_name").alias("f"))
    assert {(r.i, r.j, r.k) for r in found.collect()} == {(r.i, r.j, r.k) for r in cells.where("k <> 0").collect()}
    spans = found.groupBy("f").agg(F.min("i").alias("a"), F.max("i").alias("z")).collect()
    assert len(spans) > 3 and all(r.z - r.a < 10 for r in spans)


def test_complement_is_not_shuffled(spark):
    prot = spark.createDataFrame([(p,) for p in [*range(9), None, 3]], "prot_id long")
    mol = spark.createDataFrame([(m,) for m in [*range(30), None, 4, 4]], "mol_id long")
    inter = spark.createDataFrame([(p, m) for p in range(8) for m in range(30) if (p * m) % 3 == 1] + [(1, None), (None, 2), (77, 1)], "prot_id long, mol_id long")
    got = S.complement(inter, prot, mol, lot=8)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, prot.crossJoin(mol).join(inter, ["prot_id", "mol_id"], "left_anti").collect()))
    assert plan_of(got).index("Generate") < plan_of(got).index("Exchange")


def test_complement_lists_plain_ids(spark):
    """What a lot is exploded into is an id, not a row that holds one."""
    prot, mol = spark.range(3).toDF("prot_id"), spark.range(9).toDF("mol_id")
    got = S.complement(spark.createDataFrame([(0, 1)], "prot_id long, mol_id long"), prot, mol, lot=4)
    assert got.count() == 26
    top = plan_of(got).split("Exchange")[0]
    assert "[mol_id#" in top and "[m#" not in top
