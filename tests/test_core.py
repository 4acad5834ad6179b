"""Worked rows and properties of the engine's own operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockyard.functions import columns as C
from dockyard.functions import graphs, kernels, metrics, smiles
from dockyard.operators import factorisation, learners, splits
from dockyard.operators.ranking import global_rank, kfold
from dockyard.streaming.scoring import windowed_scores

SCORES = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.4, 0), (0.3, 1), (0.1, 0)]


def one(df):
    return df.first()[0]


def test_metrics(spark):
    pred = spark.createDataFrame([("t", y, s) for s, y in SCORES] + [("t", None, 0.5)], "task string, y int, score double")
    assert metrics.average_precision(pred, ["task"]).first().aupr == 66.67
    assert metrics.roc_auc(pred, ["task"]).first().rocauc == 62.5
    assert metrics.pr_trapezoid(pred, ["task"]).first().pr_area == 0.65
    counts = metrics.confusion(pred, ["task"])
    assert tuple(counts.first())[1:] == (2, 2, 1, 2)
    row = counts.select(*[c.alias(n) for n, c in metrics.rates().items()]).first()
    assert (row.precision, row.recall, row.f1, row.acc, row.mcc) == (50.0, 66.67, 57.14, 0.5714, 0.1667)
    cells = spark.createDataFrame([("t", 1, 0.8), ("t", None, 0.5), ("t", 0, 0.4)], "task string, y int, score double")
    assert metrics.masked_bce(cells).first().loss == pytest.approx(0.244656, abs=1e-6)
    assert metrics.average_precision(pred.where("y = 0"), ["task"]).first().aupr == 0.0
    assert {r.score_name for r in metrics.report(pred, ["task"]).collect()} == {"aupr", "rocauc", "f1", "recall", "precision", "acc"}


def test_columns(spark):
    df = spark.createDataFrame([("MKVLA", "p.Lys2Glu"), ("MKVLA", "p.Ala2Glu"), ("MKBZ", "x")], "seq string, change string")
    rows = df.select(C.substituted(F.col("seq"), F.col("change")).alias("s"), C.in_alphabet(F.col("seq")).alias("ok")).collect()
    assert [(r.s, r.ok) for r in rows] == [("MEVLA", True), (None, True), (None, False)]
    hot = spark.range(1).select(C.one_hot(F.lit(12), [5, 6, 7, 8, 9, 15, 16, 17, 35, 53, 999]).alias("h")).first().h
    assert hot == [0] * 10 + [1]
    m = spark.createDataFrame([("3_bs:20;lrs:{'name':'X','rate':0.9}",)], "p string").select(C.parsed_params(F.col("p")).alias("m")).first().m
    assert m == {"repeat": "3", "bs": "20", "lrs": "{'name':'X','rate':0.9}"}
    lr = [r[0] for r in spark.range(5).select(F.round(C.learning_rate(F.col("id")), 6)).collect()]
    assert lr == [0.001, 0.001, 0.0009, 0.0009, 0.00081]
    assert spark.range(1).select(C.sigmoid(F.lit(-1000.0)), C.sigmoid(F.lit(1000.0))).first()[:] == (0.0, 1.0)
    assert one(spark.range(1).select(C.argmax_one_hot(F.array(F.lit(1), F.lit(3), F.lit(3))))) == [0, 1, 1]


KERNEL = [(0, 0, 1.0), (0, 1, 0.5), (0, 2, 0.2), (1, 1, 1.0), (1, 2, 0.4), (2, 2, 1.0)]


def test_kernels(spark):
    full = kernels.mirrored(spark.createDataFrame(KERNEL, "i int, j int, k double"))
    c = {(r.i, r.j): r.k for r in kernels.centred(full).collect()}
    assert c[0, 0] == pytest.approx(0.444444, abs=1e-6) and c[0, 1] == pytest.approx(-0.122222, abs=1e-6)
    n = {(r.i, r.j): r.k for r in kernels.normalised(kernels.centred(full)).collect()}
    assert n[0, 1] == pytest.approx(-0.328688, abs=1e-6) and n[1, 2] == pytest.approx(-0.473686, abs=1e-6)
    top = kernels.nearest(full, 1)
    assert {(r.i, r.j) for r in top.collect()} == {(0, 1), (1, 0), (2, 1)}
    lap = {(r.i, r.j): r.l for r in kernels.laplacian(top).collect()}
    assert lap[0, 0] == pytest.approx(0.5) and lap[1, 1] == pytest.approx(0.7) and lap[1, 2] == pytest.approx(-0.2)


def test_graphs(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, -1.0), (2, 2.0)], "id int, h double")
    edges = spark.createDataFrame([(0, 1, 0.0), (1, 0, 0.0), (1, 2, 0.0), (2, 1, 0.0)], "i int, j int, w double")
    out = {r.id: r.h for r in graphs.message_passing(nodes, edges, 0.5, 0.25).collect()}
    assert out == {0: 0.25, 1: 0.25, 2: 0.75}
    att = {r.id: r.h for r in graphs.attention(nodes, edges, 1.0, 0.0, 0.0).collect()}
    assert att[0] == pytest.approx(0.0) and att[1] == pytest.approx(2 / 3)


def test_ranks_and_folds(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    ranks = global_rank(df, ["k"], F.floor(F.col("k") / 7), "r")
    assert ranks.where("r <> k").count() == 0
    folds = kfold(spark.range(13), "id", 5)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [2, 2, 3, 3, 3]


@pytest.fixture(scope="module")
def relation(spark):
    inter = spark.range(300).select((F.col("id") % 20).alias("prot_id"), (F.col("id") * 7 % 101).alias("mol_id")).distinct()
    return inter.cache(), spark.range(20).toDF("prot_id"), spark.range(101).toDF("mol_id")


def test_setting1(relation):
    inter, prots, mols = relation
    n = inter.count()
    cv = splits.setting1(inter, prots, mols, ratios=(5, 2, 1)).cache()
    count = {(r.ratio, r.y): r["count"] for r in cv.groupBy("ratio", "y").count().collect()}
    assert count[5, 1] == count[1, 1] == n
    assert splits.overlap(cv, ["prot_id", "mol_id", "ratio"]).first().n_violations == 0
    assert cv.where("y = 0").join(inter, ["prot_id", "mol_id"], "left_semi").count() == 0
    few, more = (cv.where(f"y = 0 and ratio = {r}").select("prot_id", "mol_id", "fold") for r in (1, 2))
    assert few.count() == few.join(more, ["prot_id", "mol_id", "fold"], "left_semi").count() == 5 * round(n / 5)


def test_settings_by_entity_and_orphans(relation):
    inter, prots, mols = relation
    cv = splits.by_entity(inter, prots, mols, "molecule", ratios=(2, 1)).cache()
    assert cv.groupBy("mol_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert cv.where("y = 0").join(inter, ["prot_id", "mol_id"], "left_semi").count() == 0


def test_setting4_splits_share_no_entity(relation):
    inter, prots, mols = relation
    grid = splits.make_split(4, inter, prots, mols, ratios=(3, 1)).cache()
    assert grid.where("y = 1 and ratio = 1").select("prot_id", "mol_id").exceptAll(inter.select("prot_id", "mol_id")).count() == 0
    assert grid.where("y = 1 and ratio = 3").count() == inter.count()
    assert grid.where("y = 0").join(inter, ["prot_id", "mol_id"], "left_semi").count() == 0
    few, more = (grid.where(f"y = 0 and ratio = {r}").select("prot_id", "mol_id", "pf", "mf") for r in (1, 3))
    assert few.count() == few.join(more, few.columns, "left_semi").count() == inter.count()
    cells = grid.where("y = 1 and ratio = 1").groupBy("pf", "mf").count().collect()
    size = [{r[0]: r[1] for r in kfold(ids, key, 5).groupBy("fold").count().collect()} for ids, key in ((prots, "prot_id"), (mols, "mol_id"))]
    assert more.count() == sum(min(3 * r["count"], size[0][r.pf] * size[1][r.mf] - r["count"]) for r in cells)  # a cell has no more
    counts = splits.block_counts(grid).cache()
    assert counts.select("tp", "tm", "vp", "vm").distinct().count() == 400
    for tp, tm, vp, vm in ((0, 0, 1, 1), (4, 2, 3, 0), (2, 3, 0, 4)):
        rows = splits.block(grid, tp, tm, vp, vm).collect()
        for key in ("prot_id", "mol_id"):
            own = {p: {r[key] for r in rows if r.part == p} for p in ("test", "val", "train")}
            assert not own["test"] & own["val"] and not own["test"] & own["train"] and not own["val"] & own["train"]
        told = {(r.part, r.y, r.ratio): r.n for r in counts.where(f"tp = {tp} and tm = {tm} and vp = {vp} and vm = {vm}").collect()}
        assert told == {k: sum((r.part, r.y, r.ratio) == k for r in rows) for k in told}


def test_dense_relation_takes_the_whole_complement(spark):
    """Every pair but one in seven interacts, so there are far fewer negatives than ten times the positives."""
    inter = spark.range(140).select((F.col("id") % 10).alias("prot_id"), F.floor(F.col("id") / 10).alias("mol_id")).where("(prot_id + mol_id) % 7 > 0")
    prots, mols = spark.range(10).toDF("prot_id"), spark.range(14).toDF("mol_id")
    rows, n = splits.setting1(inter, prots, mols).collect(), inter.count()
    free = 140 - n
    assert {r.ratio: r.missing for r in rows} == {10: 10 * n - free, 5: 5 * n - free, 2: 2 * n - free, 1: n - free}
    assert len({(r.prot_id, r.mol_id) for r in rows if r.y == 0 and r.ratio == 10}) == free
    assert {(r.prot_id, r.mol_id) for r in rows if r.y == 0}.isdisjoint({(r.prot_id, r.mol_id) for r in rows if r.y == 1})


def test_curve_over_many_ranges(spark):
    rng = np.random.default_rng(4)
    score = np.r_[rng.normal(0, 1e3, 300), rng.random(500), [0.5] * 20]
    y = (rng.random(820) < 0.3).astype(int)
    pred = spark.createDataFrame([(int(a), float(b), 0) for a, b in zip(y, score)], "y int, score double, g int")
    wins = sum((score[i] > score[j]) + 0.5 * (score[i] == score[j]) for i in np.flatnonzero(y) for j in np.flatnonzero(1 - y))
    got = metrics.areas_of(pred, ["g"], ["rocauc", "aupr", "pr_area"]).first()
    assert got.rocauc == pytest.approx(100 * wins / (y.sum() * (820 - y.sum())), abs=0.006)
    at = sorted(set(score), reverse=True)
    tp, n = (np.array([sum(w[score >= t]) for t in at], dtype=float) for w in (y, np.ones(820)))
    assert got.aupr == pytest.approx(100 * sum(np.diff(np.r_[0, tp]) / y.sum() * tp / n), abs=0.006)
    assert got.pr_area == pytest.approx(sum(np.diff(np.r_[0, tp]) / y.sum() * (tp / n + np.r_[1, (tp / n)[:-1]]) / 2), abs=6e-5)


def test_fold_strategies(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, i % 2, (rng.normal(8 * (i % 3), 0.1, 2)).tolist()) for i in range(60)], "id long, c int, x array<double>").cache()
    for strategy in ("random", "stratified"):
        folds = splits.assign_folds(df, "id", 3, strategy, by=["c"])
        assert {r["count"] for r in folds.groupBy("fold").count().collect()} == {20}
    clusters = {r.id: r.fold for r in splits.assign_folds(df, "id", 3, "kmeans", features="x").collect()}
    assert all(clusters[i] == clusters[i % 3] for i in clusters) and len(set(clusters.values())) == 3
    with pytest.raises(ValueError):
        splits.assign_folds(df, "id", 3, "other")
    with pytest.raises(ValueError):
        splits.make_split(5, df, df, df)


def test_fingerprints_equal_brute_force(spark):
    """Environments as nested tuples, counted; the same molecule written in two ways has the same fingerprint."""
    texts = ["CCO", "OCC", "c1ccccc1", "C1CCCCC1", "CC(=O)Nc1ccc(O)cc1", "Oc1ccc(NC(C)=O)cc1", "", "C(("]
    atoms, bonds = smiles.atoms_and_bonds(spark.createDataFrame(list(enumerate(texts)), "id int, s string"), "id", "s")
    got = {}
    for r in smiles.fingerprints(atoms, bonds, size=1 << 30).collect():
        got.setdefault(r.mol_id, {})[r.bit] = r.n
    for k, text in enumerate(texts[:6]):
        a, b = smiles.graph(text)
        code, every = [tuple(x) for x in a], []
        every += code
        for _ in range(2):
            code = [(code[i], tuple(sorted((tuple(x[:4]), code[j]) for p, j, x in b if p == i))) for i in range(len(a))]
            every += code
        assert sorted(got[k].values()) == sorted(every.count(c) for c in set(every))
    assert got[0] == got[1] and got[4] == got[5] and got[2] != got[3] and set(got) == set(range(6))
    assert smiles.rejects(spark.createDataFrame(list(enumerate(texts)), "id int, s string"), "id", "s").first()[:] == (8, 2)
    for mode, diagonal in ((0, 0.0), (1, 1.0)):
        row = smiles.dense(atoms, bonds, 4, mode).where("mol_id = 0").first()
        assert [list(x) for x in row.edges] == [[diagonal, 1, 0, 0], [1, diagonal, 1, 0], [0, 1, diagonal, 0], [0, 0, 0, 0]]
        assert len(row.nodes) == 4 and sum(row.nodes[3]) == 0 and list(row.nodes[0]) == smiles.graph("CCO")[0][0]
    assert len(smiles.dense(atoms, bonds, 4, 2).where("mol_id = 0").first().edges[0][1]) == 8


def test_learners(spark):
    """On data with a known answer: a ring that only a radial kernel can tell, a plane for PCA, a line for regression."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 2))
    y = ((x**2).sum(1) < 1.2).astype(int)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    data = learners.fourier_features(df, "v", 2, 1.0).cache()
    model, c, area = learners.best_svm(data.where("id < 300"), data.where("id >= 300"), (0.01, 1.0, 100.0))
    assert area > 97
    told = learners.probabilities(learners.margins(model, data.where("id < 300")), learners.margins(model, data.where("id >= 300"))).collect()
    assert np.mean([(r.probability > 0.5) == r.y for r in told]) > 0.9 and all(0 <= r.probability <= 1 for r in told)
    smooth = data.withColumn("y", F.col("v")[0] * 2)
    error = np.mean([(r.score - r.y) ** 2 for r in learners.predictions(learners.ridge(smooth, 1e-4), smooth).collect()])
    assert error < 0.2
    pairs = spark.createDataFrame([(i, j, int((i < 5) == (j < 5))) for i in range(10) for j in range(10)], "prot_id long, mol_id long, y int")
    side = lambda k, f: spark.createDataFrame([(i, [1.0, 1.0 if i < 5 else -1.0]) for i in range(10)], f"{k} long, {f} array<double>")
    feats = learners.kronecker_features(pairs, side("prot_id", "pf"), side("mol_id", "mf"))
    assert all((r.score > 0) == r.y for r in learners.margins(learners.linear_svm(feats), feats).collect())
    net = learners.feed_forward(df, "v", "y", [2, 8, 2])
    out = net.transform(learners._vectors(df, "v")).select("y", "prediction").collect()
    assert np.mean([r.y == r.prediction for r in out]) > 0.85
    z = np.c_[rng.normal(0, 3, 200), rng.normal(0, 2, 200), rng.normal(0, 0.1, (200, 3))] @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    axes = learners.principal_axes(spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(z)], "id long, v array<double>"), "id", "v", ratio=0.9)
    got = np.array([r.components for r in axes.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert got.shape == (200, 2) and np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_empty_relation(spark, relation):
    inter, prots, mols = relation
    assert splits.setting1(inter.limit(0), prots, mols).count() == 0
    assert splits.setting1(inter.limit(0), prots.limit(0), mols.limit(0)).count() == 0


def test_downsample(spark):
    rows = [(i, "t", 1) for i in range(2)] + [(i, "t", 0) for i in range(2, 52)] + [(99, "t", None)]
    out = splits.downsample(spark.createDataFrame(rows, "id long, task string, y int")).collect()
    assert len(out) == 53 and sum(r.y == 0 for r in out) == 20 and sum(r.y is None for r in out) == 31


def test_smiles():
    atoms, bonds = smiles.graph("CC(=O)Nc1ccc(O)cc1")
    assert len(atoms) == 11 and len(bonds) == 22 and all(len(a) == 25 for a in atoms)
    assert sum(a[23] for a in atoms) == 6 == sum(a[24] for a in atoms)
    assert atoms[0][17 + 3] == 1  # a methyl group has three hydrogens
    assert smiles.graph("C1CC") == ([], []) and smiles.graph("") == ([], []) and smiles.graph(None) == ([], [])
    atoms, bonds = smiles.graph("[NH4+].[Cl-]")
    assert bonds == [] and [a[22] for a in atoms] == [1.0, -1.0] and atoms[0][17 + 4] == 1
    assert all(not b[2][6] for b in smiles.graph("CCC")[1]) and all(b[2][6] for b in smiles.graph("C1CC1")[1])


def test_nrlmf_learns(spark):
    inter = spark.createDataFrame([(p, m) for p in range(6) for m in range(8) if p % 2 == m % 2], "prot_id long, mol_id long")
    prots, mols = spark.range(6).toDF("prot_id"), spark.range(8).toDF("mol_id")
    u, v = factorisation.nrlmf(inter, prots, mols, rank=4, rounds=6, block=4)
    pairs = spark.createDataFrame([(p, m) for p in range(6) for m in range(8)] + [(77, 0)], "prot_id long, mol_id long")
    s = {(r.prot_id, r.mol_id): r.score for r in factorisation.pair_scores(pairs, u, v).collect()}
    inside = [x for (p, m), x in s.items() if p % 2 == m % 2 and p < 9]
    outside = [x for (p, m), x in s.items() if p % 2 != m % 2 and p < 9]
    assert min(inside) > max(outside) and s[77, 0] == 0.5


def plain_nrlmf(y, s_u, s_v, u, v, c, ridge, alpha, beta, rate, rounds, tolerance):
    """The factorisation on dense arrays; also the number of rounds taken."""
    lap = lambda s: 0.5 * (np.diag(s.sum(0) + s.sum(1)) - (s + s.T))
    l_u, l_v, q = lap(s_u), lap(s_v), 1 + (c - 1) * y

    def likelihood():
        x = u @ v.T
        data = (c * y * x - q * np.logaddexp(0, x)).sum()
        return data - ridge / 2 * ((u**2).sum() + (v**2).sum()) - alpha / 2 * np.trace(u.T @ l_u @ u) - beta / 2 * np.trace(v.T @ l_v @ v)

    s, t, last = 0, 0, likelihood()
    for n in range(rounds):
        e = c * y - q / (1 + np.exp(-(u @ v.T)))
        g = e @ v - ridge * u - alpha * l_u @ u
        s = s + g**2
        u = u + rate * g / np.sqrt(s)
        e = c * y - q / (1 + np.exp(-(u @ v.T)))
        g = e.T @ u - ridge * v - beta * l_v @ v
        t = t + g**2
        v = v + rate * g / np.sqrt(t)
        now = likelihood()
        if abs(now - last) < tolerance * abs(last):
            break
        last = now
    return u, v, n + 1


def test_nrlmf_is_that_of_dense_arrays(spark):
    rng = np.random.default_rng(5)
    y = (rng.random((5, 6)) < 0.4).astype(float)
    y[4], y[:, 5] = 0, 0  # sides without a positive pair
    s_u, s_v = rng.random((5, 5)) * (rng.random((5, 5)) < 0.6), rng.random((6, 6))
    np.fill_diagonal(s_u, 0), np.fill_diagonal(s_v, 0)
    u, v = rng.standard_normal((5, 3)), rng.standard_normal((6, 3))
    side = lambda z: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "id long, z array<double>")
    near = lambda s: spark.createDataFrame([(int(i), int(j), float(s[i, j])) for i, j in zip(*np.nonzero(s))], "i long, j long, k double")
    inter = spark.createDataFrame([(int(p), int(m)) for p, m in zip(*np.nonzero(y))], "prot_id long, mol_id long")
    options = {"weight": 5.0, "ridge": 0.1, "alpha": 0.3, "beta": 0.2, "rate": 0.5}
    want = plain_nrlmf(y, s_u, s_v, u, v, 5.0, 0.1, 0.3, 0.2, 0.5, 8, 0.09)
    assert 1 < want[2] < 8  # stopped by the likelihood
    got = factorisation.nrlmf(inter, spark.range(5).toDF("prot_id"), spark.range(6).toDF("mol_id"), rounds=8, block=3, tolerance=0.09, prot_near=near(s_u), mol_near=near(s_v), start=(side(u), side(v)), **options)
    zs = [np.array([r.z for r in z.orderBy("id").collect()]) for z in got]
    assert np.allclose(zs[0], want[0], atol=1e-6) and np.allclose(zs[1], want[1], atol=1e-6)

    def latent(z, s, known, i, k=2):
        if known[i]:
            return z[i]
        order = [j for j in np.argsort(-s[i]) if known[j]][:k]
        return s[i, order] @ z[order] / s[i, order].sum() if s[i, order].sum() else None

    pairs = spark.createDataFrame([(p, m) for p in range(5) for m in range(6)], "prot_id long, mol_id long")
    scores = {(r.prot_id, r.mol_id): r.score for r in factorisation.predicted(pairs, inter, *got, near(s_u), near(s_v), k=2).collect()}
    assert len(scores) == 30
    for (p, m), score in scores.items():
        a, b = latent(zs[0], s_u, y.any(1), p), latent(zs[1], s_v, y.any(0), m)
        assert math.isclose(score, 0.5 if a is None or b is None else 1 / (1 + math.exp(-(a @ b))), abs_tol=1e-9)


def test_kernel_within_groups(spark):
    """The nearest of a kernel within groups, with and without known ones, are those of its cells, ties included."""
    from dockyard.functions import kernels as K

    rng = np.random.default_rng(3)
    rows = [(i, None if i % 17 == 3 else f"g{i % 5}", None if i % 19 == 4 else float(rng.integers(0, 9))) for i in range(120)]
    within = K.Within(spark.createDataFrame(rows, "id long, g string, x double"), 2.0)
    near = within.near().cache()
    told = lambda df: sorted((r.i, r.j, round(r.k, 12), r["rank"]) for r in df.collect())
    assert told(within.nearest(4)) == told(K.nearest(near, 4)) and near.count() > 1000
    known = spark.createDataFrame([(i,) for i in range(0, 120, 3)] + [(0,)], "id long")
    some = near.where("j % 3 = 0 and i % 3 <> 0")
    assert told(within.nearest(4, known)) == told(K.nearest(some, 4))
    assert within.nearest(4, known.where("id < 0")).count() == 0
    assert within.cells().count() == near.count() + 120


def test_scores_query_takes_all_rounds(spark):
    """The scores of pairs with known sides are those of the dense factorisation after all its rounds."""
    import __spark_entry__ as entry
    from dockyard.plans import learning as P

    d = "/root/testdata/sf0.001"
    got = {(r.prot_id, r.mol_id): r.score for r in entry.queries()["nrlmf_scores"](spark, d).collect()}
    train, _, prot, mol = P._relation(spark, d)
    near_p, near_m = P._neighbours(spark, d)
    begun = [{r.id: r.z for r in factorisation._start(ids, n, 8, seed).collect()} for ids, n, seed in ((prot, "prot_id", 92), (mol, "mol_id", 93))]
    at = [{i: n for n, i in enumerate(sorted(z))} for z in begun]

    def weights(near, at):
        s = np.zeros((len(at), len(at)))
        for r in near.nearest(5).collect():
            s[at[r.i], at[r.j]] = r.k
        return s

    y = np.zeros((len(at[0]), len(at[1])))
    pairs = [(r.prot_id, r.mol_id) for r in train.collect()]
    for p, m in pairs:
        y[at[0][p], at[1][m]] = 1
    first = [np.array([z[i] for i in sorted(z)]) for z in begun]
    u, v, taken = plain_nrlmf(y, weights(near_p, at[0]), weights(near_m, at[1]), *first, 5.0, 0.125, 0.25, 0.125, 0.5, 100, 1e-5)
    assert taken > 3
    for p, m in pairs:
        assert math.isclose(got[p, m], 1 / (1 + math.exp(-(u[at[0][p]] @ v[at[1][m]]))), abs_tol=1e-3)


def test_kept_features_are_not_shuffled_again(spark):
    pairs = spark.createDataFrame([(0, 1, 1), (1, 0, 0)], "prot_id long, mol_id long, y int")
    prot, mol = (spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], f"{n}_id long, {n[0]}f array<double>") for n in ("prot", "mol"))
    once, each = (learners.kronecker_features(pairs, prot, mol, once=o) for o in (True, False))
    assert sorted(r.x for r in once.collect()) == sorted(r.x for r in each.collect()) and once.columns == each.columns
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_grid_query_has_no_cut(spark, monkeypatch):
    from dockyard.plans import learning as P

    seen, whole = [], factorisation.nrlmf

    def fit(*given, **options):
        seen.append(sorted(options))
        return whole(*given, **options | {"rounds": 1})

    monkeypatch.setattr(factorisation, "nrlmf", fit)
    assert len(P.nrlmf_grid(spark, "/root/testdata/sf0.001").collect()) == 1
    assert seen == [["mol_near", "prot_near", "ridge"]] * 2


def test_softplus_by_products():
    rng = np.random.default_rng(1)
    for scale in (0.1, 5, 60, 900):
        x = rng.standard_normal((3, 640)) * scale
        want = np.logaddexp(0, x).sum()
        with np.errstate(over="ignore"):
            assert math.isclose(factorisation._softplus(x, 1 + np.exp(-x)), want, rel_tol=1e-12)


def test_complete_linkage(spark):
    k = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 2, 0.2), (3, 3, 1.0), (2, 2, 1.0)], "i long, j long, k double")
    group = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0)], "id long, g int")
    label = {r.id: r.cluster for r in learners.complete_linkage(k, group, 3).collect()}
    assert label[0] == label[1] != label[2] != label[3]
    with pytest.raises(ValueError):
        learners.complete_linkage(k, group, 2, most=3)


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:01:00", "view", 1.0), ("2024-01-01 00:02:00", "view", 3.0), (None, "view", 9.0)], "t string, event_type string, value double")
    events = events.select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    assert [(r.mean, r.n) for r in windowed_scores(events).collect()] == [(2.0, 2)]
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_scores(stream).writeStream.outputMode("complete").format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert math.isclose(spark.table("scores").first().mean, 2.0)


def test_factors_are_not_broadcast(spark):
    z = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, z array<double>")
    pairs = spark.createDataFrame([(0, 1), (2, 9)], "prot_id long, mol_id long")
    near = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "i long, j long, k double")
    from dockyard.operators import factorisation as R

    for df in (R.pair_scores(pairs, z, z), R.smoothed(z, z.where("id > 0").select("id"), near)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0
