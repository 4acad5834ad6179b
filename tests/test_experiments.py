"""Experiments that go on where they stopped."""

import shutil

from pyspark.sql import functions as F

from dockyard.operators import experiments as E
from dockyard.operators import splits as S
from dockyard.operators import training as N
from dockyard.sources import files


def test_rotations(spark):
    runs = E.rotations(spark, "d", 4, [1], [1, 5], k=5, attempts=2).collect()
    assert len(runs) == 25 * 2 * 2 and all(r.ival == (r.ite + 1) % 25 for r in runs)
    assert E.rotations(spark, "d", 1, [1], [1]).count() == 5


def test_each_run_is_done_once(spark, tmp_path):
    made, out = [], str(tmp_path / "out")

    def body(run):
        made.append(run["ite"])
        if run["ite"] == 2 and made.count(2) == 1:
            raise OSError("lost")
        return {"scores": spark.createDataFrame([("aupr", float(run["ite"]))], "score_name string, value double")}

    runs = E.rotations(spark, "d", 1, [1], [1])
    assert E.run_missing(spark, runs, out, body, most=2) == 2
    try:
        E.run_missing(spark, runs, out, body)
    except OSError:
        pass
    assert made == [0, 1, 2]
    assert E.run_missing(spark, runs, out, body) == 3 and made == [0, 1, 2, 2, 3, 4]
    assert E.run_missing(spark, runs, out, body) == 0
    rows = spark.read.parquet(f"{out}/scores").collect()
    assert sorted((r.ite, r.value) for r in rows) == [(i, float(i)) for i in range(5)]  # no row twice
    shutil.rmtree(next((tmp_path / "out" / "finished").rglob("ite=3")))
    assert [r.ite for r in E.left(spark, runs, out).collect()] == [3]
    assert E.run_missing(spark, runs, out, body) == 1 and spark.read.parquet(f"{out}/scores").count() == 5


def test_net_on_pairs(spark, tmp_path):
    rows = [(p, m) for p in range(12) for m in range(15) if (p + m) % 3 == 0]
    prot = spark.createDataFrame([(p, [float(p % 3 == r) for r in range(3)]) for p in range(12)], "prot_id long, pf array<double>")
    mol = spark.createDataFrame([(m, [float(m % 3 == r) for r in range(3)]) for m in range(15)], "mol_id long, mf array<double>")
    inter = spark.createDataFrame(rows, "prot_id long, mol_id long")
    files.write_folds(S.setting1(inter, prot, mol, ratios=(2, 1)), str(tmp_path / "folds"))
    body = E.pair_net_run(spark, str(tmp_path / "folds"), prot, mol, N.Net(6, (12,), 1), epochs=8, batch=40, rate=0.05, metric="rocauc", patience=3)
    runs = E.rotations(spark, "d", 1, [1], [2], attempts=2).where("ite = 0")
    out = str(tmp_path / "out")
    assert E.run_missing(spark, runs, out, body) == 2
    scores = spark.read.parquet(f"{out}/scores")
    best = E.best_attempts(scores)
    assert best.select("attempt").distinct().count() == 1 and {r.score_name for r in best.collect()} == {"aupr", "rocauc", "f1", "recall", "precision", "acc"}
    assert best.where("score_name = 'rocauc'").first().value > 80
    assert spark.read.parquet(f"{out}/predictions").where("attempt = 0").count() == files.read_folds(spark, str(tmp_path / "folds"), 2, 0, 1)["test"].count()
    assert spark.read.parquet(f"{out}/log").select(F.max("epoch")).first()[0] <= 7


def test_features_of_entities_are_not_broadcast(spark):
    from dockyard.operators.learners import kronecker_features

    prot = spark.createDataFrame([(1, [1.0, 2.0])], "prot_id long, pf array<double>")
    mol = spark.createDataFrame([(5, [3.0])], "mol_id long, mf array<double>")
    met = kronecker_features(spark.createDataFrame([(1, 5)], "prot_id long, mol_id long"), prot, mol)
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.first().x == [3.0, 6.0]
