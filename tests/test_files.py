"""The readers on small files written here."""

import gzip

import numpy as np

from dockyard.sources import files


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", "x,y,z\n1,,CCO\n0,5,\n1,6,CC\n")
    rows = files.csv_with_row_ids(spark, path, {0: "label", 2: "smiles"}, 3, "smiles").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("0", "1", "CCO"), ("2", "1", "CC")]
    assert files.csv_by_header(spark, path, ["z", "x"]).columns == ["z", "x"]


def test_sdf_and_fasta(spark, tmp_path):
    path = put(tmp_path, "d.sdf", "m\n> <DATABASE_ID>\nDB1\n> <SMILES>\nCCO\n> <MOLECULAR_WEIGHT>\n46.0\n$$$$\nm\n> <DATABASE_ID>\nDB2\n> <SMILES>\nc1ccccc1\n")
    assert sorted(map(tuple, files.sdf(spark, path).collect())) == [("DB1", "CCO", 46.0), ("DB2", "c1ccccc1", None)]
    path = put(tmp_path, "t.fasta", ">sp|P1|NAME one (DB1; DB2)\nMKV\nLLA\n>sp|P2|NAME two (DB3)\nMKXX\n")
    prot, inter = files.target_fasta(spark, path)
    assert sorted(map(tuple, prot.collect())) == [("P1", "MKVLLA"), ("P2", "MKXX")]
    assert sorted(map(tuple, inter.collect())) == [("P1", "DB1"), ("P1", "DB2"), ("P2", "DB3")]
    path = put(tmp_path, "s.fasta", ">d1 a.1.1.1\nmkv\n>d2 c.2.1.1\nmkz\n>d3 g.1.1.1\nll\n")
    assert sorted(map(tuple, files.class_fasta(spark, path).collect())) == [("d1", "MKV", 0), ("d3", "LL", 6)]
    path = put(tmp_path, "Nucleus.fasta", ">Q12345 x\nMKV\n")
    assert files.class_fasta(spark, path, ["Golgi.fasta", "Nucleus.fasta"]).first().y == 1


def test_variants_how_and_kernel(spark, tmp_path):
    path = put(tmp_path, "v.txt", "GENE  P12345  VAR_001  p.Lys2Glu  Disease  x\nheader line\n")
    assert [tuple(r) for r in files.variants(spark, path).collect()] == [("VAR_001", "P12345", "p.Lys2Glu", "Disease", 2)]
    path = put(tmp_path, "a.how", "    4 P1\nMKVL\nSTt.\n    6 P2\nMKV\nLLA\nSSS\n...\n")
    assert sorted(map(tuple, files.annotated(spark, path).collect())) == [("P1", "MKVL", "STT."), ("P2", "MKVLLA", "SSS...")]
    for i, v in ((0, "1.0\n0.5\n0.2\n"), (1, "1.0\n0.4\n"), (2, "")):
        put(tmp_path, f"LA_{i}.txt", v)
    k = files.kernel_rows(spark, str(tmp_path / "LA_*.txt"))
    assert sorted(map(tuple, k.where("k is not null").collect())) == [(0, 0, 1.0), (0, 1, 0.5), (0, 2, 0.2), (1, 1, 1.0), (1, 2, 0.4)]
    assert [r.i for r in files.incomplete_rows(k, 3).collect()] == [2]


def test_npy_and_folds(spark, tmp_path):
    x = np.zeros((1, 5, 57), dtype="float32")
    for pos, (res, y) in enumerate([(0, 3), (1, 1), (20, 0), (21, 8), (21, 8)]):
        x[0, pos, res] = x[0, pos, 22 + y] = 1
    (tmp_path / "p.npy.gz").write_bytes(gzip.compress(_npy(x)))
    row = files.residue_arrays(spark, str(tmp_path / "p.npy.gz"), length=5).first()
    assert (row.id, row.seq, row.y) == ("p.npy.gz-0", "ACX", [3, 1, 0])
    split = spark.createDataFrame([(i, 5, i % 5) for i in range(10)], "id int, ratio int, fold int")
    files.write_folds(split, str(tmp_path / "folds"))
    parts = files.read_folds(spark, str(tmp_path / "folds"), 5, 0, 1)
    assert {k: v.count() for k, v in parts.items()} == {"test": 2, "val": 2, "train": 6}
    files.write_fasta(spark.createDataFrame([("a", "MK")], "id string, seq string"), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 2


def test_results(spark, tmp_path):
    for name in ("EC_0,1_4_5_1", "H_x_2,3_1_1_5", "notes"):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "scores.txt").write_text("aupr 91.5\nrocauc 88\nbad line here\n")
    got = sorted(map(tuple, files.scan_results(spark, str(tmp_path / "runs/*/*")).collect()))
    assert got == [("EC", 0, 1, 4, 5, 1, "aupr", 91.5), ("EC", 0, 1, 4, 5, 1, "rocauc", 88.0), ("H_x", 2, 3, 1, 1, 5, "aupr", 91.5), ("H_x", 2, 3, 1, 1, 5, "rocauc", 88.0)]
    scored = spark.createDataFrame(got, "dataset string, ite int, ival int, setting int, ratio_tr int, ratio_te int, score_name string, score double")
    files.write_results(scored, str(tmp_path / "out"))
    files.write_results(scored.where("dataset = 'EC'"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and "PartitionFilters: [isnotnull(dataset" in back.where("dataset = 'EC'")._jdf.queryExecution().executedPlan().toString()
    assert files.within(scored, "score", high=90).count() == 2 and files.within(scored, "score").count() == 4


def _npy(x):
    import io

    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


def test_weights_by_name(spark, tmp_path):
    schema = "layer string, shape array<int>, values array<float>"
    trained = spark.createDataFrame([("mol_1", [2], [1.0, 2.0]), ("prot_1", [1], [3.0]), ("head", [1], [4.0])], schema)
    files.write_weights(trained, str(tmp_path / "w"), "^(mol|prot)_")
    stored = spark.read.parquet(str(tmp_path / "w"))
    assert {r.layer for r in stored.collect()} == {"mol_1", "prot_1"}
    fresh = spark.createDataFrame([("mol_1", [2], [0.0, 0.0]), ("prot_1", [2], [0.0, 0.0]), ("head", [1], [9.0])], schema)
    got = {r.layer: (r["values"], r.loaded) for r in files.load_weights(fresh, stored).collect()}
    assert got == {"mol_1": ([1.0, 2.0], True), "prot_1": ([0.0, 0.0], False), "head": ([9.0], False)}
    files.write_matrix(spark.createDataFrame([(1, 0, 2.0), (0, 1, 0.0), (0, 0, 1.0)], "i int, j int, k double"), str(tmp_path / "m"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [(0, 0, 1.0), (1, 0, 2.0)]


def test_variants_of_long_keys(spark, tmp_path):
    """Keys of seven digits are cut from the right by the SQL's lpad, so the text must be made the same way."""
    from dockyard.plans.layouts import scan_variants

    spark.createDataFrame([(1199999, 2), (42, 3)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.var_id, r.gene) for r in scan_variants(spark, str(tmp_path)).collect()}
    assert got == {("VAR_119999", "P99999"), ("VAR_000042", "P00042")}


def test_ranged_cells_are_not_sorted(spark, tmp_path, monkeypatch):
    """Cells that come in ranges are written as they come: a sort would write all of them to disk once more."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "sortWithinPartitions", lambda *a, **b: 1 / 0)
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a, **b: 1 / 0)
    files.write_matrix(spark.createDataFrame([(0, 1, 0.0), (0, 0, 1.0)], "i int, j int, k double"), str(tmp_path / "m"), ranged=True)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
