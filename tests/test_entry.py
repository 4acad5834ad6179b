"""The driver's contract: names, SQL and a smoke run."""

import __spark_entry__ as entry


def test_names_and_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 100


def test_flagship(spark):
    df = entry.queries()["cv_fold_counts"](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert {r.ratio for r in rows} == {1, 2, 5, 10} and {r.fold for r in rows} == set(range(5))
