import __spark_entry__ as entry


def test_names_match_and_entry_runs(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns
