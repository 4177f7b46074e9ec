def test_entry_and_registry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    df = entry(spark)
    assert df.count() == 200
    assert set(oracle_sql()) <= set(queries())
