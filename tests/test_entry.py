import __spark_entry__


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 1 and "hit" in df.columns
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 70
