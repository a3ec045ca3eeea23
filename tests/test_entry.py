import __spark_entry__


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    out = __spark_entry__.entry(spark)
    assert out.columns == ["seg", "outlet", "total", "channel_cells"] and out.count() == 10
