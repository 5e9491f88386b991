"""Content totals of the stored tables, beyond what a BIGINT holds."""

from checks import queries
from checks.queries import text_chunks, text_rebuild, write_tables

ORDERS_DDL = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING"
LINEITEM_DDL = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT"


def test_totals_wrap_around(spark, tmp_path):
    orders = [(k, k, "F", "1-URGENT") for k in (1, 3)]
    items = [(k, 4 * 10**12 + i, 7, i) for k in (1, 3) for i in (1, 2)]
    spark.createDataFrame(orders, ORDERS_DDL).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, LINEITEM_DDL).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.tableName: r for r in write_tables(spark, str(tmp_path)).collect()}
    total = sum(part * 1048576 + 45678 + line % 2 for _, part, _, line in items)
    assert total >= 1 << 63
    assert found["nodes"].n == 4
    assert found["nodes"].content == (total + (1 << 63)) % (1 << 64) - (1 << 63)


def test_chunks_spread_with_their_number(spark, tmp_path, monkeypatch):
    """More chunks make more tasks, whatever the session's number of partitions."""
    orders = [(k, k, "F", "1-URGENT") for k in range(1, 41)]
    spark.createDataFrame(orders, ORDERS_DDL).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([], LINEITEM_DDL).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(queries, "CHUNKS_PER_TASK", 4)
    for query in (text_chunks, text_rebuild):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(qNum" in plan and ", 10), REPARTITION_BY_NUM" in plan
