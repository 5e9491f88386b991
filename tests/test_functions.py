"""Scalar expressions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars


def values(spark, ddl, data, expression):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], f"i INT, {ddl}")
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_tick_floor(spark):
    got = values(
        spark, "ms BIGINT", [(0,), (99,), (100,), (1234,), (-1,)], scalars.tick_floor(F.col("ms"), 100)
    )
    assert got == [0, 0, 100, 1200, -100]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_tick_timestamp_ignores_the_session_zone(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    got = values(spark, "ms BIGINT", [(1700000000123,)], scalars.tick_timestamp(F.col("ms")))
    assert got == [datetime(2023, 11, 14, 22, 13, 20, 123000)]


def test_round_half_even(spark):
    data = [(2.5,), (3.5,), (0.5,), (-0.5,), (float("nan"),), (float("inf"),), (1e300,), (None,)]
    got = values(spark, "x DOUBLE", data, scalars.round_half_even(F.col("x")))
    assert got == [2, 4, 0, 0, None, None, None, None]


def test_memory(spark):
    data = [(1048576,), (46399488,), (None,), (0,)]
    assert values(spark, "b BIGINT", data, scalars.memory_mb(F.col("b"))) == [1.0, 44.3, None, 0.0]


def test_node_id(spark):
    data = [("10.0.0.1", 45678), (None, 1), ("a", None)]
    got = values(spark, "a STRING, p BIGINT", data, scalars.node_id(F.col("a"), F.col("p")))
    assert got == ["10.0.0.1:45678", None, None]


def test_state_labels(spark):
    data = [(6, "EXECUTION_PLANNING"), (11, "FAILED"), (6, None)]
    for spaced, first in ((True, "06 (EXECUTION PLANNING)"), (False, "06 (EXECUTION_PLANNING)")):
        label = scalars.state_label(F.col("c"), F.col("n"), spaced=spaced)
        assert values(spark, "c BIGINT, n STRING", data, label) == [first, "11 (FAILED)", None]


def test_duration_seconds(spark):
    data = [(1234,), (0,), (-40,), (None,)]
    got = values(spark, "ms BIGINT", data, scalars.duration_seconds(F.col("ms")))
    assert got == [1.234, 0.0, 0.0, 0.0]


def test_chunk_count_and_first_chunk(spark):
    data = [("",), ("abc",), ("abcd",), ("a😀bc",)]
    assert values(spark, "t STRING", data, scalars.chunk_count(F.col("t"), 3)) == [0, 1, 2, 2]
    got = values(spark, "t STRING", data, scalars.first_chunk(F.col("t"), 3))
    assert got == ["", "abc", "abc", "a😀b"]
