"""Profile lines derived from ``orders`` and ``lineitem``.

The test tables hold no query profiles, so each order becomes one: integer arithmetic
on its key gives the times, and its line items are the executor nodes.  ``PROFILES``
and ``NODES`` are SQL that Spark and DuckDB both run, so both sides of a check start
from the same rows.  The result is real JSON text, read by the real parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.sinks import new_staging_dir
from tickloom.operators.ticks import shuffle_partitions
from tickloom.plans.ingest import IngestReport, ingest_lines
from tickloom.sources.tables import read_tables

TICK_MS = 1000
CHUNK_SIZE = 1000

# All starts fall into one hour and there are five users, so queries really overlap.
# Every tenth order (k % 10 = 2) is a second attempt of the query before it.  Some states have a
# time before that of a lower code, in the same tick or an earlier one, and some the time 0.
PROFILES = """
SELECT o_orderkey AS k,
  concat('q', CAST(o_orderkey - (CASE WHEN o_orderkey%10=2 THEN 1 ELSE 0 END) AS varchar(20))) AS queryId,
  CAST(CASE WHEN o_orderkey%10=2 THEN 1 ELSE 0 END AS bigint) AS attempt,
  concat('u', CAST(o_custkey%5 AS varchar(20))) AS userId,
  b AS startMs, b+k7+1000+(o_orderkey*31)%20000 AS endMs,
  o_orderkey%13 AS poolWait, o_orderkey%50 AS fragments,
  CASE WHEN o_orderkey%41=0 THEN 0 ELSE b+k7+20 END AS planningStart,
  CASE WHEN o_orderkey%43<>0 THEN b+k7+40 END AS planningEnd,
  o_orderkey%5<>0 AS has_exec,
  o_orderkey%35<>1 AS has_type,
  CASE WHEN o_orderkey%35<>2 THEN o_orderpriority END AS queueName,
  CAST(o_orderkey AS double)+0.5 AS queryCost,
  CASE WHEN o_orderkey%103=0 THEN '' ELSE
    concat('SELECT /* ', o_orderpriority, ' */ ', repeat('x', CAST(o_orderkey%2500 AS int))) END AS query,
  CASE WHEN o_orderkey%101<>0 THEN b END AS s1,
  CASE WHEN o_orderkey%101<>0 THEN b+k7 END AS s2,
  CASE WHEN o_orderkey%101<>0 THEN b+k7+20+o_orderkey%53 END AS s3,
  CASE WHEN o_orderkey%101<>0 AND o_orderkey%3=0 THEN b+k7+113+o_orderkey%211
    - (CASE WHEN o_orderkey%74=0 THEN 2900 WHEN o_orderkey%37=0 THEN 400 ELSE 0 END) END AS s4,
  CASE WHEN o_orderkey%101<>0 AND o_orderkey%5<>0 AND o_orderkey%83=0 THEN CAST(0 AS bigint) END AS s5,
  CASE WHEN o_orderkey%101<>0 AND o_orderkey%5<>0 THEN b+k7+800+o_orderkey%13 END AS s6,
  CASE WHEN o_orderkey%101<>0 AND o_orderkey%5<>0 THEN b+k7+830+o_orderkey%17 END AS s7,
  CASE WHEN o_orderkey%101<>0 AND o_orderkey%5<>0 THEN b+k7+860+o_orderkey%19 END AS s8,
  CASE WHEN o_orderkey%101<>0 AND o_orderkey%97<>0 THEN b+k7+1000+(o_orderkey*31)%20000 END AS st,
  CASE o_orderstatus WHEN 'F' THEN 9 WHEN 'P' THEN 10 ELSE 11 END AS tc
FROM (SELECT *, 1700000000000 + (o_orderkey*7919)%3600000 AS b, o_orderkey%7+1 AS k7 FROM orders) x
"""

# Whole megabytes, so that sums and averages are exact in both engines.  Every fifth order
# leaves its items to the next one and has no nodes.
NODES = """
SELECT l_orderkey + (CASE WHEN l_orderkey%5=0 THEN 1 ELSE 0 END) AS k, concat('node-', CAST(l_suppkey%8 AS varchar(20))) AS endpointAddress,
  CAST(45678 + l_linenumber%2 AS bigint) AS endpointFabricPort,
  l_partkey*1048576 AS maxMemoryUsed, CAST(l_linenumber AS bigint) AS enqueuedBeforeSubmitMs
FROM lineitem
"""

_NULL_MARK = "(null)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow row per order is spread before it grows into a document."""
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    spread = orders.repartition(shuffle_partitions(orders), "o_orderkey")
    return spark.sql(PROFILES.replace("FROM orders", "FROM {orders}"), orders=spread)


def derived_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        NODES.replace("FROM lineitem", "FROM {lineitem}"),
        lineitem=_table(spark, sf_dir, "lineitem"),
    )


def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_name, attempt, line)``; a profile's node list is part of its one line."""
    node = F.struct(
        F.struct(
            F.col("endpointAddress").alias("address"),
            F.col("endpointFabricPort").alias("fabricPort"),
        ).alias("endpoint"),
        "maxMemoryUsed",
        F.col("enqueuedBeforeSubmitMs").alias("timeEnqueuedBeforeSubmitMs"),
    )
    nodes = derived_nodes(spark, sf_dir).groupBy("k").agg(F.collect_list(node).alias("nodeProfile"))

    def state(code, start):
        return F.struct(code.cast("int").alias("state"), start.alias("startTime"))

    # A repeated PENDING entry before the real one: the later entry must win.
    earlier = F.when(F.col("k") % 89 == 0, F.col("s1") - 500)
    states = [state(F.lit(1), earlier)]
    states += [state(F.lit(c), F.col(f"s{c}")) for c in range(1, 9)]
    states.append(state(F.col("tc"), F.col("st")))
    state_list = F.filter(F.array(*states), lambda s: s["startTime"].isNotNull())

    has_exec, k, start = F.col("has_exec"), F.col("k"), F.col("startMs")
    properties = F.struct(
        "queryCost",
        F.when(F.col("has_type"), F.concat(F.lit("type_"), (k % 3).cast("string"))).alias("queryType"),
    )
    scheduling = F.struct(
        (start + 60).alias("resourceSchedulingStart"),
        (start + 90).alias("resourceSchedulingEnd"),
        F.coalesce("queueName", F.lit(_NULL_MARK)).alias("queueName"),
        F.concat(F.lit("rule_"), (k % 4).cast("string")).alias("ruleName"),
        properties.alias("schedulingProperties"),
    )
    profile = F.struct(
        F.col("userId").alias("user"),
        start.alias("start"),
        F.col("endMs").alias("end"),
        F.col("poolWait").alias("commandPoolWaitMillis"),
        F.col("fragments").alias("totalFragments"),
        F.col("fragments").alias("finishedFragments"),
        "planningStart",
        "planningEnd",
        F.when(has_exec, start + 860).alias("executionStart"),
        "query",
        F.when(has_exec, scheduling).alias("resourceSchedulingProfile"),
        state_list.alias("stateList"),
        F.coalesce("nodeProfile", F.array().cast(nodes.schema["nodeProfile"].dataType)).alias(
            "nodeProfile"
        ),
    )
    # Absent and null differ in a profile; to_json can only leave a key out.
    line = F.replace(
        F.to_json(profile), F.lit(f'"queueName":"{_NULL_MARK}"'), F.lit('"queueName":null')
    )
    return (
        derived(spark, sf_dir)
        .join(nodes, "k", "left")
        .select(
            F.concat(F.lit("profile_"), "queryId", F.lit(".json")).alias("file_name"),
            "attempt",
            line.alias("line"),
        )
    )


_ingested: dict[tuple[str, str], tuple[str, IngestReport]] = {}


def ingest_derived(spark: SparkSession, sf_dir: str) -> tuple[str, IngestReport]:
    """Run the ingest job on the derived lines, once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingested:
        out = f"{new_staging_dir(spark)}/tables"
        report = ingest_lines(
            profile_lines(spark, sf_dir),
            out,
            tick_ms=TICK_MS,
            chunk_size=CHUNK_SIZE,
            base=0,
            keep_staging=True,
        )
        _ingested[key] = (out, report)
    return _ingested[key]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return read_tables(spark, ingest_derived(spark, sf_dir)[0])
