"""DuckDB answers to the registered queries, written independently of the library.

Each answer starts from `PROFILES` and `NODES`; the states of a profile become rows
and its phases come from a window over them, where the library works inside arrays.
"""

from __future__ import annotations

from checks.derived_profiles import CHUNK_SIZE, NODES, PROFILES, TICK_MS

# The state names.
_STATES = """
  SELECT CAST(id AS BIGINT) AS id, stateName FROM (VALUES (0,'INVALID_STATE'),(1,'PENDING'),(2,'METADATA_RETRIEVAL'),(3,'PLANNING'),
    (4,'QUEUED'),(5,'ENGINE_START'),(6,'EXECUTION_PLANNING'),(7,'STARTING'),(8,'RUNNING'),
    (9,'COMPLETED'),(10,'CANCELED'),(11,'FAILED')) AS v(id, stateName)
"""

_COMMON = f"""
WITH prof AS ({PROFILES}),
nodes AS ({NODES}),
state_names AS ({_STATES}),
marks AS (
  SELECT k, CAST(c AS BIGINT) AS c, t FROM (
    SELECT k, 1 AS c, s1 AS t FROM prof UNION ALL SELECT k, 2, s2 FROM prof
    UNION ALL SELECT k, 3, s3 FROM prof UNION ALL SELECT k, 4, s4 FROM prof
    UNION ALL SELECT k, 6, s6 FROM prof UNION ALL SELECT k, 7, s7 FROM prof
    UNION ALL SELECT k, 8, s8 FROM prof UNION ALL SELECT k, tc, st FROM prof) u
  WHERE t IS NOT NULL),
phases AS (
  SELECT k, c AS state, t AS startMs,
    coalesce(lead(t) OVER (PARTITION BY k ORDER BY c), t) AS endMs,
    coalesce(lead(t) OVER (PARTITION BY k ORDER BY c), t) - t AS durationMs,
    max(c) OVER (PARTITION BY k) AS top
  FROM marks),
ticks AS (
  SELECT k, state, durationMs,
    unnest(range(startMs//{TICK_MS}*{TICK_MS}, endMs//{TICK_MS}*{TICK_MS}+{TICK_MS}, {TICK_MS})) AS tickMs
  FROM phases WHERE state < top),
finals AS (
  SELECT p.k, s.stateName AS finalState
  FROM (SELECT prof.k, coalesce(max(marks.c), 0) AS top FROM prof LEFT JOIN marks ON prof.k = marks.k GROUP BY 1) p
  JOIN state_names s ON s.id = p.top),
queries AS (
  SELECT p.k, queryId, attempt, userId, startMs AS queryStartMs, poolWait AS commandPoolWait,
    fragments AS totalFragments, fragments AS finishedFragments,
    CASE WHEN planningStart <> 0 THEN planningStart END AS planningStartMs,
    planningEnd AS planningEndMs,
    CASE WHEN has_exec AND has_type THEN startMs + 60 END AS resourceSchedulingStartMs,
    CASE WHEN has_exec AND has_type THEN startMs + 90 END AS resourceSchedulingEndMs,
    CASE WHEN has_exec AND has_type THEN queueName END AS queueName,
    CASE WHEN has_exec AND has_type THEN 'rule_' || CAST(p.k % 4 AS VARCHAR) END AS ruleName,
    CASE WHEN has_exec AND has_type THEN p.k + p.k % 2 END AS queryCost,
    CASE WHEN has_exec AND has_type THEN 'type_' || CAST(p.k % 3 AS VARCHAR) END AS queryType,
    CASE WHEN has_exec THEN startMs + 860 END AS executionStartMs,
    endMs AS queryEndMs, query, left(query, {CHUNK_SIZE}) AS queryTextFirstChunk,
    CAST(ceil(length(query) / {CHUNK_SIZE}.0) AS BIGINT) AS nrQueryChunks, f.finalState
  FROM prof p JOIN finals f ON f.k = p.k),
v1 AS (
  SELECT epoch_ms(tickMs) AS tickTs, tickMs, durationMs AS stateDurationMs, queryId, userId, finalState,
    totalFragments, queueName, queryType, endpointAddress, endpointFabricPort,
    round(maxMemoryUsed / 1024.0 / 1024.0, 1) AS maxMemMb, queryTextFirstChunk AS query
  FROM ticks JOIN nodes USING (k) JOIN queries USING (k) WHERE state = 8),
v2 AS (
  SELECT tickTs, tickMs, queryId, userId, queueName, finalState, queryType,
    endpointAddress || ':' || CAST(endpointFabricPort AS VARCHAR) AS nodeId,
    count(*) AS queryCount, CAST(sum(totalFragments) AS BIGINT) AS fragments, sum(maxMemMb) AS memMb
  FROM v1 GROUP BY ALL),
named AS (
  SELECT t.*, q.*, lpad(CAST(t.state AS VARCHAR), 2, '0') AS code, s.stateName
  FROM ticks t JOIN queries q ON q.k = t.k LEFT JOIN state_names s ON s.id = t.state)
"""

_LABEL_RAW = "code || ' (' || stateName || ')'"
_LABEL_SPACED = "code || ' (' || replace(stateName, '_', ' ') || ')'"
_SECONDS = "CASE WHEN durationMs > 0 THEN round(durationMs / 1000.0, 3) ELSE 0.0 END"

_V1 = "SELECT * FROM v1"
_V2 = "SELECT * FROM v2"
_V3 = """
SELECT tickTs, tickMs, queryId, userId, queueName, finalState, queryType, count(*) AS nodeCount,
  avg(fragments) AS avgFragmentsPerNode, max(fragments) AS maxFragmentsPerNode,
  round(avg(memMb), 1) AS avgMemMbPerNode, max(memMb) AS maxMemMbPerNode
FROM v2 GROUP BY ALL
"""
_V4 = f"""
SELECT epoch_ms(tickMs) AS ts, tickMs, userId, queryType, queryId, finalState, totalFragments, queueName,
  {_LABEL_SPACED} AS queryState, {_SECONDS} AS stateDurationSec, queryTextFirstChunk AS queryText
FROM named
"""
_V5 = f"""
SELECT epoch_ms(tickMs) AS ts, tickMs, userId, finalState AS finalstate, {_LABEL_RAW} AS queryState,
  count(*) AS totalQueries, max(durationMs) AS maxDuration, round(avg(durationMs), 1) AS avgDuration,
  min(durationMs) AS minDuration, CAST(sum(durationMs) AS BIGINT) AS sumDuration
FROM named GROUP BY ALL
"""
_HEADER = """
SELECT queryId, attempt, userId, queryStartMs, commandPoolWait, totalFragments, finishedFragments,
  planningStartMs, planningEndMs, executionStartMs, queryEndMs FROM queries
"""
_SCHEDULING = """
SELECT queryId, attempt, resourceSchedulingStartMs, resourceSchedulingEndMs, queueName, ruleName,
  queryCost, queryType FROM queries
"""
_CHUNKS = f"""
SELECT queryId, attempt, i AS chunkNum,
  substr(query, CAST(i*{CHUNK_SIZE}+1 AS BIGINT), {CHUNK_SIZE}) AS chunkText
FROM (SELECT queryId, attempt, query, unnest(range(0, nrQueryChunks)) AS i FROM queries) c
"""
_PIVOT = """
SELECT q.queryId, q.attempt, CAST(NULL AS BIGINT) AS stateInvalidMs, s1 AS statePendingMs,
  s2 AS stateMetadataRetrievalMs, s3 AS statePlanningMs, s4 AS stateQueuedMs,
  s5 AS stateEngineStartMs, s6 AS stateExecutionPlanningMs, s7 AS stateStartingMs,
  s8 AS stateRunningMs, CASE WHEN tc = 9 THEN st END AS stateCompletedMs,
  CASE WHEN tc = 10 THEN st END AS stateCanceledMs, CASE WHEN tc = 11 THEN st END AS stateFailedMs
FROM queries q JOIN prof p ON p.k = q.k
"""
_PER_STATE = """
SELECT state AS queryState, count(*) AS tickMs, count(*) AS qNum, count(*) AS stateDurationMs
FROM ticks GROUP BY 1
"""
_TABLE_ROWS = """
SELECT 'queries' AS tableName, count(*) AS n, CAST(sum(queryStartMs % 3600000 + totalFragments) AS BIGINT) AS content FROM queries
UNION ALL SELECT 'query_text', count(*), CAST(sum(length(chunkText) * (chunkNum + 1)) AS BIGINT) FROM (""" + _CHUNKS + """) t
UNION ALL SELECT 'nodes', count(*), CAST(sum(maxMemoryUsed + endpointFabricPort) AS BIGINT) FROM nodes
UNION ALL SELECT 'ticks', count(*), CAST(sum(tickMs % 3600000 + durationMs * state) AS BIGINT) FROM ticks
"""
_STORED = """
SELECT queryId, attempt, userId, queryStartMs, finalState, nullif(length(query), 0) AS textLength,
  (SELECT CAST(sum(maxMemoryUsed) AS BIGINT) FROM nodes n WHERE n.k = q.k) AS memory, t.ticks, t.tickSum
FROM queries q LEFT JOIN (SELECT k, count(*) AS ticks, CAST(sum(tickMs % 3600000) AS BIGINT) AS tickSum FROM ticks GROUP BY k) t ON t.k = q.k
"""
_NUMBERS = "SELECT CAST(1 AS BIGINT) AS firstNumber, count(*) AS lastNumber, count(*) AS numbers FROM prof"

_ANSWERS = {
    # sources and sinks
    "scan_profiles": """SELECT userId, queryStartMs, queryEndMs, length(query) AS textLength,
        (SELECT count(*) FROM nodes n WHERE n.k = q.k) AS nodes FROM queries q""",
    "split_file_lines": """SELECT 'profile_' || queryId || '.json' AS file_name, attempt, CAST(0 AS BIGINT) AS shift, startMs FROM prof""",
    "parse_profiles": """SELECT queryId, attempt, userId, queryStartMs, query AS queryText,
        (SELECT count(*) FROM marks m WHERE m.k = q.k) + (SELECT count(s5) FROM prof p WHERE p.k = q.k) AS states,
        (SELECT count(*) FROM nodes n WHERE n.k = q.k) AS nodes FROM queries q""",
    "quarantine": f"""SELECT 'profile_' || queryId || '.json' AS file_name, attempt,
        CASE k % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'stateList' ELSE 'malformed JSON' END AS problem
        FROM prof WHERE k % 7 = 0""",
    "query_id_from_file": "SELECT queryId, count(*) AS n FROM prof GROUP BY 1",
    "write_tables": _TABLE_ROWS,
    "replace_tables": _TABLE_ROWS,
    "replace_then_append": _TABLE_ROWS,
    "rerun_tables": _TABLE_ROWS,
    "skip_existing": _STORED,
    "broken_rerun": """SELECT 'broken off' AS run, * FROM (
          SELECT 'queries' AS tableName, count(*) AS n, CAST(sum(queryStartMs % 3600000 + totalFragments) AS BIGINT) AS content FROM queries WHERE attempt = 0
          UNION ALL SELECT 'query_text', count(*), CAST(sum(length(chunkText) * (chunkNum + 1)) AS BIGINT) FROM (""" + _CHUNKS + """) t WHERE attempt = 0
          UNION ALL SELECT 'nodes', count(*), CAST(sum(maxMemoryUsed + endpointFabricPort) AS BIGINT) FROM nodes JOIN queries USING (k) WHERE attempt = 0
          UNION ALL SELECT 'ticks', count(*), CAST(sum(tickMs % 3600000 + durationMs * state) AS BIGINT) FROM ticks JOIN queries USING (k) WHERE attempt = 0) b
        UNION ALL SELECT 'done' AS run, * FROM (""" + _TABLE_ROWS + """) d""",
    "same_name_other_content": """SELECT q.k, 'n' || CAST(q.k % 7 AS VARCHAR) AS queryId,
          CASE WHEN queryStartMs < 1700001200000 THEN replace(userId, 'u', 'w') ELSE userId END AS userId, queryStartMs, t.ticks
        FROM queries q LEFT JOIN (SELECT k, count(*) AS ticks FROM ticks GROUP BY k) t ON t.k = q.k
        WHERE queryStartMs < 1700001200000 OR queryStartMs >= 1700002400000""",
    "ingest_range": "SELECT min(startMs) AS firstStartMs, max(startMs) AS lastStartMs FROM prof",
    "ingest_stream": "SELECT userId, queryStartMs, finalState, textLength, memory, ticks, tickSum FROM (" + _STORED + ") s",
    "sorted_headers": "SELECT CAST(0 AS BIGINT) AS outOfOrder, count(*) AS n FROM prof",
    "ticks_of_an_hour": """SELECT tickMs, count(*) AS n, CAST(sum(durationMs) AS BIGINT) AS sumDuration FROM ticks
        WHERE state = 3 AND tickMs // 3600000 = 1700000000000 // 3600000 GROUP BY tickMs""",
    "register_views": f"""SELECT 'profileTicksNodes' AS viewName, count(*) AS n, CAST(sum(tickMs % 3600000 + stateDurationMs) AS BIGINT) AS content, sum(maxMemMb) AS numbers FROM v1
        UNION ALL SELECT 'profileTickNodeAgg_1', count(*), CAST(sum(tickMs % 3600000 + queryCount * fragments) AS BIGINT), sum(memMb) FROM v2
        UNION ALL SELECT 'profileTickNodeAgg', count(*), CAST(sum(tickMs % 3600000 + nodeCount * maxFragmentsPerNode) AS BIGINT), sum(maxMemMbPerNode) FROM ({_V3}) v3
        UNION ALL SELECT 'profileStateTick', count(*), CAST(sum(tickMs % 3600000 + CAST(round(stateDurationSec * 1000) AS BIGINT)) AS BIGINT), CAST(sum(length(queryState)) AS DOUBLE) FROM ({_V4}) v4
        UNION ALL SELECT 'profile_state_tick_agg', count(*), CAST(sum(tickMs % 3600000 + totalQueries * sumDuration) AS BIGINT), CAST(sum(maxDuration - minDuration) AS DOUBLE) FROM ({_V5}) v5""",
    "state_names": """SELECT id, s.stateName, count(q.k) AS profiles FROM state_names s
        LEFT JOIN queries q ON q.finalState = s.stateName GROUP BY 1, 2""",
    # projections, filters, scalar functions
    "query_header": _HEADER,
    "scheduling_group": _SCHEDULING,
    "query_cost": "SELECT queryId, attempt, queryCost FROM queries",
    "query_text_first_chunk": "SELECT queryId, attempt, queryTextFirstChunk FROM queries",
    "query_chunk_count": "SELECT queryId, attempt, nrQueryChunks FROM queries",
    "tick_floor": f"SELECT queryId, attempt, startMs - startMs % {TICK_MS} AS startTick FROM prof",
    "final_state": "SELECT queryId, attempt, finalState FROM queries",
    "tick_timestamp": "SELECT queryId, attempt, epoch_ms(startMs) AS startTs FROM prof",
    "running_ticks": """SELECT queryId, attempt, tickMs, durationMs AS stateDurationMs
        FROM ticks JOIN prof USING (k) WHERE state = 8""",
    "max_mem_mb": "SELECT l_orderkey, l_linenumber, round(l_partkey * 65536 / 1048576.0, 1) AS maxMemMb FROM lineitem",
    "node_id": """SELECT endpointAddress || ':' || CAST(endpointFabricPort AS VARCHAR) AS nodeId,
        count(*) AS n FROM nodes GROUP BY 1""",
    "state_label_spaced": f"SELECT {_LABEL_SPACED} AS queryState, count(*) AS n FROM named GROUP BY 1",
    "state_label_raw": f"SELECT {_LABEL_RAW} AS queryState, count(*) AS n FROM named GROUP BY 1",
    "state_duration_sec": f"SELECT queryId, attempt, state, {_SECONDS} AS stateDurationSec FROM phases JOIN prof USING (k)",
    # nested data
    "nodes_table": """SELECT queryId, attempt, endpointAddress, endpointFabricPort, maxMemoryUsed,
        enqueuedBeforeSubmitMs FROM nodes JOIN prof USING (k)""",
    "query_text_chunks": _CHUNKS,
    "query_text_rebuild": "SELECT queryId, attempt, query AS queryText FROM queries WHERE query <> ''",
    "state_pivot": _PIVOT,
    "phase_durations": """SELECT queryId, attempt, state, phases.startMs, phases.endMs, durationMs
        FROM phases JOIN prof USING (k)""",
    "ticks_table": """SELECT queryId, attempt, tickMs, state AS queryState, durationMs AS stateDurationMs
        FROM ticks JOIN prof USING (k)""",
    "query_numbers": _NUMBERS,
    "ingest_numbers": _NUMBERS,
    "attempts": "SELECT queryId, count(*) AS attempts, max(attempt) AS lastAttempt FROM prof GROUP BY 1",
    # joins and aggregations
    "left_join_missing_state": """SELECT tickMs, state AS code, CASE WHEN state <> 6 THEN code || ' (' || stateName || ')' END AS queryState,
        count(*) AS n FROM named GROUP BY ALL""",
    "ticks_per_state": _PER_STATE,
    "reconcile": """SELECT state AS queryState, count(*) AS expectedTicks, count(*) AS tickMs,
        count(*) AS qNum, count(*) AS stateDurationMs FROM ticks GROUP BY 1""",
    # views
    "view_ticks_nodes": _V1,
    "view_tick_node_agg_1": _V2,
    "view_tick_node_agg": _V3,
    "view_state_tick": _V4,
    "view_state_tick_agg": _V5,
    "eager_view_tick_node_agg_1": _V2,
    "eager_view_tick_node_agg": _V3,
    "late_view_ticks_nodes": _V1,
    "late_view_tick_node_agg_1": _V2,
    "late_view_tick_node_agg": _V3,
    "late_view_state_tick": _V4,
    "late_view_state_tick_agg": _V5,
    "range_view_state_tick_agg": _V5,
}


def oracle_sql() -> dict[str, str]:
    return {name: _COMMON + body for name, body in _ANSWERS.items()}
