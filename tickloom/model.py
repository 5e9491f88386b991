"""Names, codes and schemas shared by the whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The twelve execution states, in code order 0..11.
STATE_NAMES = (
    "INVALID_STATE",
    "PENDING",
    "METADATA_RETRIEVAL",
    "PLANNING",
    "QUEUED",
    "ENGINE_START",
    "EXECUTION_PLANNING",
    "STARTING",
    "RUNNING",
    "COMPLETED",
    "CANCELED",
    "FAILED",
)

# The column of ``queries`` holding the start of each state, same order.
STATE_START_COLUMNS = (
    "stateInvalidMs",
    "statePendingMs",
    "stateMetadataRetrievalMs",
    "statePlanningMs",
    "stateQueuedMs",
    "stateEngineStartMs",
    "stateExecutionPlanningMs",
    "stateStartingMs",
    "stateRunningMs",
    "stateCompletedMs",
    "stateCanceledMs",
    "stateFailedMs",
)

RUNNING = STATE_NAMES.index("RUNNING")

DEFAULT_TICK_MS = 100
DEFAULT_CHUNK_SIZE = 1000

# The scheduling block is read as raw text: whether one of its keys is absent or
# null matters, and the text is small enough to look at a second time.
PROFILE_DDL = """
    `user` STRING,
    `start` BIGINT,
    `end` BIGINT,
    `commandPoolWaitMillis` BIGINT,
    `totalFragments` BIGINT,
    `finishedFragments` BIGINT,
    `planningStart` BIGINT,
    `planningEnd` BIGINT,
    `executionStart` BIGINT,
    `query` STRING,
    `resourceSchedulingProfile` STRING,
    `stateList` ARRAY<STRUCT<state: INT, startTime: BIGINT>>,
    `nodeProfile` ARRAY<STRUCT<
        endpoint: STRUCT<address: STRING, fabricPort: BIGINT>,
        maxMemoryUsed: BIGINT,
        timeEnqueuedBeforeSubmitMs: BIGINT>>
"""

SCHEDULING_DDL = """
    resourceSchedulingStart BIGINT,
    resourceSchedulingEnd BIGINT,
    queueName STRING,
    ruleName STRING,
    schedulingProperties STRING
"""

SCHEDULING_PROPERTIES_DDL = "queryCost DOUBLE, queryType STRING"

SCHEDULING_COLUMNS = (
    "resourceSchedulingStartMs",
    "resourceSchedulingEndMs",
    "queueName",
    "ruleName",
    "queryCost",
    "queryType",
)

_QUERIES_TYPES = {
    "queryId": "STRING",
    "userId": "STRING",
    "queueName": "STRING",
    "ruleName": "STRING",
    "queryType": "STRING",
    "queryTextFirstChunk": "STRING",
    "finalState": "STRING",
}

QUERIES_COLUMNS = (
    "queryId",
    "qNum",
    "userId",
    "queryStartMs",
    "commandPoolWait",
    "totalFragments",
    "finishedFragments",
    "planningStartMs",
    "planningEndMs",
    *SCHEDULING_COLUMNS,
    "executionStartMs",
    "queryEndMs",
    "queryTextFirstChunk",
    "nrQueryChunks",
    *STATE_START_COLUMNS,
    "finalState",
    "attempt",
)

# Ids, counts and times are BIGINT, and every column may be NULL.
TABLE_DDL = {
    "query_text": "qNum BIGINT, chunkNum BIGINT, chunkText STRING",
    "nodes": (
        "qNum BIGINT, endpointAddress STRING, endpointFabricPort BIGINT, "
        "maxMemoryUsed BIGINT, enqueuedBeforeSubmitMs BIGINT"
    ),
    "ticks": "tickMs BIGINT, qNum BIGINT, queryState BIGINT, stateDurationMs BIGINT",
    "queries": ", ".join(f"{c} {_QUERIES_TYPES.get(c, 'BIGINT')}" for c in QUERIES_COLUMNS),
}

TABLE_NAMES = tuple(TABLE_DDL)


def state_names(spark: SparkSession) -> DataFrame:
    """The 12-row dimension ``(id, stateName)``."""
    return spark.createDataFrame(list(enumerate(STATE_NAMES)), "id BIGINT, stateName STRING")
