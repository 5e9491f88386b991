"""Lines of JSON to typed profiles.

Each line is parsed once.  The parse sits inside ``inline``, which keeps Catalyst
from copying it into the filters and projections above.  Costlier questions (is a
key absent, or present and null?) are asked only of the rows that show a NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import none_if_zero, round_half_even
from tickloom.functions.states import highest_state, state_starts
from tickloom.model import (
    PROFILE_DDL,
    SCHEDULING_COLUMNS,
    SCHEDULING_DDL,
    SCHEDULING_PROPERTIES_DDL,
    STATE_NAMES,
)
from tickloom.sources.profile_files import query_id_from_file

# Texts of any length: the parser's own limit is 20 million characters.
JSON_OPTIONS = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "maxStringLen": "2147483647"}
# Set by the parser on a line with anything wrong in it, be it only an optional field.
OBJECTION = "_objection"

# Must be there, and must have a value.
NEEDED = ("start", "query", "stateList")
# Must be there; a JSON null is a value like any other.
NEEDED_OR_NULL = (
    "user",
    "end",
    "commandPoolWaitMillis",
    "totalFragments",
    "finishedFragments",
    "planningStart",
    "nodeProfile",
)

_GROUP_KEYS = (
    "resourceSchedulingStart",
    "resourceSchedulingEnd",
    "queueName",
    "ruleName",
    "schedulingProperties",
)
_NUMBERS = (
    "start",
    "end",
    "commandPoolWaitMillis",
    "totalFragments",
    "finishedFragments",
    "planningStart",
    "planningEnd",
    "executionStart",
)
# The same fields, with numbers in any form.
_ANY_NUMBER_DDL = PROFILE_DDL.replace("BIGINT", "DOUBLE").replace("state: INT", "state: DOUBLE")

_NODE_KEYS = ("endpoint", "maxMemoryUsed", "timeEnqueuedBeforeSubmitMs")
_ENDPOINT_KEYS = ("address", "fabricPort")


def parse_profiles(lines: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row per line of ``(file_name, attempt, line)``.

    ``problem`` is NULL for a usable profile and otherwise says that the JSON is
    malformed, or which keys are missing or wrong; such rows keep their ``line``.  With ``strict`` the first one
    fails the job instead.
    """
    parsed = lines.select(
        "file_name",
        "attempt",
        "line",
        F.inline(
            F.array(
                F.from_json(
                    "line",
                    f"{PROFILE_DDL}, `{OBJECTION}` STRING",
                    JSON_OPTIONS | {"columnNameOfCorruptRecord": OBJECTION},
                )
            )
        ),
    )
    checked = _with_problem(_with_number_forms(parsed))
    if strict:
        where = F.concat_ws(" ", F.col("file_name"), F.lit("line"), F.col("attempt"), "problem")
        checked = checked.withColumn(
            "problem", F.when(F.col("problem").isNotNull(), F.raise_error(where)).cast("string")
        )
    # Twelve slots are looked up in the reversed list; behind the fence it is reversed once.
    reversed_list = {"codes": F.reverse("stateList.state"), "times": F.reverse("stateList.startTime")}
    scheduled = _fenced(_with_scheduling(checked).withColumns(reversed_list))
    return scheduled.select(
        query_id_from_file(F.col("file_name")).alias("queryId"),
        "attempt",
        F.col("user").alias("userId"),
        F.col("start").alias("queryStartMs"),
        F.col("end").alias("queryEndMs"),
        F.col("commandPoolWaitMillis").alias("commandPoolWait"),
        "totalFragments",
        "finishedFragments",
        none_if_zero(F.col("planningStart")).alias("planningStartMs"),
        F.col("planningEnd").alias("planningEndMs"),
        *SCHEDULING_COLUMNS,
        F.col("executionStart").alias("executionStartMs"),
        F.col("query").alias("queryText"),
        state_starts("codes", "times").alias("stateStarts"),
        highest_state("stateList").alias("highestState"),
        "nodeProfile",
        "problem",
        "file_name",
        F.when(F.col("problem").isNotNull(), F.col("line")).alias("line"),
    )


def usable(profiles: DataFrame) -> DataFrame:
    return profiles.where("problem IS NULL").drop("problem", "file_name", "line")


def quarantined(profiles: DataFrame) -> DataFrame:
    return profiles.where("problem IS NOT NULL").select("file_name", "attempt", "problem", "line")


def _whole(value: str) -> str:
    """A whole number however it is written (``1000.0``, ``1e3``); NULL for a fraction."""
    return (
        f"CASE WHEN abs({value}) < 9007199254740992 AND {value} = floor({value})"
        f" THEN CAST({value} AS BIGINT) END"
    )


def _with_number_forms(parsed: DataFrame) -> DataFrame:
    """Whole numbers that are not written as integers.

    Only lines with an objection are read a second time.  What the first reading
    understood stays as it is.
    """

    def known(field: str, again: str, kind: str = "BIGINT") -> str:
        return f"coalesce({field}, CAST({_whole(again)} AS {kind}))"

    states = f"""transform(again.stateList, (a, i) -> CASE WHEN a IS NOT NULL THEN named_struct(
        'state', {known("get(stateList, i).state", "a.state", "INT")},
        'startTime', {known("get(stateList, i).startTime", "a.startTime")}) END)"""
    nodes = f"""transform(again.nodeProfile, (a, i) -> CASE WHEN a IS NOT NULL THEN named_struct(
        'endpoint', CASE WHEN a.endpoint IS NOT NULL THEN named_struct(
            'address', a.endpoint.address,
            'fabricPort', {known("get(nodeProfile, i).endpoint.fabricPort", "a.endpoint.fabricPort")}) END,
        'maxMemoryUsed', {known("get(nodeProfile, i).maxMemoryUsed", "a.maxMemoryUsed")},
        'timeEnqueuedBeforeSubmitMs',
        {known("get(nodeProfile, i).timeEnqueuedBeforeSubmitMs", "a.timeEnqueuedBeforeSubmitMs")}) END)"""
    again = F.when(F.col(OBJECTION).isNotNull(), F.from_json("line", _ANY_NUMBER_DDL, JSON_OPTIONS))
    read = parsed.withColumn("again", again)
    changed = {c: F.expr(known(_q(c), f"again.{_q(c)}")) for c in _NUMBERS}
    for c, value in (("stateList", states), ("nodeProfile", nodes)):
        changed[c] = F.expr(f"CASE WHEN again IS NULL THEN {c} ELSE coalesce({value}, {c}) END")
    return _fenced(read.withColumns(changed).drop("again"))


def _fenced(df: DataFrame) -> DataFrame:
    """The same rows; Catalyst does not copy their expressions into what follows."""
    return df.select(F.inline(F.array(F.struct(*(F.col(_q(c)) for c in df.columns)))))


def _with_problem(parsed: DataFrame) -> DataFrame:
    signs = [f"{_q(c)} IS NULL" for c in (*NEEDED, *NEEDED_OR_NULL)]
    signs += [f"{OBJECTION} IS NOT NULL", _STATES_BAD, _NODES_HAVE_NULL]
    marked = parsed.withColumn("suspect", F.expr(" OR ".join(signs)))
    keyed = marked.withColumn("keys", F.expr("CASE WHEN suspect THEN json_object_keys(line) END"))

    found = [F.expr(f"CASE WHEN {_q(c)} IS NULL THEN '{c}' END") for c in NEEDED]
    found += [
        F.expr(
            f"CASE WHEN {_q(c)} IS NOT NULL THEN NULL"
            f" WHEN array_contains(keys, '{c}') AND get_json_object(line, '$.{c}') IS NULL THEN NULL"
            f" ELSE '{c}' END"
        )
        for c in NEEDED_OR_NULL
    ]
    found.append(F.when(F.expr(_STATES_BAD), F.lit("stateList entry")))
    found.append(
        F.when(F.expr(_NODES_HAVE_NULL), F.when(_some_node_is_bad(), F.lit("nodeProfile entry")))
    )
    text = (
        F.when(~F.col("suspect"), F.lit(""))
        .when(F.col("keys").isNull(), F.lit("malformed JSON"))
        .otherwise(F.concat_ws(", ", *found))
    )
    return keyed.withColumn("problem", F.nullif(text, F.lit(""))).drop(
        "suspect", "keys", OBJECTION
    )


def _q(name: str) -> str:
    return f"`{name}`"


def _has_null(path: str) -> str:
    return f"size(array_compact({path})) <> size({path})"


# An entry without a time or a known code.  NULL, hence no objection, without a list.
_STATES_BAD = f"""coalesce(
    {_has_null("stateList.state")} OR {_has_null("stateList.startTime")}
    OR array_min(stateList.state) < 0 OR array_max(stateList.state) >= {len(STATE_NAMES)}, false)"""

_NODES_HAVE_NULL = f"""coalesce(
    {_has_null("nodeProfile.endpoint.address")} OR {_has_null("nodeProfile.endpoint.fabricPort")}
    OR {_has_null("nodeProfile.maxMemoryUsed")}
    OR {_has_null("nodeProfile.timeEnqueuedBeforeSubmitMs")}, false)"""


def _some_node_is_bad() -> Column:
    """A node entry lacks a key, or has a value of a type that cannot be kept.

    A missing entry or endpoint makes the test of an entry NULL, which counts as bad.
    """
    lacking = [f"NOT array_contains(map_keys(e), '{k}')" for k in _NODE_KEYS]
    lacking += [
        f"NOT array_contains(json_object_keys(try_element_at(e, 'endpoint')), '{k}')"
        for k in _ENDPOINT_KEYS
    ]
    mistyped = [
        f"n.{k} IS NULL AND try_element_at(e, '{k}') IS NOT NULL" for k in _NODE_KEYS[1:]
    ]
    mistyped += [
        f"n.endpoint.{k} IS NULL"
        f" AND get_json_object(try_element_at(e, 'endpoint'), '$.{k}') IS NOT NULL"
        for k in _ENDPOINT_KEYS
    ]
    bad = " OR ".join(f"({test})" for test in lacking + mistyped)
    entries = "from_json(line, 'nodeProfile ARRAY<MAP<STRING, STRING>>').nodeProfile"
    tests = f"zip_with(nodeProfile, {entries}, (n, e) -> coalesce({bad}, true))"
    return F.expr(f"coalesce(exists({tests}, b -> b), true)")


def _with_scheduling(checked: DataFrame) -> DataFrame:
    """The six scheduling columns: all taken over, or all NULL.

    They are kept only if every key is there and the cost can be rounded.  A key
    that is there with a JSON null does not blank the others.  The keys themselves
    are looked up only where a value is NULL.
    """
    block = F.coalesce("resourceSchedulingProfile", F.lit("{}"))
    properties = F.coalesce("g.schedulingProperties", F.lit("{}"))
    block_null = " OR ".join(f"g.{k} IS NULL" for k in _GROUP_KEYS)
    read = checked.withColumn("g", F.from_json(block, SCHEDULING_DDL, JSON_OPTIONS)).withColumns(
        {
            "gKeys": F.expr(
                f"CASE WHEN {block_null} THEN json_object_keys(resourceSchedulingProfile) END"
            ),
            "s": F.from_json(properties, SCHEDULING_PROPERTIES_DDL, JSON_OPTIONS),
            "w": F.from_json(
                F.expr("CASE WHEN g.resourceSchedulingStart IS NULL OR g.resourceSchedulingEnd IS NULL THEN resourceSchedulingProfile END"),
                "resourceSchedulingStart DOUBLE, resourceSchedulingEnd DOUBLE",
                JSON_OPTIONS,
            ),
        }
    )
    present = [
        f"(g.{k} IS NOT NULL OR coalesce(array_contains(gKeys, '{k}'), false))" for k in _GROUP_KEYS
    ]
    present.append(
        "(s.queryType IS NOT NULL OR coalesce("
        "array_contains(json_object_keys(g.schedulingProperties), 'queryType'), false))"
    )
    rounded = read.withColumn("cost", round_half_even(F.col("s.queryCost")))
    complete = rounded.withColumn(
        "complete", F.expr(" AND ".join(["cost IS NOT NULL", *present]))
    )
    values = (
        *(f"coalesce(g.{k}, {_whole(f'w.{k}')})" for k in _GROUP_KEYS[:2]),
        "g.queueName",
        "g.ruleName",
        "cost",
        "s.queryType",
    )
    return complete.withColumns(
        {
            c: F.expr(f"CASE WHEN complete THEN {v} END")
            for c, v in zip(SCHEDULING_COLUMNS, values, strict=True)
        }
    )
