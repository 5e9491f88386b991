"""Phases of a profile, and their expansion onto the tick grid.

A phase is one row until the very end of a plan.  It is first cut into slices of
at most `SLICE_TICKS` ticks, the slices are spread over the cluster, and only
then do ticks come into being, so a query that ran for weeks neither builds a huge
array nor keeps a single task busy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import tick_floor
from tickloom.functions.states import CODES, phases, state_code
from tickloom.model import DEFAULT_TICK_MS, STATE_START_COLUMNS

SLICE_TICKS = 36_000
# Tasks get about as many ticks at most; small expansions are spread finer.
TICKS_PER_TASK, TICKS_PER_SMALL_TASK = 2_000_000, 200_000


def profile_phases(profiles: DataFrame, keep: list[str], only: int | None = None) -> DataFrame:
    """Phases of parsed profiles, one row each, beside the columns ``keep``."""
    starts = [f"get(stateStarts, {c})" for c in CODES]
    ready = profiles.selectExpr(
        *keep,
        "highestState AS highest",
        "get(stateStarts, highestState) AS highestStart",
        *_seen(starts),
    )
    return _unnest(ready, keep, only)


def header_phases(queries: DataFrame, keep: list[str], only: int | None = None) -> DataFrame:
    """The same phases from the state columns of the ``queries`` table."""
    coded = queries.select(*keep, *STATE_START_COLUMNS, state_code("finalState").alias("highest"))
    ready = coded.selectExpr(
        *keep,
        "highest",
        f"get(array({', '.join(STATE_START_COLUMNS)}), highest) AS highestStart",
        *_seen(STATE_START_COLUMNS),
    )
    return _unnest(ready, keep, only)


def _seen(starts: Sequence[str]) -> list[str]:
    return [f"CASE WHEN {s} > 0 THEN {s} END AS seen{c}" for c, s in enumerate(starts)]


def _unnest(ready: DataFrame, keep: list[str], only: int | None) -> DataFrame:
    seen = [f"seen{c}" for c in CODES]
    codes = CODES if only is None else [only]
    rows = ready.select(*keep, "highest", F.inline(phases(seen, "highestStart", codes)))
    return rows.where("startMs IS NOT NULL").selectExpr(
        *keep,
        "state AS queryState",
        "startMs AS phaseStartMs",
        "endMs AS phaseEndMs",
        "durationMs AS stateDurationMs",
        "state = highest AS isHighest",
    )


def tick_ranges(phase_rows: DataFrame, tick_ms: int) -> DataFrame:
    """First and last tick of each phase that has ticks.

    Both ends count, so neighbouring phases share a tick.  The highest state never
    has ticks, nor does a phase that ends in a tick before the one it starts in.
    """
    return (
        phase_rows.where("NOT isHighest")
        .withColumn("firstTick", tick_floor(F.col("phaseStartMs"), tick_ms))
        .withColumn("lastTick", tick_floor(F.col("phaseEndMs"), tick_ms))
        .where("lastTick >= firstTick")
        .drop("isHighest", "phaseStartMs", "phaseEndMs")
    )


def sliced(ranges: DataFrame, tick_ms: int, slice_ticks: int | None = None) -> DataFrame:
    """Each range once for every slice of it: ``sliceTick`` in place of ``firstTick``."""
    slice_ticks = slice_ticks or SLICE_TICKS
    first, last = F.col("firstTick"), F.col("lastTick")
    width = F.lit(tick_ms * slice_ticks).cast("bigint")
    rest = [c for c in ranges.columns if c not in ("firstTick", "lastTick")]
    return ranges.select(
        *rest,
        "lastTick",
        F.explode(F.when(last >= first, F.sequence(first, last, width))).alias("sliceTick"),
    )


def expanded(slices: DataFrame, tick_ms: int, slice_ticks: int | None = None) -> DataFrame:
    """One row per tick of each slice of `sliced`."""
    slice_ticks = slice_ticks or SLICE_TICKS
    tick = F.lit(tick_ms).cast("bigint")
    rest = [c for c in slices.columns if c not in ("sliceTick", "lastTick")]
    slice_end = F.least(F.col("lastTick"), F.col("sliceTick") + tick * (slice_ticks - 1))
    return slices.select(
        F.explode(F.sequence(F.col("sliceTick"), slice_end, tick)).alias("tickMs"), *rest
    )


def spread_and_expand(
    ranges: DataFrame, tick_ms: int, key: list[str], partitions: int | None = None
) -> DataFrame:
    """One row per tick of each range.

    What moves between tasks is slices, not ticks.  The number of partitions is
    given outright because adaptive execution would merge partitions by their size
    before the expansion; `task_count` says how many suit a number of ticks, and
    without ``partitions`` the session's number is taken.
    """
    n = partitions or shuffle_partitions(ranges)
    return expanded(sliced(ranges, tick_ms).repartition(n, *key, "sliceTick"), tick_ms)


def per_piece(queries: DataFrame, keep: list[str], last: str, name: str) -> DataFrame:
    """Columns ``keep`` of each query once per piece of its longest phase, numbered from 0 in ``name``.

    ``last`` is the number of the last piece of a phase from ``s`` to ``e``.
    """
    starts = F.expr(f"filter(array({', '.join(STATE_START_COLUMNS)}), s -> s > 0)").alias("starts")
    longest = f"array_max(zip_with(slice(starts, 2, {len(CODES)}), starts, (e, s) -> {last}))"
    held = queries.select(*keep, starts).select(*keep, F.expr(f"greatest(0L, coalesce({longest}, 0L))").alias("last"))
    return held.select(*keep, F.explode(F.expr("sequence(0L, last)")).alias(name))


def wide_ticks(queries: DataFrame, keep: list[str], tick_ms: int, partitions: int) -> DataFrame:
    """One row per tick of each phase of ``queries``, beside wide columns such as a text.

    A query moves once with all its phases, or once per slice of its longest one; they are
    unnested after that.  Same rows as `tick_ranges` and `spread_and_expand`.
    """
    width, tick = tick_ms * SLICE_TICKS, lambda ms: f"({ms} - pmod({ms}, {int(tick_ms)}L))"
    header = list(dict.fromkeys(["qNum", *keep, *STATE_START_COLUMNS, "finalState"]))
    placed = per_piece(queries, header, f"({tick('e')} - {tick('s')}) div {width}", "slice")
    moved = placed.repartition(partitions, "qNum", "slice")
    ranges = tick_ranges(header_phases(moved, [*keep, "slice"]), tick_ms)
    unnested = ranges.where(f"slice <= (lastTick - firstTick) div {width}")
    return expanded(
        unnested.withColumn("sliceTick", F.expr(f"firstTick + slice * {width}")).drop("slice", "firstTick"), tick_ms
    )


def task_count(df: DataFrame, ticks: int) -> int:
    """Tasks for an expansion: growing with the ticks, and not bound by a setting."""
    small = min(shuffle_partitions(df), -(-ticks // TICKS_PER_SMALL_TASK))
    return max(1, small, -(-ticks // TICKS_PER_TASK))


def ticks_in_range(tick_ms: int) -> Column:
    return F.expr(f"(lastTick - firstTick) div {int(tick_ms)} + 1")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, partitions: int | None, *key: str) -> DataFrame:
    """``df`` by ``key`` in so many partitions, or in as many as the session and adaptive execution give it."""
    return df.repartition(partitions, *key) if partitions else df.repartition(*key)


def ticks_table(
    numbered: DataFrame, tick_ms: int = DEFAULT_TICK_MS, partitions: int | None = None
) -> DataFrame:
    """``(tickMs, qNum, queryState, stateDurationMs)`` of numbered profiles."""
    ranges = tick_ranges(profile_phases(numbered, ["qNum"]), tick_ms)
    ticks = spread_and_expand(ranges, tick_ms, ["qNum", "queryState"], partitions)
    return ticks.select("tickMs", "qNum", "queryState", "stateDurationMs")


def ticks_per_state(ticks: DataFrame) -> DataFrame:
    """Per state, how many values each column of ``ticks`` has."""
    return ticks.groupBy("queryState").agg(
        *[F.count(c).alias(c) for c in ("tickMs", "qNum", "stateDurationMs")]
    )


def expected_ticks_per_state(ranges: DataFrame, tick_ms: int) -> DataFrame:
    """The same count worked out from the phases, without expanding them."""
    return ranges.groupBy("queryState").agg(F.sum(ticks_in_range(tick_ms)).alias("expectedTicks"))


def reconcile(profiles: DataFrame, ticks: DataFrame, tick_ms: int) -> DataFrame:
    """Expected beside stored tick counts; a row with differing numbers is a fault."""
    ranges = tick_ranges(profile_phases(profiles, []), tick_ms)
    return expected_ticks_per_state(ranges, tick_ms).join(
        ticks_per_state(ticks), "queryState", "full_outer"
    )
