"""State lists to phases to ticks."""

import random

import pytest
from helpers import expected_phases, expected_ticks, lines_frame, profile, rows
from pyspark.sql import functions as F

from tickloom.model import STATE_NAMES, STATE_START_COLUMNS
from tickloom.operators import ticks as ticks_module
from tickloom.operators.numbering import number_profiles
from tickloom.operators.tables import queries_table
from tickloom.operators.ticks import header_phases, profile_phases, reconcile, ticks_table
from tickloom.sources.profile_json import parse_profiles, usable

GOLDENS = {
    "shared boundary ticks": (
        [(1, 1000), (2, 1005), (3, 1050), (8, 1130), (9, 1350)],
        "COMPLETED",
        {1: ([1000], 5), 2: ([1000], 45), 3: ([1000, 1100], 80), 8: ([1100, 1200, 1300], 220)},
    ),
    "highest state has no ticks": (
        [(1, 1000), (3, 1040), (8, 1130)],
        "RUNNING",
        {1: ([1000], 40), 3: ([1000, 1100], 90)},
    ),
    "code order, negative duration": (
        [(1, 1000), (4, 1250), (5, 1210), (9, 1500)],
        "COMPLETED",
        {1: ([1000, 1100, 1200], 250), 4: ([1200], -40), 5: ([1200, 1300, 1400, 1500], 290)},
    ),
    "ends before its start tick": (
        [(1, 1000), (4, 1300), (5, 1200), (9, 1500)],
        "COMPLETED",
        {1: ([1000, 1100, 1200, 1300], 300), 5: ([1200, 1300, 1400, 1500], 300)},
    ),
    "state 0": ([(0, 900), (1, 1000), (9, 1100)], "COMPLETED", {1: ([1000, 1100], 100)}),
    "last entry wins": (
        [(1, 1000), (1, 1050), (9, 1200)],
        "COMPLETED",
        {1: ([1000, 1100, 1200], 150)},
    ),
    "empty": ([], "INVALID_STATE", {}),
    "zero time counts for the final state": ([(1, 1000), (9, 0)], "COMPLETED", {}),
    "list order is irrelevant": (
        [(9, 1500), (8, 1130), (1, 1000)],
        "COMPLETED",
        {1: ([1000, 1100], 130), 8: ([1100, 1200, 1300, 1400, 1500], 370)},
    ),
    "state 0 within the first tick of the epoch": (
        [(0, 50), (1, 1000), (9, 1100)],
        "COMPLETED",
        {0: ([0], 0), 1: ([1000, 1100], 100)},
    ),
}


def numbered(spark, state_lists):
    entries = [(f"{i:05}", 0, profile(states)) for i, states in enumerate(state_lists)]
    return number_profiles(usable(parse_profiles(lines_frame(spark, entries))), buckets=1)


def test_goldens(spark):
    profiles = numbered(spark, [g[0] for g in GOLDENS.values()])
    got = rows(ticks_table(profiles, 100))
    want = [
        (tick, i, code, duration)
        for i, (_, _, phases) in enumerate(GOLDENS.values(), 1)
        for code, (grid, duration) in phases.items()
        for tick in grid
    ]
    assert got == sorted(want)
    finals = rows(queries_table(profiles).select("qNum", "finalState"))
    assert [f for _, f in finals] == [g[1] for g in GOLDENS.values()]


@pytest.fixture(scope="module")
def random_states():
    rng = random.Random(11)
    lists = []
    for _ in range(400):
        codes = [rng.randrange(12) for _ in range(rng.randrange(9))]
        lists.append([(c, rng.choice([0, -50, 70, *range(1000, 4000, 7)])) for c in codes])
    return lists


def test_random_states_against_plain_python(spark, random_states):
    profiles = numbered(spark, random_states).cache()
    got = rows(ticks_table(profiles, 100))
    want = [
        (tick, i, code, duration)
        for i, states in enumerate(random_states, 1)
        for tick, code, duration in expected_ticks(states, 100)
    ]
    assert got == sorted(want)

    phases = rows(
        profile_phases(profiles, ["qNum"]).select(
            "qNum", "queryState", "phaseStartMs", "phaseEndMs", "stateDurationMs"
        )
    )
    assert phases == sorted(
        (i, *p) for i, states in enumerate(random_states, 1) for p in expected_phases(states)[0]
    )

    headers = queries_table(profiles)
    assert rows(header_phases(headers, ["qNum"])) == rows(profile_phases(profiles, ["qNum"]))

    starts = rows(headers.select("qNum", *STATE_START_COLUMNS, "finalState"))
    for (_, *columns, final), states in zip(starts, random_states, strict=True):
        assert columns == [dict(states).get(c) for c in range(12)]
        assert final == STATE_NAMES[max((c for c, _ in states), default=0)]


def test_reconciliation(spark, random_states):
    profiles = numbered(spark, random_states)
    report = reconcile(profiles, ticks_table(profiles, 10), 10).collect()
    assert report
    for r in report:
        assert r.expectedTicks == r.tickMs == r.qNum == r.stateDurationMs


def test_slices_do_not_change_the_ticks(spark, monkeypatch):
    profiles = numbered(spark, [[(1, 1_000), (8, 1_130), (9, 73_450)]])
    whole = rows(ticks_table(profiles, 100))
    monkeypatch.setattr(ticks_module, "SLICE_TICKS", 7)
    assert rows(ticks_table(profiles, 100)) == whole
    assert len(whole) == 2 + 724


def test_a_long_query_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ticks_module, "SLICE_TICKS", 100)
    profiles = numbered(spark, [[(8, 1_000), (9, 1_000_000)]])
    per_task = (
        ticks_table(profiles, 100, partitions=8)
        .groupBy(F.spark_partition_id().alias("task"))
        .count()
        .collect()
    )
    assert len(per_task) > 4
    assert max(r["count"] for r in per_task) < 9_991 / 2


def test_no_ticks_at_all(spark):
    ticks = ticks_table(numbered(spark, [[]]), 100)
    assert ticks.columns == ["tickMs", "qNum", "queryState", "stateDurationMs"]
    assert ticks.count() == 0
