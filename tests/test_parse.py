"""Lines to profiles: optional fields, the scheduling group, quarantine."""

import json

import pytest
from helpers import count_in_plan, lines_frame, node, plan, profile, rows, scheduling

from tickloom.model import SCHEDULING_COLUMNS
from tickloom.operators.numbering import number_profiles
from tickloom.operators.tables import nodes_table, queries_table, rebuild_text, text_chunks
from tickloom.sources.profile_json import parse_profiles, quarantined, usable

FULL = (1010, 1020, "high", "rule", 2, "UI")
EMPTY = (None,) * 6


def parsed(spark, *profiles):
    return parse_profiles(lines_frame(spark, [(f"q{i}", 0, p) for i, p in enumerate(profiles)]))


def one(spark, p):
    (row,) = parsed(spark, p).collect()
    return row


def properties(**changes):
    block = {"queryCost": 2.5, "queryType": "UI"} | changes
    return {k: v for k, v in block.items() if v is not ...}


@pytest.mark.parametrize(
    "block, expected",
    [
        (scheduling(), FULL),
        (scheduling(queueName=None), (1010, 1020, None, "rule", 2, "UI")),
        (scheduling(queueName=...), EMPTY),
        (scheduling(resourceSchedulingStart=None), (None, 1020, "high", "rule", 2, "UI")),
        (scheduling(schedulingProperties=properties(queryType=None)), (*FULL[:5], None)),
        (scheduling(schedulingProperties=properties(queryType=...)), EMPTY),
        (scheduling(schedulingProperties=properties(queryCost=None)), EMPTY),
        (scheduling(schedulingProperties=properties(queryCost="5")), EMPTY),
        (scheduling(schedulingProperties=properties(queryCost=float("nan"))), EMPTY),
        (scheduling(schedulingProperties=properties(queryCost=3.5)), (*FULL[:4], 4, "UI")),
        (scheduling(schedulingProperties=...), EMPTY),
        (scheduling(schedulingProperties=None), EMPTY),
        (None, EMPTY),
        ("text", EMPTY),
        (..., EMPTY),
    ],
)
def test_scheduling_group_is_all_or_nothing(spark, block, expected):
    row = one(spark, profile(resourceSchedulingProfile=block))
    assert row.problem is None
    assert tuple(row[c] for c in SCHEDULING_COLUMNS) == expected


def test_optional_fields(spark):
    row = one(spark, profile(planningEnd=..., executionStart=..., planningStart=0))
    assert (row.planningStartMs, row.planningEndMs, row.executionStartMs) == (None, None, None)
    row = one(spark, profile(planningStart=None, user=None, end=None, nodeProfile=None))
    assert row.problem is None
    assert (row.planningStartMs, row.userId, row.queryEndMs, row.nodeProfile) == (None,) * 4


@pytest.mark.parametrize(
    "changes, problem",
    [
        ({"start": ...}, "start"),
        ({"start": None}, "start"),
        ({"start": "5"}, "start"),
        ({"start": 1.5}, "start"),
        ({"query": None}, "query"),
        ({"user": ...}, "user"),
        ({"end": ..., "totalFragments": "many"}, "end, totalFragments"),
        ({"planningStart": ...}, "planningStart"),
        ({"nodeProfile": ...}, "nodeProfile"),
        ({"stateList": None}, "stateList"),
        ({"states": [(12, 5)]}, "stateList entry"),
        ({"states": [(-1, 5)]}, "stateList entry"),
        ({"stateList": [{"state": 1}]}, "stateList entry"),
        ({"stateList": [{"startTime": 1}]}, "stateList entry"),
        ({"stateList": [None]}, "stateList entry"),
        ({"nodes": [node(), {"endpoint": {"address": "a", "fabricPort": 1}}]}, "nodeProfile entry"),
        ({"nodes": [node() | {"endpoint": {"address": "a"}}]}, "nodeProfile entry"),
        ({"nodes": [node() | {"endpoint": None}]}, "nodeProfile entry"),
        ({"nodes": [node(memory="lots")]}, "nodeProfile entry"),
        ({"nodes": [None]}, "nodeProfile entry"),
    ],
)
def test_quarantine(spark, changes, problem):
    text = json.dumps(profile(**changes))
    good = profile()
    frame = parsed(spark, text, good)
    assert rows(quarantined(frame)) == [("profile_q0.json", 0, problem, text)]
    assert [r.queryId for r in usable(frame).collect()] == ["q1"]


@pytest.mark.parametrize(
    "text",
    [
        "nonsense",
        "[1]",
        "7",
        json.dumps(profile())[:-1],
        json.dumps(profile() | {"other": [1, 2]})[:-4],
    ],
)
def test_malformed_json(spark, text):
    row = one(spark, text)
    assert row.problem == "malformed JSON"
    assert row.line == text


def test_single_quotes_are_no_json(spark):
    assert one(spark, json.dumps(profile()).replace('"', "'")).problem is not None


def test_null_values_in_nodes_are_kept(spark):
    row = one(spark, profile(nodes=[node(address=None, memory=None), node()]))
    assert row.problem is None
    assert [n.maxMemoryUsed for n in row.nodeProfile] == [None, 1048576]


def test_a_wrong_optional_field_is_no_reason_for_quarantine(spark):
    row = one(spark, profile(planningEnd="later"))
    assert (row.problem, row.planningEndMs) == (None, None)


def test_whole_numbers_in_any_form(spark):
    text = json.dumps(profile(nodes=[node()], states=((1, 1000), (8, 1130), (9, 1350))))
    other = text
    for old, new in (("1000", "1000.0"), ("1130", "1.13e3"), ("45678", "45678.0"), ("1048576", "1048576.0"), ("1010", "1010.0"), ("1005", "1005.00"), ('"state": 8', '"state": 8.0')):
        assert old in other
        other = other.replace(old, new)
    frame = parsed(spark, text, other).drop("queryId")
    first, second = frame.drop("file_name", "line").collect()
    assert first.problem is None and first == second
    assert one(spark, profile(executionStart=1130.5)).executionStartMs is None


def test_a_text_beyond_the_parsers_default_limit(spark):
    row = parsed(spark, profile(query="x" * 25_000_000, user=None)).selectExpr("problem", "length(queryText) AS n").first()
    assert (row.problem, row.n) == (None, 25_000_000)


def test_last_duplicate_key_wins(spark):
    text = json.dumps(profile(user="first")).replace('"user": "first"', '"user": "first", "user": "last"')
    assert one(spark, text).userId == "last"


def test_strict_fails_on_the_first_problem(spark):
    lines = lines_frame(spark, [("q", 0, profile()), ("q", 1, "{")])
    with pytest.raises(Exception, match="profile_q.json line 1 malformed JSON"):
        parse_profiles(lines, strict=True).collect()
    assert parse_profiles(lines.where("attempt = 0"), strict=True).count() == 1


def test_each_line_is_parsed_once(spark):
    text = plan(usable(parsed(spark, profile())))
    assert text.count("StructField(totalFragments,LongType") == 1


@pytest.mark.parametrize(
    "text, chunks", [("", []), ("abc", ["abc"]), ("abcd", ["abc", "d"]), ("a😀bc", ["a😀b", "c"])]
)
def test_text_chunks(spark, text, chunks):
    numbered = number_profiles(usable(parsed(spark, profile(query=text))), buckets=2)
    pieces = text_chunks(numbered, 3)
    assert rows(pieces) == [(1, i, c) for i, c in enumerate(chunks)]
    header = queries_table(numbered, 3).first()
    assert (header.queryTextFirstChunk, header.nrQueryChunks) == (text[:3], len(chunks))
    assert rows(rebuild_text(pieces)) == ([(1, text)] if text else [])


@pytest.mark.parametrize("size", [1, 7, 1000, 50_000])
def test_a_long_text_of_mixed_characters_is_cut_by_characters(spark, size):
    text = "a😀é\n\r\u2028b" * 6_000
    numbered = number_profiles(usable(parsed(spark, profile(query=text))), buckets=2)
    pieces = text_chunks(numbered, size)
    assert [r.chunkText for r in pieces.orderBy("chunkNum").collect()] == [
        text[i : i + size] for i in range(0, len(text), size)
    ]
    assert rows(rebuild_text(pieces)) == [(1, text)]


def test_nodes(spark):
    numbered = number_profiles(
        usable(parsed(spark, profile(nodes=[node("a", 1, 10, 5), node("a", 1, 20, 6)]), profile())),
        buckets=1,
    )
    assert rows(nodes_table(numbered)) == [(1, "a", 1, 10, 5), (1, "a", 1, 20, 6)]


def test_numbers_are_dense_and_do_not_depend_on_partitioning(spark):
    ids = spark.createDataFrame(
        [(f"q{i % 40}", i // 40) for i in range(1000)], "queryId STRING, attempt BIGINT"
    )
    a = number_profiles(ids.repartition(3), base=50, buckets=16)
    b = number_profiles(ids.repartition(7, "attempt"), base=50, buckets=16)
    assert rows(a) == rows(b)
    assert sorted(r.qNum for r in a.collect()) == list(range(51, 1051))


def test_states_are_reversed_once(spark, conf):
    """Not once for each state: the later of two entries counts, and codes out of order are found."""
    states = ((8, 1130), (1, 900), (1, 1000), (9, 1350), (8, 1140))
    found = parse_profiles(lines_frame(spark, [("q0", 0, profile(states))]).repartition(1))
    conf("spark.sql.debug.maxToStringFields", "1000")
    assert count_in_plan(found, r"reverse\(") == 2
    (row,) = found.collect()
    assert [row.stateStarts[c] for c in (1, 8, 9)] == [1000, 1140, 1350]
    assert (len(row.stateStarts), sum(v is not None for v in row.stateStarts), row.highestState) == (12, 3, 9)
    empty = one(spark, profile(stateList=[]))
    assert empty.stateStarts == [None] * 12 and empty.highestState == 0
    assert one(spark, profile(stateList=None)).problem == "stateList"
