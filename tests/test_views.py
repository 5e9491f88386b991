"""The five views: hand-checked rows, both plan families, skew and plans."""

import random
import re

import pytest
from helpers import count_in_plan, expected_ticks, formatted, lines_frame, node, plan, profile, rows
from pyspark.sql import functions as F

from tickloom import ingest_lines, read_tables, register_views
from tickloom.operators import ticks as ticks_module
from tickloom.plans import late_views, stored_views, views
from tickloom.plans.catalog import VIEW_NAMES, view_builders

TICK = 100
NAMES = list(VIEW_NAMES.values())


def build(spark, path, entries):
    ingest_lines(lines_frame(spark, entries), path, tick_ms=TICK, base=0)
    return read_tables(spark, path)


@pytest.fixture(scope="module")
def random_entries():
    """Several overlapping attempts per query, repeated nodes, NULLs, queries without nodes."""
    rng = random.Random(5)
    entries = []
    for q in range(40):
        for attempt in range(rng.choice([1, 1, 2, 3])):
            b = 100_000 + rng.randrange(3000)
            states = [(1, b), (3, b + rng.randrange(90)), (8, b + rng.randrange(400))]
            states.append((rng.choice([9, 10, 11]), b + 400 + rng.randrange(900)))
            if q % 7 == 0:
                states.pop()
            nodes = [
                node(rng.choice(["n1", "n2", "n3", None]), rng.choice([1, 2, None]), memory)
                for memory in rng.choices([1 << 20, 5 << 20, 123 << 20, None], k=rng.randrange(5))
            ]
            changes = {"resourceSchedulingProfile": None} if q % 5 == 0 else {}
            p = profile(states, nodes, user=f"u{q % 3}", totalFragments=q % 4, start=b, **changes)
            entries.append((f"q{q:02}", attempt, p))
    return entries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, random_entries):
    return build(spark, str(tmp_path_factory.mktemp("views") / "t"), random_entries)


def test_hand_checked_rows(spark, tmp_path):
    states = [(1, 1000), (8, 1130), (9, 1250)]
    nodes = [node("a", 1, 3 << 20), node("a", 1, 2 << 20), node("b", 1, 10 << 20)]
    t = build(
        spark,
        str(tmp_path / "t"),
        [("q", 0, profile(states, nodes)), ("q", 1, profile(states, nodes[2:])), ("r", 0, profile(states))],
    )
    ts = "1970-01-01 00:00:01.1"
    v1 = views.ticks_nodes(t).withColumn("tickTs", F.col("tickTs").cast("string")).drop("qNum")
    assert v1.count() == 2 * 4
    assert rows(v1)[0] == (
        ts, 1100, 120, "q", "ann", "COMPLETED", 7, "high", "UI", "a", 1, 2.0, "SELECT 1",
    )
    v2 = views.tick_node_agg_1(t).where("tickMs = 1100").drop("tickTs")
    keys = (1100, "q", "ann", "high", "COMPLETED", "UI")
    assert rows(v2) == [(*keys, "a:1", 2, 14, 5.0), (*keys, "b:1", 2, 14, 20.0)]
    v3 = views.tick_node_agg(t).where("tickMs = 1100").drop("tickTs")
    assert rows(v3) == [(*keys, 2, 14.0, 14, 12.5, 20.0)]
    v4 = views.state_tick(t).where("tickMs = 1100 AND queryId = 'r'").drop("ts")
    want = (1100, "ann", "UI", "r", "COMPLETED", 7, "high")
    assert rows(v4) == [
        (*want, "01 (PENDING)", 0.13, "SELECT 1"),
        (*want, "08 (RUNNING)", 0.12, "SELECT 1"),
    ]
    v5 = views.state_tick_agg(t).where("tickMs = 1100").drop("ts")
    assert rows(v5) == [
        (1100, "ann", "COMPLETED", "01 (PENDING)", 3, 130, 130.0, 130, 390),
        (1100, "ann", "COMPLETED", "08 (RUNNING)", 3, 120, 120.0, 120, 360),
    ]


@pytest.mark.parametrize("name", NAMES)
def test_late_views_equal_stored_views(tables, name):
    stored, late = getattr(views, name)(tables), getattr(late_views, name)(tables, TICK)
    assert stored.dtypes == late.dtypes
    assert rows(stored) == rows(late)
    assert stored.count() > 0


@pytest.mark.parametrize("name", ["tick_node_agg_1", "tick_node_agg"])
def test_eager_views_equal_plain_views(tables, name):
    assert rows(getattr(views, name)(tables, eager=True)) == rows(getattr(views, name)(tables))


def test_against_plain_python(tables, random_entries):
    """The per-query view and the state view, recomputed row by row."""
    per_node, per_state = {}, {}
    for q, _, p in random_entries:
        states = [(s["state"], s["startTime"]) for s in p["stateList"]]
        final = max(c for c, _ in states)
        cost = p["resourceSchedulingProfile"] is not None
        for tick, code, duration in expected_ticks(states, TICK):
            per_state.setdefault((tick, p["user"], final, code), []).append(duration)
            if code != 8:
                continue
            for n in p["nodeProfile"]:
                e = n["endpoint"]
                whole = e["address"] is not None and e["fabricPort"] is not None
                ident = f"{e['address']}:{e['fabricPort']}" if whole else None
                key = (tick, q, p["user"], cost, final)
                memory = n["maxMemoryUsed"]
                per_node.setdefault(key, {}).setdefault(ident, []).append(
                    (p["totalFragments"], None if memory is None else memory / (1 << 20))
                )
    got = views.state_tick_agg(tables).collect()
    assert len(got) == len(per_state)
    assert sum(r.totalQueries for r in got) == sum(map(len, per_state.values()))
    assert sum(r.sumDuration for r in got) == sum(map(sum, per_state.values()))
    assert sum(r.maxDuration for r in got) == sum(map(max, per_state.values()))
    assert sum(r.minDuration for r in got) == sum(map(min, per_state.values()))

    got = views.tick_node_agg(tables).collect()
    assert len(got) == len(per_node)
    want = []
    for (tick, q, user, _, _), nodes in per_node.items():
        fragments = [sum(f for f, _ in found) for found in nodes.values()]
        memory = [[m for _, m in found if m is not None] for found in nodes.values()]
        memory = [sum(m) for m in memory if m]
        want.append(
            (tick, q, user, len(nodes), sum(fragments) / len(nodes), max(fragments),
             max(memory) if memory else None)
        )
    assert sorted(want, key=str) == sorted(
        (
            (r.tickMs, r.queryId, r.userId, r.nodeCount, r.avgFragmentsPerNode,
             r.maxFragmentsPerNode, r.maxMemMbPerNode)
            for r in got
        ),
        key=str,
    )


def test_invariants(tables):
    v1, v2 = views.ticks_nodes(tables), views.tick_node_agg_1(tables)
    assert v2.agg(F.sum("queryCount")).first()[0] == v1.count()
    running = views.running_ticks(tables["ticks"])
    assert v1.count() == running.join(tables["nodes"], "qNum").count()
    with_nodes = tables["nodes"].select("qNum").distinct()
    assert v1.join(with_nodes, "qNum", "left_anti").count() == 0


def test_missing_state_names_give_null_labels(tables):
    partial = tables | {"state_names": tables["state_names"].where("id <> 8")}
    assert views.state_tick(partial).count() == views.state_tick(tables).count()
    missing = views.state_tick(partial).where("queryState IS NULL").count()
    assert missing == tables["ticks"].where("queryState = 8").count() > 0


def test_order_of_the_state_view(tables):
    got = [(r.ts, r.queryState) for r in views.state_tick_agg(tables).collect()]
    assert got == sorted(got)


def test_one_query_with_most_of_the_ticks(spark, tmp_path, monkeypatch):
    """A query long enough for many blocks and slices beside short ones."""
    monkeypatch.setattr(views, "BLOCK_MS", 5_000)
    monkeypatch.setattr(ticks_module, "SLICE_TICKS", 16)
    nodes = [node(f"n{i}", 1) for i in range(5)]
    long = profile([(1, 1_000), (8, 2_000), (9, 200_000)], nodes)
    short = profile([(1, 1_000), (8, 2_000), (9, 2_300)], nodes)
    t = build(
        spark, str(tmp_path / "t"), [("long", 0, long), *[(f"s{i}", 0, short) for i in range(20)]]
    )
    assert views.ticks_nodes(t).count() == 5 * (1981 + 20 * 4)
    for name in NAMES:
        assert rows(getattr(views, name)(t)) == rows(getattr(late_views, name)(t, TICK))


def test_one_query_id_with_most_of_the_attempts(spark, tmp_path):
    entries = [("hot", a, profile([(8, 1000 + a), (9, 1400 + a)], [node(f"n{a % 3}")])) for a in range(60)]
    entries += [(f"q{i}", 0, profile([(8, 1000), (9, 1400)], [node()])) for i in range(10)]
    t = build(spark, str(tmp_path / "t"), entries)
    for name in NAMES:
        assert rows(getattr(views, name)(t)) == rows(getattr(late_views, name)(t, TICK))
    hot = views.tick_node_agg(t).where("queryId = 'hot' AND tickMs = 1200").first()
    assert (hot.nodeCount, hot.maxFragmentsPerNode) == (3, 20 * 7)


@pytest.mark.parametrize("tick_ms", [None, TICK])
def test_views_from_sql(spark, tables, tick_ms):
    names = register_views(spark, tables, tick_ms=tick_ms, prefix="t_")
    assert set(names) >= {f"t_{n}" for n in (*VIEW_NAMES, "ticks", "queries", "state_names")}
    for name, builder in view_builders(tick_ms).items():
        assert spark.table(f"t_{name}").count() == builder(tables).count()
    got = spark.sql("SELECT max(nodeCount) FROM t_profileTickNodeAgg").first()[0]
    assert got == views.tick_node_agg(tables).agg(F.max("nodeCount")).first()[0]


def test_plans(tables, monkeypatch):
    # So few ticks would make one task, and that needs no exchanges.
    monkeypatch.setattr(ticks_module, "TICKS_PER_SMALL_TASK", 100)
    stored = plan(views.tick_node_agg(tables))
    assert "EqualTo(queryState,8)" in stored
    assert "queryTextFirstChunk" not in stored
    assert "CartesianProduct" not in stored and "NestedLoop" not in stored
    for name in NAMES:
        late = plan(getattr(late_views, name)(tables, TICK))
        assert "struct<tickMs:" not in late
        assert "NestedLoop" not in late
    # One narrow shuffle of phases, one of partial aggregates, one for the order.
    assert count_in_plan(late_views.state_tick_agg(tables, TICK), "Exchange ") == 3
    assert "Join" not in plan(late_views.state_tick(tables, TICK))
    assert "queryTextFirstChunk" not in plan(late_views.state_tick_agg(tables, TICK))


def test_ticks_are_scanned_once(tables, conf):
    """Without broadcasts, as at scale: few exchanges."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain = [("ticks_nodes", {}), ("tick_node_agg_1", {}), ("tick_node_agg", {})]
    eager = [(name, {"eager": True}) for name, _ in plain[1:]]
    for name, options in plain + eager:
        found = getattr(views, name)(tables, **options)
        text = plan(found)
        assert text.count("ReadSchema: struct<tickMs:") == 1, name
        # One more where the attempts of a query id are counted first.
        assert count_in_plan(found, "Exchange ") <= (9 if options and name == "tick_node_agg" else 8), name


def test_late_node_views_move_little(tables, conf):
    """Without broadcasts: the sweep, both sides of the join, the sums, and the spread before ticks."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in ("tick_node_agg_1", "tick_node_agg"):
        found = getattr(late_views, name)(tables, TICK)
        assert count_in_plan(found, "Exchange ") <= 6, name
        # Ticks come into being once.
        assert count_in_plan(found, r"explode\(sequence\(sliceTick") == 1, name


def test_no_job_runs_while_views_are_defined(spark, tables):
    spark.sparkContext.setJobGroup("definitions", "")
    try:
        register_views(spark, tables, tick_ms=TICK, prefix="late_")
        register_views(spark, tables, prefix="plain_")
        late_views.state_block_agg(tables, TICK)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("definitions")
        spark.sql("SELECT count(*) FROM late_profileStateTick").collect()
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("definitions")
    finally:
        spark.sparkContext.setJobGroup("tests", "")


def test_tasks_follow_the_stored_counts(spark, tables):
    few = late_views.expansion_tasks(tables, TICK)
    assert few == 1
    many = tables["queries"].sparkSession.conf.get("spark.sql.shuffle.partitions")
    assert late_views.expansion_tasks(dict(tables), TICK) == int(many)
    stored = sum(n for b in tables.manifest.batches for n in b.ticks.values())
    assert stored == tables["ticks"].count()
    narrow = late_views.expansion_tasks(tables, 1)
    assert 1 <= narrow <= 1 + stored * TICK // ticks_module.TICKS_PER_SMALL_TASK


def test_blocks_of_ticks(tables, random_entries):
    assert rows(late_views.state_block_agg(tables, TICK)) == rows(views.state_tick_agg(tables))


def test_missing_query_ids_form_one_group(spark, tables):
    nameless = tables | {"queries": tables["queries"].withColumn("queryId", F.expr("nullif(queryId, 'q03')"))}
    for name in ("tick_node_agg_1", "tick_node_agg"):
        want = rows(getattr(views, name)(nameless))
        assert rows(getattr(views, name)(nameless, eager=True)) == want
        assert rows(getattr(late_views, name)(nameless, TICK)) == want


def test_ticks_wider_than_a_block(spark, tmp_path, monkeypatch):
    """Blocks are found whatever the tick width, and when a phase ends in the tick it starts in."""
    monkeypatch.setattr(views, "BLOCK_MS", 30)
    entries = [(f"q{i}", 0, profile([(1, 900 + i), (8, 1000 + 7 * i), (9, 990 + 31 * i)], [node(f"n{i % 3}")])) for i in range(40)]
    t = build(spark, str(tmp_path / "t"), entries)
    for name in NAMES:
        assert rows(getattr(views, name)(t)) == rows(getattr(late_views, name)(t, TICK))


def test_skewed_ticks_are_split_in_the_header_join(spark, tmp_path, conf):
    """One query holds most of the stored ticks: its join partition is split at run time."""
    long = profile([(1, 1_000), (8, 2_000), (9, 4_000_000)])
    entries = [("long", 0, long), *[(f"s{i}", 0, profile()) for i in range(50)]]
    t = build(spark, str(tmp_path / "t"), entries)
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.files.maxPartitionBytes", "20000")
    conf("spark.sql.files.openCostInBytes", "0")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20000")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    tables_many = t | {"ticks": t["ticks"].repartition(16)}
    tables_many["ticks"].write.parquet(str(tmp_path / "ticks"))
    tables_many["ticks"] = spark.read.parquet(str(tmp_path / "ticks"))
    joined = views.state_tick(tables_many)
    assert len(joined.collect()) == t["ticks"].count()
    assert "skew=true" in plan(joined)


def test_rows_of_the_node_views_move_once(spark, tables, tmp_path, conf):
    """One exchange of the rows for both aggregations, in the builders and in the stored texts."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    text = r"Exchange hashpartitioning\(tickMs|Exchange hashpartitioning\(tickTs"
    assert count_in_plan(views.tick_node_agg(tables), text) == 1
    for name, df in tables.items():
        df.createOrReplaceTempView(f"once_{name}")
    for name, sql in list(stored_views.view_texts().items())[:3]:
        sql = sql.replace(stored_views.PREFIX, "once_")
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW once_{name} AS {sql}")
    stored = spark.table("once_profileTickNodeAgg")
    assert count_in_plan(stored, text) == 1
    assert rows(stored) == rows(views.tick_node_agg(tables))


def test_ticks_are_not_sorted_for_the_keys_of_their_queries(tables, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = plan(views.named_ticks(tables, []))
    assert "ShuffledHashJoin" in found and "Sort " not in found


def test_texts_do_not_move_once_per_node(spark, tables, conf):
    """A text goes to the slices of its query; the rows of the nodes get it there."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    found = late_views.ticks_nodes(tables, TICK)
    parts = re.findall(r"Exchange\n(?:.*\n)*?Input \[\d+\]: \[(.*)\]", formatted(found))
    assert any("queryTextFirstChunk" in columns for columns in parts)
    assert not any("queryTextFirstChunk" in columns and "endpointAddress" in columns for columns in parts)


def test_slices_of_node_ticks(spark, tables, monkeypatch):
    """Long phases have several slices, and header rows may repeat or lack their number."""
    monkeypatch.setattr(late_views, "NODE_SLICE_TICKS", 3)
    assert rows(late_views.ticks_nodes(tables, TICK)) == rows(views.ticks_nodes(tables))
    q = tables["queries"]
    odd = tables | {"queries": q.union(q).union(q.limit(5).withColumn("qNum", F.lit(None).cast("bigint")))}
    once = rows(views.ticks_nodes(tables))
    assert rows(late_views.ticks_nodes(odd, TICK)) == sorted(once * 2, key=lambda r: [(v is not None, v) for v in r])


def test_tasks_of_the_node_views_follow_the_rows(tables, monkeypatch, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = {name: rows(getattr(late_views, name)(tables, TICK)) for name in ("tick_node_agg_1", "tick_node_agg")}
    assert late_views.row_tasks(tables) is None
    stored = sum(max(b.nodes, b.profiles) for b in tables.manifest.batches)
    monkeypatch.setattr(late_views, "ROWS_PER_TASK", 10)
    tasks = -(-stored // 10)
    assert late_views.row_tasks(tables) == tasks > 4
    for name, want in before.items():
        found = getattr(late_views, name)(tables, TICK)
        assert rows(found) == want
        # The sweep, the sums per query and node, the join of both, and the sums per range.
        assert count_in_plan(found, rf"hashpartitioning\([^)]*, {tasks}\)") >= 4, name


def test_node_rows_meet_blocks_of_ticks(tables, conf, monkeypatch):
    """A row of a node is joined and moved once per block of its query's ticks, which come last."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    for name, options in [("ticks_nodes", {}), *[(n, {"eager": e}) for n in ("tick_node_agg_1", "tick_node_agg") for e in (False, True)]]:
        text = plan(getattr(views, name)(tables, **options))
        last = text.index("explode(tickMs")
        assert "Join" in text[last:] and "Join" not in text[:last], name
        assert "Exchange" not in text[:last] and "Aggregate" not in text[:last], name
    monkeypatch.setattr(views, "BLOCK_MS", 300)
    runs = views.tick_runs(tables)
    assert runs.agg(F.sum(F.size("tickMs"))).first()[0] == views.running_ticks(tables["ticks"]).count()
    assert runs.count() < runs.agg(F.sum(F.size("tickMs"))).first()[0]
    monkeypatch.setattr(views, "TICKS_PER_TASK", 10)
    assert views.node_tick_tasks(tables) > views.node_tick_tasks(dict(tables))


def test_repeated_ticks_are_added_up(tables):
    """A tick that is stored twice counts twice, and is one row."""
    twice = tables | {"ticks": tables["ticks"].union(tables["ticks"])}
    once = {(*r[:8],): r for r in views.tick_node_agg_1(tables).collect()}
    for eager in (False, True):
        found = views.tick_node_agg_1(twice, eager=eager).collect()
        assert {(*r[:8],): r.queryCount for r in found} == {k: 2 * r.queryCount for k, r in once.items()}
        assert len(found) == len(once)


def test_texts_move_once_for_all_phases(spark, tables, conf):
    """A query is unnested into its phases where its text has arrived."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    parts = re.findall(r"Exchange\n(?:.*\n)*?Input \[\d+\]: \[(.*)\]", formatted(late_views.state_tick(tables, TICK)))
    assert any("queryTextFirstChunk" in columns for columns in parts)
    assert not any("queryTextFirstChunk" in columns and "queryState" in columns for columns in parts)


def test_files_hold_as_many_texts_as_their_dictionary(spark, tables, conf, monkeypatch):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(views, "TEXTS_PER_TASK", 5)
    monkeypatch.setattr(views, "STRETCH_MS", 200)
    monkeypatch.setattr(ticks_module, "SLICE_TICKS", 3)
    tasks = -(-sum(b.profiles for b in tables.manifest.batches) // 5)
    assert tasks > 4
    for name in ("ticks_nodes", "state_tick"):
        want = rows(getattr(views, name)(dict(tables)))
        for found in (getattr(views, name)(tables), getattr(late_views, name)(tables, TICK)):
            assert rows(found) == want
            assert re.search(rf"hashpartitioning\([^)]*, {tasks}\)", plan(found)), name
    monkeypatch.setattr(views, "MOST_TEXT_TASKS", 6)
    assert views.text_tasks(tables, 1) == 6


def test_attempts_move_as_lists_of_ticks(tables, conf):
    """Rows of several attempts become ticks after they have moved, and node rows move once to their ticks."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    for eager in (False, True):
        text = plan(views.tick_node_agg_1(tables, eager=eager))
        moved = text.index("Exchange hashpartitioning(tickMsBlock")
        assert "explode(CASE WHEN shared" in text[:moved]
        assert not re.search(r"hashpartitioning\(qNum#\d+L, nodeId", text)
