"""The ingest job: layout, repetition, overlap, numbering, streaming."""

import os

import pytest
from helpers import count_in_plan, lines_frame, node, plan, profile, rows, write_files

from tickloom import ingest, ingest_available, ingest_lines, read_tables
from tickloom.__main__ import main
from tickloom.model import QUERIES_COLUMNS, TABLE_NAMES
from tickloom.operators import numbering
from tickloom.operators.sinks import range_name
from tickloom.operators.tables import queries_table

STATES = ((1, 1000), (8, 1130), (9, 1350))


def batch(ids, start=1000, **changes):
    return {f"profile_{q}.json": [profile(nodes=[node()], start=start + i, **changes)] for i, q in enumerate(ids)}


def stored(spark, out):
    """Table contents without the surrogate key, whose values differ between runs."""
    t = read_tables(spark, out)
    key = t["queries"].select("qNum", "queryId", "attempt")
    assert key.select("qNum").distinct().count() == key.count()
    result = {n: rows(t[n].join(key, "qNum").drop("qNum")) for n in ("nodes", "ticks", "query_text")}
    return result | {"queries": rows(t["queries"].drop("qNum"))}


def test_tables_and_layout(spark, tmp_path):
    path = write_files(tmp_path / "in", batch(["a", "b"]) | {"profile_c.json": "oops\n"})
    out = str(tmp_path / "out")
    report = ingest(spark, path, out)
    assert (report.profiles, report.quarantined) == (2, 1)
    assert report.ingest_range.startswith("1000_1001_")
    assert report.expected_ticks == report.stored_ticks == {1: 4, 8: 6}
    for name in TABLE_NAMES:
        assert os.listdir(f"{out}/{name}") == [f"ingest_range={report.ingest_range}"]
    t = read_tables(spark, out)
    assert tuple(t["queries"].columns) == QUERIES_COLUMNS
    assert [r.problem for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["malformed JSON"]
    assert t["query_text"].columns == ["qNum", "chunkNum", "chunkText"]
    assert t["nodes"].columns == [
        "qNum",
        "endpointAddress",
        "endpointFabricPort",
        "maxMemoryUsed",
        "enqueuedBeforeSubmitMs",
    ]
    assert t["ticks"].dtypes == [
        (c, "bigint") for c in ("tickMs", "qNum", "queryState", "stateDurationMs")
    ]
    numbers = [r.qNum - report.base for r in t["queries"].collect()]
    assert len(set(numbers)) == 2 and set(numbers) <= {1, 2, 3}
    assert not os.path.exists(report.staged_dir)


def test_the_same_batch_again_changes_nothing(spark, tmp_path):
    path = write_files(tmp_path / "in", batch(["a", "b"]))
    out = str(tmp_path / "out")
    ingest(spark, path, out)
    before = stored(spark, out)
    ingest(spark, path, out)
    assert stored(spark, out) == before


def test_another_batch_is_added(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest(spark, write_files(tmp_path / "1", batch(["a"])), out)
    ingest(spark, write_files(tmp_path / "2", batch(["b"], start=5000)), out)
    assert [r[0] for r in stored(spark, out)["queries"]] == ["a", "b"]


def test_overlapping_batches(spark, tmp_path):
    out, other = str(tmp_path / "out"), str(tmp_path / "other")
    ingest(spark, write_files(tmp_path / "1", batch(["a", "b"])), out)
    both = write_files(tmp_path / "2", batch(["a", "b", "c"]))
    report = ingest(spark, both, out, skip_existing=True)
    assert report.profiles == 1
    ingest(spark, both, other)
    assert stored(spark, out) == stored(spark, other)
    assert ingest(spark, both, out, skip_existing=True).profiles == 0
    assert stored(spark, out) == stored(spark, other)


def test_replace_writes_single_tables(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest(spark, write_files(tmp_path / "1", batch(["a", "b"])), out, replace=True, base=0)
    ingest(spark, write_files(tmp_path / "2", batch(["c"])), out, replace=True, base=0)
    assert [(r.queryId, r.qNum) for r in read_tables(spark, out)["queries"].collect()] == [("c", 1)]


def ids(spark, out):
    return sorted(r.queryId for r in read_tables(spark, out)["queries"].collect())


def test_batches_with_the_same_range_and_replace_then_append(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest(spark, write_files(tmp_path / "1", batch(["a", "b"])), out)
    ingest(spark, write_files(tmp_path / "2", batch(["c", "d"])), out)
    assert ids(spark, out) == ["a", "b", "c", "d"]
    ingest(spark, write_files(tmp_path / "3", batch(["e"])), out, replace=True)
    ingest(spark, write_files(tmp_path / "4", batch(["f"], start=9000)), out)
    assert ids(spark, out) == ["e", "f"]
    with pytest.raises(ValueError):
        ingest_available(spark, str(tmp_path / "1"), out, str(tmp_path / "p"), replace=True)


def test_quarantine_follows_its_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = lambda: sorted(r.file_name for r in spark.read.parquet(f"{out}/quarantine").collect())
    broken = batch(["a"]) | {"profile_b.json": [profile(start=5, user=...)]}
    report = ingest(spark, write_files(tmp_path / "1", broken), out)
    assert bad() == ["profile_b.json"] and report.ingest_range.startswith("1000_1000_")
    for _ in range(2):
        ingest(spark, write_files(tmp_path / "2", broken | batch(["c"])), out, skip_existing=True)
        assert bad() == ["profile_b.json"]
    ingest(spark, write_files(tmp_path / "3", batch(["a", "b"])), out)
    assert ids(spark, out) == ["a", "b", "c"] and bad() == []


def test_rows_are_sorted_within_each_file(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = [(f"q{i}", 0, profile(start=1000 + (i * 37) % 101)) for i in range(101)]
    ingest_lines(lines_frame(spark, lines).repartition(3), out)
    found = read_tables(spark, out)["queries"].selectExpr("_metadata.file_name AS f", "_metadata.row_index AS i", "queryStartMs AS s").orderBy("f", "i").collect()
    assert all(a.s <= b.s for a, b in zip(found, found[1:], strict=False) if a.f == b.f) and len(found) == 101


def test_empty_input(spark, tmp_path):
    out = str(tmp_path / "out")
    report = ingest(spark, write_files(tmp_path / "in", {"profile_a.json": "\n"}), out)
    assert (report.profiles, report.ingest_range[:4], report.stored_ticks) == (0, "0_0_", {})
    assert all(df.count() == 0 for n, df in read_tables(spark, out).items() if n != "state_names")


def test_a_start_of_zero_does_not_count_for_the_range(spark, tmp_path):
    lines = lines_frame(spark, [("a", 0, profile(start=0)), ("b", 0, profile(start=7))])
    assert ingest_lines(lines, str(tmp_path / "out")).ingest_range.startswith("7_7_")


def test_strict_and_bad_arguments(spark, tmp_path):
    lines = lines_frame(spark, [("a", 0, "{")])
    with pytest.raises(Exception, match="malformed JSON"):
        ingest_lines(lines, str(tmp_path / "out"), strict=True)
    with pytest.raises(ValueError):
        ingest_lines(lines, str(tmp_path / "out"), tick_ms=0)
    with pytest.raises(ValueError):
        ingest_lines(lines, str(tmp_path / "out"), replace=True, skip_existing=True)


def test_number_base(spark):
    assert numbering.clock_base(1_700_000_009.9) == 170_000_000 * 10_000_000
    high = numbering.clock_base() + 10**9
    frame = spark.createDataFrame([(high,), (5,)], "qNum BIGINT")
    assert numbering.next_base(frame) == high
    assert numbering.next_base(frame.where("qNum = 5")) < high
    assert numbering.next_base(None) % 10_000_000 == 0
    assert range_name(1, 2) == "1_2" and range_name(1, 2, "b0") == "1_2_b0"


def test_staged_rows_are_numbered_without_moving(spark, tmp_path):
    staged, offsets = str(tmp_path / "staged"), str(tmp_path / "offsets")
    ids = spark.range(0, 1000, numPartitions=7).selectExpr("concat('q', id) AS queryId")
    ids.write.parquet(staged)
    frame = spark.read.parquet(staged)
    numbered = numbering.number_staged(frame, offsets, base=10)
    assert sorted(r.qNum for r in numbered.collect()) == list(range(11, 1011))
    assert rows(numbered) == rows(numbering.number_staged(frame, offsets, base=10))
    assert count_in_plan(numbered, "Exchange hashpartitioning") == 0


def test_headers_are_written_without_a_shuffle_of_profiles(spark, tmp_path):
    report = ingest_lines(lines_frame(spark, [("a", 0, profile())]), str(tmp_path / "out"), keep_staging=True)
    staged = spark.read.parquet(report.staged_dir)
    numbered = numbering.number_staged(staged, str(tmp_path / "offsets"), 0)
    text = plan(queries_table(numbered))
    assert "Exchange hashpartitioning" not in text
    assert "nodeProfile" not in text


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    big = {"profile_big.json": [profile(user=f"u{i}") for i in range(300)]}
    write_files(source, batch(["a", "b"]) | big)
    options = {"whole_file_limit": 50_000, "tick_ms": 10}
    ingest_available(spark, str(source), out, progress, **options)
    first = stored(spark, out)
    assert len(first["queries"]) == 302
    ingest_available(spark, str(source), out, progress, **options)
    assert stored(spark, out) == first
    write_files(source, batch(["c"], start=9000))
    ingest_available(spark, str(source), out, progress, **options)
    assert [r[0] for r in stored(spark, out)["queries"] if r[0] != "big"] == ["a", "b", "c"]

    whole = str(tmp_path / "whole")
    ingest(spark, str(source), whole, tick_ms=10)
    assert stored(spark, out) == stored(spark, whole)


def test_stream_in_several_batches_with_the_same_range(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write_files(source, {f"profile_{q}.json": [profile(nodes=[node()])] for q in "abcd"})
    ingest_available(
        spark, str(source), out, str(tmp_path / "progress"), max_files_per_trigger=1
    )
    assert [r[0] for r in stored(spark, out)["queries"]] == ["a", "b", "c", "d"]
    assert len(os.listdir(f"{out}/ticks")) == 4


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    path, out = write_files(tmp_path / "in", batch(["a"])), str(tmp_path / "out")
    main([path, out, "--tick-ms", "10", "--chunk-size", "4"])
    assert "profiles=1" in capsys.readouterr().out
    t = read_tables(spark, out)
    assert t["query_text"].count() == 2
    assert t["ticks"].count() == 14 + 23
    main([path, str(tmp_path / "streamed"), "--checkpoint", str(tmp_path / "progress")])
    assert read_tables(spark, str(tmp_path / "streamed"))["queries"].count() == 1
