"""Profile files to lines."""

import gzip
import json
import re

import pytest
from helpers import profile, rows, write_files
from pyspark.sql import functions as F

from checks import queries
from tickloom.operators import sinks
from tickloom.sources.profile_files import read_listed, read_profile_lines, scan_files
from tickloom.sources.profile_json import parse_profiles, usable


def ids(spark, path, **options):
    profiles = usable(parse_profiles(read_profile_lines(spark, path, **options)))
    return rows(profiles.select("queryId", "attempt", "userId"))


@pytest.mark.parametrize("whole_file_limit", [1 << 20, 0])
def test_names_attempts_and_line_ends(spark, tmp_path, whole_file_limit):
    a, b, c = (json.dumps(profile(user=u)) for u in "abc")
    path = write_files(
        tmp_path / "in",
        {
            "profile_one.json": a,
            "profile_three.JSON": f"{a}\n{b}\n{c}\n",
            "profile_dos.json": f"{a}\r\n{b}\r\n",
            "profile_mac.json": f"{a}\r{b}",
            "profile_gap.json": f"{a}\n\n  \n{b}\n",
            "profile_mark.json": f"﻿{a}\n",
            "profile_a b+c%41.json": a,
            "profile_empty.json": "",
            "short.json": a,
            ".profile_three.JSON.crc": "check",
            "profile_one.json.crc": "check",
            "profile_notes.txt": a,
        },
    )
    assert ids(spark, path, whole_file_limit=whole_file_limit) == sorted(
        [
            ("one", 0, "a"),
            ("three", 0, "a"),
            ("three", 1, "b"),
            ("three", 2, "c"),
            ("dos", 0, "a"),
            ("dos", 1, "b"),
            ("mac", 0, "a"),
            ("mac", 1, "b"),
            ("gap", 0, "a"),
            ("gap", 3, "b"),
            ("mark", 0, "a"),
            ("a b+c%41", 0, "a"),
            ("", 0, "a"),
        ]
    )


def test_subdirectories_are_not_read(spark, tmp_path):
    write_files(tmp_path / "in" / "deeper", {"profile_x.json": [profile()]})
    path = write_files(tmp_path / "in", {"profile_y.json": [profile()]})
    assert ids(spark, path) == [("y", 0, "ann")]


def test_a_large_file_is_split_and_its_lines_keep_their_positions(spark, tmp_path, conf):
    users = [f"user{i:04}" * (1 + i % 5) for i in range(2000)]
    path = write_files(
        tmp_path / "in",
        {
            "profile_big.json": [profile(user=u) for u in users],
            "profile_other.json": [profile(user=u) for u in users[:700]],
            "profile_small.json": [profile(user="s")],
        },
    )
    conf("spark.sql.files.maxPartitionBytes", "50000")
    lines = read_profile_lines(spark, path, whole_file_limit=100_000)
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = ids(spark, path, whole_file_limit=100_000)
    want = [("big", i, u) for i, u in enumerate(users)]
    want += [("other", i, u) for i, u in enumerate(users[:700])]
    assert got == sorted([*want, ("small", 0, "s")])


def test_compressed_files_are_read_line_by_line(spark, tmp_path):
    """A small compressed file may hold any amount of text, so it is not read in one piece."""
    path = write_files(tmp_path / "in", {"profile_plain.json": [profile(user="p")]})
    users = [f"user{i:03}" for i in range(300)]
    lines = [json.dumps(profile(user=u)) for u in users]
    lines.insert(7, "")
    (tmp_path / "in" / "profile_many.json.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    pattern = "*.{json,json.gz}"
    whole, by_line = scan_files(spark, path, pattern=pattern)
    assert whole.count() == 1 and by_line.count() == len(lines)
    listed = [(str(f), f.stat().st_size) for f in (tmp_path / "in").iterdir()]
    for found in (read_profile_lines(spark, path, pattern=pattern), read_listed(spark, listed)):
        got = parse_profiles(found).where("problem IS NULL").select("file_name", "attempt", "userId")
        want = [("profile_many.json.gz", i + (i >= 7), u) for i, u in enumerate(users)]
        assert rows(got) == sorted([*want, ("profile_plain.json", 0, "p")])
    assert ids(spark, path) == [("plain", 0, "p")]


def test_scanned_files_are_smaller_than_their_lines(spark, tmp_path, monkeypatch):
    """The files that the scan reads hold every line, compressed."""
    lines = [json.dumps(profile(user=f"u{i}", query=f"SELECT {i} FROM t " * 20)) for i in range(400)]
    frame = spark.createDataFrame([(f"profile_{i}.json", 0, x) for i, x in enumerate(lines)], "file_name STRING, attempt BIGINT, line STRING")
    monkeypatch.setattr(queries, "profile_lines", lambda *_: frame)
    path = queries._profile_files(spark, "")
    where, fs = sinks.file_system(spark, path)
    assert fs.getContentSummary(where).getLength() < sum(map(len, lines)) / 2
    found = read_profile_lines(spark, path, pattern="*.json.gz")
    assert sorted(r.line for r in found.collect()) == sorted(lines)
    assert queries.scan_profiles(spark, "").count() == len(lines)


def test_split_files_are_smaller_than_their_lines(spark, tmp_path, monkeypatch, conf):
    """The files hold every line, packed, and still have several splits each."""
    texts = ["SELECT * FROM t | é\U0001f600 " * (1 + i % 40) + str(i) for i in range(3000)]
    texts[7] = "x" * 300_000
    lines = [json.dumps(profile(user=f"u{i}", start=1000 + i, query=q), ensure_ascii=False, separators=(",", ":")) for i, q in enumerate(texts)]
    entries = [(f"profile_{i}.json", i % 3, x) for i, x in enumerate(lines)]
    frame = spark.createDataFrame(entries, "file_name STRING, attempt BIGINT, line STRING").repartition(6)
    monkeypatch.setattr(queries, "profile_lines", lambda *_: frame)
    monkeypatch.setattr(sinks, "new_staging_dir", lambda _: str(tmp_path))
    conf("spark.sql.files.maxPartitionBytes", "50000")
    got = queries.split_file_lines(spark, "")
    assert rows(got) == sorted((f"profile_{i}.json", i % 3, 0, 1000 + i) for i in range(len(lines)))
    files = list((tmp_path / "files").glob("part-*"))
    assert sum(f.stat().st_size for f in files) < sum(len(x.encode()) for x in lines) / 2
    splits = spark.read.text(str(tmp_path / "files")).groupBy("_metadata.file_name").agg(F.count_distinct("_metadata.file_block_start").alias("n"))
    assert splits.agg(F.min("n")).first()[0] > 1


def test_lines_are_packed_whole(spark):
    texts = ["", "a", "|\t\u2028é", "\U0001f600" * 5000, *(f"line {i} " * i for i in range(300))]
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "line BINARY").coalesce(1)
    packed = queries._packed(frame)
    assert all(re.fullmatch(b"[A-Za-z0-9+/=]+", r.line) for r in packed.collect())
    assert [r.line.decode() for r in queries._unpacked(packed).collect()] == texts
