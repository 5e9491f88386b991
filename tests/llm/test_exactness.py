"""Words that a weak hash takes for equal, archives of both versions, and the largest id."""

import gzip
import os

import pytest

from tickloom.llm import decontamination, near_copies, staging, substrings, warc
from tickloom.llm import words as W


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t


ONE = thue_morse(1024)
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def test_word_hashes_differ():
    import numpy as np

    words = [ONE[:n] for n in (8, 16, 64, 255, 256, 257, 1024)] + [OTHER[:n] for n in (8, 16, 64, 255, 256, 257, 1024)]
    data = np.frombuffer(" ".join(words + words).encode(), np.uint8)
    found = W.SPACED.hashes(data).tolist()
    assert found[: len(words)] == found[len(words) :] and len(set(found)) == len(words)


def test_repeats_by_words(spark):
    rows = [(1, " ".join([ONE] * 13)), (2, " ".join([OTHER] * 13)), (3, " ".join([ONE] * 13))]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 13)]


def test_near_copies_by_words(spark):
    text = lambda w: f"{w} x {w} y {w} z"
    rows = [(1, text(ONE)), (2, text(OTHER)), (3, text(ONE))]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), k=2, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_benchmark_hits_by_words(spark):
    docs = spark.createDataFrame([(1, f"p {ONE} q"), (2, f"p {OTHER} q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, OTHER)], "item_id long, text string")
    got = {r.row.doc_id: (r.n_hit, list(r["items"])) for r in decontamination.benchmark_hits(docs, items).collect()}
    assert got == {1: (0, []), 2: (1, ["7"])}


def test_largest_and_missing_id(spark):
    rows = [(2**63 - 1, " ".join(map(str, range(20)))), (None, "a b"), (5, " ".join(map(str, range(14))))]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {2**63 - 1: 14, None: 0, 5: 0}


def record(version, page, body):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC-Type: response\r\nWARC-Record-ID: <r{page}>\r\nX-Page-Id: {page}\r\nContent-Length: {len(block)}\r\n"
    return f"WARC/{version}\r\n".encode() + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_both_versions(spark, tmp_path, version):
    bodies = [b"one", b"", b"WARC/1.0\r\nWARC/1.1\r\n\r\n\r\nWARC/1.", b"\r\n\r\n" * 3, b"last WARC/1.1"]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(b"".join(record(version, i, b) for i, b in enumerate(bodies))))
    responses, _ = warc.read_warc(spark, str(path))
    assert sorted((r.record_id, bytes(r.payload)) for r in responses.collect()) == [(f"<r{i}>", b) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("junk", ["after", "before", "version"])
def test_bytes_between_records_are_an_error(spark, tmp_path, junk):
    one, two = record("1.0", 1, b"one"), record("1.0", 2, b"two")
    data = {"after": one + b"junk" + two, "before": b"junk" + one, "version": one + record("1.7", 2, b"two")}[junk]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="a.warc.gz"):
        warc.read_warc(spark, str(path))[0].collect()


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = staging.staged(spark.range(1000).repartition(3, "id"), "shuffled")
    assert rows.count() == 1000
    # The count's own shuffle has one short row a task.
    left = _shuffle_files(spark) - before
    assert len({f.split("_")[1] for f in left}) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
