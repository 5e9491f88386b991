"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import resampling
from tickloom.llm import spellings
from tickloom.llm import words as W

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [x.encode() for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(docs, target, buckets, percent, min_words):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f) % buckets] += 1
        return out

    s, t = counts(t for _, t in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(w), len(f), weight, score, None])
    open_ = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(open_[: percent * len(open_) // 100]):
        r[5] = rank + 1
    return rows


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abAéß漢0") for _ in range(rng.choice([1, 2, 3, 9, 17])))
    return [rng.choice([" ", ". ", "\0"]).join(word() for _ in range(rng.choice([0, 1, 5, 19, 20, 40, 300]))) for _ in range(300)]


SCHEMA = "doc_id long, text string, row string, score int, rank string"


def frame(spark, rows):
    """Extra columns that clash with the operator's own."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def test_crcs():
    rows = np.random.default_rng(1).integers(0, 256, (50, 13), np.uint8)
    assert resampling.crcs(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


@pytest.mark.parametrize("piece", [1 << 19, 300, 7])
def test_features_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE", piece)
    texts = [*corpus(1)[:60], None, "", " " * 500 + "a" + " " * 500 + "b", "x" * 3000 + " " + "y" * 300 + " " + "x" * 3000]
    got = [[] for _ in texts]
    for first, again, words, pairs, at in resampling.features(pa.array(texts), 97):
        for i in range(len(at) - 1):
            got[first + i] += words[at[i] + again : at[i + 1]].tolist() + [p for p in pairs[at[i] : at[i + 1]].tolist() if p >= 0]
    assert [sorted(g) for g in got] == [sorted(zlib.crc32(f) % 97 for f in features(t)[1]) for t in texts]


def test_names_are_exact():
    words = [b"", b"\0", b"\0\0", b"a" * 8, b"a" * 9, b"a" * 16, b"a" * 16 + b"\0", b"b" * 300, b"b" * 299 + b"c", b"b" * 301, b"a" * 8, b"b" * 300]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    name, n = spellings.names(data, end - [len(w) for w in words], end)
    assert n == len(set(words)) and len(set(zip(name.tolist(), words, strict=True))) == n


@pytest.mark.parametrize(("seed", "percent", "min_words"), [(1, 25, 20), (2, 100, 0), (3, 0, 20)])
def test_resampled(spark, seed, percent, min_words):
    texts = corpus(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " . "), (None, texts[3] + " b" * 30), (903, "a " * 100_000)]
    target = [*corpus(seed + 10)[:40], None]
    made = resampling.resampled(
        frame(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), ["doc_id", "rank"], percent, min_words, buckets=50
    )
    got = sorted(
        ([r.row.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in made.collect()), key=lambda r: (r[0] is None, r[0] or 0)
    )
    assert got == sorted(brute(rows, target, 50, percent, min_words), key=lambda r: (r[0] is None, r[0] or 0))
    assert resampling.drawn(made).columns == ["doc_id", "rank"]


def test_ties_and_repeated_rows(spark):
    rows = [(7, "a b " * 20)] * 5 + [(None, "a b " * 20)] * 3
    got = resampling.resampled(frame(spark, rows), spark.createDataFrame([("a",)], "text string"), ["doc_id"], 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert len({(r.row.doc_id, r.score) for r in got}) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(frame(spark, []), none, ["doc_id"]).collect() == []
    got = resampling.resampled(frame(spark, [(1, "a " * 30)]), none, ["doc_id"], 100).collect()
    assert got[0]["rank"] == 1 and got[0].weight < 0
