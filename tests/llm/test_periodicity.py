"""Runs of repeated words against plain Python."""

import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import periodicity, queries


def brute(w, exponent, shortest):
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(shortest, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def kept(w, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(rng):
    w = [rng.choice("abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(rng.choice([0, 1, 5, 24, 100, 300]))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.choice(["x", "y", "long" * 5]) for _ in range(rng.choice([1, 2, 3, 5, 8, 17, 40]))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = (unit * rng.randint(2, 9))[: rng.randint(1, 200)]
    return w


@pytest.mark.parametrize(("exponent", "shortest"), [(3, 24), (2, 1), (2, 24), (4, 3), (3, 1)])
def test_runs(exponent, shortest):
    rng = random.Random(exponent * 100 + shortest)
    for _ in range(25):
        texts = [words(rng) for _ in range(rng.randint(1, 5))]
        got = list(periodicity.repeats(pa.array([" ".join(w) for w in texts]), exponent, shortest))
        assert [g.runs for g in got] == [brute(w, exponent, shortest) for w in texts]
        assert [g.collapsed for g in got] == [kept(w, g.runs) for w, g in zip(texts, got, strict=True)]


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=60))
def test_squares_of_two_words(text):
    assert next(periodicity.repeats(pa.array([" ".join(text)]), 2, 1)).runs == brute(list(text), 2, 1)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 100_000, fibonacci(200_000), "".join(random.Random(1).choices("ab", k=200_000))])
def test_long_texts_of_few_words(text):
    began = time.time()
    found = next(periodicity.repeats(pa.array([" ".join(text)])))
    assert time.time() - began < 10
    for s, length, p in found.runs[:200]:
        assert text[s : s + length - p] == text[s + p : s + length]


def test_one_long_period():
    text = [str(i) for i in range(50_000)]
    found = next(periodicity.repeats(pa.array([" ".join(["x", *text, *text, *text, "0", "y"])])))
    assert found.runs == [(1, 150_001, 50_000)] and found.best == (1, 150_001, 50_000)


def test_best_is_exact():
    found = periodicity.Repeats(0, [(9, 72, 24), (5, 30, 10), (2, 60, 20), (2, 3, 1)], "")
    assert found.best == (2, 3, 1)
    assert periodicity.Repeats(0, [(0, 10**9, 3 * 10**8), (1, 10**9 + 1, 3 * 10**8)], "").best[0] == 1


def test_collapsed(spark):
    rows = [(1, "a " * 30 + "b", "x"), (2, None, "x"), (3, "", None), (None, " \n\t", "x"), (5, "w" * 100_000, "x"), (6, "é  ü\n" * 12, "x")]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodicity.collapsed(docs, ["doc_id", "runs"]).collect()
    assert sorted((r.row.doc_id or 0, r.n_words, len(r.runs), r.collapsed) for r in got) == sorted(
        [(1, 31, 1, "a b")] * 4 + [(2, 0, 0, ""), (3, 0, 0, ""), (0, 0, 0, ""), (5, 1, 0, "w" * 100_000), (6, 24, 1, "é ü")]
    )
    assert all(r.best is None or tuple(r.best) == tuple(r.runs[0]) for r in got)
    assert periodicity.collapsed(docs.where("false"), ["doc_id"]).collect() == []


def test_planted_periods(spark):
    text = " ".join(map(str, range(100)))
    docs = spark.createDataFrame([(i, text) for i in range(300)] + [(None, text), (301, None), (302, " ")], "doc_id long, text string")
    planted = {r.doc_id: r.text for r in queries.with_planted_periods(docs).collect()}
    changed = [i for i, t in planted.items() if t not in (text, None, " ")]
    assert 15 < len(changed) < 50 and None not in changed
