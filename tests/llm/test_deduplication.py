"""Near copies and repeated passages against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import near_copies, substrings
from tickloom.llm import words as W

SPACED = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, kept string, n_shingles int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, texts):
    """Extra columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    texts = [[word() for _ in range(rng.choice([0, 1, 2, 12, 13, 14, 40, 200]))] for _ in range(60)]
    for _ in range(60):
        base = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 3, len(base) // 10])):
            if base:
                base[rng.randrange(len(base))] = word()
        texts.append(base)
    passage = [word() for _ in range(30)]
    for t in texts[::3]:
        t[len(t) // 2 : len(t) // 2] = passage[rng.randint(0, 10) : rng.randint(20, 30)]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]
    return rows + [(500, None), (501, ""), (502, " \n "), rows[3], (503, "WORD " * 50), (504, "word " * 50)]


def shingles(text, k):
    w = re.findall(SPACED, lowered(text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_near(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(spark, k):
    rows = corpus(k)
    got = near_copies.near_copies(frame(spark, rows), k=k)
    assert sorted(tuple(r) for r in got.collect()) == brute_near(rows, k)


def test_near_copies_close_what_stars_leave_open(spark):
    """A family whose members are similar only to some others."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        t = list(base)
        for j in rng.sample(range(120), rng.randint(4, 16)):
            t[j] = f"v{i}_{j}"
        rows.append((i, " ".join(t)))
    assert sorted(tuple(r) for r in near_copies.near_copies(frame(spark, rows), k=2).collect()) == brute_near(rows, 2)


def test_near_copies_without_ids_and_without_rows(spark):
    rows = frame(spark, [(None, "a b c d"), (4, "a b c d"), (None, "x y"), (None, "x y")])
    got = {(r.doc_id, r.component_id, r.kept) for r in near_copies.near_copies(rows, k=2).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True)}
    assert near_copies.near_copies(rows.where("false"), k=2).collect() == []


def brute_repeats(rows):
    words = [(i, re.findall(SPACED, t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed, monkeypatch):
    rows = corpus(seed)
    monkeypatch.setattr(substrings, "BYTES_PER_GROUP", 4000)
    got = substrings.without_repeats(frame(spark, rows).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(rows)


def test_repeats_without_ids_and_without_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = frame(spark, [(None, text), (9, text), (None, text + " z")])
    got = sorted((r.doc_id is None, r.n_removed, r.kept_text) for r in substrings.without_repeats(rows).collect())
    assert got == [(False, 0, text), (True, 20, ""), (True, 20, "z")]
    assert substrings.without_repeats(rows.where("false")).collect() == []


def test_the_cover_reaches_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbZ9é中 \t\n\x0b\x1c\x85,-_", max_size=60)), max_size=8), st.sampled_from([3, 17, 1 << 19]))
def test_words(texts, piece):
    """Hashes stand for the words that the patterns find, however the bytes are cut."""
    old, W.PIECE = W.PIECE, piece
    try:
        for kind, pattern in ((W.SPACED_LOWER, SPACED), (W.ALNUM_LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            want = [re.findall(pattern, lowered(t)) for t in texts]
            got = [w[a:b] for _, w, at in W.hashed_texts(pa.array(texts, pa.string()), kind) for a, b in zip(at[:-1], at[1:], strict=True)]
            assert [len(x) for x in got] == [len(x) for x in want]
            pairs = {(h, w) for x, y in zip(got, want, strict=True) for h, w in zip(x.tolist(), y, strict=True)}
            assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})
    finally:
        W.PIECE = old


def test_band_keys_agree_for_equal_sets_and_seldom_otherwise():
    rng = np.random.default_rng(1)
    orders = near_copies._bin_orders()
    a = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    near = np.unique(np.concatenate([a[:270], rng.integers(0, 1 << 63, 30).astype(np.uint64)]))
    far = np.unique(np.concatenate([a[:60], rng.integers(0, 1 << 63, 240).astype(np.uint64)]))
    keys = near_copies.band_keys([a, a, near, far, a[:1]], orders)
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).any() and not (keys[0] == keys[3]).any()


def test_digest():
    assert W.digest(np.array([1], np.uint64)) == hashlib.blake2b((1).to_bytes(8, "little"), digest_size=16).digest()


# --- spread ----------------------------------------------------------------------------


@pytest.mark.parametrize("groups", [4, 64])
def test_replies_spread_over_groups(groups):
    """What documents of one batch learn from each other goes to as many groups as there are."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(400)] * 2
    batch = pa.record_batch([pa.array(range(800), pa.int64()), pa.array([i % 400 for i in range(800)], pa.int64()), pa.array(texts)], ["doc_id", "th", "text"])
    size = {}
    for rows in substrings._anchor_rows(groups)(iter([batch])):
        for r in rows.to_pylist():
            if r["found"] is not None:
                size[r["grp"]] = size.get(r["grp"], 0) + len(r["found"])
    assert len(size) == groups and max(size) < 0
    assert max(size.values()) < 3 * sum(size.values()) / groups


@pytest.mark.parametrize("groups", [4, 64])
def test_stars_within_a_batch_spread_over_groups(groups):
    nodes = [hashlib.sha256(str(i).encode()).digest()[:16] for i in range(1200)]
    keys = [[i // 3 * near_copies.BANDS + j for j in range(near_copies.BANDS)] for i in range(1200)]
    batch = pa.record_batch([pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])
    size, found = {}, set()
    for rows in near_copies._packed_keys(groups)(iter([batch])):
        for r in rows.to_pylist():
            if r["pairs"]:
                size[r["grp"]] = size.get(r["grp"], 0) + len(r["pairs"])
                found |= {(r["pairs"][i : i + 16], r["pairs"][i + 16 : i + 32]) for i in range(0, len(r["pairs"]), 32)}
    assert len(size) == groups and max(size) < 0 and max(size.values()) < 3 * sum(size.values()) / groups
    assert found == {(nodes[i], nodes[i + j]) for i in range(0, 1200, 3) for j in (1, 2)}


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_bitmaps_of_any_width_bound_the_difference():
    rng = np.random.default_rng(6)
    sets, links = [], set()
    for n in (1, 40, 500, 600, 6_000, 9_000, 200_000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.08, 0.3):
            changed = rng.random(n) < share
            sets.append(np.unique(np.where(changed, rng.integers(0, 1 << 63, n, dtype=np.uint64), base)))
    rows = [{"bits": near_copies.bitmap(s), "n_shingles": len(s), "root": b"%016d" % i, "node": b"%016d" % i, "tile": i % 2, "i": 0, "j": 0} for i, s in enumerate(sets)]
    assert {len(r["bits"]) for r in rows} == {512, 1024, 8192, 16384, 131072}
    links = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8}
    assert links
    run, found = near_copies._tile_pairs(80), set()
    for tiles, (i, j) in (((0,), (0, 0)), ((1,), (1, 1)), ((0, 1), (0, 1))):
        held = [{**r, "i": i, "j": j} for r in rows if r["tile"] in tiles]
        out = run(pa.Table.from_pylist(held))
        found |= {tuple(sorted((int(a), int(b)), reverse=True)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
    assert links <= found
    # Nothing unlike comes through from sets of many thousand shingles.
    assert all(jaccard(sets[i], sets[j]) > 0.6 for i, j in found if len(sets[i]) > 100)


def test_long_templated_texts_leave_few_pairs_open(spark):
    """Alike in three words of five, linked by nothing: every pair was confirmed on its texts before."""
    rng = random.Random(9)
    frame_words = [f"t{i}" for i in range(9000)]
    docs = []
    for i in range(40):
        own = [w if j % 500 < 300 else f"u{rng.randrange(10**6)}" for j, w in enumerate(frame_words)]
        docs.append((i, " ".join(own)))
    sets = [near_copies.shingle_set(next(w for _, w, _ in W.hashed_texts(pa.array([t]), W.SPACED_LOWER)), 5) for _, t in docs]
    table = pa.Table.from_pylist(
        [{"bits": near_copies.bitmap(s), "n_shingles": len(s), "root": b"%016d" % i, "node": b"%016d" % i, "tile": 0, "i": 0, "j": 0} for i, s in enumerate(sets)]
    )
    assert near_copies._tile_pairs(80)(table).num_rows == 0
    got = near_copies.near_copies(spark.createDataFrame(docs + [(100, docs[7][1] + " more")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(40)} | {100: 7}
