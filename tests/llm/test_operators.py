"""The other text operators on small cases and against plain Python."""

import base64
import datetime
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import plan
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import decontamination, main_text, mixing, near_copies, pii, quality, topk, urls, warc
from tickloom.llm import components as component_steps
from tickloom.llm.components import components
from tickloom.llm.fm_index import FMIndex
from tickloom.llm.queries import RULES

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# --- mixing ----------------------------------------------------------------------------


def plain_targets(weights, sizes, budget, epochs):
    """Sources in the order in which they fill up."""
    targets, left, weight = [0.0] * len(sizes), budget, sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: epochs * sizes[i] / weights[i])
    for n, i in enumerate(order):
        if epochs * sizes[i] * weight > left * weights[i]:
            for j in order[n:]:
                targets[j] = left / weight * weights[j]
            break
        targets[i] = float(epochs * sizes[i])
        left, weight = left - targets[i], weight - weights[i]
    return targets


def test_targets(spark):
    def shared(weights, sizes, budget, epochs):
        rows = [(i, float(w), s) for i, (w, s) in enumerate(zip(weights, sizes, strict=True))]
        got = mixing.with_targets(spark.createDataFrame(rows, "i int, weight double, source_size long"), budget, epochs)
        return [r.target for r in got.orderBy("i").collect()]

    assert shared([5, 2, 1], [10, 100, 100], 315.0, 2) == [20.0, 200.0 * 0 + 295 * 2 / 3, 295 / 3]
    assert shared([5, 2], [0, 10], 15.0, 2) == [0.0, 15.0]
    assert shared([], [], 0.0, 2) == []
    assert shared([1, 1], [1, 2], 100.0, 2) == [2.0, 4.0]
    assert shared([0, 1], [9, 9], 9.0, 2) == [0.0, 9.0]
    rng = random.Random(8)
    for _ in range(3):
        weights, sizes = [rng.choice([1, 2, 5]) for _ in range(60)], [int(10 ** (5 * rng.random())) for _ in range(60)]
        np.testing.assert_allclose(shared(weights, sizes, 1.5 * sum(sizes), 2), plain_targets(weights, sizes, 1.5 * sum(sizes), 2))


def test_mix_of_many_sources_and_rows_without_id(spark):
    docs = spark.range(6000).selectExpr(
        "if(id % 3 = 0, null, id) doc_id", "concat_ws(' ', array_repeat('w', 1 + cast(id % 7 as int)), id) text", "if(id % 2 = 0, 'hot', concat('s', id)) source", "id bucket"
    )
    got = mixing.curriculum(docs, ["bucket"]).collect()
    total, by_source = sum(r.size for r in got), {}
    for r in got:
        key = "hot" if r.row.bucket % 2 == 0 else r.row.bucket
        by_source.setdefault(key, [r.target, r.source_size, 0])[2] += sum(c.words for c in r.copies)
    assert len(got) == 6000 and len(by_source) == 3001
    assert all(words == int(target) <= 2 * size for target, size, words in by_source.values())
    assert abs(sum(t for t, _, _ in by_source.values()) - 1.5 * total) < 1e-3
    order = sorted(by_source, key=lambda k: str(k) if k == "hot" else f"s{k}")
    weights, sizes = [(5, 2, 1)[i % 3] for i in range(3001)], [by_source[k][1] for k in order]
    np.testing.assert_allclose([by_source[k][0] for k in order], plain_targets(weights, sizes, 1.5 * total, 2))


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", "é", None]), 1.0) for i in range(400)]
    rows += [(900, None, "a", 0.0), (901, "", None, 0.0), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.curriculum(docs, docs.columns).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        words = sum(c.words for c in r.copies)
        assert 0 <= words <= 2 * r.size and all(0 <= c.position <= 1 for c in r.copies)
        taken.setdefault(r.row.source, [r.target, r.source_size, 0])[2] += words
    for target, size, words in taken.values():
        assert words == int(target) <= 2 * size
    assert abs(sum(t for t, _, _ in taken.values()) - 1.5 * sum(s for _, s, _ in taken.values())) < 1e-6
    again = mixing.curriculum(docs.repartition(7), docs.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    ordered = mixing.training_order(mixing.curriculum(docs, docs.columns), 3).collect()
    assert [r.position for r in ordered] == sorted(r.position for r in ordered)
    # The heavy first source fades out: more of it is in the first half.
    first = [r.position for r in ordered if r.row.source == "a"]
    assert np.mean(first) < 0.5
    assert mixing.training_order(mixing.curriculum(docs.where("false"), docs.columns)).collect() == []


# --- decontamination -------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=6))
def test_fm_index(text, phrases):
    which, at = FMIndex(np.array(text), 4).search(np.array(phrases))
    want = sorted((i, j) for i, p in enumerate(phrases) for j in range(len(text) - 2) if text[j : j + 3] == p)
    assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == want


def brute_hits(docs, items):
    low = lambda t: re.findall(ALNUM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = low(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = low(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_benchmark_hits(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontamination, "SHARD_SYMBOLS", 200)
    rng = random.Random(5)
    word = lambda: rng.choice("ab") + rng.choice("cdé")
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 9, 10, 14, 30])))) for i in range(12)] + [(50, None), (None, "ac ac"), (3, "ad, ad ad")]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.choice([0, 2, 30, 60]))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", "-", ". "]).join(w).replace("a", rng.choice("aA"))))
    docs += [(100, None), (101, ""), docs[3]]
    got = decontamination.benchmark_hits(
        spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, spans string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert sorted((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == brute_hits(docs, items)
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_hit for r in got)


def test_benchmark_without_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    (row,) = decontamination.benchmark_hits(docs, none).collect()
    assert (row.n_words, row.n_hit, row["items"], row.spans) == (2, 0, [], [])


# --- components ------------------------------------------------------------------------


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")).collect() == []


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_forests_keep_what_edges_connect(monkeypatch, held):
    monkeypatch.setattr(component_steps, "HELD_EDGES", held)
    rng = np.random.default_rng(held)
    edges = [(bytes([a]), bytes([b])) for a, b in np.sort(rng.integers(0, 120, (90, 2)), axis=1).tolist() if a < b]
    batches = [pa.record_batch([pa.array(c, pa.binary()) for c in zip(*edges[i : i + 5], strict=True)], ["a", "b"]) for i in range(0, len(edges), 5)]
    found = [(r["a"], r["b"]) for batch in component_steps._forests(iter(batches)) for r in batch.to_pylist()]

    def groups(pairs):
        root = {x: {x} for e in edges for x in e}
        for a, b in pairs:
            both = root[a] | root[b]
            root |= dict.fromkeys(both, both)
        return {frozenset(x) for x in root.values()}

    assert groups(found) == groups(edges)
    assert all(a < b for a, b in found)
    if held > len(edges):
        assert all(len({a for a, b in found if b == x}) == 1 for x in {b for _, b in found})


# --- WARC ------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 50))
def test_chunked_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


def test_archives(spark, tmp_path):
    long = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 40_000 + "\r\nWARC/1.1\r\n"
    pages = [(5, "http://a/ b", "same"), (2, None, "same"), (9, "u\r\nX: y", "same"), (1, "u", None), (3, "u", ""), (7, "u", long), (8, "u", long), (None, "u", "alone"), (2, None, "same")]
    frame = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, refers string").repartition(3)
    got = sorted(map(tuple, warc.archived(frame).collect()), key=str)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = min((j for j, _, x in pages if (x or "") == (h or "") and j is not None), default=None)
        kind = "response" if i == first or first is None else "revisit"
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    path = str(tmp_path / "warc")
    warc.write_warc(frame, path, least=10_000, segment=1000)
    responses, revisits = warc.read_warc(spark, path)
    assert sorted(bytes(r.payload) for r in responses.collect()) == sorted((h or "").encode() for i, _, h in pages if i != 8)
    assert [r.page_id for r in revisits.collect()] == [8]
    assert warc.archived(frame.where("false")).collect() == []


# --- personal data ---------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 300), st.binary(min_size=1, max_size=8))
def test_feistel_is_a_permutation(size, key):
    assert sorted(pii.permuted(i, size, key, "t") for i in range(size)) == list(range(size))


KEY = b"k"


@pytest.mark.parametrize(
    "value, kind",
    [
        ("4111 1111 1111 1111", "number"),
        ("9807915762804495", "number"),
        ("und.34@mail7.example.com", "email"),
        ("+1 (017) 555-7713", "phone"),
        ("233.254.104.120", "ip"),
        ("123-45-6789", "ssn"),
        ("2024-02-29", "date_ymd"),
        ("31.12.1999", "date_dmy"),
        ("DE89 3704 0044 0532 0130 00", "iban"),
        ("2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "secret"),
    ],
)
def test_pseudonyms_keep_the_format(value, kind):
    text, found = pii.pseudonymised(f"Is {value}!! and {value}, so", KEY)
    (a, b) = [f for f in found if f[0] == kind]
    new = text[3 : text.index("!!")]
    assert new != value and text == f"Is {new}!! and {new}, so" and len(found) == 2
    if kind not in ("ip", "email"):
        assert re.sub("[0-9]", "9", re.sub("[a-f]", "9", new)) == re.sub("[0-9]", "9", re.sub("[a-f]", "9", value))
    assert pii.pseudonymised(text, KEY)[1][0][0] == kind


def test_pseudonyms_stay_valid_and_linked():
    card = pii.pseudonym("number", "4111111111111111", KEY)
    assert pii.luhn_digit(card[:-1]) == card[-1]
    assert pii.pseudonym("number", "4111-1111-1111-1111", KEY).replace("-", "") == card
    assert pii.pseudonym("number", "4111111111111111", b"other") != card
    days = {pii.pseudonym("date_ymd", (datetime.date(2000, 1, 1) + datetime.timedelta(i)).isoformat(), KEY) for i in range(500)}
    assert len(days) == 500 and all(datetime.date.fromisoformat(d) for d in days)
    assert pii.pseudonym("date_ymd", "2023-02-29", KEY) is None
    assert pii.pseudonym("ip", "300.1.1.1", KEY) is None


def test_clean_texts_stay(spark):
    clean = ["Version 2.0 of 1234 items, 3.5.", "", None, "a@b", "call 12-34", "x" * 100_000, "100 200 300", "ISBN 9783161484100"]
    clean += ["order 1234567890123", "1700000000000", "version 10.20.30.40", "v1.2.3.4", "9807915762804490", "300-20-10 000.000.00", "@x.org ..@x.org"]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(clean)], "doc_id long, text string, found string")
    assert [(r.text, r.found) for r in pii.pseudonymise(docs, KEY).orderBy("row.doc_id").collect()] == [(t, []) for t in clean]


def test_mail_names():
    def one(text):
        new, found = pii.pseudonymised(text, KEY)
        return new, [text[b:e] for _, b, e in found]

    new, found = one("To Ann.Lee@x.org, ann.lee@x.org; a@b.com.cc@d.com é%+@e-f.de")
    assert found == ["Ann.Lee@x.org", "ann.lee@x.org", "a@b.com.cc", "é%+@e-f.de"]
    first, second = new[3:].split(", ")[0], new.split(", ")[1].split(";")[0]
    assert first.lower() == second and first != "Ann.Lee@x.org"


@pytest.mark.parametrize("unit", ["a", "a.", "a@", "a@b.", "%", "1", "1 ", "1.", "(1", "+1", "a1", "AB12", "2020-", "-"])
def test_pseudonyms_in_linear_time(unit):
    import time

    started = time.process_time()
    pii.pseudonymised("@ " + unit * (1_000_000 // len(unit)) + " 1 1", KEY)
    assert time.process_time() - started < 20


def test_pseudonyms_against_plain_search(spark):
    """The kinds that the test documents hold, found by plain rules over whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = pii.pseudonymise(docs, KEY).select("row.doc_id", "row.text", F.col("text").alias("new"), "found").collect()
    names, back, total = {}, {}, 0
    for r in rows:
        want, at = [], 0
        for word in re.split(r"([\s\"',;|]+)", r.text or ""):
            bare = re.match(r"[\w.@+-]*", word)[0].rstrip(".")
            digits = sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(bare))) if bare.isdecimal() else 1
            if re.fullmatch(r"\w+\.\d+@mail\d\.example\.com", bare):
                want.append(("email", at, at + len(bare)))
            elif re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", bare) and all(int(x) < 256 for x in bare.split(".")):
                want.append(("ip", at, at + len(bare)))
            elif len(bare) == 16 and digits % 10 == 0:
                want.append(("number", at, at + len(bare)))
            elif re.fullmatch("[0-9a-f]{40}|[0-9A-F]{40}", bare):
                want.append(("secret", at, at + len(bare)))
            at += len(word)
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+1 \(\d{3}\) \d{3}-\d{4}", r.text or "")]
        assert [tuple(f) for f in r.found] == sorted(want, key=lambda w: w[1])
        a, shift = 0, 0
        for kind, b, e in r.found:
            # Pseudonyms of addresses may be longer or shorter; the text after them shows where they end.
            assert r.new[a + shift : b + shift] == r.text[a:b]
            rest = r.text[e : e + 8] if e < len(r.text) else None
            end = len(r.new) if rest is None else r.new.index(rest, b + shift + 1)
            value, new = r.text[b:e], r.new[b + shift : end]
            assert names.setdefault((kind, value.lower()), new.lower()) == new.lower() and back.setdefault((kind, new.lower()), value.lower()) == value.lower()
            shift, a, total = end - e, e, total + 1
        assert r.new is None if r.text is None else r.new[a + shift :] == r.text[a:]
    assert total > 5


# --- URLs ------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r.text for r in RULES for h, _, p in [r.text.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    made = ["http://A.Example.NET/en/1", "http://example.net/de", "http://net", "http://net/", "x://a.net?q/", "http://b.org/fr/", "http://borg/fr/", "http://c.example.com/de/#x", "http://É.com/a?b#c", "nothing", "", None, "http://casino-a.com/x", "a://b://c/d", "http://x.orgy/fr/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(made * 3)], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(f"http://{'casino-' * (i % 2)}h{i}.com/a", i % 2) for i in range(60)] + [(None, 1), ("u", None)], "url string, label int")
    got = urls.judged(pages, RULES, labelled).collect()
    assert {(r.page_id, r.host, r.path, r.rule) for r in got} == {(i, *brute_rule(u)) for i, u in enumerate(made * 3)}
    verdicts = {r.text: r.verdict for r in RULES}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)
    assert {r.verdict for r in got if r.host == "casino-a.com"} == {"block"}
    assert urls.judged(pages, RULES, labelled.where("false")).where("rule is null and verdict = 'block'").count() == 0


# --- main text -------------------------------------------------------------------------

PAGE = (
    '<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
    '<div class="ad">Buy it now</div><div id="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>bold</b>\n text<br>next.</p>'
    '<aside>See also</aside><p title="a>b">Two &lt;3</p><form><label>Name</label><input></form><div class="comments"><p>First!</p></div></article>'
    '<div class="sidebar">More</div><footer>&copy; us</footer></body></html>'
)


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>x</nav>"), (5, "u", "plain words"), (6, "u", "<p>a<script>never closed")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    assert got[1] == "A & B\nOne bold text\nnext.\nTwo <3"
    assert [got[i] for i in (2, 3, 4, 5, 6)] == ["", "", "", "plain words", "a"]
    assert main_text.extract(pages.where("false")).collect() == []


# --- top k -----------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(400)]
    bad = [(1000, None), (1050, [1.0, None, 0.0, 0.0]), (1100, [float("nan")] * 4), (1150, [float("inf")] * 4), (None, [1.0] * 4), (2000, [1.0, 2.0]), (2001, [3.0, 1.0])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(frame).collect()))
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    want = [(2000, 1, 2001, 2 * 0 + 256 * 3 * 256 + 512 * 256)]
    for q, a in whole:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in whole if c != q)[:5]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(frame.where("false")).collect() == []


def test_no_queries_go_through_the_driver(spark):
    """However small their file is: repeated for every shard, they are not."""
    frame = spark.range(500).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    found = plan(topk.top_k(frame))
    assert "CartesianProduct" in found and "Broadcast" not in found


def test_products_of_any_size():
    q, c = np.array([[2.0**70, 3.0], [-(2.0**61), 1.0]]), np.array([[0.0, 5.0], [1.0, 2.0**60]])
    with pytest.raises(OverflowError):
        topk._products(q, c)
    assert topk._products(q[1:], c).tolist() == [[5, -(2**61) + 2**60]]
    assert topk._products(q[:1], c[:1]).tolist() == [[15]]
    assert topk._products(np.array([[2.0**40]]), np.array([[2.0**20 + 1]])).tolist() == [[2**60 + 2**40]]


# --- quality ---------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randint(1, 8))) for _ in range(60)) + "."
    junk = [lambda: prose().upper().replace(" ", "!! "), lambda: prose().replace(" ", " | "), lambda: "buy " * 60]
    rows = [(i, prose() if i % 5 else rng.choice(junk)(), 0.0) for i in range(1500)] + [(None, "x", 0.0), (3000, None, 0.0), (3001, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 1500, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).select("row.doc_id", "score", quality.held_out(F.col("row.doc_id")).alias("out")).collect()
    scores = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[3000] == scores[3001]
    right = [(scores[i] >= 0.3) == (i % 5 > 0) for i in range(1500)]
    assert np.mean(right) > 0.97
    import zlib

    assert {r.doc_id for r in got if r.out} == {i for i in scores if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    none = quality.quality_scores(docs.where("doc_id < 3"), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_from_positives_alone(spark):
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randint(1, 8))) for _ in range(60)) + "."
    # A hot id (labelled good, and all its texts are), rows without id and repeated rows; junk otherwise at every third.
    ids = [i if i % 4 else (None if i % 8 else 7) for i in range(1500)]
    good = [k == 7 or i % 3 > 0 for i, k in enumerate(ids)]
    rows = [(k, prose() if good[i] else prose().upper().replace(" ", "!! "), i) for i, k in enumerate(ids)]
    docs = spark.createDataFrame(rows + rows[:200], "doc_id long, text string, i long")
    labels = spark.createDataFrame([(i, 1) for i in range(1500) if i % 4 and i % 3 and i % 2], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert abs(model.prior - np.mean(good)) < 0.07
    scored = quality.quality_scores(docs, labels).select("row.i", "score").collect()
    assert len(scored) == 1700
    assert np.mean([(r.score >= 0.3) == good[r.i] for r in scored]) > 0.97
    assert quality.quality_scores(docs.where("false"), labels).collect() == []
    assert {r.score for r in quality.quality_scores(docs.where("i < 9").withColumn("doc_id", F.lit(None).cast("long")), labels).collect()} == {0.5}


def test_quality_samples_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITIVES", 100)
    monkeypatch.setattr(quality, "UNLABELLED", 200)
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: sizes.append((len(p), len(u))) or quality.Model(np.zeros(35), np.ones(35), np.zeros(35), 0.0, prior))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    for key in ("7L", "cast(null as bigint)", "id"):
        quality.train(spark.range(20_000).selectExpr(f"if(id < 3000, 7L, {key}) doc_id", "concat('text ', id) text"), labels)
    assert all(p < 200 and 100 < u < 300 for p, u in sizes) and len(sizes) == 3


# --- staging ---------------------------------------------------------------------------


def test_staged_tables_are_removed(spark, monkeypatch, tmp_path):
    import os

    from tickloom.llm import staging

    monkeypatch.setattr(staging, "shared_folder", lambda spark: str(tmp_path / "shared"))
    docs = spark.createDataFrame([(i, f"a b c {i % 3} d e f", "s") for i in range(30)], "doc_id long, text string, source string")
    with staging.temporary(spark):
        near_copies.near_copies(docs).write.parquet(str(tmp_path / "copies"))
        mixing.curriculum(docs, ["doc_id"]).write.parquet(str(tmp_path / "mix"))
        assert len(os.listdir(tmp_path / "shared")) > 5
    assert os.listdir(tmp_path / "shared") == []
    assert spark.read.parquet(str(tmp_path / "mix")).count() == 30
    with pytest.raises(ValueError), staging.temporary(spark):
        staging.staged(docs, "gone")
        raise ValueError
    assert os.listdir(tmp_path / "shared") == []
