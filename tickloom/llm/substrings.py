"""Repeated passages: windows of words that a document with a smaller id also has.

Hashing every window of ``LENGTH`` words would move as many rows as there are words.  Here only
*anchors* are hashed first: shorter windows that start at positions whose remainder modulo
``PERIOD`` lies in a difference cover.  For any two positions some common offset below
``PERIOD`` brings both into the cover, so two equal windows of ``LENGTH`` words, wherever they
stand, share an aligned anchor of ``LENGTH - PERIOD + 1`` words.  Only around anchors seen in
two documents are the full windows hashed, which decides the extension exactly.

Both steps pack the hashes of a batch into one row per hash group, and a batch keeps only its
smallest document for each hash, so a passage that a third of all documents hold is as many
entries per group as there are batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words as W
from tickloom.llm.packed import by_group, runs, unpack
from tickloom.llm.staging import staged

LENGTH = 13
#: Fixed by arithmetic: every difference modulo 7 occurs between two members of the cover.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = LENGTH - PERIOD + 1
BYTES_PER_GROUP = 16 << 20
FLUSH_WORDS = 2_000_000
NO_ID = (1 << 63) - 1
U64 = W.U64

PACKED = "grp long, hash binary, doc binary, pos binary, ids binary, found binary"
FOUND = "part long, ids binary, counts binary, found binary"
PER_DOCUMENT = "doc_id long, th long, found binary"


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(words) - ANCHOR + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    keep = np.isin(np.arange(PERIOD), COVER)[np.arange(n) % PERIOD]
    at = np.flatnonzero(keep)
    return at, W.windows(words, ANCHOR)[at]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for first, words, at in W.hashed_texts(batch.column("text"), W.SPACED):
        for i in range(len(at) - 1):
            yield first + i, words[at[i] : at[i + 1]]


class _Packer:
    """Gathers (hash, document, position) and gives them out as packed rows."""

    def __init__(self, groups: int, ordered: bool):
        self.groups, self.ordered = groups, ordered
        self.clear()

    def clear(self) -> None:
        self.hashes, self.docs, self.spots, self.keys, self.size = [], [], [], [], 0

    def add(self, key: tuple[int, int], hashes: np.ndarray, spots: np.ndarray) -> None:
        if len(hashes):
            self.hashes.append(hashes)
            self.docs.append(np.full(len(hashes), len(self.keys), np.uint32))
            self.spots.append(spots.astype(np.uint32))
            self.keys.append(key)
            self.size += len(hashes)

    def rows(self) -> pa.RecordBatch:
        keys = np.array(self.keys, np.int64).reshape(-1, 2)
        h, d, p = np.concatenate(self.hashes), np.concatenate(self.docs), np.concatenate(self.spots)
        order = np.lexsort((d, keys[d, 0], h))
        h, d, p = h[order], d[order], p[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        other = (keys[d] != keys[d[first]]).any(axis=1)
        out = []
        if self.ordered:
            # Entries of a larger id are decided; those of the smallest id go on.
            done, on = keys[d, 0] > keys[d[first], 0], keys[d, 0] == keys[d[first], 0]
        else:
            # Where two documents meet, all entries of the hash are anchors; one goes on.
            met = np.zeros(len(h), bool)
            met[np.flatnonzero(new)] = np.logical_or.reduceat(other, np.flatnonzero(new))
            done, on = met[first], new
        value = p if self.ordered else h
        if done.any():
            order = np.argsort(d[done], kind="stable")
            doc, count = np.unique(d[done], return_counts=True)
            # Replies go by document, to as many groups as the hashes have.
            replies = _by_document(keys[doc], count.astype(np.int64), _as_bytes(value[done][order], self.ordered), self.groups)
            out += [(-1 - r["part"], None, r["counts"], None, r["ids"], r["found"]) for r in replies.to_pylist()]
        h, d, p = h[on], d[on], p[on]
        for g, (hs, ds, ps) in by_group((h % U64(self.groups)).astype(np.int64), [h, d, p]):
            order = np.argsort(ds, kind="stable")
            hs, ds, ps = hs[order], ds[order], ps[order]
            used, local = np.unique(ds, return_inverse=True)
            out.append((g, hs.tobytes() if self.ordered else _as_bytes(hs, False).tobytes(), local.astype(np.uint32).tobytes(), ps.tobytes() if self.ordered else None, keys[used].tobytes(), None))
        self.clear()
        kinds = (pa.int64(), *[pa.binary()] * 5)
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "hash", "doc", "pos", "ids", "found"])


def _as_bytes(values: np.ndarray, ordered: bool) -> np.ndarray:
    """Positions as four bytes each; of anchor hashes the upper six bytes.

    A chance match of shortened anchors only adds a place to look at.
    """
    if ordered:
        return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _anchor_rows(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(groups, ordered=False)
        for batch in batches:
            ids, hashes, seen = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy(), set()
            for i, words in _texts(batch):
                key = (int(ids[i]), int(hashes[i]))
                if len(words) < LENGTH or key in seen:
                    continue
                seen.add(key)
                packer.add(key, u := np.unique(_anchors(words)[1]), np.zeros(len(u)))
                if packer.size >= FLUSH_WORDS:
                    yield packer.rows()
            if packer.size:
                yield packer.rows()

    return run


def _by_document(keys: np.ndarray, counts: np.ndarray, values: np.ndarray, parts: int) -> pa.Table:
    """What documents learn, packed into one row for each part of the documents."""
    part = (W.mix(keys[:, 0].view(U64) ^ W.mix(keys[:, 1].view(U64))) % U64(parts)).astype(np.int64)
    owner = np.repeat(np.arange(len(keys)), counts)
    rows = [
        (p, keys[docs].tobytes(), counts[docs].tobytes(), values[mine].tobytes())
        for (p, (docs,)), (_, (mine,)) in zip(
            by_group(part, [np.arange(len(keys))]), by_group(part[owner], [np.arange(len(owner))]), strict=True
        )
    ]
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["part", "ids", "counts", "found"])


def _met(ordered: bool, parts: int):
    """Per group of hashes: what each document learns about its entries."""
    width = 4 if ordered else 6

    def run(table: pa.Table) -> pa.Table:
        known_keys, known_counts, known = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)], [np.empty((0, width), np.uint8)]
        hs, ds, ps, ks, base = [], [], [], [], 0
        for h, d, p, ids, found in zip(*(table[c].to_pylist() for c in ("hash", "doc", "pos", "ids", "found")), strict=True):
            keys = np.frombuffer(ids, np.int64).reshape(-1, 2)
            if found is not None:
                known_keys.append(keys)
                known_counts.append(np.frombuffer(d, np.int64))
                known.append(np.frombuffer(found, np.uint8).reshape(-1, width))
                continue
            hs.append(np.frombuffer(h, U64) if ordered else _from_six(h))
            ds.append(np.frombuffer(d, np.uint32).astype(np.int64) + base)
            ps.append(np.frombuffer(p, np.uint32) if ordered else np.zeros(0, np.uint32))
            ks.append(keys)
            base += len(keys)
        if hs:
            h, d, keys = np.concatenate(hs), np.concatenate(ds), np.concatenate(ks)
            order = np.lexsort((keys[d, 0], h)) if ordered else np.argsort(h, kind="stable")
            at = runs(h[order])
            first = np.repeat(order[at[:-1]], np.diff(at))
            if ordered:
                hit = keys[d[order], 0] > keys[d[first], 0]
                value = np.concatenate(ps)[order][hit]
            else:
                differ = (keys[d[order]] != keys[d[first]]).any(axis=1)
                hit = np.repeat(np.logical_or.reduceat(differ, at[:-1]), np.diff(at))
                value = h[order][hit]
            doc = d[order][hit]
            order = np.argsort(doc, kind="stable")
            which, count = np.unique(doc, return_counts=True)
            known_keys.append(keys[which])
            known_counts.append(count.astype(np.int64))
            known.append(_as_bytes(value[order], ordered))
        return _by_document(np.concatenate(known_keys), np.concatenate(known_counts), np.concatenate(known), parts)

    return run


def _merged(width: int):
    """Per part of the documents: one row for each document with all it has learned."""

    def run(table: pa.Table) -> pa.Table:
        keys = unpack(table["ids"].to_pylist(), "i8").reshape(-1, 2)
        counts, values = unpack(table["counts"].to_pylist(), "i8"), unpack(table["found"].to_pylist(), "u1").reshape(-1, width)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.concatenate([[True], (np.diff(keys[order], axis=0) != 0).any(axis=1)])[: len(order)]
        document = np.empty(len(order), np.int64)
        document[order] = np.cumsum(new) - 1
        rows = [(*keys[order[new]][i].tolist(), v.tobytes()) for i, (v,) in by_group(np.repeat(document, counts), [values])]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "th", "found"])

    return run


def _window_rows(groups: int):
    """Full windows around the anchors that another document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(groups, ordered=True)
        for batch in batches:
            ids, hashes, known = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy(), batch.column("found").to_pylist()
            seen = set()
            for i, words in _texts(batch):
                key = (int(ids[i]), int(hashes[i]))
                if key in seen:
                    continue
                seen.add(key)
                at, values = _anchors(words)
                met = np.unique(_from_six(known[i]))
                at = at[np.isin(values >> U64(16) << U64(16), met)]
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(edge, at + 1, -1)
                start = np.flatnonzero(np.cumsum(edge)[: max(0, len(words) - LENGTH + 1)] > 0)
                packer.add(key, W.windows(words, LENGTH)[start], start)
                if packer.size >= FLUSH_WORDS:
                    yield packer.rows()
            if packer.size:
                yield packer.rows()

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that stay, joined by one space."""
    for batch in batches:
        data, offsets = W.text_bytes(batch.column("text"))
        totals, removed, texts = [], [], []
        for i, found in enumerate(batch.column("found").to_pylist()):
            body = np.append(data[offsets[i] : offsets[i + 1]], np.uint8(32))
            a, b = W.SPACED.spans(body)
            stay = np.ones(len(a), bool)
            if found:
                start = np.frombuffer(found, "<u4").astype(np.int64)
                edge = np.zeros(len(a) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + LENGTH, -1)
                stay = np.cumsum(edge)[:-1] == 0
            body[b] = 32
            edge = np.zeros(len(body) + 1, np.int8)
            edge[a[stay]] = 1
            edge[b[stay] + 1] -= 1
            texts.append(body[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()[:-1].decode())
            totals.append(len(a))
            removed.append(len(a) - int(stay.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "th", "n_words", "n_removed", "kept_text"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for each row of ``docs(doc_id, text)``.

    A word goes if a window of ``LENGTH`` words that covers it also starts in a document with a
    smaller ``doc_id``; all windows are judged on the input.  Texts without words (null, empty)
    keep nothing and lose nothing.  A missing ``doc_id`` counts as the largest there can be.
    Repeated rows have equal ids, so none makes another lose words.  Other columns are not read.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("given"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + size // BYTES_PER_GROUP

    def learned(packed: DataFrame, ordered: bool) -> DataFrame:
        met = packed.groupBy("grp").applyInArrow(_met(ordered, groups), FOUND)
        return met.groupBy("part").applyInArrow(_merged(4 if ordered else 6), PER_DOCUMENT)

    # Each step is written on its own, so the disk holds the shuffles of one step at a time.
    met = staged(learned(docs.mapInArrow(_anchor_rows(groups), PACKED), ordered=False), "met")
    places = docs.join(met, ["doc_id", "th"])
    removed = staged(learned(places.mapInArrow(_window_rows(groups), PACKED), ordered=True), "removed")
    out = docs.join(removed, ["doc_id", "th"], "left").drop("doc_id").withColumnRenamed("given", "doc_id").mapInArrow(
        _kept, "doc_id long, th long, n_words long, n_removed long, kept_text string"
    )
    return out.drop("th")
