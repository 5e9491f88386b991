"""Fingerprints that stay alike when part of a text changes: improbable windows in Bloom filters.

Every window of ``WINDOW`` bytes has an entropy.  How often each entropy occurs over all texts
makes its rarity; windows of rare entropy tell texts apart.  Of each stretch of ``WINDOW`` windows
the rarest (then the first) gets a vote, and a window with ``VOTES`` votes is a feature.  A text
of fewer than ``SHORT`` bytes leaves nothing to choose from: all its windows of 8 bytes are
features, or the whole of it if it is shorter still.  A text's features go, in order and each once, into a chain of Bloom filters, ``FULL`` in each.  Two
fingerprints are as alike as the bits of their filters overlap: from what chance gives (0) to all
bits of the filter with fewer (1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words as W
from tickloom.llm.packed import runs
from tickloom.llm.spellings import joined

WINDOW = 32
VOTES = 8
SHORT = 4 * WINDOW
#: Bits and bytes of a filter, bits set by a feature, and features in a full filter.
BITS, BYTES, HASHES, FULL = 2048, 256, 5, 160
#: Windows with less than this share of the greatest entropy are no features.
WEAK = 0.25
#: An overlap counts where it exceeds chance by so many standard deviations, and a bit.
SURE = 4.0

# Count times its logarithm, in 65,536ths; entropies are classes of 8,192 of these.
_GREATEST = int(WINDOW * np.log2(WINDOW)) << 16
_COUNTS = np.arange(1, WINDOW + 1)
_WORTH = np.concatenate([[0], np.round(_COUNTS * np.log2(_COUNTS) * 65536)]).astype(np.int32)
_STEP = np.diff(_WORTH)
_CLASS = 13
CLASSES = (_GREATEST >> _CLASS) + 1
_NEVER = np.int32(2**31 - 1)
_PLACE = 20
_PIECE = W.PIECE
U64 = np.uint64


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class of the entropy of the window that starts at each byte, in whole numbers throughout."""
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int32)
    # How often the byte at a place occurs again within a window after it, and before it.
    later, earlier = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = (data[:-lag] == data[lag:]).view(np.uint8)
        later[:-lag] += same
        earlier[lag:] += same
    worth = np.empty(n, np.int32)
    worth[0] = _WORTH[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(_STEP[earlier[WINDOW:]] - _STEP[later[: n - 1]], out=worth[1:])
    worth[1:] += worth[0]
    # Rounding can leave the entropy of a window of equal bytes a little below 0.
    return np.maximum(_GREATEST - worth, 0) >> _CLASS


def _windows_inside(start: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` windows over joined texts lie in one text; a text and its space end at ``start``."""
    ok = np.ones(n, bool)
    for back in range(WINDOW):
        at = start[1:] - 1 - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def _parts(size: int) -> Iterator[tuple[int, int, int, int]]:
    """A long text in parts: first and last window of the part, and the bytes to look at for it."""
    for begin in range(0, max(1, size), _PIECE):
        end = min(size, begin + _PIECE)
        yield begin, end, max(0, begin - WINDOW), min(size, end + 3 * WINDOW)


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: index of the first, their bytes with a space after each, and starts."""
    data, offsets = W.text_bytes(column)
    for first, last in W.grouped_texts(data, offsets):
        yield first, *joined(data, offsets[first : last + 1])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for _, data, start in _pieces(batch.column("text")):
            for begin, end, a, b in _parts(len(data)):
                found = entropy_classes(data[a:b])
                inside = _windows_inside(start - a, len(found))
                inside[: begin - a] = inside[end - a :] = False
                total += np.bincount(found[inside], minlength=CLASSES)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["class", "n"])


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rarest class first, of equally rare ones the lower entropy; -1 for classes that are too weak."""
    order = np.lexsort((np.arange(len(counts)), counts))
    out = np.empty(len(counts), np.int32)
    out[order] = np.arange(len(counts))
    out[: int(WEAK * len(counts))] = -1
    return out


def rarity(docs: DataFrame) -> np.ndarray:
    """`ranks` over all windows of ``docs(text)``; the driver gets at most ``CLASSES`` sums."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = np.zeros(CLASSES, np.int64)
    for r in texts.mapInArrow(_histogram, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r["n"]
    return ranks(counts)


def _selected(data: np.ndarray, inside: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Windows with enough votes."""
    value = rank[entropy_classes(data)]
    key = np.full(len(data) + WINDOW, _NEVER, np.int32)
    n = len(value)
    key[:n] = np.where(inside & (value >= 0), (value << _PLACE) | np.arange(n, dtype=np.int32), _NEVER)
    step = 1
    while step < WINDOW:
        key[:-step] = np.minimum(key[:-step], key[step:])
        step *= 2
    winner = key[:n][inside]
    votes = np.bincount(winner[winner != _NEVER] & ((1 << _PLACE) - 1), minlength=n)
    return np.flatnonzero(votes >= VOTES)


def _hashes(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hash of the window at each place."""
    body = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", body, strides=(1,))
    value = np.zeros(len(at), U64)
    for i in range(0, window, 8):
        value = W.mix((value + U64(i + 1)) * U64(0x9E3779B97F4A7C15) ^ W.mix(eights[at + i]))
    return value


def _whole(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def _chained(text: np.ndarray, hashes: np.ndarray, n: int) -> list[bytes]:
    """Per text the filters with the number of their features before each; features in order of text."""
    # A feature goes in once.
    _, once = np.unique(np.stack([text.astype(U64), hashes], 1), axis=0, return_index=True)
    once.sort()
    text, hashes = text[once], hashes[once]
    count = np.bincount(text, minlength=n)
    begin = np.cumsum(count) - count
    filters = -(-count // FULL)
    first = np.cumsum(filters) - filters
    ordinal = np.arange(len(text)) - begin[text]
    which = first[text] + ordinal // FULL
    table = np.zeros((int(filters.sum()), 1 + BYTES), np.uint8)
    table[:, 0] = np.bincount(which, minlength=len(table))
    for i in range(HASHES):
        bit = ((hashes >> U64(11 * i)) & U64(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(table, (which, 1 + (bit >> 3)), (1 << (bit & 7)).astype(np.uint8))
    return [table[a : a + m].tobytes() for a, m in zip(first.tolist(), filters.tolist(), strict=True)]


def fingerprints(column: pa.Array, rank: np.ndarray) -> list[bytes]:
    """The fingerprint of each text, whole; null and empty texts have none (no bytes)."""
    out: list[bytes] = []
    for _, data, start in _pieces(column):
        n, size = len(start) - 1, np.diff(start) - 1
        texts, hashes = [], []
        for begin, end, a, b in _parts(len(data)):
            part = data[a:b]
            at = _selected(part, _windows_inside(start - a, max(0, len(part) - WINDOW + 1)), rank)
            at = at[(at >= begin - a) & (at < end - a)]
            texts.append(np.searchsorted(start, at + a, side="right") - 1)
            hashes.append(_hashes(part, at, WINDOW))
        text, value = np.concatenate(texts), np.concatenate(hashes)
        long = size[text] >= SHORT
        text, value = text[long], value[long]
        # Texts without a chosen window, but not empty.
        bare = (np.bincount(text, minlength=n) == 0) & (size > 0)
        eights = np.where(bare & (size < SHORT), np.maximum(size - 7, 0), 0)
        short = np.repeat(np.arange(n), eights)
        at = start[short] + np.arange(len(short)) - np.repeat(np.cumsum(eights) - eights, eights)
        whole = np.flatnonzero(bare & (eights == 0))
        text = np.concatenate([text, short, whole])
        digests = [_whole(data[start[i] : start[i] + size[i]].tobytes()) for i in whole.tolist()]
        value = np.concatenate([value, _hashes(data, at, 8), np.array(digests, U64)])
        order = np.argsort(text, kind="stable")
        out += _chained(text[order], value[order], n)
    return out


def _best(few: np.ndarray, many: np.ndarray) -> float:
    """For each filter of ``few`` the best overlap with one of ``many``, averaged by features."""
    left, right = (np.ascontiguousarray(t[:, 1:]).view(U64) for t in (few, many))
    x_all, y = (np.bitwise_count(t).sum(axis=1, dtype=np.int64).astype(float) for t in (left, right))
    best = np.zeros(len(few))
    # Tiles keep memory small for chains of any length.
    tall, wide = 16, 128
    for i in range(0, len(few), tall):
        for j in range(0, len(many), wide):
            x = x_all[i : i + tall, None]
            both = np.bitwise_count(left[i : i + tall, None, :] & right[None, j : j + wide, :]).sum(axis=2, dtype=np.int64)
            most = np.minimum(x, y[j : j + wide])
            chance = x * y[j : j + wide] / BITS
            spread = np.sqrt(chance * (BITS - x) * (BITS - y[j : j + wide]) / (BITS * (BITS - 1)))
            score = np.where(both > chance + SURE * spread + 1, (both - chance) / np.maximum(most - chance, 1e-9), 0.0)
            best[i : i + tall] = np.maximum(best[i : i + tall], score.max(axis=1))
    return float(np.average(np.minimum(best, 1.0), weights=few[:, 0]))


def likeness(a: bytes, b: bytes) -> float:
    """How alike two fingerprints are, from 0 to 1; the same both ways round.

    Filters of the shorter chain are compared with all of the longer; of chains of one length,
    both ways.  Two empty fingerprints are equal, one empty fingerprint is like no other.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(t, np.uint8).reshape(-1, 1 + BYTES) for t in (a, b))
    if len(x) != len(y):
        return _best(x, y) if len(x) < len(y) else _best(y, x)
    return (_best(x, y) + _best(y, x)) / 2


def _fingerprinted(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column("text"), rank)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints, pa.binary())], names=["row", "fingerprint"])

    return run


def fingerprinted(docs: DataFrame, carry: list[str], rank: np.ndarray | None = None) -> DataFrame:
    """``row, fingerprint`` for each row of ``docs(text)``; `likeness` compares two of them.

    ``row`` holds the columns named in ``carry``, whatever they are called.  ``rank`` is the
    `rarity` to go by, that of ``docs`` if none is given; fingerprints compare only under one
    rarity.  Whole texts are read.  Null and empty texts have an empty fingerprint, short
    texts one of smaller windows, equal texts have equal fingerprints.
    """
    rank = rarity(docs) if rank is None else rank
    packed = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_fingerprinted(rank), f"row {kind}, fingerprint binary")
