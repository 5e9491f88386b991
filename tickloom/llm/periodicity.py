"""Runs: stretches of a text in which a sequence of words repeats itself over and over.

Words arrive one after the other.  A block of 2**k words that is complete becomes a catcher; from
then on each word that arrives is the end of another stretch of 2**k words, and where that equals
the block the text repeats with the distance as its period.  Suffix comparisons give how far the
repetition reaches back, and prefix comparisons how far it goes on; once it reaches a whole period
there is a square, and the squares of one period that follow each other are one run.

A catcher of level k looks for periods from 2**k to 2**(k + 1) - 1 only, hence takes 2**k steps,
and a stretch that repeats long enough holds a whole block at a multiple of 2**k.  All catchers of
a level advance together, one arriving word per step, as operations on arrays.  Equal blocks of
2**k words have equal names, which come from the names of their halves: comparisons are exact, and
go by jumps of powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import spellings
from tickloom.llm import words as W

#: Fixed by the contract.
MIN_EXPONENT, MIN_LENGTH = 3, 24

RUNS = "array<struct<start:long,length:long,period:long>>"
BEST = "struct<start:long,length:long,period:long>"


class Blocks:
    """Names of all blocks of 1, 2, 4, … words; -1 where a block occurs only once."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.levels: list[np.ndarray] = []
        at, name = np.arange(self.n), words
        while len(at):
            code, n = spellings.numbered(name)
            often = np.bincount(code, minlength=n)[code] > 1
            if not often.any():
                break
            level = np.full(self.n, -1, np.int64)
            level[at[often]] = code[often]
            half = 1 << len(self.levels)
            self.levels.append(level)
            at = at[often]
            at = at[at + half < self.n]
            at = at[level[at + half] >= 0]
            name = level[at] * n + level[at + half]

    def _jump(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from ``i`` and ``j > i`` on, or before them."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size, level = 1 << k, self.levels[k]
            a, b = (i - size, j - size) if back else (i, j)
            inside = (a >= 0) & (b < self.n)
            x = level[np.where(inside, a, 0)]
            same = inside & (x >= 0) & (x == level[np.where(inside, b, 0)])
            step = np.where(same, -size if back else size, 0)
            i, j, total = i + step, j + step, total + np.abs(step)
        return total

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._jump(i, j, False)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._jump(i, j, True)


def _caught(level: np.ndarray, block: np.ndarray, room: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Catchers at ``block`` step through the words that arrive: block and distance of each catch."""
    where, far = [], []
    # The catcher with the most words behind it comes first, so those that are done drop off the end.
    order = np.argsort(-room, kind="stable")
    block, left = block[order], -room[order]
    name = level[block]
    for distance in range(first, 2 * first):
        n = int(np.searchsorted(left, -distance, side="right"))
        if not n:
            break
        hit = np.flatnonzero(level[block[:n] + distance] == name[:n])
        if len(hit):
            where.append(block[hit])
            far.append(np.full(len(hit), distance, np.int64))
    none = np.empty(0, np.int64)
    return (np.concatenate(where), np.concatenate(far)) if where else (none, none)


def runs(words: np.ndarray, ends: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows ``(start, length, period)`` by start, then period.

    ``words`` are names that no two texts share, ``ends`` is where the text of each word ends.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("runs have an exponent of 2 at least")
    blocks, n = Blocks(words), len(words)
    longest = int((ends - np.arange(n)).max()) if n else 0
    found: list[np.ndarray] = []
    cover_end, cover_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    first = 1
    while max(min_length, min_exponent * first) <= longest:
        # Words that repeat in the shortest run of these periods, and the blocks that it must hold.
        repeated = max((min_exponent - 1) * first, min_length - (2 * first - 1))
        k = ((repeated + 1) // 2).bit_length() - 1
        if k >= len(blocks.levels):
            break
        size, level = 1 << k, blocks.levels[k]
        block = np.arange(0, n, size)
        block = block[level[block] >= 0]
        room = ends[block] - block - size
        block, far = _caught(level, block[room >= first], room[room >= first], first)
        # A multiple of the period of a run around it says nothing new.
        known = (block + far + size <= cover_end[block]) & (far % cover_period[block] == 0)
        block, far = block[~known], far[~known]
        start = block - blocks.before(block, block + far)
        end = block + far + size + blocks.after(block + size, block + far + size)
        length = end - start
        long = length >= np.maximum(min_length, min_exponent * far)
        if long.any():
            new = np.unique(np.stack([start, length, far], 1)[long], axis=0)
            for s, size_, p in new.tolist():
                cover_end[s : s + size_] = s + size_
                cover_period[s : s + size_] = p
            found.append(new)
        first *= 2
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    # One stretch has one smallest period; the rows are in order of start, length and period.
    smallest = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


@dataclass(frozen=True)
class Repeats:
    n_words: int
    runs: list[tuple[int, int, int]]
    collapsed: str

    @property
    def best(self) -> tuple[int, int, int] | None:
        """The run with the greatest exponent; of equal ones the first, then the smallest period."""
        return max(self.runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def repeats(column: pa.Array, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> Iterator[Repeats]:
    """Runs of each text, and the text with one period left of each."""
    for piece in spellings.whole_texts(column, W.SPACED):
        name, n = spellings.names(piece.data, piece.begin, piece.end)
        counts = np.diff(piece.at)
        text = np.repeat(np.arange(len(counts)), counts)
        found = runs(name + text * n, piece.at[1:][text], min_exponent, min_length)
        gone = np.zeros(len(name) + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
        stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        # Words that stay, each with the byte after it, which becomes a space.
        body = piece.data.copy()
        body[piece.end] = 32
        edge = np.zeros(len(body) + 1, np.int8)
        edge[piece.begin[stay]] = 1
        edge[piece.end[stay] + 1] -= 1
        kept = body[np.cumsum(edge[:-1], dtype=np.int8) > 0]
        size = np.bincount(text[stay], piece.end[stay] + 1 - piece.begin[stay], len(counts)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        which = text[found[:, 0]]
        cut = np.searchsorted(which, np.arange(len(counts) + 1))
        for i, words in enumerate(counts.tolist()):
            own = found[cut[i] : cut[i + 1]] - [int(piece.at[i]), 0, 0]
            yield Repeats(words, [tuple(r) for r in own.tolist()], kept[at[i] : max(at[i], at[i + 1] - 1)].tobytes().decode())


def _found(min_exponent: int, min_length: int):
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_row = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = list(repeats(batch.column("text"), min_exponent, min_length))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([d.n_words for d in done], pa.int64()),
                    pa.array([[as_row(r) for r in d.runs] for d in done], pa.list_(one)),
                    pa.array([as_row(d.best) for d in done], one),
                    pa.array([d.collapsed for d in done], pa.string()),
                ],
                names=["row", "n_words", "runs", "best", "collapsed"],
            )

    return run


def collapsed(docs: DataFrame, carry: list[str], min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """``row, n_words, runs, best, collapsed`` for each row of ``docs(text)``; no shuffle.

    ``row`` holds the columns named in ``carry``, whatever they are called.  A run is a stretch of
    at least ``min_length`` words and ``min_exponent`` times its smallest period that no
    neighbouring word continues; ``start`` counts words from 0.  ``runs`` is in order of start,
    then period, and ``best`` is the one with the greatest exponent (null if there is none; of
    equal ones the first, then the one with the smallest period).  ``collapsed`` joins by one
    space the words that no run holds beyond its first period.

    A null, empty or wordless text has no runs and an empty ``collapsed``.  Repeated rows give
    repeated results.  A text is always worked on whole, in memory that grows with its length
    times the logarithm of its longest repeated passage.
    """
    packed = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(
        _found(min_exponent, min_length), f"row {kind}, n_words long, runs {RUNS}, best {BEST}, collapsed string"
    )
