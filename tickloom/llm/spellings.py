"""Exact names for the words of many texts: equal numbers stand for equal bytes, never by a hash.

A word is read eight bytes at a time.  Each round numbers the pairs of the name so far and the
next eight bytes, so two words get one name only if all their bytes and their lengths agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from tickloom.llm import words as W

#: Words beyond so many bytes are numbered by a dictionary of their bytes.
LONG = 256
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 in order of first appearance, and how many there are."""
    codes, values = pd.factorize(keys)
    return codes, len(values)


def first_of(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each number appears first."""
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, past the end as zeros."""
    body = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", body, strides=(1,))


def names(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the byte spans, and how many there are."""
    if not len(begin):
        return np.empty(0, np.int64), 0
    size, eights = end - begin, _eights(data)
    part = lambda at, left: eights[at] & _MASKS[np.minimum(left, 8)]
    head, _ = numbered(part(begin, size))
    name, n = numbered(head * (int(size.max()) + 1) + size)
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest) and at < LONG:
        piece, m = numbered(part(begin[rest] + at, size[rest] - at))
        name[rest], m = numbered(name[rest] * m + piece)
        # All words of these lengths got new names: none is in use by a shorter word.
        name[rest] += n
        n += m
        at += 8
        rest = rest[size[rest] > at]
    known: dict[bytes, int] = {}
    for i in rest.tolist():
        name[i] = n + known.setdefault(data[begin[i] : end[i]].tobytes(), len(known))
    return numbered(name)


@dataclass(frozen=True)
class Piece:
    """Words of a run of whole texts, or of a part of one long text."""

    first: int
    """Index of the first text."""
    data: np.ndarray
    """Bytes, folded, with a space after each text."""
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray
    """Index of the first word of each text, and the number of words."""
    again: int
    """So many words (0 or 1) at the start were the end of the piece before."""


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space after each, and where each starts (the length at the end)."""
    sizes = np.diff(offsets)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    body = np.full(int(start[-1]), 32, np.uint8)
    keep = np.ones(len(body), bool)
    keep[start[1:] - 1] = False
    body[keep] = data[offsets[0] : offsets[-1]]
    return body, start


def whole_texts(column: pa.Array, kind: W.WordClass) -> Iterator[Piece]:
    """Runs of texts of about ``PIECE`` bytes together; a longer text is a run alone."""
    data, offsets = W.text_bytes(column)
    for first, last in W.grouped_texts(data, offsets):
        body, start = joined(data, offsets[first : last + 1])
        body = kind.fold[body]
        begin, end = kind.spans(body)
        yield Piece(first, body, begin, end, np.searchsorted(begin, start), 0)


def pieces(column: pa.Array, kind: W.WordClass) -> Iterator[Piece]:
    """The same, but a long text comes in parts that share one word with the part before."""
    data, offsets = W.text_bytes(column)
    for first, last in W.grouped_texts(data, offsets):
        if last - first > 1 or offsets[last] - offsets[first] <= W.PIECE:
            body, start = joined(data, offsets[first : last + 1])
            body = kind.fold[body]
            begin, end = kind.spans(body)
            yield Piece(first, body, begin, end, np.searchsorted(begin, start), 0)
            continue
        text, since = data[offsets[first] : offsets[last]], 0
        carried = np.empty(0, np.uint8)
        for cut in kind.cuts(text):
            body = np.concatenate([carried, kind.fold[text[since:cut]], [np.uint8(32)]])
            begin, end = kind.spans(body)
            yield Piece(first, body, begin, end, np.array([0, len(begin)]), int(len(carried) > 0))
            since = cut
            if len(begin):
                carried = np.append(body[begin[-1] : end[-1]], np.uint8(32))
