"""Words of many texts at once: positions and 64-bit hashes, worked out over byte arrays.

A text is a run of UTF-8 bytes and a word is a longest run of bytes of one class, so words
can be found with array operations and never become Python strings.  Work goes in pieces of
about ``PIECE`` bytes that end between two words, so memory does not follow the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U64 = np.uint64
#: Words beyond so many bytes are hashed one by one.
LONG = 256
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each span of bytes, eight bytes at a time, each mixed before the next comes in."""
    size = end - begin
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    value = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15))
    rest, at = np.arange(len(begin)), 0
    while len(rest) and at < LONG:
        piece = eights[begin[rest] + at] & _MASKS[np.minimum(size[rest] - at, 8)]
        value[rest] = mix((value[rest] ^ mix(piece + U64(0x517CC1B727220A95))) * U64(0x9FB21C651E98DF25))
        at += 8
        rest = rest[size[rest] > at]
    for i in rest.tolist():
        value[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return value


class WordClass:
    """Which bytes form words, and whether A-Z count as a-z."""

    def __init__(self, not_word: bytes, lower: bool):
        self.member = np.ones(256, bool)
        self.member[list(not_word)] = False
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and byte after the last of each word."""
        flags = np.zeros(len(data) + 2, np.int8)
        flags[1:-1] = self.member[data]
        edge = np.diff(flags)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def cuts(self, data: np.ndarray) -> list[int]:
        """Ends of pieces: each lies between two words, about ``PIECE`` apart."""
        cuts, at = [], 0
        while len(data) - at > PIECE:
            end, step = at + PIECE, 1 << 12
            while end < len(data):
                free = np.flatnonzero(~self.member[data[end : end + step]])
                if len(free):
                    end += int(free[0])
                    break
                end += step
            at = min(end, len(data))
            cuts.append(at)
        return [*cuts, len(data)] if not cuts or cuts[-1] < len(data) else cuts

    def hashes(self, data: np.ndarray, with_spans: bool = False):
        """A hash for each word of ``data``; with ``with_spans`` its byte span too."""
        found, begin = [], 0
        for end in self.cuts(data):
            piece = data[begin:end]
            a, b = self.spans(piece)
            found.append((_hashed(self.fold[piece], a, b), a + begin, b + begin))
            begin = end
        value, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return (value, a, b) if with_spans else value


#: Fixed by the contract: words end at white space, or at any ASCII byte but letters and digits.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACED = WordClass(SPACES, lower=False)
SPACED_LOWER = WordClass(SPACES, lower=True)
ALNUM_LOWER = WordClass(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)
# Capital letters are word bytes once they are lower case.
ALNUM_LOWER.member[65:91] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts (null: no bytes)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data, offsets


def grouped_texts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to about ``PIECE`` bytes together; a longer text is a run alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def hashed_texts(column: pa.Array, kind: WordClass) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first, word hashes of all, and where each text's words start."""
    data, offsets = text_bytes(column)
    for first, last in grouped_texts(data, offsets):
        if last - first == 1:
            words = kind.hashes(data[offsets[first] : offsets[last]])
            yield first, words, np.array([0, len(words)])
            continue
        # A space between texts keeps their words apart.
        shift = np.arange(last - first)
        at = offsets[first : last + 1] - offsets[first]
        joined = np.full(int(at[-1]) + last - first, 32, np.uint8)
        keep = np.ones(len(joined), bool)
        keep[at[1:] + shift] = False
        joined[keep] = data[offsets[first] : offsets[last]]
        words, begin, _ = kind.hashes(joined, with_spans=True)
        yield first, words, np.searchsorted(begin, np.append(at[:-1] + shift, len(joined)))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    weights = mix(np.arange(1, k + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
    total = words[:n] * weights[0]
    for i in range(1, k):
        total += words[i : i + n] * weights[i]
    return mix(total)


def digest(values: np.ndarray) -> bytes:
    """16 bytes that stand for a sequence of 64-bit values."""
    return hashlib.blake2b(np.ascontiguousarray(values).view(np.uint8), digest_size=16).digest()
