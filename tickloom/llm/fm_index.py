"""An FM-index over a sequence of small codes, searched for many phrases at once."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length until all ranks differ."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.argsort(rank * (n + 1) + after + 1, kind="stable")
        key = (rank * (n + 1) + after + 1)[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Wavelet:
    """Ranks of symbols in a sequence, one bit of the symbol per level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        begin = np.zeros_like(end)
        for i, level in enumerate(reversed(range(self.bits))):
            one = ((symbol >> level) & 1).astype(bool)
            ones, zeros = self.ones[i], self.zeros[i]
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - begin


class FMIndex:
    """``text`` holds codes from 1; 0 is left for its end."""

    def __init__(self, text: np.ndarray, top: int):
        text = np.append(text, 0)
        order = suffix_array(text)
        self.last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.wavelet = Wavelet(self.last, top)
        self.position = np.where(order % SAMPLE == 0, order, -1)

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of phrases of one length: which phrase, and where it starts."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        for i in reversed(range(phrases.shape[1])):
            symbol = phrases[which, i]
            low, high = self._step(symbol, low), self._step(symbol, high)
            live = low < high
            which, low, high = which[live], low[live], high[live]
        counts = high - low
        row = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(which, counts), self._locate(row)

    def _locate(self, row: np.ndarray) -> np.ndarray:
        """Walk back to a sampled suffix; its position and the steps taken give the place."""
        out, todo = np.empty(len(row), np.int64), np.arange(len(row))
        row = row.copy()
        for steps in range(SAMPLE):
            at = self.position[row]
            known = at >= 0
            out[todo[known]] = at[known] + steps
            todo, row = todo[~known], row[~known]
            if not len(todo):
                break
            row = self._step(self.last[row], row)
        return out
