"""Many small values as few rows: per batch one row of byte strings for each group of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """First index of each run of equal values, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    new = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return np.concatenate([[0], new, [len(sorted_values)]])


def by_group(group: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each group with its slices of the columns, in the columns' order."""
    order = np.argsort(group, kind="stable")
    group, columns = group[order], [c[order] for c in columns]
    at = runs(group)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(group[a]), [c[a:b] for c in columns]


def unpack(parts: list[bytes | None], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(p for p in parts if p), kind)
