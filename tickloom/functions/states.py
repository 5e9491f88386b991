"""Expressions over the states of one profile.

Everything is computed inside the row from twelve start times, written out per state
code: no shuffle, no map, and no lambda, so it all compiles into generated code.
The longer ones are given as SQL text, which is also much quicker to build than the
same tree of column objects.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.model import STATE_NAMES

CODES = range(len(STATE_NAMES))

_NAMES_SQL = "array(" + ", ".join(f"'{n}'" for n in STATE_NAMES) + ")"


def state_starts(codes: str, times: str) -> Column:
    """Array with the start time per state code, NULL where a code is not listed.

    ``codes`` and ``times`` name columns with the entries of the list in reverse: where a code
    is listed twice the last entry counts.
    """
    slots = [f"get({times}, CAST(array_position({codes}, {c}) - 1 AS INT))" for c in CODES]
    return F.expr(f"array({', '.join(slots)})")


def highest_state(state_list: str) -> Column:
    """Largest code listed, also one with start time 0; 0 for an empty list."""
    return F.expr(f"coalesce(array_max({state_list}.state), 0)")


def state_name(code: str) -> Column:
    return F.expr(f"element_at({_NAMES_SQL}, CAST({code} AS INT) + 1)")


def state_code(name: str) -> Column:
    return F.expr(f"CAST(array_position({_NAMES_SQL}, {name}) - 1 AS INT)")


def phases(seen: list[str], highest_start: str, codes: Iterable[int] = CODES) -> Column:
    """Array of ``(state, startMs, endMs, durationMs)``, one entry per code of ``codes``.

    ``seen`` names the columns with the start times by code, NULL for a state that
    was not seen or has no time above 0; ``startMs`` is NULL in the same cases.  A
    phase ends where the next state seen *by code* starts, so its duration may be
    negative.  The last one ends at the start held for the highest state listed: its
    own, or a time of 0 or less.  State 0 is never closed by a later state and keeps
    end and duration 0.
    """
    return F.expr(f"array({', '.join(_phase(seen, highest_start, c) for c in codes)})")


def _phase(seen: list[str], highest_start: str, code: int) -> str:
    start = seen[code]
    following = f"coalesce({', '.join([*seen[code + 1 :], 'CAST(NULL AS BIGINT)'])})"
    last_end = f"coalesce({highest_start}, 0L)"
    if code == 0:
        end = f"if({following} IS NULL, {last_end}, 0L)"
        duration = f"if({following} IS NULL, {last_end} - {start}, 0L)"
    else:
        end = f"coalesce({following}, {last_end})"
        duration = f"{end} - {start}"
    return (
        f"named_struct('state', {code}L, 'startMs', {start}, "
        f"'endMs', {end}, 'durationMs', {duration})"
    )
