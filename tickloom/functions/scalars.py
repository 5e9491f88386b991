"""Scalar expressions used by the tables and the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def tick_floor(ms: Column, tick_ms: int) -> Column:
    """Start of the tick that contains ``ms``; exact, and right for negatives too."""
    return ms - F.pmod(ms, F.lit(tick_ms).cast("bigint"))


def tick_timestamp(ms: Column) -> Column:
    """Epoch milliseconds as a timestamp without zone, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", ms, epoch)


def none_if_zero(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("bigint"))


def round_half_even(value: Column) -> Column:
    """Nearest whole number, ties to even; NULL where there is none (NaN, infinity)."""
    return F.bround(value, 0).try_cast("bigint")


def first_chunk(text: Column, chunk_size: int) -> Column:
    return F.substring(text, 1, chunk_size)


def chunk_count(text: Column, chunk_size: int) -> Column:
    return F.ceil(F.length(text) / F.lit(chunk_size))


def memory_mb(bytes_: Column) -> Column:
    return F.round(bytes_.cast("double") / 1024.0 / 1024.0, 1)


def memory_tenths(mb: Column) -> Column:
    """Memory as a whole number of tenths of a megabyte.

    Totals of these are exact and cheap, and do not depend on the order in which
    partitions arrive, as totals of doubles would.
    """
    return F.round(mb * 10).cast("bigint")


def tenths_to_mb(tenths: Column) -> Column:
    return tenths / F.lit(10.0)


def node_id(address: Column, port: Column) -> Column:
    """``address:port``; NULL if either part is NULL."""
    return F.concat(address, F.lit(":"), port.cast("string"))


def state_label(code: Column, name: Column, *, spaced: bool) -> Column:
    """``06 (EXECUTION PLANNING)``, or with the underscores kept; NULL without a name.

    ``lpad`` would cut a code of more than two digits, as it does in SQL.
    """
    shown = F.replace(name, F.lit("_"), F.lit(" ")) if spaced else name
    return F.concat(F.lpad(code.cast("string"), 2, "0"), F.lit(" ("), shown, F.lit(")"))


def duration_seconds(ms: Column) -> Column:
    """Seconds with three decimals; zero, negative and missing durations give 0.0."""
    return F.when(ms > 0, F.round(ms.cast("double") / 1000.0, 3)).otherwise(F.lit(0.0))
