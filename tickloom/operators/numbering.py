"""The surrogate key ``qNum``.

A run numbers its profiles ``base + 1``, ``base + 2``, …  Two ways, neither of
which sorts the whole input in one task.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096

# A run's numbers start at its clock time in units of ten seconds,
# times ten million.
_CLOCK_UNIT_SECONDS = 10
_NUMBERS_PER_UNIT = 10_000_000


def clock_base(now: float | None = None) -> int:
    seconds = time.time() if now is None else now
    return int(seconds // _CLOCK_UNIT_SECONDS) * _NUMBERS_PER_UNIT


def next_base(queries: DataFrame | None) -> int:
    """The clock base, or the highest number in use if that is above it.

    A run of more than ten million profiles, or two runs within ten seconds, reach
    into the numbers of the next clock unit.  The filter skips all older row groups.
    """
    base = clock_base()
    if queries is None:
        return base
    top = queries.where(F.col("qNum") > base).agg(F.max("qNum").alias("top")).first()["top"]
    return base if top is None else top


def number_profiles(profiles: DataFrame, base: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Number any frame of profiles by ``(queryId, attempt)``.

    Rows are hashed into buckets on both columns, so the attempts of one query do
    not pile up in one bucket; each bucket is numbered on its own and shifted by
    the sizes of the buckets before it.  The result is the same however the input
    is partitioned.  ``buckets`` rows, a constant, are added up and broadcast.
    """
    bucket = F.pmod(F.xxhash64("queryId", "attempt"), F.lit(buckets)).cast("int")
    placed = profiles.withColumn("bucket", bucket)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    in_bucket = F.row_number().over(Window.partitionBy("bucket").orderBy("queryId", "attempt"))
    return (
        placed.withColumn("ordinal", in_bucket)
        .join(F.broadcast(offsets), "bucket")
        .withColumn("qNum", F.col("offset") + F.col("ordinal") + F.lit(base))
        .drop("bucket", "offset", "ordinal")
    )


def number_staged(staged: DataFrame, offsets_dir: str, base: int) -> DataFrame:
    """Number the rows of a frame read straight from Parquet without moving them.

    A row's place in its file does not change any more, so its number is that place
    plus the rows of the files before.  The rows per file (one small record per file)
    are written to ``offsets_dir``: the planner then knows their true size and
    broadcasts them only if they are small enough.
    """
    file_name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    before = Window.orderBy("fileName").rowsBetween(Window.unboundedPreceding, -1)
    (
        staged.groupBy(file_name.alias("fileName"))
        .agg(F.count("*").alias("n"))
        .select("fileName", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        .write.mode("overwrite")
        .parquet(offsets_dir)
    )
    offsets = staged.sparkSession.read.schema("fileName STRING, offset BIGINT").parquet(offsets_dir)
    return (
        staged.select("*", file_name.alias("fileName"), row.alias("row"))
        .join(offsets, "fileName")
        .withColumn("qNum", F.col("offset") + F.col("row") + F.lit(base + 1))
        .drop("fileName", "row", "offset")
    )
