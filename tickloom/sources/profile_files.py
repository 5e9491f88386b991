"""Profile files to numbered lines.

One file holds all attempts of one query, one JSON object per line; the position
of a line is the attempt.  Most files are small and are read whole, so that the
line position is known without a shuffle.  A file above ``whole_file_limit`` is
read split by split instead: a first scan counts the lines of each split, and the
second adds what the splits before hold to a line's place in its own.  The lines
themselves never move.  Compressed files, which a ``pattern`` may name, are read that
way at any size: how large they are as text is not known before.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.sinks import staging_root

FILE_PATTERN = "*.{json,JSON}"
WHOLE_FILE_LIMIT = 32 * 1024 * 1024
#: So many splits, of 32 bytes each, may be broadcast; beyond it lines are joined with them.
BROADCAST_SPLITS = 4_000_000

# What the text reader takes apart by the end of a file's name.
_COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
_LINE_END = "\r\n|\n|\r"
_FILES_DDL = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _text(spark: SparkSession, paths: str | list[str], whole: bool, pattern: str) -> DataFrame:
    return (
        spark.read.option("pathGlobFilter", pattern)
        .text(paths, wholetext=whole)
        .select(
            F.col("_metadata.file_name").alias("rawName"),
            F.col("_metadata.file_path").alias("filePath"),
            F.col("_metadata.file_size").alias("fileSize"),
            F.col("_metadata.file_block_start").alias("blockStart"),
            "value",
        )
    )


def scan_files(
    spark: SparkSession, path: str, *, pattern: str = FILE_PATTERN, whole_file_limit: int = WHOLE_FILE_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """Raw text of the files directly below ``path``: small ones a row each, large or compressed ones a row per line.

    The conditions are on file metadata, so each branch opens only its own files.
    """
    small = (F.col("fileSize") <= whole_file_limit) & ~F.col("rawName").rlike(_COMPRESSED)
    return _text(spark, path, True, pattern).where(small), _text(spark, path, False, pattern).where(~small)


def new_files(spark: SparkSession, path: str, *, pattern: str = FILE_PATTERN, stream_options: dict[str, str] | None = None) -> DataFrame:
    """Stream of the ``path`` and ``length`` of each new file directly below ``path``; no file is opened."""
    reader = spark.readStream.format("binaryFile").schema(_FILES_DDL).options(**(stream_options or {}))
    return reader.option("pathGlobFilter", pattern).load(path).select("path", "length")


def read_listed(
    spark: SparkSession, files: Sequence[tuple[str, int]], *, whole_file_limit: int = WHOLE_FILE_LIMIT
) -> DataFrame:
    """Lines of the files ``(path, length)``, such as a batch of `new_files` has."""
    # A path is taken as it is, not as a pattern.
    literal = lambda p: re.sub(r"([*?\[\]{}\\^])", r"\\\1", p)
    is_small = [n <= whole_file_limit and not re.search(_COMPRESSED, p) for p, n in files]
    small = [literal(p) for (p, _), s in zip(files, is_small, strict=True) if s]
    large = [literal(p) for (p, _), s in zip(files, is_small, strict=True) if not s]
    empty = spark.createDataFrame([], "rawName STRING, filePath STRING, fileSize BIGINT, blockStart BIGINT, value STRING")
    return to_lines(
        _text(spark, small, True, "*") if small else empty, _text(spark, large, False, "*") if large else empty
    )


def to_lines(small: DataFrame, large: DataFrame) -> DataFrame:
    """``(file_name, attempt, line)`` for every line that is not blank."""
    whole = small.select("rawName", F.posexplode(F.split("value", _LINE_END)).alias("attempt", "line"))
    split = _number_split_lines(large)
    # File names in metadata are URL-encoded, but a plus sign in them is a plus sign.
    name = F.try_url_decode(F.replace("rawName", F.lit("+"), F.lit("%2B")))
    line = F.ltrim("line", F.lit("\ufeff"))
    return (
        whole.unionByName(split)
        .select(name.alias("file_name"), F.col("attempt").cast("bigint").alias("attempt"), line.alias("line"))
        .where(F.trim("line") != "")
    )


def _number_split_lines(lines: DataFrame) -> DataFrame:
    """Line positions of split files, by two scans.

    Inside a split, lines keep their order and get consecutive ids.  The first scan finds the
    first id and the number of lines of each split, which is all that is aggregated and put in
    order; the second finds the position of a line from its id alone.  Both scans deal out the
    same files in the same way; a line whose id does not fit its split fails the job.
    """
    marked = lines.withColumn("rowId", F.monotonically_increasing_id()).withColumn("fileKey", F.xxhash64("filePath"))
    earlier = Window.partitionBy("fileKey").orderBy("blockStart").rowsBetween(Window.unboundedPreceding, -1)
    staging_root(lines.sparkSession)
    splits = (
        marked.groupBy("fileKey", "blockStart")
        .agg(F.min("rowId").alias("firstId"), F.count("*").alias("lineCount"))
        .select("*", F.coalesce(F.sum("lineCount").over(earlier), F.lit(0)).alias("before"))
        .checkpoint()
    )
    n = splits.count()
    if not n:
        return lines.select("rawName", F.lit(0).cast("bigint").alias("attempt"), F.col("value").alias("line")).where("false")
    place = F.col("rowId") - F.col("firstId")
    fits = (place >= 0) & (place < F.col("lineCount"))
    position = F.when(fits, F.col("before") + place).otherwise(F.raise_error(F.lit("the files have changed")).cast("bigint"))
    return marked.join(F.broadcast(splits) if n <= BROADCAST_SPLITS else splits, ["fileKey", "blockStart"]).select(
        "rawName", position.alias("attempt"), F.col("value").alias("line")
    )


def read_profile_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of the profile files directly below ``path``; options as in `scan_files`."""
    return to_lines(*scan_files(spark, path, **options))


def query_id_from_file(file_name: Column) -> Column:
    """The query id is the file name without its first 8 and last 5 characters."""
    return F.substring(file_name, F.lit(9), F.length(file_name) - 13)
