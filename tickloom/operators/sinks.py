"""Staging and writing of tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import none_if_zero


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the cluster for intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tickloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_staging_dir(spark: SparkSession) -> str:
    return f"{staging_root(spark).rstrip('/')}/tickloom-{uuid.uuid4().hex}"


#: What is staged or stored takes about half the room that it takes with the default codec.
COMPRESSED = {"compression": "zstd"}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a job within has shuffled goes when it ends, not when the driver next collects garbage.

    For jobs whose result is written: nobody runs them a second time.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def range_bounds(counted: Column | None = None) -> list[Column]:
    """First and last query start of a batch's ``counted`` rows; a start of 0 does not count."""
    start = none_if_zero(F.col("queryStartMs"))
    if counted is not None:
        start = F.when(counted, start)
    return [
        F.coalesce(F.min(start), F.lit(0)).alias("firstStartMs"),
        F.coalesce(F.max(start), F.lit(0)).alias("lastStartMs"),
    ]


def batch_digest(lines: DataFrame) -> str:
    """The same for the same set of file names, in any order; another for another set."""
    names = lines.select("file_name").distinct()
    total = names.agg(F.sum(F.xxhash64("file_name").cast("decimal(38,0)")).alias("n")).first()["n"]
    return f"{int(total or 0) % (1 << 64):016x}"


def range_name(*parts: int | str | None) -> str:
    """First and last start, digest and tag of a batch, as far as they are given."""
    return "_".join(str(p) for p in parts if p is not None)


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below ``path``; none if there is no such folder."""
    where, fs = file_system(spark, path)
    return sorted(c.getPath().getName() for c in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    where, fs = file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = file_system(spark, path)
    stream = fs.create(where)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def write_table(df: DataFrame, output_dir: str, name: str, ingest_range: str | None, options: dict[str, str] | None = None) -> str:
    """Write one table, or only its partition ``ingest_range``.

    The partition is written by its path, so an overwrite replaces that partition
    alone and the rows need no sort on a partition column.
    """
    path = f"{output_dir}/{name}"
    if ingest_range is not None:
        path += f"/ingest_range={ingest_range}"
    with releasing_shuffles(df.sparkSession):
        df.write.mode("overwrite").options(**COMPRESSED, **(options or {})).parquet(path)
    return path
