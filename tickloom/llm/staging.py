"""Tables written to the folder that all executors share, and joins against hot keys.

An operator's result reads its staged tables, so they stay until the caller has used it:
``with temporary(spark):`` around the call and the write of its result removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.sinks import releasing_shuffles, remove, staging_root

#: What was staged within each open ``temporary`` block.
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only if it is unset and Spark is local."""
    return staging_root(spark).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end, also after an error, all that was staged within.

    Frames made within must not be read afterwards; write what is to stay to a path of your own.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: lineage and shuffle files end here, and its size is known."""
    path = new_path(df.sparkSession, name)
    with releasing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt(key: Column | str, ways: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ways)).cast("int")


def join_hot(big: DataFrame, small: DataFrame, on: str, spread: str, how: str = "left", ways: int = 16) -> DataFrame:
    """``big`` joined with one narrow row per key: each key's rows go to ``ways`` tasks."""
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return big.withColumn("_salt", salt(spread, ways)).join(small, [on, "_salt"], how).drop("_salt")
