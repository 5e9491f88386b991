"""Each text beside the next one by id: fingerprints of a text, of its edited form, and of its neighbour.

Rows are dealt to buckets by ranges of their order, and the first row of each bucket is sent to
the bucket before as well, so every row meets its successor although no task sees more than one
bucket.  Texts move once; the ranges come from a range partitioning of ids and hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import fingerprints as prints

#: Text per bucket, about; only one row per bucket comes to the driver.
BUCKET_BYTES = 32 << 20
ORDER = ["missing", "id", "hash"]


def _bounds(keys: DataFrame, buckets: int) -> np.ndarray:
    """The least ``(missing, id, hash)`` of each range, in order."""
    least = (
        keys.repartitionByRange(buckets, *ORDER)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(F.struct(*ORDER)).alias("least"))
        .collect()
    )
    return np.array(sorted((int(r.least.missing), r.least.id, r.least.hash) for r in least), np.int64).reshape(-1, 3)


def _bucket(bounds: np.ndarray):
    """The range a row lies in, times two, plus one if it may be the first of it."""
    n = len(bounds)

    @F.pandas_udf("long")
    def bucket(missing: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        keys = np.stack([missing.to_numpy(np.int64), ids.to_numpy(np.int64), hashes.to_numpy(np.int64)], 1)
        both = np.concatenate([bounds, keys])
        # A bound comes before the rows that are equal to it.
        order = np.lexsort((np.arange(len(both)) >= n, both[:, 2], both[:, 1], both[:, 0]))
        at = np.empty(len(both), np.int64)
        at[order] = np.cumsum(order < n) - 1
        mine = at[n:]
        return pd.Series(mine * 2 + (keys == bounds[mine]).all(axis=1))

    return bucket


def edited(text: str, following: str, part: int) -> str:
    """The last one in ``part`` of the characters replaced by the first as many of ``following``."""
    n = len(text) // part
    return text[: len(text) - n] + following[:n]


def _compared(rank: np.ndarray, part: int):
    columns = ["row", "bucket", "copy", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_print = None, []
        for batch in batches:
            found = prints.fingerprints(batch.column("text"), rank)
            rows = pa.Table.from_batches([batch]).select(columns)
            rows, found = (rows, found) if held is None else (pa.concat_tables([held, rows]), held_print + found)
            texts, bucket, copy = (rows.column(c).to_pylist() for c in ("text", "bucket", "copy"))
            held, held_print = rows.slice(len(texts) - 1).combine_chunks(), found[-1:]
            mine = [i for i in range(len(texts) - 1) if not copy[i]]
            if any(bucket[i] != bucket[i + 1] for i in mine):
                raise ValueError("a row without successor")
            if not mine:
                continue
            new = [edited(texts[i], texts[i + 1], part) for i in mine]
            new_prints = prints.fingerprints(pa.array(new, pa.string()), rank)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("row").take(pa.array(mine)).combine_chunks(),
                    pa.array([len(texts[i]) for i in mine], pa.int64()),
                    pa.array(new, pa.string()),
                    pa.array([found[i] for i in mine], pa.binary()),
                    pa.array(new_prints, pa.binary()),
                    pa.array([prints.likeness(found[i], p) for i, p in zip(mine, new_prints, strict=True)], pa.float64()),
                    pa.array([prints.likeness(found[i], found[i + 1]) for i in mine], pa.float64()),
                ],
                names=["row", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
        if held is not None and not held.column("copy")[0].as_py():
            raise ValueError("a row without successor")

    return run


def beside_next(docs: DataFrame, carry: list[str], part: int = 4, rank: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of each text of ``docs(doc_id, text)`` and of its edited form, and how alike they are.

    The edited form has the last one in ``part`` of its characters (rounded down) replaced by the
    first as many (or all) of the next text in ascending order of ``doc_id``; after the last comes
    the first.  Columns: ``row`` (the columns named in ``carry``, whatever they are called),
    ``n_chars``, ``edited``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``.  ``rank`` as in `fingerprints.fingerprinted`.

    A null text counts as empty.  A missing ``doc_id`` comes after all others; rows of one id are
    in order of the hash of their text, then of the text, and repeated rows follow each other.  A
    single row is its own successor.  Rows of one id spread over buckets by that hash; only
    repeated rows, which are equal in both, share one.
    """
    rank = prints.rarity(docs) if rank is None else rank
    id_ = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*carry).alias("row"),
        id_.isNull().cast("int").alias("missing"),
        F.coalesce(id_, F.lit(0)).alias("id"),
        F.xxhash64(text).alias("hash"),
        text.alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    bounds = _bounds(rows.select(*ORDER), buckets)
    # Without rows there are no ranges and nothing to place.
    bounds = bounds if len(bounds) else np.zeros((1, 3), np.int64)
    placed = rows.withColumn("at", _bucket(bounds)(*ORDER))
    own = F.shiftright("at", 1)
    before = F.pmod(own - 1, F.lit(len(bounds)))
    first = F.col("at").bitwiseAND(F.lit(1)) == 1
    # The copy of a bucket's first row stands behind the rows of the bucket before.
    places = F.when(first, F.array(own, before)).otherwise(F.array(own))
    dealt = placed.select("row", *ORDER, "text", F.posexplode(places).alias("copy", "bucket"))
    # One partition for each bucket; a hash of the bucket would put several into one.
    ordered = dealt.repartitionById(len(bounds), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "copy", *ORDER, "text")
    kind = rows.schema["row"].dataType.simpleString()
    return ordered.select("row", "bucket", (F.col("copy") == 1).alias("copy"), "text").mapInArrow(
        _compared(rank, part),
        f"row {kind}, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double",
    )
