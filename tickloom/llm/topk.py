"""Exact top-k by inner product: tiles of queries times shards of vectors.

A tile multiplies a block of queries with a shard as matrices and keeps only each query's best
rows; lists of tiles are merged in two levels, first per query and group of tiles, then per
query.  Components are whole numbers and products stay exact.  Blocks of queries come to the shards
in every task, never through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.staging import staged

QUERIES_PER_BLOCK = 2048
SHARD_ROWS = 4096
MERGE_WAYS = 16
EXACT = float(1 << 53)
#: Below the limit of 64 bits by more than the rounding of the bound.
LARGEST = float(1 << 62)
SCALE = 256


def _matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.astype(np.float64)).reshape(-1, size)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; floating products only where they are exact.

    Beyond the range of 64 bits Python's integers are used; a score that does not fit raises.
    """
    bound = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if not len(c) or bound < EXACT:
        return (q @ c.T).astype(np.int64)
    if bound < LARGEST:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    products = whole(q) @ whole(c).T
    if np.abs(products).max(initial=0) >= 1 << 63:
        raise OverflowError("an inner product does not fit into a long")
    return products.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores of each row, ties to smaller ids, best first."""
    order = np.argsort(ids, kind="stable")
    scores = scores[:, order]
    if scores.shape[1] > 4 * k:
        # Everything at or above the k-th score of a row stays in the running.
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        keep = np.flatnonzero((scores >= edge[:, None]).any(axis=0))
        scores, order = scores[:, keep], order[keep]
    return order[np.argsort(-scores, axis=1, kind="stable")[:, :k]]


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = ((batch.column(p + "_ids")[i].values, batch.column(p + "_vectors")[i].values) for p in ("q", "c"))
                lengths = [np.diff(v.offsets.to_numpy()) if len(v) else np.empty(0, np.int64) for _, v in (q, c)]
                out = [np.empty((0, 3), np.int64)]
                for size in np.intersect1d(lengths[0], lengths[1]):
                    rows = [np.flatnonzero(n == size) for n in lengths]
                    qid, cid = (x[0].to_numpy()[r] for x, r in zip((q, c), rows, strict=True))
                    scores = _products(*(_matrix(x[1], r, size) for x, r in zip((q, c), rows, strict=True)))
                    # A query is no candidate of its own: one place more, then drop it.
                    best = _best(scores, cid, k + 1 if len(np.unique(cid)) == len(cid) else min(len(cid), k + len(cid)))
                    line = np.repeat(np.arange(len(qid)), best.shape[1])
                    found = np.stack([qid[line], cid[best.ravel()], scores[line, best.ravel()]], axis=1)
                    out.append(found[found[:, 0] != found[:, 1]])
                table = np.concatenate(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array(table[:, 2]), pa.array(np.full(len(table), batch.column("tile")[i].as_py()), pa.int64())],
                    names=["query_id", "vec_id", "score", "tile"],
                )

    return run


def _blocks(name: str, rows: int):
    """Rows of a batch as few rows of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part.column(c)])) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(lists, names=[f"{name}_ids", f"{name}_vectors"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are all rows with
    another ``vec_id``.  Each component x counts as ``floor(256 * x)``; the score is the inner
    product and ties go to the smaller ``vec_id``.  Rows without id or vector, or with a null, NaN
    or infinite component, take no part; vectors meet only those of their own length.  A score
    beyond 64 bits fails the job.  Of query
    rows that repeat a ``vec_id`` the smallest vector asks; repeated candidates count each.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite
    )
    query = clean.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = query.count()
    blocks = 1 + n // QUERIES_PER_BLOCK
    schema = "{0}_ids array<long>, {0}_vectors array<array<double>>"
    asked = staged(
        query.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
        .select("block", F.col("rows.vec_id").alias("q_ids"), F.col("rows.v").alias("q_vectors")),
        "queries",
    )
    # Every block meets every shard where that is read; neither is copied for the other or sent to the driver.
    held = staged(clean, "vectors")
    shards = held.mapInArrow(_blocks("c", SHARD_ROWS), schema.format("c")).withColumn("tile", F.monotonically_increasing_id())
    tiles = shards.crossJoin(asked.repartitionById(blocks, F.col("block")).hint("shuffle_replicate_nl")).select(
        "tile", "q_ids", "q_vectors", "c_ids", "c_vectors"
    )
    lists = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score long, tile long")
    order = [F.col("score").desc(), F.col("vec_id")]
    some = Window.partitionBy("query_id", F.pmod(F.xxhash64("tile"), F.lit(MERGE_WAYS))).orderBy(*order)
    merged = lists.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
