"""Connected components of an edge table: forests within tasks, then large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.staging import new_path
from tickloom.operators.sinks import remove


#: Edges that a task holds at most before it reduces them to a forest.
HELD_EDGES = 1 << 18


def _forest(edges: pa.Table) -> pa.Table:
    """Stars, each around its smallest node, that connect what ``edges(a, b)`` connect."""
    ends = np.concatenate([edges[c].to_numpy() for c in ("a", "b")])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(edges)], at[len(edges) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a].copy(), least)
        np.minimum.at(root, root[b].copy(), least)
        while (root[root] != root).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table([pa.array(nodes[root[leaf]], edges.schema.types[0]), pa.array(nodes[leaf], edges.schema.types[1])], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as forests; one that stays large is passed on and another begun."""
    held, size = [], 0
    for batch in batches:
        held, size = [*held, pa.Table.from_batches([batch])], size + batch.num_rows
        if size >= HELD_EDGES:
            held = [_forest(pa.concat_tables(held))]
            size = len(held[0])
            if size > HELD_EDGES // 2:
                yield from held[0].to_batches()
                held, size = [], 0
    if size:
        yield from _forest(pa.concat_tables(held)).to_batches()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return (
        hung.union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        .where("x < y")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
    )


def _unfinished(edges: DataFrame) -> int:
    """Number of nodes below two others, or below one and above one; none if all are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.max("above").alias("above"), F.sum("below").alias("below")).where("below > 1 or above + below > 1").count()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node.

    The steps keep the components and end in stars; no node's neighbours are ever gathered in
    one row, minima are pre-aggregated, and each round is a written table.  Edges with a null
    end or two equal ends name no node.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    spark = pairs.sparkSession
    left, rounds = pairs.mapInArrow(_forests, pairs.schema).distinct(), []
    while True:
        rounds.append(new_path(spark, "edges"))
        left.write.parquet(rounds[-1])
        edges = spark.read.schema(pairs.schema).parquet(rounds[-1])
        # The round before is not read again.
        for path in rounds[-2:-1]:
            remove(spark, path)
        if not _unfinished(edges):
            break
        left = _small_star(_large_star(edges))
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
