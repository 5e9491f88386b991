"""Profiles to the rows of ``queries``, ``query_text`` and ``nodes``.

All of these are projections or unnests of one profile row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import chunk_count, first_chunk
from tickloom.functions.states import state_name
from tickloom.model import DEFAULT_CHUNK_SIZE, QUERIES_COLUMNS, STATE_START_COLUMNS


def queries_table(numbered: DataFrame, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """One header row per profile, with a start column per state."""
    text = F.col("queryText")
    derived = {
        "queryTextFirstChunk": first_chunk(text, chunk_size),
        "nrQueryChunks": chunk_count(text, chunk_size),
        "finalState": state_name("highestState"),
    }
    derived |= {
        name: F.expr(f"get(stateStarts, {code})") for code, name in enumerate(STATE_START_COLUMNS)
    }
    return numbered.withColumns(derived).select(*QUERIES_COLUMNS)


def text_chunks(numbered: DataFrame, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """The query text cut into pieces of ``chunk_size`` characters; none for an empty text.

    One pass of a pattern cuts the whole text; taking substrings one by one would count
    characters from the start each time.  The quantifier is possessive, hence needs no
    stack, and a character outside the basic plane counts as one.
    """
    pieces = F.regexp_extract_all("queryText", F.lit(f"(?s).{{1,{int(chunk_size)}}}+"), F.lit(0))
    return numbered.select("qNum", F.posexplode(pieces).alias("chunkNum", "chunkText")).select(
        "qNum", F.col("chunkNum").cast("bigint").alias("chunkNum"), "chunkText"
    )


def rebuild_text(chunks: DataFrame) -> DataFrame:
    """``(qNum, queryText)`` put together again from its pieces."""
    pieces = F.array_sort(F.collect_list(F.struct("chunkNum", "chunkText")))
    text = F.array_join(F.transform(pieces, lambda p: p["chunkText"]), "")
    return chunks.groupBy("qNum").agg(text.alias("queryText"))


def nodes_table(numbered: DataFrame) -> DataFrame:
    """One row per executor node of a profile; none where there are no nodes."""
    return numbered.select("qNum", F.explode("nodeProfile").alias("n")).select(
        "qNum",
        F.col("n.endpoint.address").alias("endpointAddress"),
        F.col("n.endpoint.fabricPort").alias("endpointFabricPort"),
        F.col("n.maxMemoryUsed").alias("maxMemoryUsed"),
        F.col("n.timeEnqueuedBeforeSubmitMs").alias("enqueuedBeforeSubmitMs"),
    )
