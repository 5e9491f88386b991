"""Drawing the documents that look most like a target text: importance resampling on hashed n-grams.

Features are runs of one and two words, hashed by CRC-32 into buckets.  A bucket's gain is the
logarithm of its share in the target over its share in the documents, a document's weight is the
mean gain of its features, and a draw without repetition takes the highest sums of weight and
Gumbel noise.  The CRCs of all distinct features of a piece are worked out together: features of
one length form a matrix of bytes, and one step updates the CRCs of all its rows by one column.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import spellings
from tickloom.llm import words as W
from tickloom.llm.staging import staged

#: Fixed by the contract.
BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, 7
#: A matrix of few long rows has more columns than its steps are worth; same CRC either way.
LONG_FEATURE = 1024


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, from the reflected polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


CRC = _crc_table()


def crcs(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes, all rows advancing column by column."""
    state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        state = CRC[(state ^ column) & 0xFF] ^ (state >> 8)
    return ~state


def _spelled(data: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The byte spans of each feature one after the other: ``parts`` holds begin and size by place."""
    begin = np.stack([b for b, _ in parts], 1).ravel()
    size = np.stack([s for _, s in parts], 1).ravel()
    shift = begin - (np.cumsum(size) - size)
    return data[np.repeat(shift, size) + np.arange(int(size.sum()))]


def bucket_of(data: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> np.ndarray:
    """Bucket of each feature, each given as one to three byte spans of ``data``."""
    total = sum(s for _, s in parts)
    order = np.argsort(total, kind="stable")
    flat = _spelled(data, [(b[order], s[order]) for b, s in parts])
    lengths, counts = np.unique(total, return_counts=True)
    out, row, at = np.empty(len(total), np.uint32), 0, 0
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        bytes_ = flat[at : at + n * length].reshape(n, length)
        found = crcs(bytes_) if length <= LONG_FEATURE else np.array([zlib.crc32(r) for r in bytes_], np.uint32)
        out[order[row : row + n]] = found
        row, at = row + n, at + n * length
    return out % np.uint32(buckets)


def features(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: index of the first text, words told before, buckets of words and of pairs, and where texts start.

    A pair belongs to the text of its second word; the pair that a text's first word ends has bucket -1.
    """
    for piece in spellings.pieces(column, W.ALNUM_LOWER):
        name, n = spellings.names(piece.data, piece.begin, piece.end)
        if not n:
            yield piece.first, 0, np.empty(0, np.int64), np.empty(0, np.int64), piece.at
            continue
        size = piece.end - piece.begin
        one = spellings.first_of(name, n)
        words = bucket_of(piece.data, [(piece.begin[one], size[one])], buckets).astype(np.int64)[name]
        second = np.ones(len(name), bool)
        second[piece.at[:-1][piece.at[:-1] < len(name)]] = False
        second = np.flatnonzero(second)
        pairs = np.full(len(name), -1, np.int64)
        if len(second):
            pair, m = spellings.numbered(name[second - 1] * n + name[second])
            at = second[spellings.first_of(pair, m)]
            # A space follows every word once other separators are replaced.
            data = piece.data.copy()
            data[piece.end] = 32
            spans = [(piece.begin[at - 1], size[at - 1] + 1), (piece.begin[at], size[at])]
            pairs[second] = bucket_of(data, spans, buckets).astype(np.int64)[pair]
        yield piece.first, piece.again, words, pairs, piece.at


def _counted(buckets: int):
    """One row for each bucket in use per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, again, words, pairs, _ in features(batch.column("text"), buckets):
                total += np.bincount(words[again:], minlength=buckets)
                total += np.bincount(pairs[pairs >= 0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return run


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").cast("string").alias("text"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all of ``texts(text)``; the driver gets at most ``buckets`` sums."""
    counts = _texts(texts).mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over raw share, each count plus one, rounded down."""
    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray):
    # What the absent pair of a text's first word adds.
    gain = np.append(gain, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_pairs, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, again, words, pairs, at in features(batch.column("text"), len(gain) - 1):
                here = slice(first, first + len(at) - 1)
                value = gain[words]
                value[:again] = 0
                summed = np.concatenate([[0], np.cumsum(value + gain[pairs])])
                paired = np.concatenate([[0], np.cumsum(pairs >= 0)])
                total[here] += summed[at[1:]] - summed[at[:-1]]
                n_pairs[here] += paired[at[1:]] - paired[at[:-1]]
                n_words[here] += np.diff(at)
                n_words[first] -= again
            n = n_words + n_pairs
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(n_words), pa.array(n), pa.array(weight)],
                names=["row", "id", "n_words", "n_features", "weight"],
            )

    return run


def weights(docs: DataFrame, gain: np.ndarray, carry: list[str]) -> DataFrame:
    """``row, id, n_words, n_features, weight`` for each row of ``docs(doc_id, text)``."""
    packed = docs.select(
        F.struct(*carry).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")
    )
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_weighed(gain), f"row {kind}, id long, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    carry: list[str],
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``row, n_words, n_features, weight, score, rank`` for each row of ``docs(doc_id, text)``.

    ``row`` holds the columns named in ``carry``, whatever they are called.  Of the rows with at
    least ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn: those with the
    highest score, then the smallest ``doc_id``.  ``rank`` counts them from 1 and is null for
    all others.  Counts cover all rows of both inputs, texts of any length are read whole.

    A null, empty or wordless text has no features and weight 0.  A missing ``doc_id`` draws its
    noise as the empty id and comes after all others; repeated rows score alike and take ranks
    in a row.  Without rows nothing is drawn; without target rows every gain is that of an empty
    target.

    Scores are put in order by a range sort over narrow rows.  A row's place is its place in its
    partition plus the rows of the partitions before, so no task sees more than one partition.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(
        weights(docs, gain, carry).select(
            "row", "id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= min_words).alias("open")
        ),
        "scored",
    )
    keys = [F.col("open").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.xxhash64("row")]
    # The number of a row is its partition, times 2 ** 33, plus its place there.
    ordered = staged(
        scored.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "ordered"
    )
    part, place = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        ordered.groupBy(part)
        .agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"))
        .select(
            "part",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
            F.floor(F.lit(percent) * F.sum("n_open").over(Window.partitionBy()) / 100).alias("drawn"),
        )
    )
    # One row for each partition of the sort.
    placed = ordered.withColumn("part", part).join(F.broadcast(sizes), "part")
    rank = F.col("base") + place + 1
    return placed.select(
        "row", "n_words", "n_features", "weight", "score", F.when(F.col("open") & (rank <= F.col("drawn")), rank).alias("rank")
    )


def drawn(ranked: DataFrame) -> DataFrame:
    """The rows that were drawn, with the columns that were carried."""
    return ranked.where(F.col("rank").isNotNull()).select("row.*")
