"""Benchmark phrases in documents, found through an FM-index of each training shard.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item (a shorter item is one
phrase).  A shard is what one task reads at a time.  Words that no item holds cannot be part of
an occurrence, so the index is built over the runs of benchmark words that are long enough for
the shortest phrase; each phrase is searched backward through wavelet-tree ranks, its places
are located from sampled suffix positions, and overlapping places merge into removal spans.

The benchmark is a stated query set.  It is taken to the executors in blocks of ``BLOCK_BYTES``
of text, one pass of narrow columns per block, so nothing broadcast grows beyond a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words as W
from tickloom.llm.fm_index import FMIndex
from tickloom.llm.packed import by_group, runs

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_SYMBOLS = 4_000_000
BREAK = 1

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"
RESULT_NAMES = ["n_words", "n_hit", "items", "spans"]


class Phrases:
    """The windows of a block of items, as codes of the block's vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        column = pa.array([text for _, text in items], pa.string())
        texts = [w[a:b] for _, w, at in W.hashed_texts(column, W.ALNUM_LOWER) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, W.U64), *texts]))
        self.top = len(self.vocabulary) + BREAK
        windows: dict[int, dict[bytes, set[str]]] = {}
        for (item, _), hashes in zip(items, texts, strict=True):
            code = (np.searchsorted(self.vocabulary, hashes) + BREAK + 1).astype(np.int64)
            size = min(window, len(code))
            for i in range(len(code) - size + 1 if size else 0):
                windows.setdefault(size, {}).setdefault(code[i : i + size].tobytes(), set()).add(item)
        #: By phrase length: the phrases, and for each the items that hold it.
        self.by_length = {
            size: (np.frombuffer(b"".join(found), np.int64).reshape(-1, size), list(found.values()))
            for size, found in windows.items()
        }
        self.shortest = min(self.by_length, default=0)


class _Shard:
    """Runs of benchmark words of the texts added so far."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.codes, self.docs, self.places, self.size = [], [], [], 0

    def add(self, first: int, words: np.ndarray, at: np.ndarray) -> None:
        p = self.phrases
        code = np.searchsorted(p.vocabulary, words)
        known = p.vocabulary[np.minimum(code, len(p.vocabulary) - 1)] == words
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # Runs of known words within a document.
        run = np.cumsum((~known) | np.concatenate([[True], doc[1:] != doc[:-1]])) if len(words) else code
        run = run[known]
        cut = runs(run)
        long = np.diff(cut) >= p.shortest if len(run) else np.empty(0, bool)
        keep = np.repeat(long, np.diff(cut)) if len(run) else np.empty(0, bool)
        index = np.flatnonzero(known)[keep]
        if not len(index):
            return
        ends = np.flatnonzero(np.append(np.diff(run[keep]) != 0, True)) + 1
        self.codes.append(np.insert(code[index] + BREAK + 1, ends, BREAK))
        self.docs.append(np.insert(doc[index] + first, ends, -1))
        self.places.append(np.insert(index - at[doc[index]], ends, -1))
        self.size += len(index) + len(ends)

    def occurrences(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per phrase length: phrase, document and first word of each occurrence."""
        if self.codes:
            index = FMIndex(np.concatenate(self.codes), self.phrases.top)
            doc, place = np.concatenate(self.docs), np.concatenate(self.places)
            for size, (phrases, _) in self.phrases.by_length.items():
                which, at = index.search(phrases)
                yield size, which, doc[at], place[at]
        self.clear()


def _merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    return list(zip(begin[new].tolist(), reach[np.append(np.flatnonzero(new)[1:], len(begin)) - 1].tolist(), strict=True))


def _searched(shared, window: int):
    """Adds what one block of items finds to what earlier blocks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for batch in batches:
            n = batch.num_rows
            total, found = [0] * n, [([], [], set()) for _ in range(n)]
            for i, (items, spans) in enumerate(zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                found[i][2].update(items)
                found[i][0].extend([s["begin"] for s in spans])
                found[i][1].extend([s["end"] for s in spans])

            def note(shard: _Shard) -> None:
                for size, which, doc, place in shard.occurrences():
                    items = phrases.by_length[size][1]
                    for d, (w, p) in by_group(doc, [which, place]):
                        found[d][0].extend(p.tolist())
                        found[d][1].extend((p + size).tolist())
                        for x in np.unique(w).tolist():
                            found[d][2].update(items[x])

            shard = _Shard(phrases)
            for first, words, at in W.hashed_texts(batch.column("text"), W.ALNUM_LOWER):
                total[first : first + len(at) - 1] = np.diff(at).tolist()
                if phrases.shortest:
                    shard.add(first, words, at)
                if shard.size >= SHARD_SYMBOLS:
                    note(shard)
            note(shard)
            spans = [_merged(np.array(b), np.array(e)) if b else [] for b, e, _ in found]
            span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "text")),
                    pa.array(total, pa.int64()),
                    pa.array([sum(e - b for b, e in s) for s in spans], pa.int64()),
                    pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                    pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], span_type),
                ],
                names=["row", "text", *RESULT_NAMES],
            )

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, n_words, n_hit, items, spans`` for each row of ``docs``; ``row`` is that row.

    ``spans`` are the merged word ranges that occurrences of the benchmark's windows cover,
    ``n_hit`` the words in them, ``items`` the ids of the items found, sorted as strings.  Words
    are runs of ASCII letters (case ignored), digits and non-ASCII characters.  Null and empty
    texts have no words and no hits; items without words or ids find nothing.  Repeated rows of
    either table change nothing but the number of result rows.  ``row`` keeps any other columns.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    out = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.col("row.text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<begin:long,end:long>>").alias("spans"),
    )
    schema = f"row {docs.select(F.struct('*').alias('row')).schema[0].dataType.simpleString()}, text string, {RESULT}"
    for block in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().collect()
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in chosen])
        out = out.mapInArrow(_searched(shared, window), schema)
    return out.drop("text")
