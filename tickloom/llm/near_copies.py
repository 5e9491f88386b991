"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

A document is the set of its ``k``-word shingles.  Every shingle is hashed once; the high bits
of the hash choose one of ``BINS`` bins and the smallest hash of a bin is its value.  An empty
bin copies the first filled bin in an order of its own (optimal densification).  ``ROWS`` bins
form a band, and documents with equal bands share a bucket: a pair at similarity 0.8 shares
none with a chance of 8 in a million.

Documents with equal sets are one node.  A bucket yields a star, from its members to a centre,
never all pairs.  Stars are confirmed on the full sets.  What a star can leave open (members of
one bucket that are in different components) is closed exactly: those nodes meet in tiles of
bitmaps, whose distance is a lower bound of the sets' difference; pairs that the bound cannot
rule out are confirmed on the full sets as well.  Bitmaps are as wide as their sets need, so
that the bound is close at any size, and a tile holds a bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words as W
from tickloom.llm.components import components
from tickloom.llm.packed import by_group
from tickloom.llm.staging import join_hot, staged

BINS, ROWS = 512, 8
BANDS = BINS // ROWS
#: Bits of the narrowest and the widest bitmap, and bits for each shingle between them.
BITS, MOST_BITS, BITS_EACH = 4096, 1 << 20, 8
TILE, TILE_BYTES = 2048, 8 << 20
LEAVES = 256
KEYS_PER_GROUP = 1 << 19
U64 = W.U64


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, no words are none."""
    if len(words) >= k:
        return np.unique(W.windows(words, k))
    return W.windows(words, len(words)) if len(words) else words


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, words, at in W.hashed_texts(column, W.SPACED_LOWER):
        for i in range(len(at) - 1):
            yield shingle_set(words[at[i] : at[i + 1]], k)


def _bin_orders() -> np.ndarray:
    """For each bin an order of all bins, the same in every task."""
    i = np.arange(BINS * BINS, dtype=U64).reshape(BINS, BINS)
    return np.argsort(W.mix(i + U64(0x5EED)), axis=1, kind="stable")


def band_keys(sets: list[np.ndarray], orders: np.ndarray) -> np.ndarray:
    """``BANDS`` bucket keys for each non-empty set."""
    value = np.zeros((len(sets), BINS), U64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> U64(64 - 9)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        value[i, bins[first]] = s[first]
        filled[i, bins[first]] = True
    row, bin_ = np.nonzero(~filled)
    for step in range(BINS):
        if not len(row):
            break
        source = orders[bin_, step]
        hit = filled[row, source]
        value[row[hit], bin_[hit]] = value[row[hit], source[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    weights = W.mix(np.arange(ROWS, dtype=U64)) | U64(1)
    bands = (value.reshape(len(sets), BANDS, ROWS) * weights).sum(axis=2, dtype=U64)
    return W.mix(bands + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))


def bitmap(s: np.ndarray) -> bytes:
    """One bit per shingle, in a power of two of bits that follows the size of the set."""
    width = min(MOST_BITS, max(BITS, 1 << (BITS_EACH * len(s) - 1).bit_length()))
    out = np.zeros(width, np.uint8)
    out[(s & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _bin_orders()
        for batch in batches:
            at, sets = 0, []
            for s in shingle_sets(batch.column("text"), k):
                sets.append(s)
                if len(sets) == 512 or at + len(sets) == batch.num_rows:
                    full = [x for x in sets if len(x)]
                    keys = iter(band_keys(full, orders).view(np.int64) if full else [])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(at, len(sets)),
                            pa.array([len(x) for x in sets], pa.int64()),
                            pa.array([W.digest(x) if len(x) else None for x in sets], pa.binary()),
                            pa.array([bitmap(x) if len(x) else None for x in sets], pa.binary()),
                            pa.array([next(keys) if len(x) else None for x in sets], pa.list_(pa.int64())),
                        ],
                        names=["doc_id", "n_shingles", "node", "bits", "keys"],
                    )
                    at, sets = at + len(sets), []

    return run


def _packed_keys(groups: int):
    """Star within a batch, then the keys of its centres packed by bucket group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = np.frombuffer(b"".join(batch.column("node").to_pylist()), "S16")
            keys = batch.column("keys").flatten().to_numpy().view(U64)
            owner = np.repeat(np.arange(len(nodes)), BANDS)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            new = np.diff(keys, prepend=keys[0] ^ U64(1)) != 0
            centre = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
            leaf = (owner != centre) & (nodes[owner] != nodes[centre])
            pairs = np.unique(centre[leaf] * len(nodes) + owner[leaf])
            key, node = keys[new], nodes[owner[new]]
            group = (key % U64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            group, key, node = group[order], key[order], node[order]
            cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            rows = [(int(group[a]), key[a:b].tobytes(), node[a:b].tobytes(), None) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            if len(pairs):
                both = np.stack([nodes[pairs // len(nodes)], nodes[pairs % len(nodes)]], axis=1)
                # Nodes are digests: their first bytes spread the centres evenly.
                part = np.frombuffer(both.tobytes(), U64).reshape(-1, 4)[:, 0] % U64(groups)
                rows += [(-1 - g, None, None, part_pairs.tobytes()) for g, (part_pairs,) in by_group(part.astype(np.int64), [both])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                names=["grp", "key", "node", "pairs"],
            )

    return run


def _edge_table(pairs: np.ndarray) -> pa.Table:
    kind = pa.binary()
    return pa.table({"a": pa.array([x.ljust(16, b"\0") for x in pairs[:, 0].tolist()], kind), "b": pa.array([x.ljust(16, b"\0") for x in pairs[:, 1].tolist()], kind)})


def _stars(table: pa.Table) -> pa.Table:
    """Edges from the nodes of each bucket to its centre; in-batch edges pass through."""
    stars = [np.frombuffer(x, "S16").reshape(-1, 2) for x in table["pairs"].to_pylist() if x]
    key = np.frombuffer(b"".join(x for x in table["key"].to_pylist() if x), U64)
    if len(key):
        node = np.frombuffer(b"".join(x for x in table["node"].to_pylist() if x), "S16")
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.diff(key, prepend=key[0] ^ U64(1)) != 0
        centre = node[np.flatnonzero(new)][np.cumsum(new) - 1]
        leaf = centre != node
        stars.append(np.stack([centre[leaf], node[leaf]], axis=1))
    found = np.concatenate(stars) if stars else np.empty((0, 2), "S16")
    return _edge_table(np.unique(found, axis=0) if len(found) else found)


def _confirmed(k: int, percent: int):
    """Links of each centre, whose own row comes before its leaves'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, np.empty(0, U64)
        for batch in batches:
            found = []
            groups, own, wanted = (batch.column(c).to_pylist() for c in ("centre", "node", "is_leaf"))
            for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                if W.digest(s) != own[i]:
                    continue  # another text under the same doc_id
                if not wanted[i]:
                    held, centre = groups[i], s
                elif held == groups[i]:
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(s) - both):
                        found.append((groups[i], own[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], names=["a", "b"]
            )

    return run


def _confirm(docs: DataFrame, classes: DataFrame, edges: DataFrame, k: int, percent: int) -> DataFrame:
    """The edges whose full sets are similar enough; texts travel, each once per centre."""
    degree = edges.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).alias("parts"))
    edges = edges.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    roles = edges.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("is_leaf")).unionByName(
        edges.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("is_leaf")).distinct()
    )
    roles = roles.join(classes.select("node", F.col("doc_id").alias("rep")), "node")
    texts = roles.join(docs, F.col("rep").eqNullSafe(F.col("doc_id")), "inner")
    return (
        texts.select(F.col("a").alias("centre"), "part", "is_leaf", "node", "text")
        .repartition("centre", "part")
        .sortWithinPartitions("centre", "part", "is_leaf")
        .select("centre", "is_leaf", "node", "text")
        .mapInArrow(_confirmed(k, percent), "a binary, b binary")
        .distinct()
    )


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps as they would be with ``words`` words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _tile_pairs(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of two tiles in different components that their bitmaps cannot rule out."""
        packed = table["bits"].to_pylist()
        words = np.array([len(b) // 8 for b in packed])
        size = table["n_shingles"].to_numpy()
        roots = np.unique(np.array(table["root"].to_pylist(), "S16"), return_inverse=True)[1]
        nodes = np.array(table["node"].to_pylist(), "S16")
        tile, (left, right) = table["tile"].to_numpy(), (table["i"][0].as_py(), table["j"][0].as_py())
        found = []
        widths = np.unique(words)
        of_width = {w: np.flatnonzero(words == w) for w in widths}
        bits = {w: np.frombuffer(b"".join(packed[i] for i in rows), U64).reshape(-1, w) for w, rows in of_width.items()}
        for a, narrow in enumerate(widths):
            for wide in widths[a:]:
                x_rows, y_rows = of_width[narrow], of_width[wide]
                if size[x_rows].max() * 100 < percent * size[y_rows].min():
                    break
                y_bits = _folded(bits[wide], narrow)
                for i, x in enumerate(x_rows):
                    y = np.flatnonzero((roots[y_rows] != roots[x]) & (tile[y_rows] == (right if tile[x] == left else left)))
                    y = y[y_rows[y] > x] if narrow == wide else y
                    n = size[y_rows[y]]
                    y = y[np.minimum(n, size[x]) * 100 >= percent * np.maximum(n, size[x])]
                    gap = np.bitwise_count(y_bits[y] ^ bits[narrow][i]).sum(axis=1, dtype=np.int64)
                    y = y_rows[y[gap * (100 + percent) <= (100 - percent) * (size[y_rows[y]] + size[x])]]
                    found.append(np.stack([np.full(len(y), nodes[x]), nodes[y]], axis=1))
        return _edge_table(np.concatenate(found) if found else np.empty((0, 2), "S16"))

    return run


def _lifted(edges: DataFrame, linked: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, where these differ."""
    for end in ("a", "b"):
        roots = linked.select(F.col("node").alias(end), F.col("root").alias("up"))
        edges = edges.join(roots, end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
    return edges.where("a <> b")


def _open_pairs(nodes: DataFrame, stars: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Pairs that stars left open: candidates of one cluster, in different components."""
    clusters = components(_lifted(stars, linked)).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    rooted = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = staged(join_hot(rooted, clusters, "root", "node", "inner"), "clusters")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("bits")).alias("bytes"))
    members = join_hot(members, sizes, "cluster", "node", "inner")
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("bytes") / TILE_BYTES)).cast("int")
    members = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    members = members.withColumn("other", F.explode(other)).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    return (
        members.select("cluster", "i", "j", "tile", "node", "root", "n_shingles", "bits")
        .groupBy("cluster", "i", "j")
        .applyInArrow(_tile_pairs(percent), "a binary, b binary")
    )


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Linked are documents with ``100 * intersection >= percent * union`` of their ``k``-word
    shingle sets; ``component_id`` is the smallest ``doc_id`` that links lead to.  Null and
    wordless texts have an empty set and stand alone.  A row without ``doc_id`` takes part, but
    names no component unless all of its rows lack one (then ``component_id`` is null and
    ``kept`` true).  Repeated rows give repeated, equal result rows.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(
        docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, node binary, bits binary, keys array<long>"), "signatures"
    )
    full = rows.where("node is not null")
    classes = staged(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "classes")
    groups = max(1, BANDS * classes.count() // KEYS_PER_GROUP)
    stars = staged(
        full.select("node", "keys")
        .mapInArrow(_packed_keys(groups), "grp long, key binary, node binary, pairs binary")
        .groupBy("grp")
        .applyInArrow(_stars, "a binary, b binary")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "stars",
    )
    links = staged(_confirm(docs, classes, stars, k, percent), "links")
    one = full.select("node", "n_shingles", "bits").join(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), "node", "left_semi").dropDuplicates(["node"])
    linked = staged(components(links), "linked")
    pending = staged(_open_pairs(one, stars, linked, percent), "open")
    merged = components(_lifted(_confirm(docs, classes, pending, k, percent), linked))
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = classes.join(linked, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"), "n")
    named = staged(
        join_hot(rooted, merged, "root", "node").select("node", "doc_id", F.coalesce("top", "root").alias("root"), "n"), "named"
    )
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    label = join_hot(named, least, "root", "node", "inner").where("n > 1 or m > 1").select("node", "component_id", F.lit(True).alias("grouped"))
    out = join_hot(rows.select("doc_id", "n_shingles", "node"), label, "node", "doc_id")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )
