"""Leaving out what is stored already, without moving profiles.

Only the identity of a profile and its place in the staged files take part.  A membership filter
over the stored identities of the same time range lets most new profiles pass at once; the others
are compared exactly.  What is known then comes back as one bit per staged row, and the staged
files are read once more with these bits beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ("queryId", "attempt", "queryStartMs")
#: Fixed value: bits in a bitmap that Spark builds.
BITMAP_BITS = 32_768
BITS_PER_KEY = 16
#: At most so many bytes of bitmaps are broadcast at once.
BROADCAST_BYTES = 64 << 20
_BITMAP_BYTES = BITMAP_BITS // 8


def bit_is_set(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap of `bitmap_construct_agg` is set; null without a bitmap."""
    byte = F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("long")
    return F.pmod(F.floor(value / F.pow(F.lit(2.0), position % 8)), F.lit(2)) == 1


def _positions(slots: int) -> dict[str, Column]:
    """Slot of an identity, and its place in each of the slot's two bitmaps."""
    first, second = F.xxhash64(*IDENTITY), F.xxhash64(*IDENTITY, F.lit("second"))
    return {
        "slot": F.pmod(first, F.lit(slots)),
        "one": F.pmod(F.shiftright(first, 32), F.lit(BITMAP_BITS)),
        "two": F.pmod(second, F.lit(BITMAP_BITS)),
    }


def filter_slots(keys: int) -> int:
    return -(-keys * BITS_PER_KEY // BITMAP_BITS) or 1


def membership_filter(known: DataFrame, slots: int) -> DataFrame:
    """``slot, ones, twos``: at most ``slots`` rows of two bitmaps each."""
    placed = known.select(*(c.alias(n) for n, c in _positions(slots).items()))
    return placed.groupBy("slot").agg(
        F.bitmap_construct_agg("one").alias("ones"), F.bitmap_construct_agg("two").alias("twos")
    )


def may_be_known(rows: DataFrame, known: DataFrame, slots: int) -> DataFrame:
    """``rows`` that pass the filter: all that are known, and about one in 250 others."""
    bits = F.broadcast(membership_filter(known, slots))
    hit = bit_is_set(F.col("ones"), F.col("one")) & bit_is_set(F.col("twos"), F.col("two"))
    return rows.withColumns(_positions(slots)).join(bits, "slot").where(hit).select(*rows.columns)


def known_places(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """``fileName, block, bits``: which rows of the staged files ``stored`` has, a bit for each.

    A stored copy of a profile has the same start, so only row groups of this batch's time
    range are read from the stored table.
    """
    narrow = staged.select(
        *IDENTITY, F.col("_metadata.file_name").alias("fileName"), F.col("_metadata.row_index").alias("place")
    )
    bounds = staged.agg(F.min("queryStartMs").alias("lo"), F.max("queryStartMs").alias("hi")).first()
    known = stored.select(*IDENTITY)
    known = known.where(F.col("queryStartMs").between(bounds["lo"], bounds["hi"])) if bounds["lo"] is not None else known.where("false")
    slots = filter_slots(known.count())
    # Beyond the bound the identities are compared without the filter.
    if slots * 2 * _BITMAP_BYTES <= BROADCAST_BYTES:
        narrow = may_be_known(narrow, known, slots)
    met = narrow.join(known, list(IDENTITY), "left_semi")
    block = F.expr(f"place div {BITMAP_BITS}").alias("block")
    return met.groupBy("fileName", block).agg(F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bits"))


def without_places(staged: DataFrame, places: DataFrame) -> DataFrame:
    """The staged rows whose bit is not set; ``places`` has been written.

    The bits are broadcast in runs of files of at most ``BROADCAST_BYTES``; the filter on the
    file name keeps all other files from being read with them.
    """
    sizes = [(r["fileName"], r["n"]) for r in places.groupBy("fileName").agg(F.count("*").alias("n")).orderBy("fileName").collect()]
    runs, held = [], 0
    for name, n in sizes:
        if not runs or held + n > BROADCAST_BYTES // _BITMAP_BYTES:
            runs.append(name)
            held = 0
        held += n
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    out = None
    for first, after in zip(runs or [None], [*runs[1:], None], strict=True):
        part, bits = staged, places
        # The first run also has all files before it that nothing is known of.
        if first is not None and first != runs[0]:
            part, bits = part.where(name >= first), bits.where(F.col("fileName") >= first)
        if after is not None:
            part, bits = part.where(name < after), bits.where(F.col("fileName") < after)
        placed = part.select("*", name.alias("fileName"), F.expr(f"_metadata.row_index div {BITMAP_BITS}").alias("block"), (row % BITMAP_BITS).alias("bit"))
        left = (
            placed.join(F.broadcast(bits), ["fileName", "block"], "left")
            .where(F.col("bits").isNull() | ~bit_is_set(F.col("bits"), F.col("bit")))
            .select(*staged.columns)
        )
        out = left if out is None else out.unionByName(left)
    return out
