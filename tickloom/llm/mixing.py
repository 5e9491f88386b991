"""Mixing sources to target weights along a curriculum that changes over time.

Each source has a weight schedule: straight lines between ``(time, weight)`` knots over a run
from 0 to 1.  Its integral is the source's weight; weights share a token budget, a source stops
at ``max_epochs`` times its size, and what it cannot take is shared again.  The schedule, scaled
to the target, is the source's demand for tokens over time.  Documents line up in a hashed
order, epoch after epoch; the first token of a document in this line is served at the time where
the cumulative demand reaches it, and sorting by that time gives the training order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.staging import staged

#: From a source's number (by code point, null last) and name to its knots, two or more of
#: ``(t, w)`` from time 0 to time 1.
Schedule = Callable[[Column, Column], Column]

#: Fixed by the contract: words, the repeating weights, and the share of all sizes.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: A source's name with nulls told apart: equal keys meet in one partition.
KEY = ["missing", "source"]


def repeating(number: Column, source: Column) -> Column:
    """Weights 5, 2, 1 in turn: heavy sources fade out over the run, light ones fade in."""
    weight = F.get(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (number % len(WEIGHTS)).cast("int"))
    tilt = F.when(weight == 5, 0.5).when(weight == 1, -0.5).otherwise(0.0)
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), w.alias("w"))
    return F.array(knot(0.0, weight * (1 + tilt)), knot(1.0, weight * (1 - tilt)))


def _areas(knots: Column) -> Column:
    """Integral from the first knot to each knot."""
    get = lambda i, part: F.get(knots, i)[part]
    step = lambda i: (get(i, "t") - get(i - 1, "t")) * (get(i - 1, "w") + get(i, "w")) / 2
    steps = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), step)
    return F.transform(knots, lambda _, i: F.aggregate(F.slice(steps, 1, i), F.lit(0.0), lambda total, x: total + x))


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``number``: places from 0 in the order of ``KEY``, by a range sort of narrow rows."""
    placed = staged(sources.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id()), "sources")
    # A place is its partition, times 2 ** 33, plus the place there.
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row for each partition of the sort.
    return placed.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("number", F.col("base") + place).drop("part", "base", "place")


def with_targets(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """``sources(source_size, weight)`` with ``target``: ``budget`` by weight, none above its cap.

    The level, tokens for a unit of weight, rises as full sources pass on what they cannot take.
    Each round adds up the sources once and ends when no more of them are full.
    """
    cap, weight = F.col("source_size") * max_epochs, F.col("weight")
    level, full = 0.0, -1
    while True:
        is_full = cap <= weight * level
        row = sources.where(weight > 0).agg(
            F.count_if(is_full).alias("full"), F.sum(F.when(is_full, cap)).alias("taken"), F.sum(F.when(~is_full, weight)).alias("rest")
        ).first()
        if row.full <= full or not row.rest:
            break
        full, level = row.full, (budget - (row.taken or 0)) / row.rest
    own = F.when(cap <= weight * level, cap).otherwise(weight * level) if row.rest else cap
    return sources.withColumn("target", F.when(weight > 0, own).otherwise(0).cast("double"))


def _planned(sources: DataFrame, schedule: Schedule, share: float, max_epochs: int) -> DataFrame:
    """Size, target and demand over time of each source, a written table."""
    areas = numbered(sources).withColumn("knots", schedule(F.col("number"), F.when(~F.col("missing"), F.col("source"))))
    areas = staged(areas.withColumn("areas", _areas(F.col("knots"))).withColumn("weight", F.element_at("areas", -1)), "schedules")
    total = areas.agg(F.sum("source_size")).first()[0] or 0
    scale = F.when(F.col("weight") > 0, F.col("target") / F.col("weight")).otherwise(0.0)
    return with_targets(areas, share * total, max_epochs).select(
        *KEY,
        "source_size",
        "target",
        F.col("knots.t").alias("times"),
        F.transform("areas", lambda x: x * scale).alias("demand"),
        F.transform("knots", lambda k: k["w"] * scale).alias("rates"),
    )


def curriculum(
    docs: DataFrame,
    carry: list[str],
    schedule: Schedule = repeating,
    share: float = SHARE,
    max_epochs: int = 2,
    prefix: int = 3,
) -> DataFrame:
    """``row, size, source_size, target, copies`` for each row of ``docs(doc_id, text, source)``.

    ``row`` holds the columns named in ``carry``, whatever they are called.  ``copies`` lists what
    the mix takes of the row: ``(copy, position, words)``, with the words of the copy and its time
    in [0, 1].  The words taken of a source are its target, rounded down; only the copy at the
    target's edge is taken in part.  Null and wordless texts have size 0 and no copies; a null
    source is a source and comes last.  Rows without ``doc_id`` line up by their text; rows that
    repeat an id follow each other, the shorter first, and each counts.

    Offsets are summed in two levels, within the buckets of a hashed order and over the buckets
    of a source, so a source with most of the rows spreads over ``16 ** prefix`` buckets.  Sources
    may be any number: their sizes, places, targets and schedules are tables.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*carry).alias("row"),
        F.col("source").isNull().alias("missing"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")), F.lit("")).cast("binary")).alias("place"),
        F.xxhash64(text).alias("tie"),
    ).withColumn("bucket", F.substring("place", 1, prefix))
    buckets = staged(rows.groupBy(*KEY, "bucket").agg(F.sum("size").alias("n")), "buckets")
    sources = staged(_planned(buckets.groupBy(*KEY).agg(F.sum("n").alias("source_size")), schedule, share, max_epochs), "plan")
    base = F.sum("n").over(Window.partitionBy(*KEY).orderBy("bucket")) - F.col("n")
    before = buckets.withColumn("base", base).drop("n").join(sources, KEY)
    # Joined and summed on the same keys: rows move once.
    placed = rows.join(before, [*KEY, "bucket"])
    line = Window.partitionBy(*KEY, "bucket").orderBy("place", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("offset", F.col("base") + F.sum("size").over(line) - F.col("size"))

    def copy(e):
        start = F.col("offset") + e * F.col("source_size")
        words = F.least(F.floor("target") - start, F.col("size"))
        return F.struct(e.cast("int").alias("copy"), _time(start).alias("position"), words.alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), copy), lambda c: c["words"] > 0)
    return placed.select("row", "size", "source_size", "target", copies.alias("copies"))


def _time(tokens):
    """When a source's cumulative demand reaches ``tokens``: a quadratic on one line of the schedule."""
    last = F.size("times") - 2
    i = F.greatest(F.lit(0), F.least(last, F.size(F.filter("demand", lambda d: d <= tokens)) - 1))
    get = lambda name, k: F.get(F.col(name), k)
    rest = tokens - get("demand", i)
    rate, step = get("rates", i), get("times", i + 1) - get("times", i)
    slope = F.when(step > 0, (get("rates", i + 1) - rate) / step).otherwise(0.0)
    root = F.sqrt(F.greatest(rate * rate + 2 * slope * rest, F.lit(0.0)))
    return get("times", i) + F.when(rest > 0, 2 * rest / (rate + root)).otherwise(0.0)


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """``curriculum`` rows, one for each copy, sorted by position over the whole output."""
    copies = mixed.select("row", "size", "source_size", "target", F.explode("copies").alias("c"))
    keys = [F.col("c.position"), F.xxhash64("row"), F.col("c.copy")]
    ordered = copies.repartitionByRange(partitions, *keys) if partitions else copies.repartitionByRange(*keys)
    return ordered.sortWithinPartitions(*keys).select("row", "size", "source_size", "target", "c.copy", "c.position", F.col("c.words").alias("taken"))
