"""The ingest job: profile lines to the four stored tables.

The parsed profiles are written once to the shared staging folder.  Numbering and
all four tables then read only the columns they need from there, and none of them
shuffles a profile; just the narrow phase rows are spread before they become ticks.
An executor lost on the way costs the tasks it ran, not the parse.  What a run has
written becomes visible in one step, when its manifest is put in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace as changed

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.states import CODES
from tickloom.model import DEFAULT_CHUNK_SIZE, DEFAULT_TICK_MS
from tickloom.operators.manifest import QUARANTINE, Batch, open_manifest, publish, remove_unlisted
from tickloom.operators.numbering import next_base, number_staged
from tickloom.operators.overlap import known_places, without_places
from tickloom.operators.sinks import (
    COMPRESSED,
    batch_digest,
    new_staging_dir,
    range_bounds,
    range_name,
    releasing_shuffles,
    remove,
    write_table,
)
from tickloom.operators.tables import nodes_table, queries_table, text_chunks
from tickloom.operators.ticks import (
    expected_ticks_per_state,
    profile_phases,
    task_count,
    tick_ranges,
    ticks_table,
)
from tickloom.sources.profile_files import read_profile_lines
from tickloom.sources.profile_json import parse_profiles, quarantined, usable
from tickloom.sources.tables import read_table

QUARANTINE_DDL = "file_name STRING, attempt BIGINT, problem STRING, line STRING"
PLACES_DDL = "fileName STRING, block BIGINT, bits BINARY"
#: Row groups of the ticks, which are sorted by state and time, hold some 200,000 rows: few are
#: read for one state in one hour.
WRITE_OPTIONS = {"ticks": {"parquet.block.size": str(1 << 20)}}


@dataclass(frozen=True)
class IngestReport:
    ingest_range: str
    base: int
    profiles: int
    quarantined: int
    staged_dir: str
    expected_ticks: dict[int, int] = field(default_factory=dict)
    stored_ticks: dict[int, int] = field(default_factory=dict)


def ingest(spark: SparkSession, input_dir: str, output_dir: str, **options) -> IngestReport:
    """Ingest the profile files directly below ``input_dir``; options as in `ingest_lines`."""
    return ingest_lines(read_profile_lines(spark, input_dir), output_dir, **options)


def ingest_lines(
    lines: DataFrame,
    output_dir: str,
    *,
    tick_ms: int = DEFAULT_TICK_MS,
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    base: int | None = None,
    strict: bool = False,
    replace: bool = False,
    skip_existing: bool = False,
    tag: str | None = None,
    keep_staging: bool = False,
    written: Callable[[str], None] | None = None,
) -> IngestReport:
    """Ingest ``(file_name, attempt, line)``.

    A run becomes one partition per table, named after the first and last query start of its
    usable profiles, a digest of its file names, ``tag``, and the run.  Nothing of it is visible
    before all of it is; a run that breaks off leaves the tables as they were.

    A run replaces what files of the same names wrote before, if the time ranges of both
    overlap: the same batch again, or corrected.  Files of the same names from another time are
    another batch, and so are other files whatever their range.  ``replace`` replaces everything
    that is stored.  ``skip_existing`` replaces nothing and leaves out profiles that are stored
    already, so overlapping inputs do not repeat rows.

    ``written`` is called with the name of each table once it is written.  The staged profiles
    are removed at the end unless ``keep_staging`` is set.
    """
    if tick_ms < 1 or chunk_size < 1:
        raise ValueError("tick_ms and chunk_size must be at least 1")
    if replace and skip_existing:
        raise ValueError("replace and skip_existing exclude each other")
    spark = lines.sparkSession
    manifest = open_manifest(spark, output_dir)

    staged_dir, staged = _stage(parse_profiles(lines, strict=strict))
    finished = [staged_dir]
    own = range_name(batch_digest(staged), tag)
    if skip_existing and manifest.batches:
        staged_dir, staged = _stage_new(staged_dir, staged, read_table(spark, output_dir, "queries", manifest))
        finished.append(staged_dir)
    facts = staged.agg(
        *range_bounds(F.col("problem").isNull()),
        F.count("*").alias("rows"),
        F.count_if(F.col("problem").isNull()).alias("profiles"),
        F.count_if(F.col("problem").isNotNull()).alias("quarantined"),
    ).first()
    first, last = facts["firstStartMs"], facts["lastStartMs"]

    def goes(batch: Batch) -> bool:
        return replace or (not skip_existing and batch.same_batch(own, first, last))

    if base is None:
        again = [b for b in manifest.batches if goes(b) and b.files == own and b.rows == facts["rows"]]
        stored = None if replace or manifest.last_number is not None else read_table(spark, output_dir, "queries", manifest)
        # The same batch keeps its numbers; others come after all that are in use.
        base = again[0].base if len(again) == 1 else max(next_base(stored), 0 if replace else manifest.last_number or 0)
    ranges = tick_ranges(profile_phases(usable(staged), []), tick_ms)
    expected = _by_state(expected_ticks_per_state(ranges, tick_ms), "expectedTicks")
    tick_files = task_count(staged, sum(expected.values()))

    numbered = usable(number_staged(staged, f"{staged_dir}-offsets", base))
    bad = quarantined(staged)
    if skip_existing:
        listed = [b for b in manifest.batches if b.files != own]
        bad = _not_listed(bad, read_table(spark, output_dir, QUARANTINE, changed(manifest, batches=tuple(listed)), QUARANTINE_DDL))
    tables = {
        QUARANTINE: bad,
        "query_text": text_chunks(numbered, chunk_size),
        "nodes": nodes_table(numbered),
        "ticks": ticks_table(numbered, tick_ms, tick_files).sortWithinPartitions("queryState", "tickMs"),
        "queries": queries_table(numbered, chunk_size).sortWithinPartitions("queryStartMs"),
    }
    name = range_name(first, last, own, uuid.uuid4().hex[:12])
    counts = {}
    for table, df in tables.items():
        counts[table] = _write_counted(df, output_dir, table, name)
        if written is not None:
            written(table)

    ticks = counts["ticks"]
    batch = Batch(name, own, first, last, facts["profiles"], base, facts["rows"], tick_ms, counts["nodes"].pop("rows"), {str(k): n for k, n in ticks.items() if k != "rows"})

    def change(batches: tuple[Batch, ...]) -> tuple[Batch, ...]:
        kept = (b for b in batches if not goes(b))
        if skip_existing:
            # The new list of bad lines holds what the same files listed before.
            kept = (changed(b, tables=tuple(t for t in b.tables if t != QUARANTINE)) if b.files == own else b for b in kept)
        return (*kept, batch)

    before, after = publish(spark, output_dir, change)
    live = {b.partition for b in after.batches}
    remove_unlisted(spark, output_dir, own, {b.partition for b in before.batches} - live)
    if not keep_staging:
        for path in finished:
            remove(spark, path.removesuffix("/profiles"))
    stored_ticks = {k: n for k, n in ticks.items() if k != "rows"}
    return IngestReport(name, base, facts["profiles"], facts["quarantined"], staged_dir, expected, stored_ticks)


def _write_counted(df: DataFrame, output_dir: str, table: str, name: str) -> dict:
    """Write a partition and count its rows on the way; ticks by state as well."""
    counts = [F.count(F.lit(1)).alias("rows")]
    if table == "ticks":
        counts += [F.count_if(F.col("queryState") == code).alias(str(code)) for code in CODES]
    seen = Observation(f"{table} {name}")
    write_table(df.observe(seen, *counts), output_dir, table, name, WRITE_OPTIONS.get(table))
    return {(int(k) if k.isdigit() else k): n for k, n in seen.get.items() if n or k == "rows"}


def _not_listed(bad: DataFrame, listed: DataFrame) -> DataFrame:
    """Bad lines that no other batch has listed."""
    line = ["file_name", "attempt", "line"]
    return bad.join(listed.select(*line), line, "left_anti")


def _by_state(counts: DataFrame, column: str) -> dict[int, int]:
    """At most one row per state code."""
    rows = counts.select("queryState", column).orderBy("queryState").collect()
    return {r["queryState"]: r[column] for r in rows}


def _stage(profiles: DataFrame) -> tuple[str, DataFrame]:
    """Write parsed profiles to the shared staging folder and read them back."""
    spark = profiles.sparkSession
    path = f"{new_staging_dir(spark)}/profiles"
    with releasing_shuffles(spark):
        profiles.write.options(**COMPRESSED).parquet(path)
    return path, spark.read.schema(profiles.schema).parquet(path)


def _stage_new(staged_dir: str, staged: DataFrame, stored: DataFrame) -> tuple[str, DataFrame]:
    """The staged profiles that ``stored`` does not have, staged again."""
    path = f"{staged_dir}-known"
    with releasing_shuffles(staged.sparkSession):
        known_places(staged, stored).write.parquet(path)
    return _stage(without_places(staged, staged.sparkSession.read.schema(PLACES_DDL).parquet(path)))
