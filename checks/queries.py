"""The registered queries: one per operator, source, sink and view."""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.derived_profiles import (
    CHUNK_SIZE,
    TICK_MS,
    ingest_derived,
    profile_lines,
    tables,
)
from tickloom.functions import scalars
from tickloom.functions.states import state_code
from tickloom.model import STATE_START_COLUMNS, TABLE_NAMES
from tickloom.operators import numbering, sinks
from tickloom.operators.manifest import QUARANTINE
from tickloom.operators.tables import rebuild_text
from tickloom.operators.ticks import header_phases, reconcile, shuffle_partitions, ticks_per_state
from tickloom.plans import late_views, views
from tickloom.plans.ingest import ingest_lines
from tickloom.plans.stored_views import load_views, save_views
from tickloom.sources.profile_files import query_id_from_file, read_profile_lines
from tickloom.sources.profile_json import parse_profiles, quarantined, usable
from tickloom.sources.tables import read_tables
from tickloom.streaming.incremental import ingest_available

Query = Callable[[SparkSession, str], DataFrame]

ID = ["queryId", "attempt"]
SETTINGS = {"tick_ms": TICK_MS, "chunk_size": CHUNK_SIZE, "base": 0}


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed profiles as the ingest job staged them."""
    return usable(spark.read.parquet(ingest_derived(spark, sf_dir)[1].staged_dir))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["queries"]


def _identified(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """``df`` with query id and attempt in place of the surrogate key."""
    return df.join(_queries(spark, sf_dir).select("qNum", *ID), "qNum").drop("qNum")


# --- sources and sinks -----------------------------------------------------------------


def _profile_files(spark: SparkSession, sf_dir: str) -> str:
    """The derived lines as compressed profile files; a file holds many lines, so ids come from elsewhere."""
    path = f"{sinks.new_staging_dir(spark)}/files"
    profile_lines(spark, sf_dir).select("line").write.text(path, compression="gzip")
    for name in sinks.children(spark, path):
        if name.startswith("part-"):
            where, fs = sinks.file_system(spark, f"{path}/{name}")
            to, _ = sinks.file_system(spark, f"{path}/profile_{name.removesuffix('.txt.gz')}.json.gz")
            fs.rename(where, to)
    return path


def scan_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_profile_lines(spark, _profile_files(spark, sf_dir), pattern="*.json.gz")
    return usable(parse_profiles(lines)).select(
        "userId",
        "queryStartMs",
        "queryEndMs",
        F.length("queryText").cast("bigint").alias("textLength"),
        F.size("nodeProfile").cast("bigint").alias("nodes"),
    )


#: Lines that are packed or unpacked at once, so that long ones need little memory.
LINES_AT_ONCE = 128


def _each_line(lines: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """``lines`` with their binary column ``line`` changed."""

    def batches(found):
        for batch in found:
            for at in range(0, batch.num_rows, LINES_AT_ONCE):
                part = batch.slice(at, LINES_AT_ONCE)
                line = part.column("line")
                changed = pa.array(map(change, line.to_pylist()), line.type)
                yield part.set_column(part.schema.get_field_index("line"), "line", changed)

    return lines.mapInArrow(batches, lines.schema)


def _packed(lines: DataFrame) -> DataFrame:
    """Each ``line`` compressed by itself, behind four bytes for its length, in base64."""
    return _each_line(lines, lambda b: b64encode(len(b).to_bytes(4) + pa.compress(b, "lz4_raw", asbytes=True)))


def _unpacked(lines: DataFrame) -> DataFrame:
    """Each ``line`` as it was before `_packed`."""

    def unpacked(b):
        b = b64decode(b)
        return pa.decompress(b[4:], int.from_bytes(b[:4]), "lz4_raw", asbytes=True)

    return _each_line(lines, unpacked)


def split_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of files that are read split by split: its digest, and what is left of its place.

    The files hold a line's position in front of it, so position and content can be compared.
    A compressed file is read in one piece, unless by bzip2, which is slow; so the files are plain
    text, in which each line is compressed by itself.
    """
    path = f"{sinks.new_staging_dir(spark)}/files"
    # Packed lines make smaller files; with fewer of them, each still has several splits.
    n, cores = shuffle_partitions(spark.range(0)), spark.sparkContext.defaultParallelism
    fewer = profile_lines(spark, sf_dir).coalesce(min(n, cores * max(1, n // (4 * cores))))
    # Positions from the task and the place in it, which is how the lines are written.
    numbered = fewer.withColumn("at", F.monotonically_increasing_id())
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).cast("string")
    head = F.concat_ws("|", place, "file_name", "attempt").alias("head")
    packed = _packed(numbered.select(head, F.col("line").cast("binary").alias("line")))
    packed.select(F.concat_ws("|", "head", F.col("line").cast("string"))).write.text(path)
    lines = read_profile_lines(spark, path, pattern="*.txt", whole_file_limit=0)
    parts = F.split("line", r"\|", 4)
    found = lines.select(
        parts[1].alias("file_name"),
        parts[2].cast("bigint").alias("attempt"),
        (F.col("attempt") - parts[0].cast("bigint")).alias("shift"),
        parts[3].cast("binary").alias("line"),
    )
    start = F.regexp_extract(F.col("line").cast("string"), r'"start":(\d+)', 1)
    return _unpacked(found).select("file_name", "attempt", "shift", start.cast("bigint").alias("startMs"))


def parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(parse_profiles(profile_lines(spark, sf_dir))).select(
        *ID,
        "userId",
        "queryStartMs",
        "queryText",
        F.size(F.array_compact("stateStarts")).cast("bigint").alias("states"),
        F.size("nodeProfile").cast("bigint").alias("nodes"),
    )


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh profile damaged in one of three ways, the others left whole."""
    k = F.regexp_extract("file_name", r"q(\d+)\.", 1).cast("bigint") + F.col("attempt")
    line = F.col("line")
    damaged = (
        F.when(k % 7 != 0, line)
        .when(k % 3 == 0, F.regexp_replace(line, r'"user":"[^"]*",', ""))
        .when(k % 3 == 1, F.regexp_replace(line, r'"stateList":\[[^\]]*\]', '"stateList":null'))
        .otherwise(F.substring(line, F.lit(1), F.length(line) - 5))
    )
    bad = quarantined(parse_profiles(profile_lines(spark, sf_dir).withColumn("line", damaged)))
    return bad.select("file_name", "attempt", "problem")


def query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_id = query_id_from_file(F.col("file_name")).alias("queryId")
    return profile_lines(spark, sf_dir).groupBy(query_id).agg(F.count("*").alias("n"))


#: What is added up to compare the content of a stored table.
_CONTENT = {
    "queries": "queryStartMs % 3600000 + totalFragments",
    "query_text": "cast(length(chunkText) AS bigint) * (chunkNum + 1)",
    "nodes": "maxMemoryUsed + endpointFabricPort",
    "ticks": "tickMs % 3600000 + stateDurationMs * queryState",
}


#: The total modulo 2^64, as a BIGINT: itself where it fits, and no overflow where it does not.
_WRAPPED_TOTAL = """CAST(pmod(sum(CAST(content AS DECIMAL(20, 0))) + 9223372036854775808, 18446744073709551616)
    - 9223372036854775808 AS BIGINT)"""


def _table_rows(frames: dict[str, DataFrame]) -> DataFrame:
    counts = [
        frames[t]
        .selectExpr(f"'{t}' AS tableName", f"{content} AS content")
        .groupBy("tableName")
        .agg(F.count("*").alias("n"), F.expr(_WRAPPED_TOTAL).alias("content"))
        for t, content in _CONTENT.items()
    ]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_rows(tables(spark, sf_dir))


def replace_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.new_staging_dir(spark)
    ingest_lines(profile_lines(spark, sf_dir), out, replace=True, **SETTINGS)
    return _table_rows(read_tables(spark, out))


def replace_then_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts by ``replace``, the others by a plain run: both stay visible."""
    out = sinks.new_staging_dir(spark)
    lines = profile_lines(spark, sf_dir)
    settings = {"tick_ms": TICK_MS, "chunk_size": CHUNK_SIZE}
    ingest_lines(lines.where("attempt = 0"), out, replace=True, **settings)
    ingest_lines(lines.where("attempt > 0"), out, **settings)
    return _table_rows(read_tables(spark, out))


def _held_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lines for several runs of the job, put together once; each run parses them anew."""
    path = f"{sinks.new_staging_dir(spark)}/lines"
    lines = profile_lines(spark, sf_dir)
    with sinks.releasing_shuffles(spark):
        lines.write.options(**sinks.COMPRESSED).parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def rerun_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch twice: the second run replaces the first."""
    out = sinks.new_staging_dir(spark)
    lines = _held_lines(spark, sf_dir)
    for _ in range(2):
        ingest_lines(lines, out, **SETTINGS)
    return _table_rows(read_tables(spark, out))


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts, then everything: the overlap is stored once."""
    out = sinks.new_staging_dir(spark)
    lines = profile_lines(spark, sf_dir)
    ingest_lines(lines.where("attempt = 0"), out, **SETTINGS)
    ingest_lines(lines, out, skip_existing=True, tick_ms=TICK_MS, chunk_size=CHUNK_SIZE)
    return _stored_headers(spark, out)


def _stored_headers(spark: SparkSession, out: str) -> DataFrame:
    """Every stored query with what the other tables hold of it."""
    t = read_tables(spark, out)
    per_query = [
        t["query_text"].groupBy("qNum").agg(F.sum(F.length("chunkText")).alias("textLength")),
        t["nodes"].groupBy("qNum").agg(F.sum("maxMemoryUsed").alias("memory")),
        t["ticks"].groupBy("qNum").agg(F.count("*").alias("ticks"), F.sum(F.col("tickMs") % 3600000).alias("tickSum")),
    ]
    found = t["queries"].select("qNum", *ID, "userId", "queryStartMs", "finalState")
    for other in per_query:
        found = found.join(other, "qNum", "left")
    return found.drop("qNum")


class BrokenOff(Exception):
    """Raised by a query that ends a run on purpose."""


def broken_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts are stored; runs over all lines that replace them break off after each table.

    What is visible afterwards, and what is visible once such a run ends.
    """
    out = sinks.new_staging_dir(spark)
    lines = _held_lines(spark, sf_dir)
    ingest_lines(lines.where("attempt = 0"), out, **SETTINGS)

    def breaking(at: str):
        def written(table: str) -> None:
            if table == at:
                raise BrokenOff(table)

        return written

    for table in (QUARANTINE, *TABLE_NAMES):
        try:
            ingest_lines(lines, out, replace=True, written=breaking(table), **SETTINGS)
        except BrokenOff:
            pass
    broken = _table_rows(read_tables(spark, out)).select(F.lit("broken off").alias("run"), "*").checkpoint()
    ingest_lines(lines, out, replace=True, **SETTINGS)
    return broken.unionByName(_table_rows(read_tables(spark, out)).select(F.lit("done").alias("run"), "*"))


def same_name_other_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the same names: from another time they are added, from the same time they replace."""
    out = sinks.new_staging_dir(spark)
    k = F.regexp_extract("file_name", r"q(\d+)\.", 1).cast("bigint") + F.col("attempt")
    start = F.regexp_extract("line", r'"start":(\d+)', 1).cast("bigint") % 3600000 - 1700000000000 % 3600000
    name = F.concat(F.lit("profile_n"), (k % 7).cast("string"), F.lit(".json")).alias("file_name")
    lines = profile_lines(spark, sf_dir).select(name, k.alias("attempt"), "line", F.pmod(start, F.lit(3600000)).alias("at"))
    early, late = lines.where("at < 1200000").drop("at"), lines.where("at >= 2400000").drop("at")
    corrected = early.withColumn("line", F.replace("line", F.lit('"user":"u'), F.lit('"user":"w')))
    for batch in (early, late, corrected):
        ingest_lines(batch, out, tick_ms=TICK_MS, chunk_size=CHUNK_SIZE)
    t = read_tables(spark, out)
    ticks = t["ticks"].groupBy("qNum").agg(F.count("*").alias("ticks"))
    return t["queries"].join(ticks, "qNum", "left").select(F.col("attempt").alias("k"), "queryId", "userId", "queryStartMs", "ticks")


def ingest_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(parse_profiles(profile_lines(spark, sf_dir))).agg(*sinks.range_bounds())


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile that the stream has stored; its file name, hence its id, is not a profile's own."""
    out = sinks.new_staging_dir(spark)
    ingest_available(
        spark,
        _profile_files(spark, sf_dir),
        f"{out}/tables",
        f"{out}/progress",
        pattern="*.json.gz",
        max_files_per_trigger=3,
        tick_ms=TICK_MS,
        chunk_size=CHUNK_SIZE,
    )
    return _stored_headers(spark, f"{out}/tables").drop(*ID)


def sorted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored headers, and how many of them start before the one above them in their file."""
    place = Window.partitionBy("file").orderBy("place")
    rows = _queries(spark, sf_dir).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), "queryStartMs"
    )
    early = F.col("queryStartMs") < F.lag("queryStartMs").over(place)
    return rows.withColumn("early", early).agg(F.count_if("early").alias("outOfOrder"), F.count("*").alias("n"))


def ticks_of_an_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state in one hour: the filters reach the files, which are laid out for them."""
    first = 1700000000000 // 3600000 * 3600000
    ticks = tables(spark, sf_dir)["ticks"]
    hour = ticks.where((F.col("queryState") == 3) & (F.col("tickMs") >= first) & (F.col("tickMs") < first + 3600000))
    return hour.groupBy("tickMs").agg(F.count("*").alias("n"), F.sum("stateDurationMs").alias("sumDuration"))


def registered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five views as they are stored beside the tables, registered from there and queried by name."""
    out = ingest_derived(spark, sf_dir)[0]
    save_views(spark, out)
    load_views(spark, out, prefix="derived_")
    return spark.sql(
        """SELECT 'profileTicksNodes' AS viewName, count(*) AS n, sum(tickMs % 3600000 + stateDurationMs) AS content, sum(maxMemMb) AS numbers FROM derived_profileTicksNodes
           UNION ALL SELECT 'profileTickNodeAgg_1', count(*), sum(tickMs % 3600000 + queryCount * fragments), sum(memMb) FROM derived_profileTickNodeAgg_1
           UNION ALL SELECT 'profileTickNodeAgg', count(*), sum(tickMs % 3600000 + nodeCount * maxFragmentsPerNode), sum(maxMemMbPerNode) FROM derived_profileTickNodeAgg
           UNION ALL SELECT 'profileStateTick', count(*), sum(tickMs % 3600000 + CAST(round(stateDurationSec * 1000) AS BIGINT)), CAST(sum(length(queryState)) AS DOUBLE) FROM derived_profileStateTick
           UNION ALL SELECT 'profile_state_tick_agg', count(*), sum(tickMs % 3600000 + totalQueries * sumDuration), CAST(sum(maxDuration - minDuration) AS DOUBLE) FROM derived_profile_state_tick_agg"""
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    ended = t["queries"].groupBy(state_code("finalState").cast("bigint").alias("id")).agg(
        F.count("*").alias("profiles")
    )
    return (
        t["state_names"]
        .join(ended, "id", "left")
        .select("id", "stateName", F.coalesce("profiles", F.lit(0)).alias("profiles"))
    )


# --- projections, filters, scalar functions --------------------------------------------


def query_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(parse_profiles(profile_lines(spark, sf_dir))).select(
        *ID,
        "userId",
        "queryStartMs",
        "commandPoolWait",
        "totalFragments",
        "finishedFragments",
        "planningStartMs",
        "planningEndMs",
        "executionStartMs",
        "queryEndMs",
    )


def scheduling_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(parse_profiles(profile_lines(spark, sf_dir))).select(
        *ID,
        "resourceSchedulingStartMs",
        "resourceSchedulingEndMs",
        "queueName",
        "ruleName",
        "queryCost",
        "queryType",
    )


def query_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = usable(parse_profiles(profile_lines(spark, sf_dir)))
    return profiles.select(*ID, "queryCost")


def _column(*columns: str) -> Query:
    return lambda spark, sf_dir: _queries(spark, sf_dir).select(*ID, *columns)


def first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = scalars.first_chunk(F.col("queryText"), CHUNK_SIZE)
    return _staged(spark, sf_dir).select(*ID, chunk.alias("queryTextFirstChunk"))


def tick_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = scalars.tick_floor(F.col("queryStartMs"), TICK_MS)
    return _queries(spark, sf_dir).select(*ID, start.alias("startTick"))


def tick_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select(
        *ID, scalars.tick_timestamp(F.col("queryStartMs")).alias("startTs")
    )


def running_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir, views.running_ticks(tables(spark, sf_dir)["ticks"]))


def max_mem_mb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteenths of a megabyte, so that the rounding has something to do."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    memory = scalars.memory_mb(F.col("l_partkey") * 65536)
    return items.select("l_orderkey", "l_linenumber", memory.alias("maxMemMb"))


def node_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = scalars.node_id(F.col("endpointAddress"), F.col("endpointFabricPort"))
    return tables(spark, sf_dir)["nodes"].groupBy(node.alias("nodeId")).agg(F.count("*").alias("n"))


def _labels(spaced: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        label = scalars.state_label(F.col("queryState"), F.col("stateName"), spaced=spaced)
        rows = views.named_ticks(tables(spark, sf_dir), [])
        return rows.groupBy(label.alias("queryState")).agg(F.count("*").alias("n"))

    return query


def state_duration_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = scalars.duration_seconds(F.col("stateDurationMs"))
    return header_phases(_queries(spark, sf_dir), ID).select(
        *ID, F.col("queryState").alias("state"), seconds.alias("stateDurationSec")
    )


# --- nested data -----------------------------------------------------------------------


def nodes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir, tables(spark, sf_dir)["nodes"])


#: A chunk has up to a thousand characters, and tasks sort them.
CHUNKS_PER_TASK = 250_000


def _spread_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunks by query, in partitions that become more and not larger."""
    chunks = tables(spark, sf_dir)["query_text"]
    return chunks.repartition(max(shuffle_partitions(chunks), -(-chunks.count() // CHUNKS_PER_TASK)), "qNum")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir, _spread_chunks(spark, sf_dir))


def text_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir, rebuild_text(_spread_chunks(spark, sf_dir)))


def phase_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_phases(_queries(spark, sf_dir), ID).select(
        *ID,
        F.col("queryState").alias("state"),
        F.col("phaseStartMs").alias("startMs"),
        F.col("phaseEndMs").alias("endMs"),
        F.col("stateDurationMs").alias("durationMs"),
    )


def ticks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir, tables(spark, sf_dir)["ticks"])


def query_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = numbering.number_profiles(_staged(spark, sf_dir).select(*ID))
    return numbered.agg(
        F.min("qNum").alias("firstNumber"),
        F.max("qNum").alias("lastNumber"),
        F.count_distinct("qNum").alias("numbers"),
    )


def ingest_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that the job has stored."""
    return _queries(spark, sf_dir).agg(
        F.min("qNum").alias("firstNumber"),
        F.max("qNum").alias("lastNumber"),
        F.count_distinct("qNum").alias("numbers"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _queries(spark, sf_dir)
        .groupBy("queryId")
        .agg(F.count("*").alias("attempts"), F.max("attempt").alias("lastAttempt"))
    )


# --- joins and aggregations ------------------------------------------------------------


def left_join_missing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension without one of the states: its ticks stay, their label is NULL."""
    t = tables(spark, sf_dir)
    partial = t | {"state_names": t["state_names"].where("id <> 6")}
    label = scalars.state_label(F.col("queryState"), F.col("stateName"), spaced=False)
    return (
        views.named_ticks(partial, [])
        .groupBy("tickMs", F.col("queryState").alias("code"), label.alias("queryState"))
        .agg(F.count("*").alias("n"))
    )


def per_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_per_state(tables(spark, sf_dir)["ticks"])


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(_staged(spark, sf_dir), tables(spark, sf_dir)["ticks"], TICK_MS)


# --- views -----------------------------------------------------------------------------


def _view(name: str) -> Query:
    return lambda spark, sf_dir: getattr(views, name)(tables(spark, sf_dir)).drop("qNum")


def _late_view(name: str) -> Query:
    return lambda spark, sf_dir: getattr(late_views, name)(tables(spark, sf_dir), TICK_MS).drop("qNum")


def _eager_view(name: str) -> Query:
    return lambda spark, sf_dir: getattr(views, name)(tables(spark, sf_dir), eager=True)


VIEWS = ("ticks_nodes", "tick_node_agg_1", "tick_node_agg", "state_tick", "state_tick_agg")


def queries() -> dict[str, Query]:
    return {
        "scan_profiles": scan_profiles,
        "split_file_lines": split_file_lines,
        "parse_profiles": parse,
        "quarantine": quarantine,
        "query_id_from_file": query_ids,
        "write_tables": write_tables,
        "replace_tables": replace_tables,
        "replace_then_append": replace_then_append,
        "rerun_tables": rerun_tables,
        "skip_existing": skip_existing,
        "broken_rerun": broken_rerun,
        "same_name_other_content": same_name_other_content,
        "ingest_range": ingest_range,
        "ingest_stream": ingest_stream,
        "sorted_headers": sorted_headers,
        "ticks_of_an_hour": ticks_of_an_hour,
        "register_views": registered_views,
        "state_names": states,
        "query_header": query_header,
        "scheduling_group": scheduling_group,
        "query_cost": query_cost,
        "query_text_first_chunk": first_chunk,
        "query_chunk_count": _column("nrQueryChunks"),
        "tick_floor": tick_floor,
        "final_state": _column("finalState"),
        "tick_timestamp": tick_timestamp,
        "running_ticks": running_ticks,
        "max_mem_mb": max_mem_mb,
        "node_id": node_id,
        "state_label_spaced": _labels(True),
        "state_label_raw": _labels(False),
        "state_duration_sec": state_duration_sec,
        "nodes_table": nodes_table,
        "query_text_chunks": text_chunks,
        "query_text_rebuild": text_rebuild,
        "state_pivot": _column(*STATE_START_COLUMNS),
        "phase_durations": phase_durations,
        "ticks_table": ticks_table,
        "query_numbers": query_numbers,
        "ingest_numbers": ingest_numbers,
        "attempts": attempts,
        "left_join_missing_state": left_join_missing_state,
        "ticks_per_state": per_state,
        "reconcile": reconciled,
        **{f"view_{name}": _view(name) for name in VIEWS},
        **{f"eager_view_{name}": _eager_view(name) for name in VIEWS[1:3]},
        **{f"late_view_{name}": _late_view(name) for name in VIEWS},
        "range_view_state_tick_agg": _late_view("state_block_agg"),
    }
