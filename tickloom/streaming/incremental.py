"""Ingest of the files that arrived since the last run.

The stream only finds new files, by name and length; what is in them is read by the batch job,
which gets the names of a micro-batch.  A batch's partition carries the batch id, so one that is
repeated after a failure replaces its own rows and two batches never replace each other's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickloom.plans.ingest import ingest_lines
from tickloom.sources.profile_files import FILE_PATTERN, WHOLE_FILE_LIMIT, new_files, read_listed


def ingest_available(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    checkpoint_dir: str,
    *,
    max_files_per_trigger: int | None = None,
    pattern: str = FILE_PATTERN,
    whole_file_limit: int = WHOLE_FILE_LIMIT,
    **options,
) -> StreamingQuery:
    """Ingest every new file below ``input_dir``, then stop; options as in `ingest_lines`."""
    if options.get("replace"):
        raise ValueError("a stream cannot replace: each batch would erase the one before")
    stream_options = {}
    if max_files_per_trigger is not None:
        stream_options["maxFilesPerTrigger"] = str(max_files_per_trigger)
    found = new_files(spark, input_dir, pattern=pattern, stream_options=stream_options)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # Names and lengths only, as the stream itself holds them on the driver.  Where a name has
        # a pattern's characters, Spark lists other files of its batch twice.
        files = sorted({(r["path"], r["length"]) for r in batch.collect()})
        lines = read_listed(spark, files, whole_file_limit=whole_file_limit)
        ingest_lines(lines, output_dir, tag=f"b{batch_id}", **options)

    query = (
        found.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
