"""``spark-submit`` entry: ``python -m tickloom INPUT OUTPUT [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tickloom.model import DEFAULT_CHUNK_SIZE, DEFAULT_TICK_MS
from tickloom.plans.ingest import ingest
from tickloom.streaming.incremental import ingest_available


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tickloom", description=__doc__)
    parser.add_argument("input_dir")
    parser.add_argument("output_dir")
    parser.add_argument("--tick-ms", type=int, default=DEFAULT_TICK_MS)
    parser.add_argument("--chunk-size", type=int, default=DEFAULT_CHUNK_SIZE)
    parser.add_argument("--strict", action="store_true", help="fail on the first unusable line")
    parser.add_argument("--replace", action="store_true", help="overwrite the tables as a whole")
    parser.add_argument("--skip-existing", action="store_true", help="leave out stored profiles")
    parser.add_argument("--checkpoint", help="take only new files, remembered in this folder")
    args = parser.parse_args(argv)
    if args.checkpoint and args.replace:
        parser.error("--replace does not go with --checkpoint")

    spark = SparkSession.builder.appName("tickloom").getOrCreate()
    options = {
        "tick_ms": args.tick_ms,
        "chunk_size": args.chunk_size,
        "strict": args.strict,
        "skip_existing": args.skip_existing,
    }
    if args.checkpoint:
        ingest_available(spark, args.input_dir, args.output_dir, args.checkpoint, **options)
    else:
        print(ingest(spark, args.input_dir, args.output_dir, replace=args.replace, **options))


if __name__ == "__main__":
    main()
