"""Reading the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.model import TABLE_DDL, TABLE_NAMES, state_names
from tickloom.operators.manifest import Manifest, read_manifest


class StoredTables(dict):
    """The stored tables by name, and the manifest that they were found by."""

    def __init__(self, frames: dict[str, DataFrame], manifest: Manifest):
        super().__init__(frames)
        self.manifest = manifest


def read_table(spark: SparkSession, output_dir: str, name: str, manifest: Manifest | None = None, ddl: str | None = None) -> DataFrame:
    """One stored table, as its manifest shows it.

    The schema is known and the partitions are listed, so no file is opened to find them out.
    """
    manifest = read_manifest(spark, output_dir) if manifest is None else manifest
    ddl = TABLE_DDL[name] if ddl is None else ddl
    paths = [f"{output_dir}/{name}/ingest_range={p}" for p in manifest.partitions(name)]
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def read_tables(spark: SparkSession, output_dir: str) -> StoredTables:
    """The four stored tables, all of one version, plus the ``state_names`` dimension."""
    manifest = read_manifest(spark, output_dir)
    frames = {name: read_table(spark, output_dir, name, manifest) for name in TABLE_NAMES}
    return StoredTables(frames | {"state_names": state_names(spark)}, manifest)
