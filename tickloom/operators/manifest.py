"""What of an output folder is visible: a small file that names the live partitions.

A run writes its partitions under a name of its own, where nobody looks.  Renaming one file into
``_manifest`` then makes all of them visible, and all that they replace invisible, in one step: a
reader sees the tables as they were or as they are, whenever a run breaks off.  Versions are
numbered; a rename onto a number that exists fails, and the change is worked out again on top of
what another run has published meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tickloom.model import TABLE_NAMES
from tickloom.operators.sinks import children, file_system, read_text, remove, write_text

FOLDER = "_manifest"
QUARANTINE = "quarantine"
#: Readers may still be at one of the versions before the last.
KEPT_VERSIONS = 10
_DIGITS = 12
_ATTEMPTS = 50


@dataclass(frozen=True)
class Batch:
    """One run's partition of every table in ``tables``."""

    partition: str
    files: str
    """Digest of the file names, and the tag."""
    first_start: int = 0
    last_start: int = 0
    profiles: int = 0
    base: int | None = None
    """Numbers above it, as many as ``rows``, are the run's; unknown in a store without manifest."""
    rows: int = 0
    tick_ms: int = 0
    nodes: int = 0
    ticks: dict[str, int] = field(default_factory=dict)
    tables: tuple[str, ...] = (*TABLE_NAMES, QUARANTINE)

    def same_batch(self, files: str, first_start: int, last_start: int) -> bool:
        """Whether a run over ``files`` with this range is another reading of the same batch.

        Files of the same names whose queries started in another time are other files; a batch
        without any usable profile has no time yet.
        """
        overlaps = self.first_start <= last_start and first_start <= self.last_start
        return self.files == files and (overlaps or not self.profiles)


@dataclass(frozen=True)
class Manifest:
    version: int
    batches: tuple[Batch, ...]

    def partitions(self, table: str) -> list[str]:
        return [b.partition for b in self.batches if table in b.tables]

    @property
    def last_number(self) -> int | None:
        """The highest number in use, or None if a batch does not say."""
        if any(b.base is None for b in self.batches):
            return None
        return max((b.base + b.rows for b in self.batches), default=0)


def _path(output_dir: str, version: int) -> str:
    return f"{output_dir}/{FOLDER}/{version:0{_DIGITS}}.json"


def _versions(spark: SparkSession, output_dir: str) -> list[int]:
    names = children(spark, f"{output_dir}/{FOLDER}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def read_manifest(spark: SparkSession, output_dir: str) -> Manifest:
    """The last version; version 0 of a folder without manifest lists every partition there is."""
    versions = _versions(spark, output_dir)
    if not versions:
        found = [n.partition("=")[2] for n in children(spark, f"{output_dir}/queries") if n.startswith("ingest_range=")]
        return Manifest(0, tuple(_unlisted(n) for n in sorted(found)))
    text = read_text(spark, _path(output_dir, versions[-1]))
    batches = (Batch(**(b | {"tables": tuple(b["tables"])})) for b in json.loads(text)["batches"])
    return Manifest(versions[-1], tuple(batches))


def _unlisted(name: str) -> Batch:
    """A partition written before there were manifests, as far as its name tells."""
    first, last, files = (*name.split("_", 2), "", "")[:3]
    return Batch(name, files, int(first or 0), int(last or 0), profiles=1, tables=TABLE_NAMES)


def _published(spark: SparkSession, output_dir: str, manifest: Manifest) -> bool:
    """Whether this version could be put in place; False if it exists."""
    jvm, final = spark._jvm, _path(output_dir, manifest.version)
    draft = f"{output_dir}/{FOLDER}/.{uuid.uuid4().hex}"
    write_text(spark, draft, json.dumps({"batches": [asdict(b) for b in manifest.batches]}))
    (draft, fs), (final, _) = file_system(spark, draft), file_system(spark, final)
    # This kind of rename never replaces what is there.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), no_options)
    except Py4JJavaError:
        fs.delete(draft, False)
        if fs.exists(final):
            return False
        raise
    return True


def open_manifest(spark: SparkSession, output_dir: str) -> Manifest:
    """The last version, after writing one where there is none: nothing is found by listing from then on."""
    manifest = read_manifest(spark, output_dir)
    if not manifest.version:
        _published(spark, output_dir, Manifest(1, manifest.batches))
        manifest = read_manifest(spark, output_dir)
    return manifest


def publish(
    spark: SparkSession, output_dir: str, change: Callable[[tuple[Batch, ...]], tuple[Batch, ...]]
) -> tuple[Manifest, Manifest]:
    """Apply ``change`` to the batches in one step; returns the versions before and after."""
    for _ in range(_ATTEMPTS):
        before = read_manifest(spark, output_dir)
        after = Manifest(before.version + 1, change(before.batches))
        if _published(spark, output_dir, after):
            for old in _versions(spark, output_dir)[:-KEPT_VERSIONS]:
                remove(spark, _path(output_dir, old))
            return before, after
    raise RuntimeError(f"other runs keep publishing to {output_dir}")


def remove_unlisted(spark: SparkSession, output_dir: str, files: str | None, gone: set[str] = frozenset()) -> list[str]:
    """Remove partitions that no version shows: those ``gone``, and leftovers of a batch that broke off.

    ``files`` names the batch; with None every partition that is not listed goes, which is only
    safe while no run is under way.
    """
    live = read_manifest(spark, output_dir)
    removed = []
    for table in (*TABLE_NAMES, QUARANTINE):
        listed = set(live.partitions(table))
        for child in children(spark, f"{output_dir}/{table}"):
            name = child.partition("=")[2]
            # The last part of a name is the run's own.
            mine = files is None or name.rpartition("_")[0].endswith(f"_{files}")
            if name and name not in listed and (mine or name in gone):
                remove(spark, f"{output_dir}/{table}/{child}")
                removed.append(f"{table}/{name}")
    return removed
