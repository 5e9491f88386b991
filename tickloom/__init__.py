"""Query-profile analytics on Spark.

JSON profile dumps become four tables (``queries``, ``query_text``, ``nodes``,
``ticks``); five views turn those into time series.  See README.md.
"""

from tickloom.plans.ingest import ingest, ingest_lines
from tickloom.plans.catalog import register_views
from tickloom.sources.profile_files import read_profile_lines
from tickloom.sources.profile_json import parse_profiles
from tickloom.sources.tables import read_tables
from tickloom.streaming.incremental import ingest_available

__all__ = [
    "ingest",
    "ingest_available",
    "ingest_lines",
    "parse_profiles",
    "read_profile_lines",
    "read_tables",
    "register_views",
]
