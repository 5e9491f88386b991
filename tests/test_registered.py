"""Every registered query against its DuckDB answer, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from checks import oracles, queries
from checks.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_answer():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query(spark, duck, name):
    assert differences(spark, duck, name, SF_DIR) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_runs_break_off_after_each_table(spark, monkeypatch):
    """`broken_rerun` breaks a run off after every table that the job writes, then lets one end."""
    made = []

    def run(lines, out, written=None, **options):
        made.append([])
        for table in ("quarantine", "query_text", "nodes", "ticks", "queries"):
            made[-1].append(table)
            if written is not None:
                written(table)

    frame = spark.createDataFrame([("t", 0)], "tableName STRING, attempt INT")
    monkeypatch.setattr(queries, "ingest_lines", run)
    monkeypatch.setattr(queries, "read_tables", lambda *a: {})
    monkeypatch.setattr(queries, "_table_rows", lambda frames: frame)
    monkeypatch.setattr(queries, "profile_lines", lambda *a: frame)
    assert queries.broken_rerun(spark, SF_DIR).count() == 2
    assert {tables[-1] for tables in made[1:-1]} == {"quarantine", "query_text", "nodes", "ticks", "queries"}
    assert sorted(map(len, made[1:-1])) == [1, 2, 3, 4, 5] and len(made[0]) == len(made[-1]) == 5
