"""The pipeline on planted cases, and its stages on awkward tables."""

import random

import corpus_pipeline
import pytest

from tickloom.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, copies, a benchmark passage, junk and personal data."""
    folder = tmp_path_factory.mktemp("sf")
    prose = lambda i: " ".join(f"w{random.Random(100 * i + j).randrange(9973)}x" for j in range(80)) + "."
    item = " ".join(f"q{j}" for j in range(15))
    rows = [(i, prose(i)) for i in range(300)]
    rows += [(400, prose(5)), (401, prose(6).replace("w", "W")), (402, prose(7) + " " + item), (403, prose(8) + " own words here for a.b@c.example.com")]
    rows += [(500 + i, prose(900 + i).upper().replace(" ", "!! ")) for i in range(60)]
    rows += [(600, None), (601, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows if i < 600], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run(spark, corpus):
    got = corpus_pipeline.run(spark, corpus).collect()
    ids = {r.doc_id for r in got}
    assert not ids & ({400, 401, 402} | set(range(500, 560)))
    assert all(0 < r.mix_words and r.mix_copy in (0, 1) for r in got)
    assert not any("a.b@c" in r.text for r in got)


def test_stages_keep_columns_and_clean_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    clean = set(range(300))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns
        assert clean <= {r.doc_id for r in out.select("doc_id").collect()}
        assert stage(spark, docs.where("false"), corpus).collect() == []


def test_near_copy_stage_keeps_one_of_repeated_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 10")
    out = corpus_pipeline.one_of_each(spark, docs.union(docs), corpus)
    assert sorted(r.doc_id for r in out.collect()) == list(range(10))


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
