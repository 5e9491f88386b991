"""Training text from raw documents: five stages, each over what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, mixing, near_copies, pii, quality
from tickloom.llm.staging import new_path, staged, temporary
from tickloom.operators.sinks import remove

#: Documents that score below are rejected.
THRESHOLD = 0.3
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Session setting with the secret of the pseudonyms, and what stands in for it.
SECRET, NO_SECRET = "spark.tickloom.pseudonym.key", "tickloom"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; empty texts share one score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs, labels).where(F.col("score") >= THRESHOLD).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; repeated rows once."""
    decided = near_copies.near_copies(docs, SHINGLE_WORDS, SIMILARITY)
    decided = staged(decided.groupBy("doc_id").agg(F.min("kept").alias("keep"), F.count("*").alias("times")).where("not keep or times > 1"), "decided")
    same = lambda part: F.col("doc_id").eqNullSafe(part["other"])
    listed = decided.withColumnRenamed("doc_id", "other")
    once = docs.join(listed, same(listed), "left_anti")
    repeated = listed.where("keep and times > 1")
    return once.unionByName(docs.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    hits = decontamination.benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.where(F.col("n_hit") == 0).select("row.*")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; ``n_chars`` follows the text, null texts stay null."""
    done = pii.pseudonymise(docs, spark.conf.get(SECRET, NO_SECRET).encode())
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.col("row.n_chars"))}
    return done.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes, sorted by its time in the run.

    Adds ``mix_copy``, ``mix_position`` and ``mix_words``.
    """
    ordered = mixing.training_order(mixing.curriculum(docs, docs.columns))
    added = {"copy": "mix_copy", "position": "mix_position", "taken": "mix_words"}
    return ordered.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in added.values()), *(F.col(a).alias(b) for a, b in added.items()))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each),
    ("benchmark", decontaminated),
    ("pii", without_pii),
    ("mixing", in_training_order),
]

#: The classifier is fitted and the near copies are closed over links; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again.

    What a stage wrote for itself goes with its end, and its input once its result is written.
    """
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with temporary(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if done:
            remove(spark, done)
        done = path
    return STAGES[-1][1](spark, docs, sf_dir)
