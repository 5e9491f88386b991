"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    decontamination,
    main_text,
    mixing,
    near_copies,
    neighbours,
    periodicity,
    pii,
    quality,
    resampling,
    substrings,
    topk,
    urls,
    warc,
)

#: Fixed by the contract.
THRESHOLD = 0.3
RULES = [
    urls.Rule("net/", "block"),
    urls.Rule("example.net/en/", "allow"),
    urls.Rule("example.com/de/", "block"),
    urls.Rule("org/fr/", "allow"),
]
#: The queries show the operator; a real run takes a secret.
QUERY_KEY = b"tickloom"
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a host that label a URL as one to block; the tables hold no labels for URLs.
BAD_HOST_WORDS = ("ads", "bets", "casino", "pills", "spam")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(table(spark, sf_dir, "documents"), ["doc_id"])
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, copy: total + copy["words"])
    return mixed.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"), k=2, percent=80)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op5_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return done.select("row.doc_id", F.size("found").cast("long").alias("n_found"), "text")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    label = F.col("url").rlike(rf"://[^/?#]*\b({'|'.join(BAD_HOST_WORDS)})\b").cast("int")
    return urls.judged(pages, RULES, pages.select("url", label.alias("label")))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = main_text.extract(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "row.doc_id",
        quality.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = resampling.resampled(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return ranked.select("row.doc_id", "n_features", "weight", "score", "rank")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in about a tenth of the texts the words repeat from some word on."""
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    repeated = F.expr(
        "transform(w, (x, i) -> if(i < a, x, w[CAST(a + (i - a) % (1 + (size(w) - a) div (3 + g % 8)) AS INT)]))"
    )
    # The start is a column of its own, worked out once; without words there is none.
    started = split.withColumn("a", F.expr("CASE WHEN size(w) > 0 THEN g % size(w) END"))
    return started.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodicity.collapsed(with_planted_periods(table(spark, sf_dir, "documents")), ["doc_id"])
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark breaks lines in base64.
    text = lambda c: F.replace(F.base64(c), F.lit("\r\n"), F.lit("")).alias(c)
    compared = neighbours.beside_next(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return compared.select(
        "row.doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text("fingerprint"),
        text("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mix,
        op2_decontaminate,
        op3_near_copies,
        op4_warc,
        op5_pseudonymise,
        op6_url_filter,
        op7_repeats,
        op8_main_text,
        op9_top_k,
        op10_quality,
        op11_resample,
        op12_collapse_runs,
        op13_fingerprint,
    )
    return {f.__name__: f for f in found}
