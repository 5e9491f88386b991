"""URL filtering: prefix rules first, gradient-boosted trees on lexical features for the rest.

Everything is column expressions and the DataFrame-based learner.  The trees are fitted on a
hash-chosen sample of at most about ``TRAINING_URLS`` labelled URLs; every URL is judged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.staging import staged

TRAINING_URLS = 20_000
MAX_RULES = 2_000
TREES, DEPTH = 12, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = [
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "hyphens", "labels", "entropy", "parameters",
    "fragment", "longest_label", "suffix_rate", "suffix_count",
]


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path``; it fits the host and its subdomains below that path."""

    text: str
    verdict: str

    def fits(self) -> Column:
        host, slash, rest = self.text.partition("/")
        own = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        return own & F.startswith("path", F.lit(slash + rest))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both are empty without ``://`` or without a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        text = F.when(rule.fits(), rule.text).otherwise(text)
        verdict = F.when(rule.fits(), rule.verdict).otherwise(verdict)
    return text, verdict


def _count(text: str, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _lexical(df: DataFrame) -> DataFrame:
    """Features of ``url`` and ``host``; nulls count as empty."""
    letters = F.array_distinct(F.split("host", ""))
    n = F.length("host").cast("double")
    counts = F.transform(letters, lambda c: (F.length("host") - F.length(F.replace(F.col("host"), c, F.lit("")))).cast("double"))
    spent = F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    length = F.greatest(F.length("url"), F.lit(1))
    return df.withColumns(
        {
            "url_length": F.length("url").cast("double"),
            "host_length": n,
            "path_length": F.length("path").cast("double"),
            "depth": _count("path", "/").cast("double"),
            "digit_ratio": _count("url", "[0-9]") / length,
            "hyphens": _count("host", "-").cast("double"),
            "labels": (_count("host", "[.]") + 1).cast("double"),
            "entropy": F.when(n > 0, F.log2(n) - spent / n).otherwise(0.0),
            "parameters": F.when(F.contains("url", F.lit("?")), _count("url", "&") + 1).otherwise(0).cast("double"),
            "fragment": F.contains("url", F.lit("#")).cast("double"),
            "longest_label": F.array_max(F.transform(F.split("host", "[.]"), F.length)).cast("double"),
            "suffix": F.regexp_extract("host", r"[^.]*$", 0),
        }
    )


def _urls(df: DataFrame, *more: str) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = parts(url)
    return df.select(*more, url.alias("url"), host.alias("host"), path.alias("path"))


@dataclass(frozen=True)
class Judge:
    """A fitted model and the suffix statistics of its training URLs."""

    suffixes: DataFrame | None
    model: object
    constant: float

    def blocked(self, df: DataFrame) -> DataFrame:
        """``df`` with ``risk``, the chance that a URL should be blocked."""
        if self.model is None:
            return df.withColumn("risk", F.lit(self.constant))
        scored = self.model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_with_suffixes(_lexical(df), self.suffixes)))
        return scored.withColumn("risk", vector_to_array("probability")[1])


def _with_suffixes(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    # One row for each suffix of at most about TRAINING_URLS urls.
    df = df.join(F.broadcast(suffixes), "suffix", "left")
    return df.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(0.5)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))})


def train(labelled: DataFrame) -> Judge:
    """Fit on ``labelled(url, label)``, label 1 for URLs to block; others and nulls are left out."""
    known = labelled.where("label in (0, 1)")
    total, ones = known.agg(F.count("*"), F.sum("label")).first()
    if not total or ones in (0, total):
        return Judge(None, None, float(bool(total and ones)))
    share = int(min(1.0, TRAINING_URLS / total) * (1 << 20))
    sample = _lexical(_urls(known, "label")).where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share)
    rate, count = (F.sum("label") + 1) / (F.count("*") + 2), F.log1p(F.count("*"))
    suffixes = staged(sample.groupBy("suffix").agg(rate.alias("suffix_rate"), count.alias("suffix_count")), "suffixes")
    # Written once: the learner reads its rows many times, the pages only here.
    rows = staged(_with_suffixes(sample, suffixes).select(*FEATURES, F.col("label").cast("double").alias("label")), "urls")
    if rows.agg(F.countDistinct("label")).first()[0] < 2:
        return Judge(None, None, ones / total)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label").coalesce(4)
    return Judge(suffixes, GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1).fit(data), 0.0)


def judged(pages: DataFrame, rules: list[Rule], labelled: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, risk`` for each row of ``pages(page_id, url)``.

    The longest fitting rule decides; without one the trees block what they find likelier bad
    than good.  A null url or one without ``://`` has empty host and path and is judged like any
    other.  Without labels of both kinds every URL gets the share of ones as its risk.  Repeated
    rows get equal verdicts; other columns are not read.
    """
    rule, verdict = ruled(rules)
    out = train(labelled).blocked(_urls(pages, "page_id"))
    method = F.when(F.col("risk") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "risk")
