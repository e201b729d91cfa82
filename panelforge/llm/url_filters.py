"""Verdicts on URLs by host and path rules, and by boosted trees where no rule fits.

A rule is a host and a path; it fits the host and its subdomains if the URL's path begins
with the rule's. The longest fitting rule decides. The URLs that a rule decides are the
labelled ones: gradient-boosted trees on lexical features learn from them what blocked URLs
look like and judge the others.

Only DataFrame functions and Spark ML are used. The trees are fitted on at most
``FIT_ROWS`` distinct labelled URLs, of each kind its share and the lowest by a hash of the
URL; statistics of the suffixes are counted on all labelled rows.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged by its features like any other; repeated rows are judged alike; without
labelled URLs of both kinds there is nothing to learn, and what no rule decides is allowed;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.session import materialize

FIT_ROWS = 10_000
TREES = 20
DEPTH = 4
SEED = 7
# Weight of the overall block rate in the rate of a suffix, in URLs.
PRIOR = 20.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
FEATURES = (
    "f_length",
    "f_host_length",
    "f_path_length",
    "f_depth",
    "f_host_labels",
    "f_digit_ratio",
    "f_host_digit_ratio",
    "f_entropy",
    "f_parameters",
    "f_query_length",
    "f_hyphens",
    "f_secure",
    "f_suffix_rate",
    "f_suffix_count",
)
AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, AZ, LOWER_AZ), path


def _fits(rule: Rule) -> Column:
    host, path = F.col("host"), F.col("path")
    own = (host == rule.host) | host.endswith("." + rule.host)
    return own & path.startswith(rule.path)


def decided(rules: Sequence[Rule], value: str) -> Column:
    """``value`` (name or verdict) of the longest rule that fits; null if none does."""
    longest_first = sorted(rules, key=lambda rule: -len(rule.name))
    chosen = F.lit(None).cast("string")
    for rule in reversed(longest_first):
        chosen = F.when(_fits(rule), F.lit(getattr(rule, value))).otherwise(chosen)
    return chosen


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text).cast("double")

    def term(char: Column) -> Column:
        p = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return -p * F.log2(p)

    chars = F.array_distinct(F.split(text, ""))
    chars = F.filter(chars, lambda c: c != "")
    summed = F.aggregate(chars, F.lit(0.0), lambda total, c: total + term(c))
    return F.when(n > 0, summed).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Add the features that need only the URL, and the keys of the suffix statistics."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    rest = _after_scheme(url)
    query = F.regexp_extract(rest, r"(?s)\?([^#]*)", 1)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return urls.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length(host).cast("double"),
            "f_path_length": F.length(path).cast("double"),
            "f_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
            "f_host_labels": F.size(F.split(host, r"\.")).cast("double"),
            "f_digit_ratio": ratio(_digits(url), F.length(url)),
            "f_host_digit_ratio": ratio(_digits(host), F.length(host)),
            "f_entropy": _entropy(url),
            "f_parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
            "f_query_length": F.length(query).cast("double"),
            "f_hyphens": (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double"),
            "f_secure": url.startswith("https://").cast("double"),
            "suffix": F.substring_index(host, ".", -2),
        }
    )


def _rates(labelled: DataFrame, key: str, overall: Column, out: str) -> DataFrame:
    """Per value of ``key``: labelled URLs and their block rate, drawn to the overall one."""
    n, blocked = F.count(F.lit(1)), F.sum("label")
    return labelled.groupBy(key).agg(
        n.cast("double").alias(f"{out}_count"),
        ((blocked + overall * PRIOR) / (n + PRIOR)).alias(f"{out}_rate"),
    )


def _features(urls: DataFrame, labelled: DataFrame) -> tuple[DataFrame, float | None]:
    """URLs with all features, and the block rate of the labelled ones.

    A suffix may be as frequent as it likes: it is counted before the shuffle, and the counts
    join as tables of one row per value.
    """
    kinds = labelled.agg(F.avg("label").alias("rate")).first()
    rate = kinds["rate"]
    if rate is None or rate in (0.0, 1.0):
        return urls, None
    overall = F.lit(rate)
    joined = urls.join(_rates(labelled, "suffix", overall, "f_suffix"), "suffix", "left")
    return (
        joined.fillna({"f_suffix_rate": rate, "f_suffix_count": 0.0}).withColumn(
            "f_suffix_count", F.log1p("f_suffix_count")
        ),
        rate,
    )


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> GBTClassificationModel:
    """Trees from labelled URLs, in one partition so that sums are repeatable.

    Of more than ``rows`` distinct URLs each kind gives its share, but at least one. Repeats
    of a URL have equal labels and features, and are combined before they are shuffled.
    """
    urls = materialize(
        labelled.select("url", "label", "features").dropDuplicates(["url"]), "labelled_urls"
    )
    kinds = {r["label"]: r["count"] for r in urls.groupBy("label").count().collect()}
    total = sum(kinds.values())
    parts = [
        urls.where(F.col("label") == kind)
        .orderBy(F.xxhash64("url"), "url")
        .limit(n if total <= rows else max(1, rows * n // total))
        for kind, n in sorted(kinds.items())
    ]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    chosen = chosen.coalesce(1)
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        maxIter=TREES,
        maxDepth=DEPTH,
        seed=SEED,
    )
    return trees.fit(materialize(chosen.select("features", "label"), "labelled"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")
    ).withColumns({"host": host, "path": path})
    urls = urls.withColumns({"rule": decided(rules, "name"), "given": decided(rules, "verdict")})
    urls = urls.withColumn("label", (F.col("given") == "block").cast("double"))
    urls = materialize(lexical(urls), "urls")
    labelled = urls.where(F.col("label").isNotNull())
    ready, rate = _features(urls, labelled)
    if rate is None:
        judged = urls.withColumn("prediction", F.lit(0.0))
    else:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        ready = assembler.transform(ready)
        model = fit(ready.where(F.col("label").isNotNull()), fit_rows)
        judged = model.transform(ready.select("page_id", "host", "path", "rule", "given", "features"))
    learned = F.when(F.col("prediction") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("given", learned).alias("verdict")
    )
