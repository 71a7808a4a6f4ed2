"""Judge URLs by rules and, where no rule fits, by boosted trees on lexical features.

The rules label the URLs they fit; the trees are trained on those labels and judge the rest.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.native import LOWER, UPPER, ascii_lower, stored

#: (host, path start, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The trees are fitted on so many labelled URLs at most, those with the smallest hashes.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, SMOOTHING = 20, 4, 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio",
    "host_digit_ratio", "hyphens", "host_entropy", "path_entropy", "n_params", "query_length",
    "has_fragment", "is_https", "longest_label", "suffix_rate", "suffix_log_rows", "segment_rate",
    "segment_log_rows", "extension_length",
)


def host_and_path(url: Column) -> dict[str, Column]:
    """The host in lower case and the path; both empty without ``://`` or for null."""
    found = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return {
        "host": ascii_lower(F.regexp_extract(found, pattern, 1)),
        "path": F.regexp_extract(found, pattern, 2),
    }


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        name = F.when(fits, F.lit(rule_host + start)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    total = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    shares = F.transform(
        F.filter(chars, lambda c: c != ""), lambda c: (total - F.length(F.replace(text, c, F.lit("")))) / total
    )
    return F.when(total > 0, -F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(0.0)


def _letters_away(text: Column, pattern: str) -> Column:
    """The number of characters of ``text`` that ``pattern`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(pages: DataFrame) -> DataFrame:
    """Add the features that a URL shows by itself to ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    host, path = F.col("host"), F.col("path")
    ratio = lambda part, whole: F.when(F.length(whole) > 0, part / F.length(whole)).otherwise(0.0)
    return pages.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "host_labels": F.size(F.split(host, "\\.")),
            "path_depth": _letters_away(path, "/"),
            "digit_ratio": ratio(_letters_away(url, "[0-9]"), url),
            "host_digit_ratio": ratio(_letters_away(host, "[0-9]"), host),
            "hyphens": _letters_away(host, "-"),
            "host_entropy": _entropy(host),
            "path_entropy": _entropy(path),
            "n_params": F.when(query == "", 0).otherwise(_letters_away(query, "&") + 1),
            "query_length": F.length(query),
            "has_fragment": F.when(url.contains("#"), 1.0).otherwise(0.0),
            "is_https": F.when(F.translate(F.substring(url, 1, 8), UPPER, LOWER) == "https://", 1.0).otherwise(0.0),
            "longest_label": F.array_max(F.transform(F.split(host, "\\."), lambda s: F.length(s))),
            "extension_length": F.length(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1)),
            "suffix": F.substring_index(host, ".", -1),
            "segment": F.split_part(F.concat(path, F.lit("//")), F.lit("/"), F.lit(2)),
        }
    )


def _statistics(labelled: DataFrame, key: str) -> DataFrame:
    """Per value of ``key``: its smoothed rate of blocked labels and the log of its rows."""
    n, blocked = F.count(F.lit(1)), F.sum("label")
    return labelled.groupBy(key).agg(
        ((blocked + SMOOTHING / 2) / (n + SMOOTHING)).alias(f"{key}_rate"), F.log1p(n).alias(f"{key}_log_rows")
    )


def _with_statistics(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    for key, stats in tables.items():
        rows = rows.join(stats, key, "left")
    return rows.fillna({f"{key}_rate": 0.5 for key in tables} | {f"{key}_log_rows": 0.0 for key in tables})


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules=RULES,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, block_score.

    ``labelled`` has ``url`` and ``label`` (1: block); without it, the URLs that rules fit are
    the labelled ones. Rows without a rule are blocked if ``block_score`` is 0.5 or more; null
    and odd URLs have empty hosts and paths and are judged like the others. If the labels are
    all alike, that label's share is everyone's score; without labels every score is 0. Repeated
    rows stay. Empty tables give an empty result; other columns are ignored.
    """
    plain = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    parsed = plain.withColumns(host_and_path(F.col("url")))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = stored(lexical(parsed.withColumns({"rule": name, "says": says})), "urls")
    if labelled is None:
        known = ruled.where("says is not null").withColumn("label", F.when(F.col("says") == "block", 1.0).otherwise(0.0))
    else:
        own = labelled.where("label is not null").select("url", F.col("label").cast("double").alias("label"))
        known = lexical(own.withColumns(host_and_path(F.col("url"))))
    # Different last labels of hosts and first segments of paths.
    tables = {key: stored(_statistics(known, key), "stats") for key in ("suffix", "segment")}
    sample = known.orderBy(F.xxhash64("url"), "url").limit(MAX_TRAINING_ROWS)
    training = stored(_with_statistics(sample.select("url", "label", "suffix", "segment", *(c for c in FEATURES if c in sample.columns)), tables), "training")
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    ready = _with_statistics(ruled, tables)
    shares = training.agg(F.avg("label").alias("share")).first()["share"]
    if shares is None or shares in (0.0, 1.0):
        scored = ready.withColumn("block_score", F.lit(float(shares or 0.0)))
    else:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7, featuresCol="features", labelCol="label")
        model = trees.fit(vector.transform(training).select("features", "label").repartition(2))
        vectors = vector.transform(ready).select("id", "host", "path", "rule", "says", "features")
        scored = model.transform(vectors).withColumn("block_score", vector_to_array("probability")[1])
    own_verdict = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("says", own_verdict).alias("verdict"), "block_score"
    )
