"""Quality of risk scores against observed labels.

Rows are counted per different score first, so ties are exact and a score shared by many
customers is one row. Ranks come from distributed running totals over those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions import (
    as_double,
    edge_bin,
    n_rows,
    quantile_edges,
    ratio,
    round_even,
    running_totals,
    side_by_side,
)


def score_histogram(
    df: DataFrame, score: str = "score", label: str = "lapsed", by: Sequence[str] = ()
) -> DataFrame:
    """Per different score: rows with label 1 (``pos``) and label 0 (``neg``)."""
    return df.groupBy(*by, as_double(score).alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
    )


def classification_metrics(
    df: DataFrame,
    score: str = "score",
    label: str = "lapsed",
    by: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """ROC-AUC, average precision and Brier score, per group of ``by``.

    ROC-AUC gives half credit to ties. Average precision sums precision times the gain
    in recall over the different scores, from the highest down. Both are NULL when only
    one label occurs.
    """
    by = list(by)
    counts = running_totals(score_histogram(df, score, label, by), [*by, "score"], ["pos", "neg"])
    pos, neg, s = F.col("pos"), F.col("neg"), F.col("score")
    neg_below = F.col("cum_neg") - neg
    wide = lambda column: column.cast("decimal(20,0)")

    # Groups lie one after another in the order, so what precedes a group is its smallest
    # running total; subtracting it leaves totals within the group.
    groups = counts.groupBy(*by).agg(
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
        F.min(F.col("cum_pos") - pos).alias("_pos_start"),
        F.min(neg_below).alias("_neg_start"),
        F.sum(wide(pos) * wide(2 * neg_below + neg)).alias("_pairs"),
        F.sum(pos * F.pow(s - 1.0, F.lit(2.0)) + neg * F.pow(s, F.lit(2.0))).alias("_squares"),
    )
    n_pos, n_neg = F.col("_pos"), F.col("_neg")
    before_group = 2 * wide(F.col("_neg_start")) * wide(n_pos)
    groups = groups.select(
        *by,
        (n_pos + n_neg).alias("n"),
        n_pos.alias("n_pos"),
        ratio(F.col("_pairs") - before_group, 2 * wide(n_pos) * wide(n_neg)).alias("roc_auc"),
        ratio("_squares", n_pos + n_neg).alias("brier"),
        "_pos",
        "_neg",
        "_pos_start",
        "_neg_start",
    )
    if by:
        # One row per group, and groups are the few models or features being compared.
        joined = counts.join(F.broadcast(groups), by)
    else:
        # Without groups the overall totals are already on every row.
        joined = counts.withColumns(
            {
                "_pos": F.col("total_pos"),
                "_neg": F.col("total_neg"),
                "_pos_start": F.lit(0),
                "_neg_start": F.lit(0),
            }
        )
    found = F.col("_pos") - (F.col("cum_pos") - pos - F.col("_pos_start"))
    raised = F.col("_neg") - (F.col("cum_neg") - neg - F.col("_neg_start"))
    step = ratio(pos, "_pos") * ratio(found, found + raised)
    precision = joined.groupBy(*by).agg(F.sum(step).alias("pr_auc"))
    groups = groups.select(*by, "n", "n_pos", "roc_auc", "brier")
    if by:
        both = groups.join(precision, by)
    else:
        both = side_by_side(groups, precision)
    return both.select(
        *by,
        "n",
        "n_pos",
        round_even("roc_auc", digits).alias("roc_auc"),
        round_even("pr_auc", digits).alias("pr_auc"),
        round_even("brier", digits).alias("brier"),
    )


def metric_roc_auc(df: DataFrame, score: str = "score", label: str = "lapsed") -> DataFrame:
    return classification_metrics(df, score, label).select("roc_auc")


def metric_avg_precision(df: DataFrame, score: str = "score", label: str = "lapsed") -> DataFrame:
    return classification_metrics(df, score, label).select("pr_auc")


def metric_brier(df: DataFrame, score: str = "score", label: str = "lapsed") -> DataFrame:
    """Mean squared difference between score and label; needs no order, so no ranks."""
    difference = F.pow(as_double(score) - as_double(label), F.lit(2.0))
    return df.agg(F.avg(difference).alias("brier"))


def risk_deciles(
    df: DataFrame, score: str, output: str = "risk_decile", bins: int = 10, bounded: bool = False
) -> DataFrame:
    """Add quantile bins of the score, numbered from 1 = highest risk.

    ``df`` should be stored or materialised: it is read for the edges and again for the
    result. Equal edges are merged, so there can be fewer bins.
    """
    edges = quantile_edges(df, score, bins, bounded)
    return df.withColumn(output, F.lit(len(edges)).cast("bigint") - edge_bin(score, edges))


def lift_by_decile(
    df: DataFrame, score: str = "score", label: str = "lapsed", digits: int | None = 1,
    bounded: bool = False,
) -> DataFrame:
    """Per risk decile: size, lapses, mean score, lapse rate, capture, running capture and lift.

    Running capture and lift build on the rounded columns; ``digits=None`` rounds nothing.
    """
    binned = risk_deciles(df, score, "decile", 10, bounded)
    sums = binned.groupBy("decile").agg(
        F.count(label).alias("n_customers"),
        F.sum(F.col(label).cast("bigint")).alias("n_lapsed"),
        F.sum(as_double(score)).alias("_scores"),
    )
    overall = W.partitionBy()  # one row per decile
    all_lapsed, everyone = F.sum("n_lapsed").over(overall), F.sum("n_customers").over(overall)
    rates = sums.select(
        "decile",
        "n_customers",
        "n_lapsed",
        ratio("_scores", "n_customers").alias("avg_prob"),
        round_even(ratio("n_lapsed", "n_customers") * 100.0, digits).alias("lapse_rate_pct"),
        round_even(ratio("n_lapsed", all_lapsed) * 100.0, digits).alias("capture_pct"),
        (ratio(all_lapsed, everyone) * 100.0).alias("_base"),
    )
    so_far = W.orderBy("decile").rowsBetween(W.unboundedPreceding, 0)
    lift_digits = None if digits is None else digits + 1
    return rates.select(
        "decile",
        "n_customers",
        "n_lapsed",
        "avg_prob",
        "lapse_rate_pct",
        "capture_pct",
        round_even(F.sum("capture_pct").over(so_far), digits).alias("cum_capture_pct"),
        round_even(ratio("lapse_rate_pct", "_base"), lift_digits).alias("lift"),
    )


def top_capture(lift: DataFrame, k: Sequence[int] = (1, 3), digits: int | None = 1) -> DataFrame:
    """Share of all lapses in the ``k`` riskiest deciles, one column per ``k``."""
    shares = [
        round_even(F.sum(F.when(F.col("decile") <= top, F.col("capture_pct"))), digits).alias(
            f"top_{top}_capture_pct"
        )
        for top in k
    ]
    return lift.agg(*shares)


def calibration_bins(
    df: DataFrame, score: str = "score", label: str = "lapsed", bins: int = 10
) -> DataFrame:
    """Observed rate and mean score in equal-width bins of [0, 1]; empty bins are left out.

    A score on an edge belongs to the lower bin.
    """
    value = as_double(score)
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    number: Column = F.lit(1)
    for edge in edges:
        number = number + F.when(value > edge, 1).otherwise(0)
    grouped = df.groupBy(number.cast("bigint").alias("bin")).agg(
        n_rows().alias("n"),
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.sum(value).alias("_scores"),
    )
    return grouped.select(
        "bin",
        "n",
        ratio("_pos", "n").alias("observed_rate"),
        ratio("_scores", "n").alias("mean_score"),
    )
