"""Recency, frequency and monetary value: metrics, scores and segments."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.config import DEFAULT, OTHER_SEGMENT, SEGMENT_RULES, SegmentRule
from stayrate.functions import (
    as_double,
    n_rows,
    quantile_bins,
    rank_quantile_bins,
    ratio,
    share_pct,
)
from stayrate.operators.purchases import purchase_days


def rfm_metrics(txn: DataFrame, ref_date: str | datetime.date | None = None) -> DataFrame:
    """Per customer: days since the last purchase, purchase days and total spend.

    Recency counts back from ``ref_date``, by default the last date in ``txn``. To look
    at customers as of a past date, filter ``txn`` to the days before it.
    """
    if ref_date is None:
        # One value, from a scan of the date column alone.
        ref_date = txn.agg(F.max("t_dat")).first()[0]
    reference = F.lit(ref_date).cast("date")
    return purchase_days(txn).groupBy("customer_id").agg(
        F.datediff(reference, F.max("t_dat")).cast("bigint").alias("recency_days"),
        n_rows().alias("frequency"),
        F.sum("spend").alias("monetary"),
    )


def rfm_scores(metrics: DataFrame, q: int = DEFAULT.n_quantiles) -> DataFrame:
    """Add the quantile scores ``R_q``, ``F_q`` and ``M_q``; the highest is best.

    Recency is cut at its quantiles and inverted. With merged edges there are fewer bins,
    which then take the top of the scale. Frequency and spend are cut by rank, ties in
    the order of ``customer_id``.
    """
    scored = rank_quantile_bins(metrics, "frequency", q, "customer_id", "F_q")
    scored = rank_quantile_bins(scored, "monetary", q, "customer_id", "M_q")
    # Recency is a number of days, so its different values are few.
    scored = quantile_bins(scored, "recency_days", q, "_bin", bounded=True)
    return scored.select(
        *metrics.columns, (q + 1 - F.col("_bin")).alias("R_q"), "F_q", "M_q"
    )


def _segment_column(rules: Sequence[SegmentRule]) -> Column:
    matched = None
    for rule in rules:
        inside = (
            F.col("R_q").isin(*rule.recency)
            & F.col("F_q").isin(*rule.frequency)
            & F.col("M_q").isin(*rule.monetary)
        )
        name = F.lit(rule.name)
        matched = F.when(inside, name) if matched is None else matched.when(inside, name)
    other = F.lit(OTHER_SEGMENT)
    return other if matched is None else matched.otherwise(other)


def rfm_segment(scores: DataFrame, rules: Sequence[SegmentRule] = SEGMENT_RULES) -> DataFrame:
    """Add ``segment``: the first rule whose box holds the three scores, else Other."""
    return scores.withColumn("segment", _segment_column(rules))


def rfm_integrity(seg: DataFrame) -> DataFrame:
    """Customers, customers in more than one row, and rows without a segment."""
    per_customer = seg.groupBy("customer_id").agg(
        n_rows().alias("n"), F.count(F.when(F.col("segment").isNull(), 1)).alias("n_null")
    )
    return per_customer.agg(
        n_rows().alias("n_customers"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_duplicated"),
        F.coalesce(F.sum("n_null"), F.lit(0)).alias("n_without_segment"),
    )


def segment_summary(seg: DataFrame, digits: int | None = 1) -> DataFrame:
    """Per segment: size, revenue, mean R, F and M, shares, and mean spend over all = 100."""
    sums = seg.groupBy("segment").agg(
        n_rows().alias("n_customers"),
        F.sum("monetary").alias("revenue"),
        F.sum("recency_days").alias("recency"),
        F.sum("frequency").alias("days"),
    )
    overall = W.partitionBy()  # one row per segment
    revenue_all, customers_all = F.sum("revenue").over(overall), F.sum("n_customers").over(overall)
    index = ratio(ratio("revenue", "n_customers"), ratio(revenue_all, customers_all)) * 100.0
    return sums.select(
        "segment",
        "n_customers",
        as_double("revenue").alias("total_revenue"),
        ratio("recency", "n_customers").alias("avg_recency"),
        ratio("days", "n_customers").alias("avg_frequency"),
        ratio("revenue", "n_customers").alias("avg_monetary"),
        share_pct("revenue", revenue_all, digits).alias("revenue_share_pct"),
        share_pct("n_customers", customers_all, digits).alias("customer_share_pct"),
        index.alias("avg_monetary_index"),
    )


def quintile_bounds(seg: DataFrame) -> DataFrame:
    """Lowest and highest recency per R score, and frequency per F score."""

    def bounds(metric: str, score: str) -> DataFrame:
        grouped = seg.groupBy(F.col(score).alias("quantile"))
        ends = grouped.agg(F.min(metric).alias("lowest"), F.max(metric).alias("highest"))
        return ends.select(F.lit(metric).alias("metric"), "quantile", "lowest", "highest")

    return bounds("recency_days", "R_q").unionByName(bounds("frequency", "F_q"))
