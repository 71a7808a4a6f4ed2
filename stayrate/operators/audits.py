"""Checks that recompute what a stage promised and count the rows that break it."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.config import DEFAULT, SEGMENT_RULES, SegmentRule
from stayrate.functions import n_rows
from stayrate.operators.rfm import rfm_segment


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def audit_unique(df: DataFrame, key: str = "customer_id", by: str = "snapshot_date") -> DataFrame:
    """Per ``by``: different keys, and keys that occur more than once."""
    per_key = df.groupBy(by, key).agg(n_rows().alias("n"))
    return per_key.groupBy(by).agg(
        n_rows().alias("n_keys"), _count_if(F.col("n") > 1).alias("n_duplicated")
    )


def _purchase_dates(txn: DataFrame) -> DataFrame:
    return txn.select("customer_id", "t_dat").distinct()


def _snapshot_dates(snap: DataFrame) -> list[datetime.date]:
    """The different dates; of an empty snapshot one at which nothing happened."""
    return [row[0] for row in snap.select("snapshot_date").distinct().collect()] or [datetime.date(1970, 1, 1)]


def audit_feature_dates(txn: DataFrame, snap: DataFrame) -> DataFrame:
    """Per snapshot: customers whose recency is not that of their last day before it.

    A recency of zero or less, or one that differs from the recomputed value, means that
    features were taken from the snapshot date or later, or from too little history.
    """
    days = _snapshot_dates(snap)
    dates = F.array(*(F.lit(d).cast("date") for d in days))
    last_days = (
        _purchase_dates(txn.where(F.col("t_dat") < F.lit(max(days))))
        .withColumn("snapshot_date", F.explode(dates))
        .where(F.col("t_dat") < F.col("snapshot_date"))
        .groupBy("customer_id", "snapshot_date")
        .agg(F.max("t_dat").alias("last_day"))
    )
    checked = snap.select("customer_id", "snapshot_date", "recency_days").join(
        last_days, ["customer_id", "snapshot_date"], "left"
    )
    expected = F.datediff("snapshot_date", "last_day")
    wrong = ~F.col("recency_days").eqNullSafe(expected.cast("bigint"))
    return checked.groupBy("snapshot_date").agg(
        n_rows().alias("n_customers"),
        _count_if(F.col("recency_days") < 1).alias("n_not_before"),
        _count_if(wrong).alias("n_wrong_recency"),
        F.max("last_day").alias("max_source_date"),
    )


def _labels_against_purchases(
    txn: DataFrame, snap: DataFrame, label_weeks: int, lapsed: int
) -> DataFrame:
    """Per snapshot: customers with this label, and those with purchases in the label window.

    Purchases are reduced to different customers per window first, so the join is on
    unique keys.
    """
    days = 7 * label_weeks
    starts = _snapshot_dates(snap)
    dates = F.array(*(F.lit(d).cast("date") for d in starts))
    end = max(starts) + datetime.timedelta(days=days)
    needed = txn.where((F.col("t_dat") >= F.lit(min(starts))) & (F.col("t_dat") < F.lit(end)))
    buyers = (
        _purchase_dates(needed)
        .withColumn("snapshot_date", F.explode(dates))
        .where(F.datediff("t_dat", "snapshot_date").between(0, days - 1))
        .select("customer_id", "snapshot_date")
        .distinct()
        .withColumn("_bought", F.lit(True))
    )
    labelled = snap.where(F.col("lapsed") == lapsed).select("customer_id", "snapshot_date")
    return (
        labelled.join(buyers, ["customer_id", "snapshot_date"], "left")
        .groupBy("snapshot_date")
        .agg(n_rows().alias("n_labelled"), F.count("_bought").alias("n_bought"))
    )


def audit_label_retained(
    txn: DataFrame, snap: DataFrame, label_weeks: int = DEFAULT.label_window_weeks
) -> DataFrame:
    """Per snapshot: retained customers, and those without a purchase in the window."""
    counts = _labels_against_purchases(txn, snap, label_weeks, lapsed=0)
    violations = (F.col("n_labelled") - F.col("n_bought")).alias("n_violations")
    return counts.select("snapshot_date", F.col("n_labelled").alias("n_retained"), violations)


def audit_label_lapsed(
    txn: DataFrame, snap: DataFrame, label_weeks: int = DEFAULT.label_window_weeks
) -> DataFrame:
    """Per snapshot: lapsed customers, and those with a purchase in the window."""
    counts = _labels_against_purchases(txn, snap, label_weeks, lapsed=1)
    return counts.select(
        "snapshot_date",
        F.col("n_labelled").alias("n_lapsed"),
        F.col("n_bought").alias("n_violations"),
    )


def audit_spacing(
    calendar: DataFrame, spacing_weeks: int = DEFAULT.snapshot_spacing_weeks
) -> DataFrame:
    """Days from each snapshot to the next, and whether they are as configured."""
    before = F.lag("snapshot_date").over(W.orderBy("snapshot_date"))  # one row per snapshot
    spaced = calendar.withColumn("gap_days", F.datediff("snapshot_date", before).cast("bigint"))
    return spaced.where(F.col("gap_days").isNotNull()).select(
        "snapshot_date", "gap_days", (F.col("gap_days") == 7 * spacing_weeks).alias("is_spaced")
    )


def audit_quintiles(seg: DataFrame, q: int = DEFAULT.n_quantiles) -> DataFrame:
    """Rows with a score outside 1..q or without a segment, and customers in several rows."""
    score_ok = [F.coalesce(F.col(c).between(1, q), F.lit(False)) for c in ("R_q", "F_q", "M_q")]
    per_customer = seg.groupBy("customer_id").agg(
        n_rows().alias("n"),
        _count_if(~(score_ok[0] & score_ok[1] & score_ok[2])).alias("bad"),
        _count_if(F.col("segment").isNull()).alias("without"),
    )
    return per_customer.agg(
        n_rows().alias("n_customers"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad_scores"),
        F.coalesce(F.sum("without"), F.lit(0)).alias("n_without_segment"),
        _count_if(F.col("n") > 1).alias("n_duplicated"),
    )


def audit_segment_rules(seg: DataFrame, rules: Sequence[SegmentRule] = SEGMENT_RULES) -> DataFrame:
    """Rows whose segment is not the one the rules give, over all rows."""
    again = rfm_segment(seg.withColumnRenamed("segment", "_stored"), rules)
    return again.agg(
        n_rows().alias("n_rows"),
        _count_if(~F.col("segment").eqNullSafe(F.col("_stored"))).alias("n_mismatched"),
        F.count_distinct("_stored").alias("n_segments"),
    )
