"""Retention by month of first purchase and by channel of first purchase."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions import as_double, month_start, months_after, n_rows, ratio, share_pct
from stayrate.operators.purchases import purchase_days


def first_purchase(txn: DataFrame) -> DataFrame:
    """Per customer: first date, its month, and the lowest channel number of that day.

    A missing channel counts only when the day has no other.
    """
    days = purchase_days(txn).groupBy("customer_id")
    first = days.agg(
        F.min("t_dat").alias("first_date"), F.min_by("channel", "t_dat").alias("first_channel")
    )
    return first.select(
        "customer_id", "first_date", month_start("first_date").alias("cohort_month"), "first_channel"
    )


def monthly_activity(txn: DataFrame) -> DataFrame:
    """The months in which each customer bought."""
    known = txn.where(F.col("customer_id").isNotNull() & F.col("t_dat").isNotNull())
    return known.select("customer_id", month_start("t_dat").alias("activity_month")).distinct()


def cohort_activity(txn: DataFrame) -> DataFrame:
    """Active customers per cohort month, first channel and month.

    Each customer's days are read in order once: the first day gives the cohort and the
    channel, and every first day of a month counts as activity. So the transactions are
    scanned once and no join is needed.
    """
    history = W.partitionBy("customer_id").orderBy("t_dat")
    month = month_start("t_dat")
    marked = purchase_days(txn).select(
        F.first("t_dat").over(history).alias("first_date"),
        F.first("channel").over(history).alias("first_channel"),
        month.alias("activity_month"),
        month_start(F.lag("t_dat").over(history)).alias("previous_month"),
    )
    new_month = F.col("previous_month").isNull() | (
        F.col("previous_month") < F.col("activity_month")
    )
    cohort = month_start("first_date")
    return (
        marked.where(new_month)
        .groupBy(cohort.alias("cohort_month"), "first_channel", "activity_month")
        .agg(n_rows().alias("n_customers"))
        .select(
            "cohort_month",
            "first_channel",
            "activity_month",
            months_after("activity_month", "cohort_month").alias("months_since"),
            "n_customers",
        )
    )


def cohort_sizes(first: DataFrame) -> DataFrame:
    return first.groupBy("cohort_month").agg(n_rows().alias("cohort_size"))


def channel_sizes(first: DataFrame) -> DataFrame:
    return first.groupBy("first_channel").agg(n_rows().alias("cohort_size"))


def sizes_of(activity: DataFrame, key: str) -> DataFrame:
    """Customers per cohort or first channel from ``cohort_activity``: all are active in month 0."""
    at_first = activity.where(F.col("months_since") == 0)
    return at_first.groupBy(key).agg(F.sum("n_customers").alias("cohort_size"))


def at_risk(activity: DataFrame, key: str, last_month: str | datetime.date | None = None) -> DataFrame:
    """Per value of ``key`` and month: customers whose month lies inside the data, as ``cohort_size``.

    ``last_month`` is any day of the last month that counts, by default the last with activity; give
    the month before it if the data ends within a month. What is spread over months are
    the cohorts of each key, not customers.
    """
    if last_month is None:
        last_month = activity.agg(F.max("activity_month")).first()[0]  # one value
    last = month_start(F.lit(last_month).cast("date"))
    first = activity.where((F.col("months_since") == 0) & (F.col("cohort_month") <= last))
    starts = first.groupBy(key, F.col("cohort_month").alias("_start")).agg(F.sum("n_customers").alias("_n"))
    months = F.sequence(F.lit(0).cast("bigint"), months_after(last, "_start"))
    spread = starts.select(key, "_n", F.explode(months).alias("months_since"))
    return spread.groupBy(key, "months_since").agg(F.sum("_n").alias("cohort_size"))


def _retention(activity: DataFrame, sizes: DataFrame, key: str, digits: int | None) -> DataFrame:
    """Active customers over ``sizes``, which may be per key or, from ``at_risk``, per key and month.

    Keys may be missing, as first channels are.
    """
    active = activity.groupBy(key, "months_since").agg(F.sum("n_customers").alias("n_customers"))
    by_month = "months_since" in sizes.columns
    renamed = sizes.select(
        F.col(key).alias("_key"), "cohort_size", *([F.col("months_since").alias("_month")] if by_month else [])
    )
    same = F.col(key).eqNullSafe(F.col("_key"))
    if by_month:
        same = same & (F.col("months_since") == F.col("_month"))
    return active.join(renamed, same).select(
        key,
        "months_since",
        "n_customers",
        "cohort_size",
        share_pct("n_customers", "cohort_size", digits).alias("retention_pct"),
    )


def cohort_retention(activity: DataFrame, sizes: DataFrame, digits: int | None = 1) -> DataFrame:
    """Percent of each cohort active, by months since the first purchase."""
    return _retention(activity, sizes, "cohort_month", digits)


def channel_retention(activity: DataFrame, sizes: DataFrame, digits: int | None = 1) -> DataFrame:
    """Percent of each first channel's customers active, by months since the first purchase.

    With ``channel_sizes`` all customers of the channel are in the denominator, also those whose month
    lies after the end of the data; with ``at_risk(activity, "first_channel")`` only the others are.
    """
    return _retention(activity, sizes, "first_channel", digits)


def retention_matrix(retention: DataFrame, months: int = 12, min_cells: int = 6) -> DataFrame:
    """Cohorts as rows and months 0 to ``months`` as columns ``m0, m1, ...``.

    Cohorts with fewer than ``min_cells`` filled months are left out.
    """
    names = [f"m{month}" for month in range(months + 1)]
    cells = [
        F.max(F.when(F.col("months_since") == month, F.col("retention_pct"))).alias(name)
        for month, name in enumerate(names)
    ]
    return retention.groupBy("cohort_month").agg(*cells).dropna(thresh=min_cells, subset=names)


def avg_retention(matrix: DataFrame, months: Sequence[int] = (3, 6)) -> DataFrame:
    """The mean over cohorts, each with the same weight, and the number of cohorts."""
    means = [ratio(F.sum(F.col(f"m{m}")), F.count(f"m{m}")).alias(f"avg_m{m}") for m in months]
    return matrix.agg(*means, n_rows().alias("n_cohorts"))


def channel_gap_m6(
    retention: DataFrame, month: int = 6, channels: tuple[int, int] = (1, 2)
) -> DataFrame:
    """Retention of two first channels after ``month`` months, their gap and the better one."""
    first, second = channels
    at_month = retention.where(F.col("months_since") == month)
    pct = lambda c: F.max(F.when(F.col("first_channel") == c, F.col("retention_pct")))
    both = at_month.agg(pct(first).alias("_a"), pct(second).alias("_b"))
    a, b = as_double("_a"), as_double("_b")
    better = F.when(a > b, first).when(b >= a, second).cast("bigint")
    return both.select(
        a.alias(f"channel_{first}_pct"),
        b.alias(f"channel_{second}_pct"),
        F.abs(a - b).alias("gap_pp"),
        better.alias("better_channel"),
    )


def channel_gaps(retention: DataFrame, month: int = 6) -> DataFrame:
    """Every first channel's retention after ``month`` months and how far it lies below the best.

    Channels that nobody came back to in that month, or whose month lies after the data, have 0
    active customers if ``retention`` has them in month 0. A missing channel is a group of its own.
    """
    at = lambda column: F.max(F.when(F.col("months_since") == month, F.col(column)))
    per_channel = retention.groupBy("first_channel").agg(
        F.coalesce(at("n_customers"), F.lit(0)).alias("n_active"),
        F.coalesce(as_double(at("retention_pct")), F.lit(0.0)).alias("retention_pct"),
    )
    best = F.max("retention_pct").over(W.partitionBy())  # one row per channel
    return per_channel.withColumn("gap_pp", best - F.col("retention_pct"))
