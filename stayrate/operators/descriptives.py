"""Revenue trends, mix and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.config import DEFAULT
from stayrate.functions import (
    as_double,
    month_start,
    n_rows,
    ratio,
    running_totals,
    share_pct,
    week_start,
)


def _total(column: str) -> Column:
    """Sum over a frame that has one row per week, month or category."""
    return F.sum(column).over(W.partitionBy())


def daily_totals(txn: DataFrame) -> DataFrame:
    """Revenue (as ``price``) and number of items per day and channel.

    The trends that do not need single customers or articles take this in place of the
    transactions, so that one scan serves them all.
    """
    return txn.groupBy("t_dat", "sales_channel_id").agg(
        F.sum("price").alias("price"), n_rows().alias("n_items")
    )


def _items(txn: DataFrame) -> Column:
    """Transactions in a group, of single rows or of daily totals."""
    return F.sum("n_items") if "n_items" in txn.columns else n_rows()


def weekly_revenue(txn: DataFrame) -> DataFrame:
    """Per week (from Monday): revenue, transactions and different customers."""
    return (
        txn.groupBy(week_start("t_dat").alias("week"))
        .agg(
            F.sum("price").alias("revenue"),
            n_rows().alias("n_txns"),
            F.count_distinct("customer_id").alias("n_customers"),
        )
        .withColumn("revenue", as_double("revenue"))
    )


def weekly_index(weekly: DataFrame, base_row: int = 2, digits: int | None = 1) -> DataFrame:
    """Weekly revenue relative to that of the ``base_row``-th week, times 100.

    The default base is the second week, since the first one may be cut short.
    """
    in_order = W.orderBy("week").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = F.nth_value("revenue", base_row).over(in_order)
    return weekly.select("week", "revenue", share_pct("revenue", base, digits).alias("rev_index"))


def _first_extreme(value: str, date: str, highest: bool) -> Column:
    """The date of the highest or lowest value, the earliest one on ties."""
    earliness = -F.unix_date(date)
    if highest:
        return F.max_by(date, F.struct(value, earliness))
    return F.min_by(date, F.struct(value, -earliness))


def weekly_extremes(index: DataFrame) -> DataFrame:
    """Number of weeks, and the peak and the trough of ``weekly_index``."""
    return index.agg(
        n_rows().alias("n_weeks"),
        _first_extreme("rev_index", "week", highest=True).alias("peak_week"),
        F.max("rev_index").alias("peak_index"),
        _first_extreme("rev_index", "week", highest=False).alias("trough_week"),
        F.min("rev_index").alias("trough_index"),
    )


def channel_weekly(txn: DataFrame) -> DataFrame:
    grouped = txn.groupBy(week_start("t_dat").alias("week"), "sales_channel_id")
    totals = grouped.agg(F.sum("price").alias("revenue"), _items(txn).alias("n_txns"))
    return totals.withColumn("revenue", as_double("revenue"))


def channel_share(txn: DataFrame, digits: int | None = 1) -> DataFrame:
    totals = txn.groupBy("sales_channel_id").agg(F.sum("price").alias("revenue"))
    return totals.select(
        "sales_channel_id",
        as_double("revenue").alias("revenue"),
        share_pct("revenue", _total("revenue"), digits).alias("pct"),
    )


def channel_weekly_share(
    txn: DataFrame, channels: Sequence[int] = DEFAULT.channels, digits: int | None = None
) -> DataFrame:
    """Per week, each channel's percentage of the week's revenue, and ``other_pct``.

    ``other_pct`` is what comes from channels beyond ``channels``, and from rows without one.
    """
    channel = F.col("sales_channel_id")
    part = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("price"))), F.lit(0))
    shares = {f"channel_{c}_pct": part(channel == c) for c in channels}
    shares["other_pct"] = part(~F.coalesce(channel.isin(*channels), F.lit(False)))
    weekly = txn.groupBy(week_start("t_dat").alias("week"))
    sums = weekly.agg(F.sum("price").alias("_all"), *(total.alias(name) for name, total in shares.items()))
    return sums.select("week", *(share_pct(name, F.col("_all"), digits).alias(name) for name in shares))


def product_mix(txn: DataFrame, art: DataFrame, digits: int | None = 1) -> DataFrame:
    """Revenue and its share per product group; unknown articles form the NULL group.

    Revenue is summed per article before the join, so the joined side has one row per
    article, however often it was sold.
    """
    per_article = txn.groupBy("article_id").agg(F.sum("price").alias("revenue"))
    groups = art.select("article_id", "product_group_name")
    totals = (
        per_article.join(groups, "article_id", "left")
        .groupBy("product_group_name")
        .agg(F.sum("revenue").alias("revenue"))
    )
    return totals.select(
        "product_group_name",
        as_double("revenue").alias("revenue"),
        share_pct("revenue", _total("revenue"), digits).alias("pct"),
    )


def customer_revenue(txn: DataFrame) -> DataFrame:
    """Total revenue per customer; ``txn`` may also be a stored ``purchase_days`` frame."""
    amount = "spend" if "n_items" in txn.columns else "price"
    return txn.groupBy("customer_id").agg(F.sum(amount).alias("total_rev"))


def _concentration(revenue: DataFrame) -> DataFrame:
    """Per different revenue ``v``: its customers ``n``, and customers and revenue below it."""
    spend = revenue.where(F.col("total_rev").isNotNull())
    levels = spend.groupBy(F.col("total_rev").alias("v")).agg(
        n_rows().alias("n"), F.sum("total_rev").alias("spend")
    )
    totals = running_totals(levels, ["v"], ["n", "spend"])
    return totals.select(
        as_double("v").alias("v"),
        "n",
        (F.col("cum_n") - F.col("n")).alias("n_below"),
        as_double(F.col("cum_spend") - F.col("spend")).alias("spend_below"),
        F.col("total_n").alias("n_all"),
        as_double("total_spend").alias("spend_all"),
    )


def _spend_up_to(rank: Column) -> Column:
    return F.col("spend_below") + (rank - F.col("n_below")) * F.col("v")


def lorenz_curve(revenue: DataFrame, points: int = 100) -> DataFrame:
    """``points`` points of the curve: shares of customers and of revenue, ascending spend.

    Point ``i`` stands at the customer of rank ``ceil(i * n / points)``.
    """
    # In whole numbers, the points with n_below < ceil(i * n_all / points) <= n_below + n
    levels = _concentration(revenue).selectExpr(
        "*",
        f"n_below * {points} div n_all + 1 AS first_point",
        f"(n_below + n) * {points} div n_all AS last_point",
    )
    picked = (
        levels.where(F.col("first_point") <= F.col("last_point"))
        .withColumn("point", F.explode(F.sequence("first_point", "last_point")))
        .withColumn("rank", F.expr(f"(point * n_all + {points - 1}) div {points}"))
    )
    return picked.select(
        "point",
        "rank",
        ratio("rank", "n_all").alias("customer_share"),
        ratio(_spend_up_to(F.col("rank")), "spend_all").alias("revenue_share"),
    )


def top_share(revenue: DataFrame, fractions: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """Revenue share of the customers ranked above the first ``int(n * (1 - f)) + 1``."""
    levels = _concentration(revenue)
    shares = []
    for fraction in fractions:
        rank = F.floor(F.col("n_all") * F.lit(1 - fraction)) + 1
        at_rank = (rank > F.col("n_below")) & (rank <= F.col("n_below") + F.col("n"))
        shares.append((fraction, F.max(F.when(at_rank, 1 - ratio(_spend_up_to(rank), "spend_all")))))
    row = levels.agg(*(share.alias(f"_s{i}") for i, (_, share) in enumerate(shares)))
    entries = F.array(
        *(
            F.struct(F.lit(fraction).alias("fraction"), F.col(f"_s{i}").alias("revenue_share"))
            for i, (fraction, _) in enumerate(shares)
        )
    )
    return row.select(F.inline(entries))


def gini(revenue: DataFrame) -> DataFrame:
    """1 minus twice the area under the curve, by trapezoids between the first and last customer."""
    n, v, below = F.col("n"), F.col("v"), F.col("spend_below")
    sum_of_cumulated = n * below + v * n * (n + 1) / 2
    found = _concentration(revenue).agg(
        F.sum(sum_of_cumulated / F.col("spend_all")).alias("area"),
        F.min(F.when(F.col("n_below") == 0, v / F.col("spend_all"))).alias("first"),
        F.max("n_all").alias("n_customers"),
    )
    trapezoids = ratio(F.col("area") - F.col("first") / 2 - 0.5, "n_customers")
    return found.select("n_customers", (1 - 2 * trapezoids).alias("gini"))


def monthly_revenue(txn: DataFrame) -> DataFrame:
    grouped = txn.groupBy(month_start("t_dat").alias("month"))
    totals = grouped.agg(F.sum("price").alias("revenue"), _items(txn).alias("n_txns"))
    return totals.withColumn("revenue", as_double("revenue"))


def seasonality_index(monthly: DataFrame, digits: int | None = 1) -> DataFrame:
    """Monthly revenue relative to the median month, times 100; the first peak is marked."""
    middle = F.percentile("revenue", 0.5).over(W.partitionBy())  # one row per month
    indexed = monthly.select(
        "month", "revenue", "n_txns", share_pct("revenue", middle, digits).alias("rev_index")
    )
    place = F.row_number().over(W.orderBy(F.desc_nulls_last("rev_index"), "month"))
    return indexed.withColumn("is_peak", place == 1)


def seasonality_peak(index: DataFrame) -> DataFrame:
    return index.agg(
        n_rows().alias("n_months"),
        _first_extreme("rev_index", "month", highest=True).alias("peak_month"),
        F.max("rev_index").alias("peak_index"),
    )
