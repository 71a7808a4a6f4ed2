"""Transactions condensed to one row per customer and day.

Most customer-level operators start here. The first aggregation is keyed on customer and
day, so a customer with a large share of all transactions is summed in many tasks; what
remains per customer is at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.config import DEFAULT


def _known(txn: DataFrame) -> DataFrame:
    return txn.where(F.col("customer_id").isNotNull() & F.col("t_dat").isNotNull())


def purchase_days(txn: DataFrame, online_channel: int = DEFAULT.online_channel) -> DataFrame:
    """Per customer and day: items, spend, priced and online items, lowest channel number.

    Sums that the caller does not use are pruned from the plan. A frame that is already
    condensed, such as a stored one, is returned as it is.
    """
    if "n_items" in txn.columns:
        return txn
    online = F.col("sales_channel_id") == online_channel
    return _known(txn).groupBy("customer_id", "t_dat").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("price").alias("spend"),
        F.count("price").alias("n_priced"),
        F.count(F.when(online, 1)).alias("n_online"),
        F.min("sales_channel_id").alias("channel"),
    )


def purchase_days_with_articles(
    txn: DataFrame, online_channel: int = DEFAULT.online_channel
) -> DataFrame:
    """As ``purchase_days``, with ``n_new_articles``.

    ``n_new_articles`` counts the articles that the customer buys for the first time on
    that day. Its running sum is the number of different articles bought so far, at any
    date, which saves a distinct count per date.

    One read of the transactions gives both groupings, customers' days and the first day of
    customers' articles; every grouping is summed before it moves, so a customer, day or article
    with a large share of all rows is spread over many tasks.
    """
    if "n_new_articles" in txn.columns:
        return txn
    bought = _known(txn).withColumn("_day", F.col("t_dat"))
    sets = [["customer_id", "t_dat"], ["customer_id", "article_id"]]
    both = bought.groupingSets(sets, "customer_id", "t_dat", "article_id").agg(
        F.grouping("article_id").alias("_is_day"),
        F.min("_day").alias("_first"),
        F.count(F.lit(1)).alias("_items"),
        F.sum("price").alias("_spend"),
        F.count("price").alias("_priced"),
        F.count(F.when(F.col("sales_channel_id") == online_channel, 1)).alias("_online"),
        F.min("sales_channel_id").alias("_channel"),
    )
    is_day = F.col("_is_day") == 1
    first_seen = ~is_day & F.col("article_id").isNotNull()
    of_day = lambda column: F.when(is_day, F.col(column))
    return (
        both.where(is_day | first_seen)
        .groupBy("customer_id", F.col("_first").alias("t_dat"))
        .agg(
            F.max(of_day("_items")).alias("n_items"),  # one row per day has the day's sums
            F.max(of_day("_spend")).alias("spend"),
            F.max(of_day("_priced")).alias("n_priced"),
            F.max(of_day("_online")).alias("n_online"),
            F.max(of_day("_channel")).alias("channel"),
            F.count(F.when(first_seen, 1)).alias("n_new_articles"),
        )
    )


def store_purchase_days(
    txn: DataFrame, table: str, buckets: int = 200, online_channel: int = DEFAULT.online_channel
) -> DataFrame:
    """Store the purchase days, new articles included, as the table ``table`` in buckets of customers.

    Rows of a customer lie in one bucket, in the order of their days. Metrics, cohorts, gaps,
    features and spend per customer then read the table without an exchange by customer, as often as
    they are asked for. An existing table of that name is replaced. Choose ``buckets`` so that one
    holds some 100 MB; each is written as one file.
    """
    days = purchase_days_with_articles(txn, online_channel).repartition(buckets, "customer_id")
    writer = days.write.mode("overwrite").format("parquet")
    writer.bucketBy(buckets, "customer_id").sortBy("customer_id", "t_dat").saveAsTable(table)
    return txn.sparkSession.table(table)


def with_gaps(days: DataFrame) -> DataFrame:
    """Add ``gap_days``, the days since the customer's previous purchase day."""
    previous = F.lag("t_dat").over(W.partitionBy("customer_id").orderBy("t_dat"))
    return days.withColumn("gap_days", F.datediff("t_dat", previous).cast("bigint"))
