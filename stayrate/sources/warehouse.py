"""The retail tables as views over an orders / lineitem / customer / part warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def retail_tables(spark: SparkSession, path: str, item_column: str = "p_name") -> dict[str, DataFrame]:
    """Map the warehouse tables under ``path`` to transactions, customers and articles.

    Prices are decimals, so sums do not depend on the order of the rows.
    """
    orders = spark.read.parquet(f"{path}/orders.parquet")
    lineitem = spark.read.parquet(f"{path}/lineitem.parquet")
    customer = spark.read.parquet(f"{path}/customer.parquet")
    part = spark.read.parquet(f"{path}/part.parquet")

    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    transactions = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").cast("date").alias("t_dat"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.when(urgent, 2).otherwise(1).cast("bigint").alias("sales_channel_id"),
    )
    segment = F.col("c_mktsegment")
    customers = customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.when(segment == "BUILDING", "ACTIVE").otherwise(segment).alias("club_member_status"),
        F.when(segment == "MACHINERY", "Regularly").otherwise("NONE").alias("fashion_news_frequency"),
        F.floor(F.col("c_acctbal") / 100).cast("bigint").alias("age"),
    )
    articles = part.select(
        F.col("p_partkey").alias("article_id"),
        F.col(item_column).alias("product_type_name"),
        F.col("p_type").alias("product_group_name"),
    )
    return {"transactions": transactions, "customers": customers, "articles": articles}
