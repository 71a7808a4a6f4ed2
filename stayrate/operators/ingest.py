"""Profiling, customer sampling and storage of the source tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.config import DEFAULT
from stayrate.functions import lookup_join
from stayrate.sources.checkpoints import materialise

_COPY_SLOTS = 1024


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name and number of rows."""
    return _stack(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table"), "row_count"
            )
            for name, df in tables.items()
        ]
    )


def schema_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: table, position, name, type and the table's row count."""
    profiles = []
    for name, df in tables.items():
        columns = F.array(
            *(
                F.struct(
                    F.lit(i).cast("bigint").alias("position"),
                    F.lit(column).alias("column"),
                    F.lit(dtype).alias("dtype"),
                )
                for i, (column, dtype) in enumerate(df.dtypes, 1)
            )
        )
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        profiles.append(counted.select(F.lit(name).alias("table"), F.inline(columns), "row_count"))
    return _stack(profiles)


def table_stats(txn: DataFrame, cust: DataFrame, art: DataFrame, approximate: bool = False) -> DataFrame:
    """Date range and distinct keys, as (table, stat, value) rows with text values.

    Every count reads one column of its own: two distinct counts in one aggregate would
    multiply the rows. ``approximate`` trades exact counts for one small sketch each.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct

    def stat(df: DataFrame, table: str, name: str, value) -> DataFrame:
        found = df.agg(value.cast("string").alias("value"))
        return found.select(F.lit(table).alias("table"), F.lit(name).alias("stat"), "value")

    return _stack(
        [
            stat(txn, "transactions", "min_date", F.min("t_dat")),
            stat(txn, "transactions", "max_date", F.max("t_dat")),
            stat(txn, "transactions", "distinct_customers", distinct("customer_id")),
            stat(txn, "transactions", "distinct_articles", distinct("article_id")),
            stat(cust, "customers", "distinct_customers", distinct("customer_id")),
            stat(art, "articles", "distinct_articles", distinct("article_id")),
        ]
    )


def in_sample(
    column: str, fraction: float = DEFAULT.sample_fraction, seed: int = DEFAULT.random_seed
):
    """True for the ids whose hash falls in the sampled share of 10,000 buckets."""
    digest = F.md5(F.concat(F.col(column).cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10000
    return bucket < int(fraction * 10000)


def hash_sample_ids(
    df: DataFrame,
    id_col: str = "customer_id",
    fraction: float = DEFAULT.sample_fraction,
    seed: int = DEFAULT.random_seed,
) -> DataFrame:
    """The distinct sampled ids of ``df``; the same ids whatever the order of the rows."""
    return df.where(in_sample(id_col, fraction, seed)).select(id_col).distinct()


def sample_tables(
    tables: Mapping[str, DataFrame],
    fraction: float = DEFAULT.sample_fraction,
    seed: int = DEFAULT.random_seed,
) -> dict[str, DataFrame]:
    """Keep the sampled customers and their transactions, and all articles.

    The hash decides row by row, so transactions are filtered in the scan. Those of
    customers that the customer table lacks, which are few if any, are found among the
    different ids and taken out; the transactions themselves are not shuffled. An empty
    sample gives empty tables.
    """
    chosen = in_sample("customer_id", fraction, seed)
    customers = tables["customers"].where(chosen)
    transactions = tables["transactions"].where(chosen)
    buyers = transactions.select("customer_id").distinct()
    strangers = buyers.join(customers.select("customer_id"), "customer_id", "left_anti")
    kept = lookup_join(transactions, strangers, "customer_id", "left_anti")
    return {
        **tables,
        "customers": customers,
        "transactions": kept.select(*tables["transactions"].columns),
    }


def write_clustered(
    df: DataFrame, path: str, date_col: str = "t_dat", spread: Sequence[str] = ("customer_id",)
) -> None:
    """Write ``df`` as Parquet whose files cover narrow date ranges.

    Rows are range partitioned by date, then by ``spread`` and a running number, so a day,
    a customer or even copies of one row with a large share of all rows are cut over
    several files. Readers skip files and row groups by their date statistics. The numbers are
    stored before rows are placed by them, so a task that runs again finds the same ones.
    """
    order = [date_col, *spread]
    numbered = materialise(df.withColumn("_copy", F.monotonically_increasing_id() % _COPY_SLOTS))
    placed = numbered.repartitionByRange(*order, "_copy").drop("_copy")
    placed.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def reconcile_counts(raw: Mapping[str, DataFrame], stored: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table before and after storing, and whether they agree."""
    before = row_counts(raw).withColumnRenamed("row_count", "raw_rows")
    after = row_counts(stored).withColumnRenamed("row_count", "stored_rows")
    return before.join(after, "table").withColumn("matches", F.col("raw_rows") == F.col("stored_rows"))


def check_reconciled(counts: DataFrame) -> None:
    """Raise if a table of ``reconcile_counts`` lost or gained rows."""
    wrong = [row["table"] for row in counts.where(~F.col("matches")).select("table").collect()]
    if wrong:
        raise ValueError(f"row counts differ between source and storage: {sorted(wrong)}")


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result as ``parquet``, ``json`` or ``csv`` (with a header)."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown result format: {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
