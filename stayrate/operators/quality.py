"""Data-quality checks. They count and report; no table is changed."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.config import DEFAULT, RetentionConfig
from stayrate.functions import (
    as_double,
    exact_quantiles,
    n_rows,
    ratio,
    share_pct,
    side_by_side,
)
from stayrate.sources.checkpoints import materialise

_PRICE_PROBS = (0.25, 0.5, 0.75, 0.99)
_PRICE_NAMES = ("p25", "p50", "p75", "p99")


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column``, as ``n``. Most checks follow from these counts."""
    return df.groupBy(column).agg(n_rows().alias("n"))


def _total(condition: Column | None = None) -> Column:
    """Rows behind the counts, or those that meet ``condition``."""
    counted = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(counted), F.lit(0))


def q_duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Surplus copies: rows beyond the first of each group that agrees on ``cols``."""
    groups = df.groupBy(*(cols or df.columns)).agg(n_rows().alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"))


def q_missing_age(cust: DataFrame) -> DataFrame:
    counts = cust.agg(_count_if(F.col("age").isNull()).alias("n_missing"), n_rows().alias("n_customers"))
    return counts.withColumn("pct", share_pct("n_missing", "n_customers", 2))


def _implausible_age(per_age: DataFrame, lo: int, hi: int) -> DataFrame:
    age = F.col("age")
    return per_age.agg(
        _total(age < lo).alias("n_under"),
        _total(age > hi).alias("n_over"),
        _total((age < lo) | (age > hi)).alias("n_implausible"),
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
        F.percentile("age", 0.5, F.col("n")).alias("median_age"),
    )


def q_implausible_age(
    cust: DataFrame, lo: int = DEFAULT.min_age, hi: int = DEFAULT.max_age
) -> DataFrame:
    return _implausible_age(value_counts(cust, "age"), lo, hi)  # one row per age


def _without_txn(cust: DataFrame, per_customer: DataFrame) -> DataFrame:
    buyers = per_customer.select("customer_id", F.lit(True).alias("_bought"))
    seen = cust.select("customer_id").join(buyers, "customer_id", "left")
    counts = seen.agg(
        _count_if(F.col("_bought").isNull()).alias("n_no_txn"), n_rows().alias("n_customers")
    )
    return counts.withColumn("pct", share_pct("n_no_txn", "n_customers", 2))


def q_customers_no_txn(
    cust: DataFrame, txn: DataFrame, since: str | datetime.date | None = None
) -> DataFrame:
    """Customers without a transaction, or without one on or after ``since``."""
    if since is not None:
        txn = txn.where(F.col("t_dat") >= F.lit(since).cast("date"))
    return _without_txn(cust, value_counts(txn, "customer_id"))


def _orphans(per_key: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    unknown = per_key.join(dim.select(key), key, "left_anti")
    return unknown.agg(_total().alias("n_orphans"), n_rows().alias("n_unknown_keys"))


def q_orphan_customers(txn: DataFrame, cust: DataFrame) -> DataFrame:
    """Transactions of unknown customers; they are counted per customer before the join."""
    return _orphans(value_counts(txn, "customer_id"), cust, "customer_id")


def q_orphan_articles(txn: DataFrame, art: DataFrame) -> DataFrame:
    """Transactions of unknown articles; they are counted per article before the join."""
    return _orphans(value_counts(txn, "article_id"), art, "article_id")


def _price_validity(per_price: DataFrame) -> DataFrame:
    price = F.col("price")
    return per_price.agg(
        _total(price.isNull()).alias("n_null"),
        _total(price <= 0).alias("n_non_positive"),
        _total(price.isNull() | (price <= 0)).alias("n_invalid"),
    )


def q_price_validity(txn: DataFrame) -> DataFrame:
    """Missing and non-positive prices; counted in the scan, without a shuffle."""
    return _price_validity(txn.select("price", F.lit(1).cast("bigint").alias("n")))


def _price_distribution(per_price: DataFrame) -> DataFrame:
    price, n = F.col("price"), F.col("n")
    spread = per_price.agg(
        _total().alias("n_txn"),
        as_double(F.min(price)).alias("min_price"),
        as_double(F.max(price)).alias("max_price"),
        ratio(F.sum(price * n), F.sum(F.when(price.isNotNull(), n))).alias("mean_price"),
    )
    found = exact_quantiles(per_price, "price", _PRICE_PROBS, weight="n")
    quantiles = found.select(*(F.col(f"q{i}").alias(name) for i, name in enumerate(_PRICE_NAMES)))
    return side_by_side(spread, quantiles)


def q_price_distribution(txn: DataFrame, exact: bool = True) -> DataFrame:
    """Range, mean and quartiles of the price; ``exact=False`` uses a sketch for the quantiles."""
    if exact:
        return _price_distribution(materialise(value_counts(txn, "price")))
    price = F.col("price")
    sketch = F.percentile_approx(as_double(price), list(_PRICE_PROBS), 10000)
    found = txn.agg(
        n_rows().alias("n_txn"),
        as_double(F.min(price)).alias("min_price"),
        as_double(F.max(price)).alias("max_price"),
        ratio(F.sum(price), F.count(price)).alias("mean_price"),
        sketch.alias("_q"),
    )
    picked = (F.col("_q")[i].alias(name) for i, name in enumerate(_PRICE_NAMES))
    return found.select("*", *picked).drop("_q")


def _single_purchase(per_customer: DataFrame) -> DataFrame:
    known = per_customer.where(F.col("customer_id").isNotNull())
    counts = known.agg(_count_if(F.col("n") == 1).alias("n_single"), n_rows().alias("n_buyers"))
    return counts.withColumn("pct", share_pct("n_single", "n_buyers", 2))


def q_single_purchase(txn: DataFrame) -> DataFrame:
    """Customers with exactly one transaction row."""
    return _single_purchase(value_counts(txn, "customer_id"))


def _day_gaps(per_day: DataFrame) -> DataFrame:
    """Days since the previous day with transactions. There is one row per calendar day."""
    days = per_day.where(F.col("t_dat").isNotNull())
    before = F.lag("t_dat").over(W.orderBy("t_dat"))
    return days.select("t_dat", F.datediff("t_dat", before).cast("bigint").alias("gap_days"))


def _date_gaps(per_day: DataFrame) -> DataFrame:
    return _day_gaps(per_day).agg(
        n_rows().alias("n_days"),
        _count_if(F.col("gap_days") > 1).alias("n_gaps"),
        F.max("gap_days").alias("max_gap_days"),
    )


def q_date_gaps(txn: DataFrame) -> DataFrame:
    return _date_gaps(value_counts(txn, "t_dat"))


def _max_gap_date(per_day: DataFrame) -> DataFrame:
    gaps = _day_gaps(per_day).where(F.col("gap_days") > 1)
    return gaps.orderBy(F.desc("gap_days"), "t_dat").limit(1)


def q_max_gap_date(txn: DataFrame) -> DataFrame:
    """The day that ends the longest gap of more than a day, the earliest one on ties."""
    return _max_gap_date(value_counts(txn, "t_dat"))


def _distribution(counts: DataFrame) -> DataFrame:
    everything = F.sum("n").over(W.partitionBy())  # one row per category
    return counts.withColumn("pct", share_pct("n", everything, 2))


def q_channel_distribution(txn: DataFrame) -> DataFrame:
    return _distribution(value_counts(txn, "sales_channel_id"))


def q_club_distribution(cust: DataFrame) -> DataFrame:
    """Missing status is kept as a group of its own."""
    return _distribution(value_counts(cust, "club_member_status"))


def _as_text(column: str, scale: int) -> Column:
    return F.col(column).cast(f"decimal(28,{scale})").cast("string")


def marginal_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value of each of ``columns``, as ``n``, all from one read and one exchange.

    Every row has a value in one column; ``counts_of`` picks the rows of a column. Counts are
    taken before the exchange, so a value with a large share of all rows is summed in many tasks.
    """
    grouped = df.groupingSets([[c] for c in columns], *columns)
    return grouped.agg(F.grouping_id().alias("_set"), n_rows().alias("n"))


def counts_of(marginals: DataFrame, column: str) -> DataFrame:
    """The counts of one column of ``marginal_counts``, as ``value_counts`` gives them."""
    columns = [c for c in marginals.columns if c not in ("_set", "n")]
    everything, place = 2 ** len(columns) - 1, len(columns) - 1 - columns.index(column)
    return marginals.where(F.col("_set") == everything - 2**place).select(column, "n")


def _met(dim: DataFrame, counts: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Rows of a dimension and keys of the facts, counted by whether each has the other.

    ``known`` marks the dimension's rows, ``used`` keys with transactions; ``n`` counts rows,
    ``n_txn`` the transactions of the keys. Missing keys meet nothing.
    """
    sides = (
        dim.select(key, *kept, F.lit(True).alias("known")),
        counts.select(key, F.col("n").alias("_txn"), F.lit(True).alias("used")),
    )
    both = sides[0].join(sides[1], key, "full")
    return both.groupBy("known", "used", *kept).agg(
        n_rows().alias("n"), F.coalesce(F.sum("_txn"), F.lit(0)).alias("n_txn")
    )


def _unknown(met: DataFrame) -> DataFrame:
    """Transactions whose key the dimension lacks, and the number of such keys."""
    lacking = met.where(F.col("known").isNull())
    return lacking.agg(F.coalesce(F.sum("n_txn"), F.lit(0)).alias("n_orphans"), _total().alias("n_unknown_keys"))


def _listing(df: DataFrame, column: str) -> DataFrame:
    """The number of categories, and the categories as text, in their order."""
    entry = F.concat(
        F.coalesce(F.col(column).cast("string"), F.lit("missing")),
        F.lit("="),
        F.col("n").cast("string"),
    )
    return df.agg(
        n_rows().alias("count"), F.array_join(F.array_sort(F.collect_list(entry)), "; ").alias("detail")
    )


def quality_report(
    txn: DataFrame, cust: DataFrame, art: DataFrame, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """All checks as rows: check, count, pct, detail, treatment, rows_affected.

    Every table is read once, and the transactions a second time for their duplicates: one
    aggregate counts the values of all their columns, and each dimension meets these counts once.
    """
    lo, hi = cfg.min_age, cfg.max_age
    columns = ["customer_id", "article_id", "price", "t_dat", "sales_channel_id"]
    marginals = materialise(marginal_counts(txn, columns))
    per_customer, per_article, per_price, per_day, per_channel = (counts_of(marginals, c) for c in columns)
    met_customers = materialise(_met(cust, per_customer, "customer_id", ["age", "club_member_status"]))
    met_articles = materialise(_met(art, per_article, "article_id", []))
    customers = met_customers.where("known")
    shares = customers.agg(
        _total().alias("n"),
        _total(F.col("age").isNull()).alias("n_missing"),
        _total(F.col("used").isNull()).alias("n_no_txn"),
    )
    per_club = customers.groupBy("club_member_status").agg(F.sum("n").alias("n"))

    def line(df: DataFrame, check: str, count: str, treatment: str, **optional: Column) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"),
            F.col(count).cast("bigint").alias("count"),
            optional.get("pct", F.lit(None)).cast("double").alias("pct"),
            optional.get("detail", F.lit(None)).cast("string").alias("detail"),
            F.lit(treatment).alias("treatment"),
            optional.get("affected", F.lit(0)).cast("bigint").alias("rows_affected"),
        )

    ages = _implausible_age(customers, lo, hi).withColumns(
        {c: F.col(c).cast("string") for c in ("min_age", "max_age")}
    )
    age_detail = F.concat_ws(
        ", ",
        F.concat(F.lit("under="), F.col("n_under").cast("string")),
        F.concat(F.lit("over="), F.col("n_over").cast("string")),
        F.concat(F.lit("range="), F.concat_ws("..", "min_age", "max_age")),
    )
    price_names = ("min_price", "p25", "p50", "p75", "p99", "max_price", "mean_price")
    price_detail = F.concat_ws(
        ", ", *(F.concat(F.lit(f"{name}="), _as_text(name, 4)) for name in price_names)
    )
    gaps = side_by_side(
        _date_gaps(per_day), _max_gap_date(per_day).select(F.col("t_dat").alias("around"))
    )
    gap_detail = F.concat_ws(
        " around ",
        F.concat(F.lit("max_gap="), F.col("max_gap_days").cast("string")),
        F.col("around").cast("string"),
    )
    pct = F.col("pct")
    rows = [
        line(per_channel.agg(_total().alias("n")), "transactions", "n", "starting count"),
        line(shares, "customers", "n", "starting count"),
        line(met_articles.where("known").agg(_total().alias("n")), "articles", "n", "starting count"),
        line(
            q_duplicate_rows(txn), "duplicate_transactions", "n_duplicates",
            "kept: several units of one article may be bought together",
        ),
        line(
            shares, "missing_age", "n_missing", "kept as NULL", pct=share_pct("n_missing", "n", 2),
        ),
        line(
            ages, "implausible_age", "n_implausible", f"set to NULL outside {lo}..{hi}",
            detail=age_detail, affected=F.col("n_implausible"),
        ),
        line(
            shares, "customers_without_transactions", "n_no_txn",
            "excluded: no history to analyse", pct=share_pct("n_no_txn", "n", 2), affected=F.col("n_no_txn"),
        ),
        line(_unknown(met_customers), "unknown_customers", "n_orphans", "kept without metadata"),
        line(_unknown(met_articles), "unknown_articles", "n_orphans", "kept without metadata"),
        line(_price_validity(per_price), "invalid_price", "n_invalid", "kept and flagged"),
        line(
            _price_distribution(per_price), "price_distribution", "n_txn", "no outliers removed",
            detail=price_detail,
        ),
        line(_single_purchase(per_customer), "single_purchase_customers", "n_single", "kept", pct=pct),
        line(gaps, "date_gaps", "n_gaps", "no action", detail=gap_detail),
        line(
            _listing(_distribution(per_channel), "sales_channel_id"), "sales_channels", "count",
            "used as a feature", detail=F.col("detail"),
        ),
        line(
            _listing(_distribution(per_club), "club_member_status"), "club_status", "count",
            "missing kept as a category", detail=F.col("detail"),
        ),
    ]
    report = rows[0]
    for row in rows[1:]:
        report = report.unionByName(row)
    affected = F.sum("rows_affected").over(W.partitionBy())  # one row per check
    return report.withColumn("total_rows_affected", affected)
