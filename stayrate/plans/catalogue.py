"""Every operator as a query over a directory of warehouse tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate import sources
from stayrate.config import RetentionConfig
from stayrate.functions import clean_age as clean_age_column
from stayrate.functions import quantile_bins as add_quantile_bins
from stayrate.functions import rank_quantile_bins as add_rank_quantile_bins
from stayrate.operators import affinity as aff
from stayrate.operators import audits, cohorts, descriptives, ingest, kpis, metrics, model
from stayrate.operators import quality, rfm, sizing
from stayrate.operators import snapshots as snap
from stayrate.operators.purchases import purchase_days, purchase_days_with_articles
from stayrate.sources import (
    SCHEMAS,
    export_csv,
    materialise,
    retail_tables,
    scratch_path,
)

CFG = RetentionConfig()

# The product names of the test tables are spread so evenly that no pair reaches the
# default support at every scale.
PAIR_SUPPORT = 0.004
TRIPLE_SUPPORT = 0.002

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


class _Tables:
    """The three retail tables of a directory, with what several queries derive from them."""

    def __init__(self, spark: SparkSession, path: str, item_column: str = "p_name"):
        tables = retail_tables(spark, path, item_column)
        self.all = tables
        self.txn = tables["transactions"]
        self.cust = tables["customers"]
        self.art = tables["articles"]

    @cached_property
    def windows(self) -> list[snap.SnapshotWindow]:
        return snap.snapshot_windows(self.txn, CFG)

    @property
    def test_date(self) -> datetime.date:
        return self.windows[-1].date

    @cached_property
    def days(self) -> DataFrame:
        """The transactions per customer and day, stored for queries that read them several times."""
        return materialise(purchase_days(self.txn, CFG.online_channel))

    @cached_property
    def days_test_date(self) -> datetime.date:
        return snap.snapshot_windows(self.days, CFG)[-1].date

    def snapshots(self, *columns: str) -> DataFrame:
        """The three snapshots; with ``columns``, what only other columns need is not computed."""
        articles = not columns or "n_distinct_articles" in columns
        built = snap.snapshots(self.txn, self.cust, self.windows, CFG, articles)
        return materialise(built.select(*columns) if columns else built)

    def segments(self) -> DataFrame:
        return rfm.rfm_segment(rfm.rfm_scores(rfm.rfm_metrics(self.days), CFG.n_quantiles))

    def baseline(self, date: datetime.date | None = None) -> DataFrame:
        """The test population scored by recency."""
        history = snap.recency_and_label(self.days, date or self.days_test_date, CFG)
        return model.recency_baseline(materialise(history))

    def baseline_risk(self) -> DataFrame:
        return model.risk_scores(self.baseline(), "score", bounded=True)

    def value(self) -> DataFrame:
        spend = sizing.window_spend(self.days, self.days_test_date, CFG.label_window_weeks)
        return sizing.cohort_value(self.baseline_risk(), self.segments(), spend)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round values whose last bits depend on the order of a floating-point sum."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Sources, sinks and ingest


@_query
def read_tables(spark, path):
    t = _Tables(spark, path)
    target = scratch_path(spark, "csv")
    export_csv(t.all, target)
    back = sources.read_tables(spark, target, {name: df.schema for name, df in t.all.items()})
    stats = ingest.table_stats(back["transactions"], back["customers"], back["articles"])
    spend = back["transactions"].agg(F.sum("price").cast("string").alias("value"))
    return stats.unionByName(
        spend.select(F.lit("transactions").alias("table"), F.lit("spend").alias("stat"), "value")
    )


@_query
def read_tables_parquet(spark, path):
    t = _Tables(spark, path)
    target = scratch_path(spark, "stored")
    for name, df in t.all.items():
        ingest.write_result(df, f"{target}/{name}.parquet")
    return ingest.row_counts(sources.read_tables(spark, target, SCHEMAS, fmt="parquet"))


@_query
def schema_profile(spark, path):
    return ingest.schema_profile(_Tables(spark, path).all)


@_query
def table_stats(spark, path):
    t = _Tables(spark, path)
    return ingest.table_stats(t.txn, t.cust, t.art)


@_query
def hash_sample_ids(spark, path):
    return ingest.hash_sample_ids(_Tables(spark, path).cust)


@_query
def sample_tables(spark, path):
    return ingest.row_counts(ingest.sample_tables(_Tables(spark, path).all))


@_query
def sample_transactions(spark, path):
    return ingest.sample_tables(_Tables(spark, path).all)["transactions"]


@_query
def write_clustered(spark, path):
    target = scratch_path(spark, "clustered")
    ingest.write_clustered(_Tables(spark, path).txn, target)
    stored = spark.read.parquet(target)
    return stored.groupBy("t_dat").agg(
        F.count(F.lit(1)).alias("n_txns"), F.sum("price").cast("double").alias("revenue")
    )


@_query
def reconcile_counts(spark, path):
    t = _Tables(spark, path)
    target = scratch_path(spark, "stored")
    for name, df in t.all.items():
        ingest.write_result(df, f"{target}/{name}.parquet")
    return ingest.reconcile_counts(t.all, sources.read_tables(spark, target, SCHEMAS, fmt="parquet"))


@_query
def write_result(spark, path):
    result = descriptives.monthly_revenue(_Tables(spark, path).txn)
    target = scratch_path(spark, "result")
    stored = None
    for fmt in ("parquet", "json", "csv"):
        ingest.write_result(result, f"{target}/{fmt}", fmt)
        reader = spark.read.schema(result.schema).option("header", True).format(fmt)
        back = reader.load(f"{target}/{fmt}").withColumn("fmt", F.lit(fmt))
        stored = back if stored is None else stored.unionByName(back)
    return stored


# Data quality


@_query
def q_duplicate_rows(spark, path):
    lineitem = spark.read.parquet(f"{path}/lineitem.parquet")
    return quality.q_duplicate_rows(lineitem, ["l_orderkey", "l_linenumber"])


@_query
def q_duplicate_transactions(spark, path):
    return quality.q_duplicate_rows(_Tables(spark, path).txn)


@_query
def q_missing_age(spark, path):
    return quality.q_missing_age(_Tables(spark, path).cust)


@_query
def q_implausible_age(spark, path):
    return quality.q_implausible_age(_Tables(spark, path).cust)


@_query
def clean_age(spark, path):
    return _Tables(spark, path).cust.select(
        "customer_id", clean_age_column("age").cast("double").alias("age")
    )


@_query
def q_customers_no_txn(spark, path):
    t = _Tables(spark, path)
    return quality.q_customers_no_txn(t.cust, t.txn)


@_query
def q_orphan_customers(spark, path):
    t = _Tables(spark, path)
    return quality.q_orphan_customers(t.txn, t.cust)


@_query
def q_orphan_articles(spark, path):
    t = _Tables(spark, path)
    return quality.q_orphan_articles(t.txn, t.art)


@_query
def q_price_validity(spark, path):
    return quality.q_price_validity(_Tables(spark, path).txn)


@_query
def q_price_distribution(spark, path):
    found = quality.q_price_distribution(_Tables(spark, path).txn)
    return _rounded(found, 6, "p25", "p50", "p75", "p99")


@_query
def q_single_purchase(spark, path):
    return quality.q_single_purchase(_Tables(spark, path).txn)


@_query
def q_date_gaps(spark, path):
    return quality.q_date_gaps(_Tables(spark, path).txn)


@_query
def q_max_gap_date(spark, path):
    return quality.q_max_gap_date(_Tables(spark, path).txn)


@_query
def q_channel_distribution(spark, path):
    return quality.q_channel_distribution(_Tables(spark, path).txn)


@_query
def q_club_distribution(spark, path):
    return quality.q_club_distribution(_Tables(spark, path).cust)


@_query
def quality_report(spark, path):
    t = _Tables(spark, path)
    return quality.quality_report(t.txn, t.cust, t.art, CFG)


# Revenue descriptives


@_query
def weekly_revenue(spark, path):
    return descriptives.weekly_revenue(_Tables(spark, path).txn)


@_query
def weekly_index(spark, path):
    return descriptives.weekly_index(descriptives.weekly_revenue(_Tables(spark, path).txn))


@_query
def weekly_extremes(spark, path):
    weekly = descriptives.weekly_revenue(_Tables(spark, path).txn)
    return descriptives.weekly_extremes(descriptives.weekly_index(weekly))


@_query
def channel_weekly(spark, path):
    return descriptives.channel_weekly(_Tables(spark, path).txn)


@_query
def channel_share(spark, path):
    return descriptives.channel_share(_Tables(spark, path).txn)


@_query
def channel_weekly_share(spark, path):
    return descriptives.channel_weekly_share(_Tables(spark, path).txn, CFG.channels)


@_query
def product_mix(spark, path):
    t = _Tables(spark, path)
    return descriptives.product_mix(t.txn, t.art)


@_query
def customer_revenue(spark, path):
    totals = descriptives.customer_revenue(_Tables(spark, path).txn)
    return totals.withColumn("total_rev", F.col("total_rev").cast("double"))


@_query
def lorenz_curve(spark, path):
    revenue = descriptives.customer_revenue(_Tables(spark, path).txn)
    return _rounded(descriptives.lorenz_curve(revenue), 9, "revenue_share")


@_query
def top_share(spark, path):
    revenue = descriptives.customer_revenue(_Tables(spark, path).txn)
    return _rounded(descriptives.top_share(revenue), 9, "revenue_share")


@_query
def gini(spark, path):
    revenue = descriptives.customer_revenue(_Tables(spark, path).txn)
    return _rounded(descriptives.gini(revenue), 9, "gini")


@_query
def monthly_revenue(spark, path):
    return descriptives.monthly_revenue(_Tables(spark, path).txn)


@_query
def seasonality_index(spark, path):
    return descriptives.seasonality_index(descriptives.monthly_revenue(_Tables(spark, path).txn))


@_query
def seasonality_peak(spark, path):
    monthly = descriptives.monthly_revenue(_Tables(spark, path).txn)
    return descriptives.seasonality_peak(descriptives.seasonality_index(monthly))


# RFM segmentation


@_query
def rfm_metrics(spark, path):
    found = rfm.rfm_metrics(_Tables(spark, path).txn)
    return found.withColumn("monetary", F.col("monetary").cast("double"))


@_query
def quantile_bins(spark, path):
    found = materialise(rfm.rfm_metrics(_Tables(spark, path).txn))
    binned = add_quantile_bins(found, "recency_days", 5, "recency_bin", bounded=True)
    binned = add_quantile_bins(binned, "monetary", 10, "monetary_bin")
    binned = add_quantile_bins(binned, "frequency", 20, "frequency_bin", bounded=True)
    return binned.select("customer_id", "recency_bin", "monetary_bin", "frequency_bin")


@_query
def rank_quantile_bins(spark, path):
    found = rfm.rfm_metrics(_Tables(spark, path).txn)
    binned = add_rank_quantile_bins(found, "frequency", 5, "customer_id", "frequency_bin")
    return binned.select("customer_id", "frequency", "frequency_bin")


@_query
def rfm_scores(spark, path):
    found = rfm.rfm_scores(rfm.rfm_metrics(_Tables(spark, path).txn), CFG.n_quantiles)
    return found.select("customer_id", "R_q", "F_q", "M_q")


@_query
def rfm_segment(spark, path):
    return _Tables(spark, path).segments().select("customer_id", "segment")


@_query
def rfm_integrity(spark, path):
    return rfm.rfm_integrity(_Tables(spark, path).segments())


@_query
def segment_summary(spark, path):
    return rfm.segment_summary(_Tables(spark, path).segments())


@_query
def segment_monetary_index(spark, path):
    summary = rfm.segment_summary(_Tables(spark, path).segments())
    return summary.select("segment", "avg_monetary_index")


@_query
def quintile_bounds(spark, path):
    return rfm.quintile_bounds(materialise(_Tables(spark, path).segments()))


# Cohort retention


@_query
def first_purchase(spark, path):
    return cohorts.first_purchase(_Tables(spark, path).txn)


@_query
def monthly_activity(spark, path):
    return cohorts.monthly_activity(_Tables(spark, path).txn)


@_query
def cohort_activity(spark, path):
    return cohorts.cohort_activity(_Tables(spark, path).txn)


@_query
def cohort_sizes(spark, path):
    return cohorts.cohort_sizes(cohorts.first_purchase(_Tables(spark, path).txn))


def _retention(t: _Tables) -> DataFrame:
    activity = cohorts.cohort_activity(t.txn)
    return cohorts.cohort_retention(activity, cohorts.sizes_of(activity, "cohort_month"))


def _channel_retention(t: _Tables) -> DataFrame:
    activity = cohorts.cohort_activity(t.txn)
    return cohorts.channel_retention(activity, cohorts.sizes_of(activity, "first_channel"))


@_query
def cohort_retention(spark, path):
    return _retention(_Tables(spark, path))


@_query
def retention_matrix(spark, path):
    return cohorts.retention_matrix(_retention(_Tables(spark, path)))


@_query
def avg_retention(spark, path):
    matrix = cohorts.retention_matrix(_retention(_Tables(spark, path)))
    return _rounded(cohorts.avg_retention(matrix), 9, "avg_m3", "avg_m6")


@_query
def channel_sizes(spark, path):
    return cohorts.channel_sizes(cohorts.first_purchase(_Tables(spark, path).txn))


@_query
def channel_retention(spark, path):
    return _channel_retention(_Tables(spark, path))


@_query
def channel_gap_m6(spark, path):
    return _rounded(cohorts.channel_gap_m6(_channel_retention(_Tables(spark, path))), 9, "gap_pp")


@_query
def channel_retention_at_risk(spark, path):
    activity = materialise(cohorts.cohort_activity(_Tables(spark, path).txn))
    return cohorts.channel_retention(activity, cohorts.at_risk(activity, "first_channel"))


@_query
def channel_gaps(spark, path):
    return _rounded(cohorts.channel_gaps(_channel_retention(_Tables(spark, path))), 9, "gap_pp")


# Snapshots


@_query
def snapshot_calendar(spark, path):
    return snap.snapshot_calendar(_Tables(spark, path).txn)


@_query
def population(spark, path):
    t = _Tables(spark, path)
    return snap.population(t.txn, t.test_date, CFG.lookback_weeks)


@_query
def features_all_time(spark, path):
    t = _Tables(spark, path)
    return snap.features_all_time(t.txn, t.test_date, CFG)


@_query
def features_trailing(spark, path):
    t = _Tables(spark, path)
    return snap.features_trailing(t.txn, t.test_date, CFG)


@_query
def features_gap(spark, path):
    t = _Tables(spark, path)
    return snap.features_gap(t.txn, t.test_date, CFG)


@_query
def avg_basket_size(spark, path):
    t = _Tables(spark, path)
    return snap.avg_basket_size(t.txn, t.test_date, CFG)


@_query
def features_demo(spark, path):
    t = _Tables(spark, path)
    return snap.features_demo(t.cust, snap.population(t.txn, t.test_date, CFG.lookback_weeks), CFG)


@_query
def lapse_label(spark, path):
    t = _Tables(spark, path)
    return snap.lapse_label(t.txn, t.test_date, CFG)


@_query
def snapshot(spark, path):
    t = _Tables(spark, path)
    return snap.snapshot(t.txn, t.cust, t.test_date, CFG)


@_query
def snapshots(spark, path):
    t = _Tables(spark, path)
    return snap.snapshots(t.txn, t.cust, t.windows, CFG)


@_query
def leakage_guard(spark, path):
    t = _Tables(spark, path)
    windows = snap.snapshot_windows(t.days, CFG)
    return snap.leakage_guard(materialise(snap.snapshots(t.days, t.cust, windows, CFG, articles=False)), t.days)


@_query
def leakage_report(spark, path):
    t = _Tables(spark, path)
    days = materialise(purchase_days_with_articles(t.txn, CFG.online_channel))
    built = snap.snapshots(days, t.cust, snap.snapshot_windows(days, CFG), CFG, provenance=True)
    return snap.leakage_report(materialise(built), days)


@_query
def snapshot_summary(spark, path):
    t = _Tables(spark, path)
    return snap.snapshot_summary(snap.snapshots(t.txn, t.cust, t.windows, CFG))


@_query
def gap_distribution(spark, path):
    return snap.gap_distribution(_Tables(spark, path).txn)


# Lapse model


@_query
def feature_vector(spark, path):
    t = _Tables(spark, path)
    names = snap.feature_names(CFG)
    vectors = model.feature_vector(snap.snapshot(t.txn, t.cust, t.test_date, CFG), names)
    values = vectors.withColumn("_v", vector_to_array("features"))
    return values.select(
        "customer_id", "lapsed", *(F.col("_v")[i].alias(name) for i, name in enumerate(names))
    )


@_query
def recency_baseline(spark, path):
    return _Tables(spark, path).baseline()


def _vectors(t: _Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _split(model.feature_vector(t.snapshots(), snap.feature_names(CFG)))


def _split(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, val, test = (vectors.where(F.col("snapshot") == n) for n in ("train", "val", "test"))
    return train, val, test


@_query
def standardise(spark, path):
    train, _, test = _vectors(_Tables(spark, path))
    scaled = model.standardise(train, test)[1].withColumn("_v", vector_to_array("scaled"))
    names = snap.feature_names(CFG)
    columns = [F.round(F.col("_v")[i], 6).alias(name) for i, name in enumerate(names)]
    return scaled.select("customer_id", *columns)


def _selection(spark: SparkSession, selected: model.Selected) -> DataFrame:
    values = {**selected.params, "val_auc": selected.val_auc}
    return spark.range(1).select(*(F.lit(float(v)).alias(k) for k, v in values.items()))


@_query
def logistic_select(spark, path):
    train, val, _ = _vectors(_Tables(spark, path))
    return _selection(spark, model.logistic_select(train, val, CFG.logistic_c))


def _boosted(t: _Tables):
    train, val, test = _split(materialise(model.feature_vector(t.snapshots(), snap.feature_names(CFG))))
    chosen = model.gbt_grid(train, val, cfg=CFG)
    calibration = model.isotonic_calibrate(model.score(chosen.model, val))
    return chosen, calibration, test


@_query
def gbt_grid(spark, path):
    snaps = _Tables(spark, path).snapshots()
    train, val, _ = _split(materialise(model.feature_vector(snaps, snap.feature_names(CFG))))
    return _selection(spark, model.gbt_grid(train, val, cfg=CFG))


@_query
def isotonic_calibrate(spark, path):
    t = _Tables(spark, path)
    _, val, test = t.windows
    fitted = model.isotonic_calibrate(t.baseline(val.date))
    calibrated = model.calibrate(fitted, t.baseline(test.date))
    return _rounded(calibrated.select("customer_id", "calibrated"), 6, "calibrated")


@_query
def metric_roc_auc(spark, path):
    return metrics.metric_roc_auc(_Tables(spark, path).baseline())


@_query
def metric_avg_precision(spark, path):
    return _rounded(metrics.metric_avg_precision(_Tables(spark, path).baseline()), 9, "pr_auc")


@_query
def metric_brier(spark, path):
    return _rounded(metrics.metric_brier(_Tables(spark, path).baseline()), 9, "brier")


@_query
def model_comparison(spark, path):
    t = _Tables(spark, path)
    snaps = t.snapshots()
    train, val, test = _split(materialise(model.feature_vector(snaps, snap.feature_names(CFG))))
    logistic = model.logistic_select(train, val, CFG.logistic_c)
    boosted = model.gbt_grid(train, val, cfg=CFG)
    calibration = model.isotonic_calibrate(model.score(boosted.model, val))
    raw = model.score(boosted.model, test)
    calibrated = model.calibrate(calibration, raw).select(
        "lapsed", F.col("calibrated").alias("score")
    )
    return model.model_comparison(
        {
            "recency": model.recency_baseline(snaps.where(F.col("snapshot") == "test")),
            "logistic": model.score(logistic.model, test),
            "boosted": raw,
            "boosted_calibrated": calibrated,
        },
        params={"logistic": logistic.params, "boosted": boosted.params, "boosted_calibrated": boosted.params},
    )


@_query
def baseline_comparison(spark, path):
    """Model comparison over scores that need no training."""
    t = _Tables(spark, path)
    baseline = t.baseline()
    constant = baseline.withColumn("score", F.lit(0.5))
    inverted = baseline.withColumn("score", 1 - F.col("score"))
    scored = {"recency": baseline, "constant": constant, "inverted": inverted}
    return _rounded(model.model_comparison(scored, digits=None), 9, "pr_auc", "brier")


@_query
def lift_by_decile(spark, path):
    return _rounded(metrics.lift_by_decile(_Tables(spark, path).baseline(), bounded=True), 9, "avg_prob")


@_query
def top_capture(spark, path):
    return metrics.top_capture(metrics.lift_by_decile(_Tables(spark, path).baseline(), bounded=True))


@_query
def calibration_bins(spark, path):
    bins = metrics.calibration_bins(_Tables(spark, path).baseline())
    return _rounded(bins, 9, "mean_score")


@_query
def feature_importance(spark, path):
    chosen, _, test = _boosted(_Tables(spark, path))
    return model.feature_importance(chosen.model, test, snap.feature_names(CFG))


@_query
def risk_scores(spark, path):
    return _Tables(spark, path).baseline_risk()


@_query
def risk_scores_boosted(spark, path):
    chosen, calibration, test = _boosted(_Tables(spark, path))
    scored = model.calibrate(calibration, model.score(chosen.model, test))
    return model.risk_scores(materialise(scored))


# Basket affinity


@_query
def baskets(spark, path):
    t = _Tables(spark, path)
    return aff.baskets(t.txn, t.art)


@_query
def n_baskets(spark, path):
    t = _Tables(spark, path)
    return aff.n_baskets(aff.basket_rows(t.txn, t.art))


@_query
def item_counts(spark, path):
    t = _Tables(spark, path, "p_brand")
    return aff.item_counts(aff.basket_rows(t.txn, t.art))


@_query
def basket_types(spark, path):
    t = _Tables(spark, path, "p_brand")
    types = aff.basket_types(aff.basket_rows(t.txn, t.art))
    return types.select(F.array_join("items", "|").alias("items"), "n")


@_query
def pair_counts(spark, path):
    t = _Tables(spark, path, "p_brand")
    return aff.pair_counts(aff.basket_rows(t.txn, t.art))


@_query
def affinity_pairs(spark, path):
    t = _Tables(spark, path)
    rows = aff.basket_rows(t.txn, t.art)
    return aff.affinity_pairs(rows, PAIR_SUPPORT)


@_query
def affinity_top(spark, path):
    t = _Tables(spark, path, "p_brand")
    pairs = aff.affinity_pairs(aff.basket_rows(t.txn, t.art), CFG.min_support)
    return aff.affinity_top(pairs, CFG.top_n_pairs)


@_query
def affinity_triples(spark, path):
    t = _Tables(spark, path, "p_brand")
    return _rounded(aff.affinity_triples(aff.basket_rows(t.txn, t.art), TRIPLE_SUPPORT), 9, "lift")


@_query
def affinity_pairs_articles(spark, path):
    """Pairs of single articles, of which there are thousands."""
    t = _Tables(spark, path)
    rows = aff.basket_rows(t.txn, t.art.withColumn("name", F.col("article_id").cast("string")), "name")
    return _rounded(aff.affinity_pairs(rows, 0.0, 2), 9, "lift")


# Sizing and headline numbers


@_query
def window_spend(spark, path):
    t = _Tables(spark, path)
    found = sizing.window_spend(t.txn, t.test_date, CFG.label_window_weeks)
    return found.withColumn("spend", F.col("spend").cast("double"))


@_query
def cohort_value(spark, path):
    found = _Tables(spark, path).value()
    return found.withColumn("actual_spend", F.col("actual_spend").cast("double"))


@_query
def revenue_index(spark, path):
    return sizing.revenue_index(_Tables(spark, path).value(), CFG.revenue_index_base)


@_query
def target_group(spark, path):
    found = sizing.target_group(_Tables(spark, path).value())
    return found.withColumn("actual_spend", F.col("actual_spend").cast("double"))


@_query
def value_at_risk(spark, path):
    found = sizing.value_at_risk(_Tables(spark, path).value(), CFG)
    return _rounded(found, 9, "avg_retained_index", "value_lost_index")


@_query
def uplift_scenarios(spark, path):
    found = sizing.uplift_scenarios(_Tables(spark, path).value(), cfg=CFG, rounded=False)
    return _rounded(
        found, 9, "revenue_recovered_index", "share_of_total_pct", "break_even_cost_pct"
    )


@_query
def assumptions(spark, path):
    return sizing.assumptions(_Tables(spark, path).value(), CFG)


@_query
def headline_kpis(spark, path):
    t = _Tables(spark, path)
    segments = materialise(t.segments())
    baseline = t.baseline()
    risk = model.risk_scores(baseline, "score", bounded=True)
    spend = sizing.window_spend(t.days, t.days_test_date, CFG.label_window_weeks)
    value = materialise(sizing.cohort_value(risk, segments, spend))
    rows = aff.basket_rows(t.txn, t.art)
    pairs = aff.affinity_pairs(rows, PAIR_SUPPORT)
    found = kpis.headline_kpis(
        rfm.segment_summary(segments),
        cohorts.avg_retention(cohorts.retention_matrix(_retention(t))),
        metrics.lift_by_decile(baseline, bounded=True),
        sizing.value_at_risk(value, CFG),
        sizing.uplift_scenarios(value, cfg=CFG, rounded=False),
        aff.affinity_top(pairs, CFG.top_n_pairs),
    )
    doubles = [name for name, dtype in found.dtypes if dtype == "double"]
    return _rounded(found, 9, *doubles)


# Audits


@_query
def audit_unique(spark, path):
    t = _Tables(spark, path)
    return audits.audit_unique(snap.snapshots(t.txn, t.cust, t.windows, CFG, articles=False))


@_query
def audit_feature_dates(spark, path):
    t = _Tables(spark, path)
    return audits.audit_feature_dates(t.txn, t.snapshots("customer_id", "snapshot_date", "recency_days"))


@_query
def audit_label_retained(spark, path):
    t = _Tables(spark, path)
    return audits.audit_label_retained(t.txn, t.snapshots("customer_id", "snapshot_date", "lapsed"), CFG.label_window_weeks)


@_query
def audit_label_lapsed(spark, path):
    t = _Tables(spark, path)
    return audits.audit_label_lapsed(t.txn, t.snapshots("customer_id", "snapshot_date", "lapsed"), CFG.label_window_weeks)


@_query
def audit_spacing(spark, path):
    calendar = snap.snapshot_calendar(_Tables(spark, path).txn)
    return audits.audit_spacing(calendar, CFG.snapshot_spacing_weeks)


@_query
def audit_quintiles(spark, path):
    return audits.audit_quintiles(_Tables(spark, path).segments(), CFG.n_quantiles)


@_query
def audit_segment_rules(spark, path):
    return audits.audit_segment_rules(_Tables(spark, path).segments(), CFG.segment_rules)
