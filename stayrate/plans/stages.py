"""The whole analysis as stages that read stored tables and write their results.

A stage writes wide tables (one row per customer) as Parquet under ``<root>/data`` and
small results under ``<root>/results`` as JSON, or CSV for the report tables. Later
stages read what earlier ones stored, so any stage can be run again on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.config import DEFAULT, RetentionConfig
from stayrate.operators import affinity, cohorts, descriptives, ingest, kpis, metrics, model
from stayrate.operators import quality, rfm, sizing, snapshots
from stayrate.operators.purchases import purchase_days_with_articles
from stayrate.sources import read_tables


class Store:
    """Where the stages keep their tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def data_path(self, name: str) -> str:
        return f"{self.root}/data/{name}.parquet"

    def data(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.data_path(name))

    def save_data(self, name: str, df: DataFrame) -> DataFrame:
        ingest.write_result(df, self.data_path(name))
        return self.data(name)

    def result(self, name: str, fmt: str = "json") -> DataFrame:
        return self.spark.read.option("header", True).format(fmt).load(
            f"{self.root}/results/{name}.{fmt}"
        )

    def save_result(self, name: str, df: DataFrame, fmt: str = "json") -> DataFrame:
        """Write a small result to one file; return the frame that was written.

        The rows are shuffled to one task at the very end, so what computes them stays spread.
        """
        ingest.write_result(df.repartition(1), f"{self.root}/results/{name}.{fmt}", fmt)
        return df


def ingest_stage(
    store: Store, source: str, cfg: RetentionConfig = DEFAULT, sample: bool = False, fmt: str = "csv"
) -> dict[str, DataFrame]:
    """Read the delivered tables, profile them, and store all customers or a sample."""
    raw = read_tables(store.spark, source, fmt=fmt)
    kept = ingest.sample_tables(raw, cfg.sample_fraction, cfg.random_seed) if sample else raw
    ingest.write_clustered(kept["transactions"], store.data_path("transactions"))
    store.save_data("customers", kept["customers"])
    store.save_data("articles", kept["articles"])
    stored = {name: store.data(name) for name in raw}

    profile = ingest.schema_profile(raw)
    stats = ingest.table_stats(raw["transactions"], raw["customers"], raw["articles"])
    counts = ingest.reconcile_counts(raw, stored)
    store.save_result("schema", profile)
    store.save_result("table_stats", stats)
    store.save_result("reconciliation", counts)
    if not sample:
        ingest.check_reconciled(counts)
    days = purchase_days_with_articles(stored["transactions"], cfg.online_channel)
    store.save_data("purchase_days", days)
    return stored


def quality_stage(store: Store, cfg: RetentionConfig = DEFAULT) -> DataFrame:
    txn, cust, art = (store.data(name) for name in ("transactions", "customers", "articles"))
    return store.save_result("quality", quality.quality_report(txn, cust, art, cfg), "csv")


def descriptives_stage(store: Store, cfg: RetentionConfig = DEFAULT) -> dict[str, DataFrame]:
    txn, art = store.data("transactions"), store.data("articles")
    daily = store.save_data("daily_totals", descriptives.daily_totals(txn))
    weekly = descriptives.weekly_index(store.save_data("weekly", descriptives.weekly_revenue(txn)))
    monthly = descriptives.seasonality_index(descriptives.monthly_revenue(daily))
    revenue = store.save_data(
        "customer_revenue", descriptives.customer_revenue(store.data("purchase_days"))
    )
    results = {
        "weekly_index": weekly,
        "weekly_extremes": descriptives.weekly_extremes(weekly),
        "channel_weekly": descriptives.channel_weekly(daily),
        "channel_share": descriptives.channel_share(daily),
        "channel_weekly_share": descriptives.channel_weekly_share(daily, cfg.channels),
        "product_mix": descriptives.product_mix(txn, art),
        "lorenz_curve": descriptives.lorenz_curve(revenue),
        "top_share": descriptives.top_share(revenue),
        "gini": descriptives.gini(revenue),
        "seasonality_index": monthly,
        "seasonality_peak": descriptives.seasonality_peak(monthly),
    }
    return {name: store.save_result(name, df) for name, df in results.items()}


def segments_stage(store: Store, cfg: RetentionConfig = DEFAULT) -> DataFrame:
    scores = rfm.rfm_scores(rfm.rfm_metrics(store.data("purchase_days")), cfg.n_quantiles)
    seg = store.save_data("rfm_segments", rfm.rfm_segment(scores, cfg.segment_rules))
    broken = rfm.rfm_integrity(seg).first()
    if broken["n_duplicated"] or broken["n_without_segment"]:
        raise ValueError(f"segments are not a partition of the customers: {broken}")
    summary = rfm.segment_summary(seg).orderBy(F.desc("revenue_share_pct"), "segment")
    store.save_result("quintile_bounds", rfm.quintile_bounds(seg))
    return store.save_result("segments", summary, "csv")


def cohorts_stage(store: Store) -> dict[str, DataFrame]:
    days = store.data("purchase_days")
    first = store.save_data("first_purchase", cohorts.first_purchase(days))
    activity = store.save_data("cohort_activity", cohorts.cohort_activity(days))
    retention = cohorts.cohort_retention(activity, cohorts.cohort_sizes(first))
    by_channel = cohorts.channel_retention(activity, cohorts.channel_sizes(first))
    matrix = cohorts.retention_matrix(retention)
    store.save_result("cohort_retention", matrix.orderBy("cohort_month"), "csv")
    results = {
        "avg_retention": cohorts.avg_retention(matrix),
        "channel_retention": by_channel,
        "channel_gap_m6": cohorts.channel_gap_m6(by_channel),
    }
    return {name: store.save_result(name, df) for name, df in results.items()}


def snapshots_stage(store: Store, cfg: RetentionConfig = DEFAULT) -> DataFrame:
    """The three snapshots as one table, partitioned by snapshot."""
    days, cust = store.data("purchase_days"), store.data("customers")
    windows = snapshots.snapshot_windows(days, cfg)
    built = snapshots.snapshots(days, cust, windows, cfg)
    path = store.data_path("snapshots")
    built.write.mode("overwrite").partitionBy("snapshot").parquet(path)
    stored = store.data("snapshots")
    snapshots.check_leakage(stored, days)
    store.save_result("snapshots", snapshots.snapshot_summary(stored))
    store.save_result("gap_distribution", snapshots.gap_distribution(days))
    return stored


def model_stage(
    store: Store,
    cfg: RetentionConfig = DEFAULT,
    grid: Sequence[Mapping[str, Any]] | None = None,
) -> dict[str, DataFrame]:
    """Fit on train, select and calibrate on val, score test once."""
    snaps = store.data("snapshots")
    names = snapshots.feature_names(cfg)
    train, val, test = (
        model.feature_vector(snaps.where(F.col("snapshot") == part), names)
        for part in ("train", "val", "test")
    )
    logistic = model.logistic_select(train, val, cfg.logistic_c)
    boosted = model.gbt_grid(train, val, grid, cfg)
    calibration = model.isotonic_calibrate(model.score(boosted.model, val))
    raw = store.save_data("test_scores", model.score(boosted.model, test))
    calibrated = model.calibrate(calibration, raw)
    predictions = store.save_data(
        "test_predictions", model.risk_scores(store.save_data("calibrated_scores", calibrated))
    )
    probabilities = predictions.withColumn("score", F.col("prob_lapse"))
    lift = metrics.lift_by_decile(probabilities)
    comparison = model.model_comparison(
        {
            "recency": model.recency_baseline(snaps.where(F.col("snapshot") == "test")),
            "logistic": model.score(logistic.model, test),
            "boosted": raw,
            "boosted_calibrated": probabilities,
        },
        params={"logistic": logistic.params, "boosted": boosted.params, "boosted_calibrated": boosted.params},
    )
    results = {
        "model_comparison": comparison,
        "lift_by_decile": lift.orderBy("decile"),
        "top_capture": metrics.top_capture(lift),
        "calibration_bins": metrics.calibration_bins(probabilities),
        "feature_importance": model.feature_importance(boosted.model, test, names).orderBy(
            F.desc("auc_drop"), "feature"
        ),
    }
    return {name: store.save_result(name, df, "csv") for name, df in results.items()}


def affinity_stage(
    store: Store, cfg: RetentionConfig = DEFAULT, item_col: str = "product_type_name"
) -> DataFrame:
    txn, art = store.data("transactions"), store.data("articles")
    rows = affinity.basket_rows(txn, art, item_col)
    store.save_result("n_baskets", affinity.n_baskets(rows))
    pairs = affinity.affinity_pairs(rows, cfg.min_support, cfg.min_pair_count)
    return store.save_result("affinity_top_pairs", affinity.affinity_top(pairs, cfg.top_n_pairs), "csv")


def sizing_stage(store: Store, cfg: RetentionConfig = DEFAULT) -> dict[str, DataFrame]:
    days = store.data("purchase_days")
    test_date = snapshots.snapshot_windows(days, cfg)[-1].date
    spend = sizing.window_spend(days, test_date, cfg.label_window_weeks)
    value = store.save_data(
        "cohort_value",
        sizing.cohort_value(store.data("test_predictions"), store.data("rfm_segments"), spend),
    )
    results = {
        "value_at_risk": sizing.value_at_risk(value, cfg),
        "sizing_scenarios": sizing.uplift_scenarios(value, cfg=cfg),
        "sizing_assumptions": sizing.assumptions(value, cfg),
    }
    return {name: store.save_result(name, df, "csv") for name, df in results.items()}


def kpis_stage(store: Store, cfg: RetentionConfig = DEFAULT) -> DataFrame:
    """The headline numbers, from the stored results."""
    probabilities = store.data("test_predictions").withColumn("score", F.col("prob_lapse"))
    value = store.data("cohort_value")
    retention = store.result("avg_retention")
    if "avg_m6" not in retention.columns:  # JSON leaves out what is NULL in all rows
        retention = retention.withColumn("avg_m6", F.lit(None).cast("double"))
    pairs = store.result("affinity_top_pairs", "csv").withColumn("lift", F.col("lift").cast("double"))
    found = kpis.headline_kpis(
        rfm.segment_summary(store.data("rfm_segments")),
        retention,
        metrics.lift_by_decile(probabilities),
        sizing.value_at_risk(value, cfg, digits=2),
        sizing.uplift_scenarios(value, cfg=cfg),
        pairs,
    )
    return store.save_result("headline_kpis", found)


def run_all(
    spark: SparkSession,
    source: str,
    root: str,
    cfg: RetentionConfig = DEFAULT,
    sample: bool = False,
    fmt: str = "csv",
    grid: Sequence[Mapping[str, Any]] | None = None,
) -> Store:
    """Run every stage in order; results are left in the returned store."""
    store = Store(spark, root)
    ingest_stage(store, source, cfg, sample, fmt)
    quality_stage(store, cfg)
    descriptives_stage(store, cfg)
    segments_stage(store, cfg)
    cohorts_stage(store)
    snapshots_stage(store, cfg)
    model_stage(store, cfg, grid)
    affinity_stage(store, cfg)
    sizing_stage(store, cfg)
    kpis_stage(store, cfg)
    return store
