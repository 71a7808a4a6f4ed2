"""The whole analysis from CSV files to headline numbers, on a small share of the customers."""

import pytest
from pyspark.sql import functions as F

from stayrate import config_from_mapping
from stayrate.config import DEFAULT, RetentionConfig
from stayrate.plans import stages
from stayrate.sources import SCHEMAS, export_csv, read_tables
from tests.conftest import plan_of

CFG = RetentionConfig(logistic_c=(0.01,), min_support=0.004)
GRID = [{"max_depth": 2, "learning_rate": 0.1, "n_trees": 3, "positive_weight": 1.0}]


@pytest.fixture(scope="module")
def delivery(tables, tmp_path_factory):
    """The test tables in the layout of the public data set, ids with leading zeros."""
    path = str(tmp_path_factory.mktemp("delivery"))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    full = {}
    for name, schema in SCHEMAS.items():
        df = tables[name]
        for key in ("customer_id", "article_id"):
            if key in df.columns:
                df = df.withColumn(key, pad(key))
        have = set(df.columns)
        full[name] = df.select(
            *(
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema
            )
        )
    export_csv(full, path)
    return path


@pytest.fixture(scope="module")
def store(spark, delivery, tmp_path_factory):
    return stages.run_all(spark, delivery, str(tmp_path_factory.mktemp("out")), CFG, grid=GRID)


def test_csv_keeps_leading_zeros(spark, delivery):
    back = read_tables(spark, delivery)
    assert back["articles"].where("article_id LIKE '0000%'").count() == back["articles"].count()
    assert {name: df.schema for name, df in back.items()} == dict(SCHEMAS)


def test_missing_files_and_wrong_headers_fail(spark, delivery, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_tables(spark, str(tmp_path))
    with pytest.raises(ValueError):
        read_tables(spark, delivery, fmt="orc")
    wrong = {"articles": SCHEMAS["customers"]}
    with pytest.raises(Exception):
        read_tables(spark, delivery, wrong)["articles"].collect()


def test_all_customers_are_stored(store, tables):
    assert store.data("transactions").count() == tables["transactions"].count()
    assert {r.matches for r in store.result("reconciliation").collect()} == {True}
    assert store.result("schema").count() == sum(len(s) for s in SCHEMAS.values())


def test_results_are_written(store):
    json = (
        "weekly_extremes channel_share product_mix lorenz_curve top_share gini seasonality_peak "
        "quintile_bounds avg_retention channel_retention channel_gap_m6 snapshots gap_distribution "
        "headline_kpis"
    )
    csv = (
        "quality segments cohort_retention model_comparison lift_by_decile top_capture "
        "calibration_bins feature_importance affinity_top_pairs value_at_risk sizing_scenarios "
        "sizing_assumptions"
    )
    for name in json.split():
        assert store.result(name).count() > 0, name
    for name in csv.split():
        assert store.result(name, "csv").count() > 0, name


def test_stages_agree(store, tables):
    seg, predictions = store.data("rfm_segments"), store.data("test_predictions")
    buyers = tables["transactions"].select("customer_id").distinct().count()
    assert seg.count() == buyers
    summary = {r.snapshot: r for r in store.result("snapshots").collect()}
    assert predictions.count() == summary["test"].n_customers
    assert store.data("cohort_value").count() == predictions.count()
    kpis = store.result("headline_kpis").first()
    risk = store.result("value_at_risk", "csv").first()
    assert kpis.n_target_customers == int(risk.n_target_customers)
    assert kpis.base_rate_pct == pytest.approx(
        100 * summary["test"].n_lapsed / summary["test"].n_customers
    )
    models = {r.model for r in store.result("model_comparison", "csv").collect()}
    assert models == {"recency", "logistic", "boosted", "boosted_calibrated"}


def test_snapshot_partitions_are_pruned(store):
    plan = plan_of(store.data("snapshots").where("snapshot = 'test'"))
    assert "PartitionFilters: [isnotnull(snapshot" in plan


def test_sample_run_keeps_a_share_of_the_customers(spark, delivery, tmp_path):
    store = stages.Store(spark, str(tmp_path))
    stages.ingest_stage(store, delivery, RetentionConfig(sample_fraction=0.2), sample=True)
    kept = store.data("customers").count()
    assert 0 < kept < read_tables(spark, delivery)["customers"].count()
    ids = store.data("transactions").select("customer_id").distinct().count()
    assert 0 < ids <= kept


def test_settings_mapping():
    cfg = config_from_mapping(
        {
            "random_seed": 7,
            "feature_windows_weeks": [2, 6],
            "rfm": {
                "n_quantiles": 4,
                "segments": {
                    "Lapsed": {"recency_q": [1], "frequency_q": [1], "monetary_q": [1]},
                    "Champions": {"recency_q": [4], "frequency_q": [4], "monetary_q": [4]},
                },
            },
            "affinity": {"min_support": 0.1, "min_pair_count": 50},
            "model": {"logistic_C": [1], "xgb_param_grid": {"max_depth": [2], "subsample": [0.5, 1]}},
            "sizing": {"target_deciles": [1, 2], "revenue_index_base": 10},
        }
    )
    assert [r.name for r in cfg.segment_rules] == ["Champions", "Lapsed"]
    assert (cfg.random_seed, cfg.n_quantiles, cfg.feature_windows_weeks) == (7, 4, (2, 6))
    assert (cfg.min_support, cfg.min_pair_count, cfg.row_subsamples) == (0.1, None, (0.5, 1.0))
    assert (cfg.target_deciles, cfg.revenue_index_base) == ((1, 2), 10.0)
    assert config_from_mapping({}) == DEFAULT
