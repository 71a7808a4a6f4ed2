"""Plans, uneven keys, and lookups too large to broadcast."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrate.operators import affinity as aff
from stayrate.operators import cohorts, descriptives, ingest, quality, rfm
from stayrate.operators import snapshots as snap
from stayrate.plans.catalogue import QUERIES
from tests.conftest import TEST_DATA, TXN, plan_of

# Queries whose output has a row per customer or more: none may pass through one task.
WIDE = (
    "sample_transactions",
    "rfm_metrics",
    "first_purchase",
    "monthly_activity",
    "population",
    "features_all_time",
    "features_gap",
    "features_trailing",
    "features_demo",
    "lapse_label",
    "snapshot",
    "snapshots",
    "baskets",
    "basket_types",
    "customer_revenue",
    "window_spend",
    "recency_baseline",
    "risk_scores",
)


@pytest.fixture
def no_broadcast(confs):
    confs(spark__sql__autoBroadcastJoinThreshold="-1")


@pytest.mark.parametrize("name", WIDE)
def test_wide_results_stay_distributed(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, TEST_DATA))
    for word in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert word not in plan, word


def test_dates_reach_the_scan(spark, tmp_path, tables):
    path = f"{tmp_path}/t"
    tables["transactions"].write.parquet(path)
    plan = plan_of(snap.population(spark.read.parquet(path), "2001-05-09"))
    assert "GreaterThanOrEqual(t_dat,2000-05-10)" in plan and "LessThan(t_dat,2001-05-09)" in plan
    assert "ReadSchema: struct<t_dat:date,customer_id:bigint>" in plan


def test_snapshots_shuffle_by_customer_once_after_condensing(spark, no_broadcast, tmp_path, tables):
    path = f"{tmp_path}/t"
    tables["transactions"].write.parquet(path)
    txn = spark.read.parquet(path)
    plan = plan_of(snap.features_all_time(txn, "2001-05-09"))
    # first articles, days, customers; grouping by snapshot and customer adds none
    assert plan.count("Exchange hashpartitioning") == 3
    plan = plan_of(snap.features_gap(txn, "2001-05-09"))
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.fixture(scope="module")
def uneven(spark):
    """One customer, one article and one day hold a third of all rows each."""
    rng = np.random.default_rng(11)
    n = 30_000
    hot = lambda values, value: np.where(rng.random(n) < 1 / 3, value, values)
    days = pd.Timestamp("2019-01-01") + pd.to_timedelta(hot(rng.integers(0, 500, n), 250), "D")
    pdf = pd.DataFrame(
        {
            "t_dat": days.date,
            "customer_id": [f"c{i}" for i in hot(rng.integers(0, 800, n), 13)],
            "article_id": [f"a{i}" for i in hot(rng.integers(0, 60, n), 5)],
            "price": rng.integers(1, 400, n) / 4,
            "sales_channel_id": rng.integers(1, 3, n),
        }
    )
    return pdf, spark.createDataFrame(pdf, TXN).repartition(8).cache()


def test_uneven_customers(uneven, no_broadcast):
    pdf, txn = uneven
    found = rfm.rfm_metrics(txn).toPandas().set_index("customer_id").sort_index()
    grouped = pdf.groupby("customer_id")
    assert found.frequency.tolist() == grouped.t_dat.nunique().sort_index().tolist()
    assert np.allclose(found.monetary, grouped.price.sum().sort_index())
    activity = cohorts.cohort_activity(txn).groupBy().sum("n_customers").first()[0]
    months = pd.to_datetime(pdf.t_dat).dt.to_period("M")
    assert activity == pdf.assign(m=months).drop_duplicates(["customer_id", "m"]).shape[0]
    assert quality.q_duplicate_rows(txn).first()[0] == pdf.duplicated().sum()


def test_uneven_snapshots(uneven, no_broadcast):
    pdf, txn = uneven
    T = pd.Timestamp("2020-03-01")
    before = pdf[pd.to_datetime(pdf.t_dat) < T]
    found = snap.features_all_time(txn, "2020-03-01").toPandas().set_index("customer_id")
    grouped = before.groupby("customer_id")
    expected = pd.DataFrame({"n": grouped.size(), "articles": grouped.article_id.nunique()})
    expected = expected.loc[found.index]
    assert found.txn_count_all.tolist() == expected.n.tolist()
    assert found.n_distinct_articles.tolist() == expected.articles.tolist()


def test_uneven_articles_and_baskets(spark, uneven, no_broadcast, monkeypatch):
    pdf, txn = uneven
    names = [f"a{i}" for i in range(60)]
    art = spark.createDataFrame(
        [(a, f"t{i % 25:02d}", f"g{i % 4}") for i, a in enumerate(names)],
        "article_id string, product_type_name string, product_group_name string",
    )
    lookup = {a: f"t{i % 25:02d}" for i, a in enumerate(names)}
    items = pdf.assign(item=pdf.article_id.map(lookup)).drop_duplicates(["customer_id", "t_dat", "item"])
    joined = items.merge(items, on=["customer_id", "t_dat"])
    joined = joined[joined["item_x"] < joined["item_y"]]
    expected = joined.groupby(["item_x", "item_y"]).size().to_dict()
    monkeypatch.setattr("stayrate.functions.joins.MAX_BROADCAST_ROWS", 10)
    rows = aff.basket_rows(txn, art)
    found = {(r.item_a, r.item_b): r.pair_count for r in aff.pair_counts(rows).collect()}
    assert found == expected
    assert "_salt" in plan_of(rows)
    monkeypatch.setattr(aff, "BLOCK_ITEMS", 6)
    assert {(r.item_a, r.item_b): r.pair_count for r in aff.pair_counts(rows).collect()} == expected
    mix = {r.product_group_name: r.revenue for r in descriptives.product_mix(txn, art).collect()}
    groups = pdf.price.groupby(pdf.article_id.map({a: f"g{i % 4}" for i, a in enumerate(names)})).sum()
    assert mix == pytest.approx(groups.to_dict())
    assert quality.q_orphan_articles(txn, art.where("article_id <> 'a5'")).first()[0] == (
        pdf.article_id == "a5"
    ).sum()


def test_copies_of_one_row_spread_over_files(spark, confs, tmp_path, make):
    confs(spark__sql__adaptive__coalescePartitions__enabled="false")
    one = make.txn([("2020-01-01", "x")])
    txn = one.join(spark.range(20_000)).drop("id").unionByName(make.txn([("2020-01-02", "y")]))
    ingest.write_clustered(txn, f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert stored.count() == 20_001 and stored.columns == txn.columns
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 10_000


def test_results_do_not_depend_on_partitions(spark, confs, tables):
    summary = lambda: sorted(
        map(tuple, rfm.segment_summary(
            rfm.rfm_segment(rfm.rfm_scores(rfm.rfm_metrics(tables["transactions"])))
        ).collect())
    )
    few = summary()
    confs(
        spark__sql__shuffle__partitions="23",
        spark__sql__adaptive__enabled="false",
        spark__sql__autoBroadcastJoinThreshold="-1",
    )
    assert summary() == few


def test_checkpoints_go_to_the_configured_folder(spark):
    from stayrate.sources import materialise, scratch_path

    kept = materialise(spark.range(10))
    assert kept.count() == 10
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = spark.sparkContext.getCheckpointDir()
    if configured is not None:
        assert configured.removeprefix("file:") in folder
    assert scratch_path(spark, "x").startswith(folder)
