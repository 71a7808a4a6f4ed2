"""Purchase days with first-seen articles: values, one read of the facts, storage in buckets."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrate.operators import cohorts, rfm, sizing
from stayrate.operators import snapshots as snap
from stayrate.operators.purchases import (
    purchase_days,
    purchase_days_with_articles,
    store_purchase_days,
    with_gaps,
)
from tests.conftest import TXN, plan_of


def _random_rows(n, seed=3):
    pick = random.Random(seed)
    days = pd.date_range("2020-01-01", periods=12).strftime("%Y-%m-%d")
    customers = ["hot"] * 6 + ["b", "c", "d", None]
    return [
        (
            pick.choice(days),
            pick.choice(customers),
            pick.choice(["x", "y", "z", "w", None]),
            pick.choice([1.0, 2.5, None]),
            pick.choice([1, 2, None]),
        )
        for _ in range(n)
    ]


def test_days_and_first_articles_against_a_loop(make):
    rows = _random_rows(300)
    expected, seen = {}, set()
    for day, customer, article, price, channel in sorted(rows, key=lambda r: r[0]):
        if customer is None:
            continue
        entry = expected.setdefault((customer, day), [0, None, 0, 0, None, 0])
        entry[0] += 1
        if price is not None:
            entry[1] = (entry[1] or 0.0) + price
            entry[2] += 1
        entry[3] += channel == 2
        if channel is not None:
            entry[4] = channel if entry[4] is None else min(entry[4], channel)
        if article is not None and (customer, article) not in seen:
            seen.add((customer, article))
            entry[5] += 1
    found = purchase_days_with_articles(make.txn(rows)).collect()
    assert len(found) == len(expected)
    for r in found:
        values = [r.n_items, r.spend, r.n_priced, r.n_online, r.channel, r.n_new_articles]
        assert values == expected[r.customer_id, str(r.t_dat)]


def test_days_without_rows(spark):
    assert purchase_days_with_articles(spark.createDataFrame([], TXN)).count() == 0


def test_article_days_agree_with_plain_days(tables):
    txn = tables["transactions"]
    counted = purchase_days_with_articles(txn)
    plain = purchase_days(txn)
    keys = ["customer_id", "t_dat", "n_items", "n_priced", "n_online", "channel"]
    assert counted.select(keys).exceptAll(plain.select(keys)).count() == 0
    assert counted.count() == plain.count()
    distinct = txn.where("article_id IS NOT NULL").select("customer_id", "article_id").distinct().count()
    assert counted.agg(F.sum("n_new_articles")).first()[0] == distinct


def test_article_features_read_the_facts_once(tables):
    txn, cust = tables["transactions"], tables["customers"]
    frames = (
        (2, purchase_days_with_articles(txn)),  # grouping sets, days
        (3, with_gaps(purchase_days_with_articles(txn))),  # and customers
        (3, snap.features_all_time(txn, "1997-01-01")),  # and snapshots of customers
    )
    for exchanges, frame in frames:
        plan = plan_of(frame)
        assert plan.count("FileScan") == plan_of(txn).count("FileScan")
        assert plan.count("Exchange hashpartitioning(") - plan_of(txn).count("Exchange hashpartitioning(") == exchanges
    built = plan_of(snap.snapshot(txn, cust, "1997-01-01"))
    assert built.count("FileScan") == plan_of(txn).count("FileScan") + plan_of(cust).count("FileScan")


@pytest.fixture
def stored(spark, tables):
    name = f"days_{uuid.uuid4().hex}"
    yield store_purchase_days(tables["transactions"], name, buckets=4)
    spark.sql(f"DROP TABLE {name}")


def test_bucketed_days_are_read_without_exchange(spark, tables, stored, confs):
    confs(spark__sql__autoBroadcastJoinThreshold="-1")
    frames = {
        "gaps": lambda t: with_gaps(t),
        "rfm": lambda t: rfm.rfm_metrics(t, "1998-12-31"),
        "first": cohorts.first_purchase,
        "trailing": lambda t: snap.features_trailing(t, "1997-01-01"),
        "all_time": lambda t: snap.features_all_time(t, "1997-01-01"),
        "label": lambda t: snap.lapse_label(t, "1997-01-01"),
        "spend": lambda t: sizing.window_spend(t, "1997-01-01"),
    }
    for name, build in frames.items():
        plan = plan_of(build(stored))
        assert "Exchange" not in plan, name
    assert "hashpartitioning(customer_id" not in plan_of(cohorts.cohort_activity(stored))
    # Metrics meet features of the same customers where both lie.
    scored = frames["rfm"](stored).join(frames["label"](stored), "customer_id")
    assert "Exchange" not in plan_of(scored)
    assert sorted(scored.columns) == sorted(["customer_id", "recency_days", "frequency", "monetary", "lapsed"])


def test_bucketed_days_give_the_same_results(tables, stored):
    txn, cust = tables["transactions"], tables["customers"]
    assert stored.count() == purchase_days(txn).count()
    exact = ("customer_id", "recency_days", "frequency")
    left, right = rfm.rfm_metrics(stored), rfm.rfm_metrics(txn)
    assert left.select(*exact).exceptAll(right.select(*exact)).count() == 0
    assert cohorts.cohort_activity(stored).exceptAll(cohorts.cohort_activity(txn)).count() == 0
    windows = snap.snapshot_windows(txn)
    counts = ("customer_id", "snapshot", "txn_count_all", "n_distinct_articles", "avg_gap_days", "lapsed")
    left = snap.snapshots(stored, cust, windows).select(*counts)
    right = snap.snapshots(txn, cust, windows).select(*counts)
    assert left.count() == right.count() and left.exceptAll(right).count() == 0
