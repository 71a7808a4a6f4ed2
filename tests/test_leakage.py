"""Leaks planted in one feature family at a time are reported in that family, and only there."""

import datetime

import pytest
from pyspark.sql import functions as F

from stayrate.operators import snapshots as snap
from stayrate.operators.purchases import purchase_days, purchase_days_with_articles
from stayrate.sources.checkpoints import materialise

T = datetime.date(2020, 6, 1)
LEAKS = {
    "counts": "txn_count_12w",
    "spend": "spend_all",
    "online": "online_share",
    "gaps": "avg_gap_days",
    "articles": "n_distinct_articles",
}


@pytest.fixture(scope="module")
def txn(make):
    before = [
        ("2020-05-01", "x", "a", 1.0, 1),
        ("2020-05-20", "x", "b", 2.0, 2),
        ("2020-05-31", "y", "a", 4.0, 1),
        ("2020-05-11", "y", "a", None, 2),
    ]
    after = [("2020-06-01", "x", "c", 8.0, 2), ("2020-06-09", "y", "c", 16.0, 2)]
    return make.txn(before + after)


@pytest.fixture(scope="module")
def built(make, txn):
    cust = make.cust([("x", None, None, 30), ("y", None, None, 40)])
    return materialise(snap.snapshots(txn, cust, [snap.window_at(T)], provenance=True))


def report(snaps, txn=None):
    return {r.family: r for r in snap.leakage_report(snaps, txn).collect()}


def test_clean_snapshot(built, txn):
    for days in (None, txn, purchase_days_with_articles(txn)):
        found = report(built, days)
        assert set(found) == set(LEAKS)
        assert {r.is_safe for r in found.values()} == {True}
        assert {r.n_rows for r in found.values()} == {2}
        assert {r.n_differing for r in found.values()} == {None if days is None else 0}
    assert found["counts"].max_source_date == datetime.date(2020, 5, 31)
    assert found["gaps"].max_source_date == datetime.date(2020, 5, 31)
    assert snap.leakage_guard(built, txn).first().is_safe


def test_provenance_names_the_day_that_entered(built):
    by_id = {r.customer_id: r for r in built.collect()}
    assert by_id["x"].source_spend == datetime.date(2020, 5, 20)
    assert by_id["y"].source_spend == datetime.date(2020, 5, 31)
    assert by_id["x"].source_gaps == datetime.date(2020, 5, 20)


@pytest.mark.parametrize("family", sorted(LEAKS))
def test_value_that_saw_later_days(family, built, txn, make):
    """The leaking feature is taken as of two weeks later, all others as of the date."""
    cust = make.cust([("x", None, None, 30), ("y", None, None, 40)])
    later = snap.snapshots(txn, cust, [snap.window_at(T + datetime.timedelta(days=14))])
    leak = LEAKS[family]
    leaked = built.drop(leak).join(later.select("customer_id", leak), "customer_id")
    found = report(leaked, txn)
    assert {f for f, r in found.items() if not r.is_safe} == {family}
    assert found[family].n_differing > 0
    assert not snap.leakage_guard(leaked, txn).first().is_safe
    with pytest.raises(ValueError, match="label window"):
        snap.check_leakage(leaked, txn)


@pytest.mark.parametrize("family", sorted(LEAKS))
def test_source_day_that_is_not_past(family, built):
    """Without the transactions, the noted source days give the leak away."""
    leaked = built.withColumn(f"source_{family}", F.lit(T).cast("date"))
    found = report(leaked)
    assert {f for f, r in found.items() if not r.is_safe} == {family}
    assert not snap.leakage_guard(leaked).first().is_safe


def test_an_aggregation_that_looks_ahead_notes_it(make, txn, monkeypatch):
    """If the aggregation itself takes days from the date on, its provenance and the cut-off days show it."""
    cust = make.cust([("x", None, None, 30), ("y", None, None, 40)])
    plain = F.datediff
    monkeypatch.setattr(snap.F, "datediff", lambda a, b: plain(a, b) + 14)
    ahead = materialise(snap.snapshots(txn, cust, [snap.window_at(T)], provenance=True))
    monkeypatch.undo()
    for days in (None, txn):
        assert not any(r.is_safe for r in report(ahead, days).values())


def test_families_that_cannot_be_taken_again(built, txn):
    found = report(built.drop("source_articles"), purchase_days(txn))
    assert found["articles"].is_safe is None and found["articles"].n_differing is None
    assert found["spend"].is_safe
    assert snap.leakage_report(built.limit(0), txn).count() == 0


def test_source_columns_are_no_features(built):
    assert snap.snapshot_summary(built).first().n_features == len(snap.feature_names())
