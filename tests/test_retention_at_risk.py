"""Denominators of customers whose month lies inside the data, and gaps of all first channels."""

import random

import pandas as pd

from stayrate.operators import cohorts


def _txn(make):
    pick = random.Random(11)
    days = pd.date_range("2020-01-01", "2020-09-20").strftime("%Y-%m-%d")
    return make.txn(
        [(pick.choice(days), f"c{pick.randrange(60)}", "a", 1.0, pick.choice([1, 2, 3, None])) for _ in range(240)]
    )


def _number(month):
    return month.year * 12 + month.month


def test_at_risk_against_a_loop(make):
    txn = _txn(make)
    first = cohorts.first_purchase(txn).collect()
    activity = cohorts.cohort_activity(txn)
    months = {(r.customer_id, _number(r.activity_month)) for r in cohorts.monthly_activity(txn).collect()}
    last = max(m for _, m in months)
    for last_month, end in ((None, last), ("2020-08-15", last - 1)):
        sizes = cohorts.at_risk(activity, "first_channel", last_month)
        found = cohorts.channel_retention(activity, sizes, digits=None).collect()
        cells = {(r.first_channel, r.months_since): (r.n_customers, r.cohort_size) for r in found}
        expected = {}
        for r in first:
            for since in range(end - _number(r.cohort_month) + 1):
                cell = expected.setdefault((r.first_channel, since), [0, 0])
                cell[0] += (r.customer_id, _number(r.cohort_month) + since) in months
                cell[1] += 1
        sized = {(r.first_channel, r.months_since): r.cohort_size for r in sizes.collect()}
        assert sized == {k: v[1] for k, v in expected.items()}
        if last_month is None:
            assert cells == {k: tuple(v) for k, v in expected.items() if v[0]}


def test_cohorts_keep_their_denominators(make):
    """All customers of a cohort reach the same months, so only the mix of channels changes."""
    activity = cohorts.cohort_activity(_txn(make))
    plain = cohorts.cohort_retention(activity, cohorts.sizes_of(activity, "cohort_month"))
    at_risk = cohorts.cohort_retention(activity, cohorts.at_risk(activity, "cohort_month"))
    assert plain.exceptAll(at_risk).count() == 0 and at_risk.count() == plain.count()


def test_gaps_of_every_first_channel(make):
    txn = make.txn(
        [
            ("2020-01-01", "a", "i", 1.0, 1), ("2020-07-01", "a", "i", 1.0, 2),
            ("2020-01-01", "b", "i", 1.0, 1),
            ("2020-01-01", "c", "i", 1.0, 3), ("2020-07-09", "c", "i", 1.0, 1),
            ("2020-01-01", "d", "i", 1.0, None), ("2020-07-09", "d", "i", 1.0, 1),
            ("2020-01-01", "e", "i", 1.0, None),
            ("2020-05-01", "f", "i", 1.0, 2),
        ]
    )
    activity = cohorts.cohort_activity(txn)
    plain = cohorts.channel_retention(activity, cohorts.sizes_of(activity, "first_channel"))
    found = {r.first_channel: (r.n_active, r.retention_pct, r.gap_pp) for r in cohorts.channel_gaps(plain).collect()}
    assert found == {1: (1, 50.0, 50.0), 2: (0, 0.0, 100.0), 3: (1, 100.0, 0.0), None: (1, 50.0, 50.0)}


def test_empty_activity(make):
    activity = cohorts.cohort_activity(make.txn([]))
    assert cohorts.at_risk(activity, "first_channel").count() == 0
    assert cohorts.channel_gaps(cohorts.channel_retention(activity, cohorts.at_risk(activity, "first_channel"))).count() == 0
