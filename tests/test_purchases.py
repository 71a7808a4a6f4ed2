"""Hand-made cases of the customer-level operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from stayrate.config import DEFAULT, RetentionConfig
from stayrate.functions import clean_age
from stayrate.operators import audits, cohorts, descriptives, ingest, quality, rfm, sizing
from stayrate.operators import snapshots as snap

D = datetime.date.fromisoformat


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Ingest and quality


def test_sampling_keeps_all_articles_and_only_known_customers(spark, make):
    ids = [f"c{i}" for i in range(200)]
    tables = {
        "transactions": make.txn([("2020-01-01", c) for c in [*ids, "stranger"]]),
        "customers": make.cust([(c, None, None, None) for c in ids]),
        "articles": make.art([("a", "t", "g"), ("b", "t", "g")]),
    }
    some = ingest.sample_tables(tables, 0.5, 42)
    chosen = {r[0] for r in ingest.hash_sample_ids(tables["customers"], fraction=0.5).collect()}
    assert 0 < len(chosen) < 200
    assert {r.customer_id for r in some["transactions"].collect()} == chosen
    assert {r.customer_id for r in some["customers"].collect()} == chosen
    assert some["articles"].count() == 2
    none = ingest.sample_tables(tables, 0.0, 42)
    assert none["transactions"].count() == 0 and none["customers"].count() == 0
    everyone = ingest.sample_tables(tables, 1.0, 42)
    assert everyone["transactions"].count() == 200


def test_reconciliation_reports_lost_rows(spark, make):
    full = {"articles": make.art([("a", "t", "g"), ("b", "t", "g")])}
    cut = {"articles": full["articles"].limit(1)}
    assert rows(ingest.reconcile_counts(full, cut)) == [("articles", 2, 1, False)]
    with pytest.raises(ValueError, match="articles"):
        ingest.check_reconciled(ingest.reconcile_counts(full, cut))
    ingest.check_reconciled(ingest.reconcile_counts(full, full))


def test_results_go_through_every_format(spark, make, tmp_path):
    df = make.art([("01", "x", None), ("02", "y, z", "g")])
    for fmt in ("parquet", "json", "csv"):
        ingest.write_result(df, f"{tmp_path}/{fmt}", fmt)
        back = spark.read.schema(df.schema).option("header", True).format(fmt).load(f"{tmp_path}/{fmt}")
        assert rows(back, "article_id") == rows(df, "article_id")
    with pytest.raises(ValueError):
        ingest.write_result(df, f"{tmp_path}/other", "xml")


def test_clustered_files_cover_narrow_date_ranges(spark, tables, tmp_path):
    ingest.write_clustered(tables["transactions"], f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    per_file = stored.groupBy(F.input_file_name()).agg(F.min("t_dat"), F.max("t_dat")).collect()
    spans = sorted((r[1], r[2]) for r in per_file)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert stored.count() == tables["transactions"].count()


def test_ages(make):
    cust = make.cust([(str(a), None, None, a) for a in (14, 15, 100, 101, None)])
    found = dict(rows(cust.select("customer_id", clean_age("age"))))
    assert found == {"14": None, "15": 15, "100": 100, "101": None, "None": None}
    assert rows(quality.q_missing_age(cust)) == [(1, 5, 20.0)]
    row = quality.q_implausible_age(cust).first()
    assert (row.n_under, row.n_over, row.n_implausible) == (1, 1, 2)
    assert (row.min_age, row.max_age, row.median_age) == (14, 101, 57.5)


def test_keys_and_duplicates(make):
    txn = make.txn(
        [
            ("2020-01-01", "x", "a", 1.0, 1),
            ("2020-01-01", "x", "a", 1.0, 1),
            ("2020-01-01", "x", "a", None, 1),
            ("2020-01-01", "x", "a", None, 1),
            ("2020-01-05", "y", "zz", -2.0, None),
            ("2020-01-05", None, None, 0.0, 2),
        ]
    )
    cust = make.cust([("x", "ACTIVE", None, 1), ("quiet", None, None, 1)])
    art = make.art([("a", "t", "g")])
    assert rows(quality.q_duplicate_rows(txn)) == [(2,)]
    assert rows(quality.q_customers_no_txn(cust, txn)) == [(1, 2, 50.0)]
    assert rows(quality.q_customers_no_txn(cust, txn, since="2020-01-02")) == [(2, 2, 100.0)]
    assert rows(quality.q_orphan_customers(txn, cust)) == [(2, 2)]
    assert rows(quality.q_orphan_articles(txn, art)) == [(2, 2)]
    assert rows(quality.q_price_validity(txn)) == [(2, 2, 4)]
    assert rows(quality.q_single_purchase(txn)) == [(1, 2, 50.0)]
    assert rows(quality.q_date_gaps(txn)) == [(2, 1, 4)]
    assert rows(quality.q_max_gap_date(txn)) == [(D("2020-01-05"), 4)]
    assert quality.q_price_distribution(txn).first().mean_price == 0.0
    assert quality.q_price_distribution(txn, exact=False).first().max_price == 1.0
    assert {r[0]: r[1] for r in quality.q_channel_distribution(txn).collect()} == {1: 4, 2: 1, None: 1}
    report = {r.check: r for r in quality.quality_report(txn, cust, art).collect()}
    assert report["club_status"].detail == "ACTIVE=1; missing=1"
    assert report["implausible_age"].rows_affected == 2
    assert report["date_gaps"].detail == "max_gap=4 around 2020-01-05"
    assert {r.total_rows_affected for r in report.values()} == {3}


def test_quality_report_agrees_with_the_single_checks(make):
    """Copies of customers, missing keys and unknown keys are counted as the checks by themselves do."""
    txn = make.txn(
        [
            ("2020-01-01", "x", "a", 1.0, 1),
            ("2020-01-01", "x", "a", 1.0, 1),
            ("2020-01-05", "y", None, -2.0, None),
            ("2020-01-05", None, "zz", 0.0, 2),
            ("2020-01-09", "w", "zz", None, 2),
        ]
    )
    cust = make.cust([("x", "ACTIVE", None, 30), ("x", "ACTIVE", None, 30), (None, None, None, None), ("q", "LEFT", None, 150)])
    art = make.art([("a", "t", "g"), ("b", "t", "g"), (None, "t", "g")])
    report = {r.check: r for r in quality.quality_report(txn, cust, art).collect()}
    assert (report["transactions"]["count"], report["customers"]["count"], report["articles"]["count"]) == (5, 4, 3)
    assert report["unknown_customers"]["count"] == quality.q_orphan_customers(txn, cust).first().n_orphans == 3
    assert report["unknown_articles"]["count"] == quality.q_orphan_articles(txn, art).first().n_orphans == 3
    alone = quality.q_customers_no_txn(cust, txn).first()
    assert (report["customers_without_transactions"]["count"], report["customers_without_transactions"].pct) == (alone[0], alone.pct)
    assert alone[0] == 2
    assert report["missing_age"]["count"] == 1 and report["missing_age"].pct == 25.0
    assert report["implausible_age"].detail == "under=0, over=1, range=30..150"
    assert report["invalid_price"]["count"] == quality.q_price_validity(txn).first().n_invalid == 3
    assert report["club_status"].detail == "ACTIVE=2; LEFT=1; missing=1"
    assert report["sales_channels"].detail == "1=2; 2=2; missing=1"


def test_counts_of_every_column_at_once(make):
    txn = make.txn([("2020-01-01", "x", "a", 1.0, None), ("2020-01-02", "x", "b", 1.0, 2), ("2020-01-02", None, "b", 2.0, 2)])
    columns = ["customer_id", "t_dat", "price", "article_id", "sales_channel_id"]
    marginals = quality.marginal_counts(txn, columns)
    for column in columns:
        assert sorted(map(str, quality.counts_of(marginals, column).collect())) == sorted(
            map(str, quality.value_counts(txn, column).collect())
        )


def test_quality_report_reads_every_table_once(tables, monkeypatch):
    """One scan a table for what is stored, and one of the transactions for their duplicates."""
    from tests.conftest import plan_of

    scans, stored = [], quality.materialise

    def counted(df):
        scans.append(plan_of(df).count("FileScan"))
        return stored(df)

    monkeypatch.setattr(quality, "materialise", counted)
    txn, cust, art = tables["transactions"], tables["customers"], tables["articles"]
    report = quality.quality_report(txn, cust, art)
    per_table = [plan_of(df).count("FileScan") for df in (txn, cust, art)]
    assert scans == per_table
    assert plan_of(report).count("FileScan") == per_table[0]


def test_no_gap_has_no_date(make):
    txn = make.txn([("2020-01-01", "x"), ("2020-01-02", "x")])
    assert rows(quality.q_max_gap_date(txn)) == []
    assert rows(quality.q_date_gaps(txn)) == [(2, 0, 1)]


# Descriptives


def test_weeks_start_on_monday(make):
    txn = make.txn([("2020-01-05", "x", "a", 1.0), ("2020-01-06", "x", "a", 2.0), ("2020-01-12", "y", "a", 3.0)])
    weekly = descriptives.weekly_revenue(txn)
    assert rows(weekly, "week") == [(D("2019-12-30"), 1.0, 1, 1), (D("2020-01-06"), 5.0, 2, 2)]
    index = descriptives.weekly_index(weekly)
    assert [r[2] for r in rows(index, "week")] == [20.0, 100.0]
    assert rows(descriptives.weekly_extremes(index)) == [
        (2, D("2020-01-06"), 100.0, D("2019-12-30"), 20.0)
    ]


def test_extremes_take_the_first_of_equal_weeks(spark):
    index = spark.createDataFrame(
        [(D("2020-01-06"), 2.0, 80.0), (D("2020-01-13"), 2.0, 80.0), (D("2020-01-20"), 2.0, 80.0)],
        "week date, revenue double, rev_index double",
    )
    row = descriptives.weekly_extremes(index).first()
    assert row.peak_week == row.trough_week == D("2020-01-06")


def test_unknown_articles_form_a_group(make):
    txn = make.txn([("2020-01-01", "x", "a", 3.0), ("2020-01-01", "x", "zz", 1.0)])
    art = make.art([("a", "t", "g")])
    assert dict((r[0], r[2]) for r in descriptives.product_mix(txn, art).collect()) == {"g": 75.0, None: 25.0}


def test_concentration_equals_a_sorted_array(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    spend = np.sort(np.round(rng.pareto(1.5, 997) * 10, 1) + 0.1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(spend)], "customer_id int, total_rev double")
    share = np.cumsum(spend) / spend.sum()
    customers = np.arange(1, len(spend) + 1) / len(spend)
    assert descriptives.gini(df).first().gini == pytest.approx(1 - 2 * np.trapezoid(share, customers))
    tops = {r.fraction: r.revenue_share for r in descriptives.top_share(df).collect()}
    assert tops[0.1] == pytest.approx(1 - share[int(len(spend) * 0.9)])
    assert tops[0.2] == pytest.approx(1 - share[int(len(spend) * 0.8)])
    curve = {r.point: r for r in descriptives.lorenz_curve(df, 10).collect()}
    assert len(curve) == 10 and curve[10].revenue_share == pytest.approx(1.0)
    assert curve[3].revenue_share == pytest.approx(share[curve[3]["rank"] - 1])


def test_daily_totals_give_the_same_trends(tables):
    txn = tables["transactions"]
    daily = descriptives.daily_totals(txn)
    for trend in (
        descriptives.channel_weekly,
        descriptives.channel_share,
        descriptives.channel_weekly_share,
        descriptives.monthly_revenue,
    ):
        assert sorted(map(tuple, trend(daily).collect())) == sorted(map(tuple, trend(txn).collect()))


def test_shares_sum_to_one_hundred(tables):
    weekly = descriptives.channel_weekly_share(tables["transactions"]).collect()
    assert all(r.channel_1_pct + r.channel_2_pct == pytest.approx(100) for r in weekly)


def test_other_channels_keep_their_weeks(make):
    days = ("2020-01-06", "2020-01-13", "2020-01-20")
    txn = make.txn([(d, "a", "x", p, c) for d, p, c in zip(days, (5.0, 3.0, 2.0), (1, 3, None))])
    found = sorted(map(tuple, descriptives.channel_weekly_share(txn).collect()))
    assert [row[1:] for row in found] == [(100.0, 0.0, 0.0), (0.0, 0.0, 100.0), (0.0, 0.0, 100.0)]


# RFM


def test_equal_customers_fall_to_other(make):
    txn = make.txn([("2020-01-01", c) for c in "abcdef"])
    seg = rfm.rfm_segment(rfm.rfm_scores(rfm.rfm_metrics(txn)))
    assert {(r.R_q, r.segment) for r in seg.collect()} == {(None, "Other")}


def test_merged_recency_edges_take_the_top_of_the_scale(make):
    days = ["2020-01-10"] * 6 + ["2020-01-09", "2020-01-08", "2020-01-07", "2020-01-06"]
    txn = make.txn([(d, f"c{i}") for i, d in enumerate(days)])
    scores = {r.recency_days: r.R_q for r in rfm.rfm_scores(rfm.rfm_metrics(txn)).collect()}
    assert scores == {0: 5, 1: 4, 2: 4, 3: 3, 4: 3}


def test_frequency_counts_days(make):
    txn = make.txn([("2020-01-01", "x", "a", 1.5), ("2020-01-01", "x", "b", 2.0), ("2020-01-03", "x"), ("2020-01-04", "y")])
    assert rows(rfm.rfm_metrics(txn), "customer_id") == [("x", 1, 2, 4.5), ("y", 0, 1, 1.0)]
    assert rfm.rfm_metrics(txn, "2020-01-11").where("customer_id = 'x'").first().recency_days == 8


def test_first_matching_rule_wins(spark):
    triples = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    df = spark.createDataFrame(triples, "R_q int, F_q int, M_q int")
    found = {(r.R_q, r.F_q, r.M_q): r.segment for r in rfm.rfm_segment(df).collect()}
    assert found[(5, 5, 5)] == "Champions" and found[(3, 5, 5)] == "Loyal"
    assert found[(1, 3, 3)] == "At_risk" and found[(4, 2, 3)] == "Promising"
    assert found[(2, 1, 1)] == "Lapsed" and found[(5, 5, 1)] == "Other"
    assert sum(v == "Other" for v in found.values()) == 50


def test_segment_summary_and_audits(tables):
    seg = rfm.rfm_segment(rfm.rfm_scores(rfm.rfm_metrics(tables["transactions"])))
    summary = rfm.segment_summary(seg, digits=None).collect()
    assert sum(r.revenue_share_pct for r in summary) == pytest.approx(100)
    assert sum(r.customer_share_pct for r in summary) == pytest.approx(100)
    assert len(summary) >= 3
    wrong = seg.withColumn("segment", F.lit("Loyal"))
    assert audits.audit_segment_rules(wrong).first().n_mismatched > 0
    twice = seg.unionByName(seg.limit(3)).withColumn("M_q", F.when(F.col("customer_id") > 5, F.col("M_q")))
    found = audits.audit_quintiles(twice).first()
    assert found.n_duplicated == 3 and found.n_bad_scores > 0
    assert rfm.rfm_integrity(twice).first().n_duplicated == 3


# Cohorts


def test_missing_channel_on_the_first_day(make):
    txn = make.txn(
        [
            ("2020-01-31", "x", "a", 1.0, None),
            ("2020-01-31", "x", "a", 1.0, 2),
            ("2020-02-01", "x", "a", 1.0, 1),
            ("2020-03-01", "y", "a", 1.0, None),
        ]
    )
    assert rows(cohorts.first_purchase(txn), "customer_id") == [
        ("x", D("2020-01-31"), D("2020-01-01"), 2),
        ("y", D("2020-03-01"), D("2020-03-01"), None),
    ]
    activity = cohorts.cohort_activity(txn)
    assert rows(activity, "cohort_month", "months_since") == [
        (D("2020-01-01"), 2, D("2020-01-01"), 0, 1),
        (D("2020-01-01"), 2, D("2020-02-01"), 1, 1),
        (D("2020-03-01"), None, D("2020-03-01"), 0, 1),
    ]


def test_everyone_is_active_in_month_zero(tables):
    txn = tables["transactions"]
    sizes = cohorts.cohort_sizes(cohorts.first_purchase(txn))
    retention = cohorts.cohort_retention(cohorts.cohort_activity(txn), sizes)
    assert {r.retention_pct for r in retention.where("months_since = 0").collect()} == {100.0}


# Snapshots


T = "2020-06-01"


def history(make, extra=()):
    return make.txn(
        [
            ("2020-01-10", "x", "a", 2.0, 2),
            ("2020-01-10", "x", "b", 4.0, 1),
            ("2020-05-25", "x", "a", None, 2),
            ("2020-05-31", "once", "a", 7.0, 1),
            ("2018-01-01", "gone", "a", 7.0, 1),
            *extra,
        ]
    )


def by_customer(df):
    return {r.customer_id: r for r in df.collect()}


def test_features_by_hand(make):
    cust = make.cust([("x", "ACTIVE", None, 120)])
    found = by_customer(snap.snapshot(history(make), cust, T))
    assert set(found) == {"x", "once"}
    x = found["x"]
    assert (x.txn_count_all, x.spend_all, x.active_days_all, x.n_purchase_days) == (3, 6.0, 2, 2)
    assert (x.recency_days, x.tenure_days) == (7, 143)
    assert (x.txn_count_4w, x.spend_4w, x.active_days_4w) == (1, None, 1)
    assert (x.txn_count_26w, x.spend_26w, x.active_days_26w) == (3, 6.0, 2)
    assert x.avg_item_price == 3.0 and x.online_share == pytest.approx(2 / 3)
    assert x.n_distinct_articles == 2 and x.avg_basket_size == 1.5
    assert (x.avg_gap_days, x.max_gap_days, x.min_gap_days) == (136.0, 136.0, 136.0)
    assert (x.age, x.is_club_active, x.news_regular, x.lapsed) == (None, 1.0, 0.0, 1)
    once = found["once"]
    assert (once.avg_gap_days, once.max_gap_days, once.min_gap_days) == (None, None, None)
    assert (once.age, once.is_club_active, once.news_regular) == (None, None, None)
    assert list(x.asDict())[1:26] == snap.feature_names()


def test_empty_trailing_window(make):
    row = by_customer(snap.features_trailing(make.txn([("2020-01-01", "x")]), T))["x"]
    assert (row.txn_count_4w, row.spend_4w, row.active_days_4w) == (0, None, 0)
    assert (row.txn_count_26w, row.spend_26w) == (1, 1.0)


def test_days_on_the_borders(make):
    end = "2020-08-24"
    on_date = history(make, [(T, "x")])
    assert by_customer(snap.snapshot(on_date, make.cust([]), T))["x"].lapsed == 0
    assert by_customer(snap.snapshot(on_date, make.cust([]), T))["x"].txn_count_all == 3
    at_end = history(make, [(end, "x")])
    assert by_customer(snap.lapse_label(at_end, T))["x"].lapsed == 1
    before_end = history(make, [("2020-08-23", "x")])
    assert by_customer(snap.lapse_label(before_end, T))["x"].lapsed == 0
    lookback_start = make.txn([("2019-06-03", "in"), ("2019-06-02", "out")])
    assert set(by_customer(snap.population(lookback_start, T))) == {"in"}
    assert set(by_customer(snap.lapse_label(lookback_start, T))) == {"in"}


def test_calendar_counts_back_from_the_last_day(make):
    calendar = snap.snapshot_calendar(make.txn([("2020-09-22", "x"), ("2019-01-01", "x")]))
    assert rows(calendar, "snapshot_date") == [
        ("train", D("2020-01-14"), D("2020-04-07")),
        ("val", D("2020-04-07"), D("2020-06-30")),
        ("test", D("2020-06-30"), D("2020-09-22")),
    ]
    assert {r.is_spaced for r in audits.audit_spacing(calendar).collect()} == {True}
    assert {r.is_spaced for r in audits.audit_spacing(calendar, 11).collect()} == {False}


def without(df, *columns):
    return sorted(map(str, df.drop(*columns).collect()))


def test_later_rows_do_not_change_features(spark, tables):
    txn, cust = tables["transactions"], tables["customers"]
    date = snap.snapshot_windows(txn)[-1].date
    before = snap.snapshot(txn, cust, date)
    later = F.col("t_dat") >= F.lit(date)
    changed = txn.where(~later).unionByName(
        txn.where(later & (F.col("customer_id") % 2 == 0))
        .withColumn("price", F.col("price") * 10)
        .withColumn("price", F.col("price").cast("decimal(12,2)"))
    )
    after = snap.snapshot(changed, cust, date)
    assert without(before, "lapsed") == without(after, "lapsed")
    assert without(before) != without(after)


def test_earlier_rows_do_not_change_labels(spark, tables):
    txn, cust = tables["transactions"], tables["customers"]
    date = snap.snapshot_windows(txn)[-1].date
    doubled = txn.unionByName(txn.where(F.col("t_dat") < F.lit(date)))
    labels = lambda t: sorted(map(tuple, snap.lapse_label(t, date).collect()))
    assert labels(txn) == labels(doubled)


def test_snapshots_together_equal_snapshots_apart(tables):
    txn, cust = tables["transactions"], tables["customers"]
    windows = snap.snapshot_windows(txn)
    together = snap.snapshots(txn, cust, windows)
    for window in windows:
        apart = snap.snapshot(txn, cust, window.date)
        assert without(together.where(F.col("snapshot") == window.name), "snapshot") == without(apart)


def test_stored_days_give_the_same_snapshots(tables):
    from stayrate.operators.purchases import purchase_days_with_articles

    txn, cust = tables["transactions"], tables["customers"]
    windows = snap.snapshot_windows(txn)
    days = purchase_days_with_articles(txn)
    assert without(snap.snapshots(days, cust, windows)) == without(snap.snapshots(txn, cust, windows))


def test_audits_find_planted_errors(tables):
    txn, cust = tables["transactions"], tables["customers"]
    snaps = snap.snapshots(txn, cust, snap.snapshot_windows(txn))
    flipped = snaps.withColumn("lapsed", 1 - F.col("lapsed"))
    assert all(r.n_violations == r.n_retained for r in audits.audit_label_retained(txn, flipped).collect())
    assert all(r.n_violations == r.n_lapsed for r in audits.audit_label_lapsed(txn, flipped).collect())
    leaked = snaps.withColumn("recency_days", F.col("recency_days") - 400)
    assert all(r.n_not_before > 0 and r.n_wrong_recency > 0 for r in audits.audit_feature_dates(txn, leaked).collect())
    with pytest.raises(ValueError, match="label window"):
        snap.check_leakage(leaked)
    snap.check_leakage(snaps)
    snap.check_leakage(snaps, txn)
    # Features that saw two months more, under the snapshot's own date and with a harmless recency.
    windows = snap.snapshot_windows(txn)
    later = snap.window_at(windows[0].date + datetime.timedelta(days=60))
    built = snap.snapshots(txn, cust, [later]).withColumn("snapshot_date", F.lit(windows[0].date).cast("date"))
    assert snap.leakage_guard(built).first().is_safe
    assert not snap.leakage_guard(built, txn).first().is_safe
    assert not snap.leakage_guard(snaps.withColumn("txn_count_12w", F.col("txn_count_12w") + 1), txn).where("is_safe").count()
    assert snap.leakage_guard(snaps.limit(0), txn).count() == 0
    assert {r.n_duplicated > 0 for r in audits.audit_unique(snaps.unionByName(snaps)).collect()} == {True}


def test_other_windows_and_lookback(make):
    cfg = RetentionConfig(feature_windows_weeks=(1, 2), lookback_weeks=10, label_window_weeks=2)
    found = by_customer(snap.snapshot(history(make), make.cust([]), T, cfg))
    assert found["x"].txn_count_1w == 1 and found["x"].txn_count_2w == 1
    assert len(snap.feature_names(cfg)) == len(snap.feature_names(DEFAULT)) - 3


# Sizing


def value_frame(spark, rows_):
    return spark.createDataFrame(
        rows_, "customer_id int, risk_decile bigint, lapsed bigint, segment string, actual_spend double"
    )


def test_sizing_by_hand(spark):
    value = value_frame(
        spark,
        [
            (1, 1, 0, "Loyal", 10.0),
            (2, 1, 1, "Champions", 0.0),
            (3, 1, 1, "Other", 0.0),
            (4, 2, 0, "Loyal", 30.0),
            (5, None, 0, None, 10.0),
        ],
    )
    assert rows(sizing.revenue_index(value)) == [(50.0, 2.0)]
    assert {r.customer_id for r in sizing.target_group(value).collect()} == {1, 2}
    risk = sizing.value_at_risk(value).first()
    assert (risk.n_target_customers, risk.n_retained) == (2, 1)
    assert risk.value_lost_index == 20.0 and risk.avg_retained_index == 20.0
    scenarios = rows(sizing.uplift_scenarios(value, [50]))
    assert scenarios == [(50.0, 1, 20.0, 20.0, 50.0)]
    assert dict(rows(sizing.assumptions(value)))["avg_retained_spend_index"] == "20.000000"


@pytest.mark.parametrize(
    "row", [(1, 2, 0, "Loyal", 10.0), (1, 1, 1, "Loyal", 0.0)], ids=["no targets", "none retained"]
)
def test_sizing_without_retained_targets(spark, row):
    value = value_frame(spark, [row])
    risk = sizing.value_at_risk(value).first()
    assert risk.value_lost_index is None and risk.avg_retained_index is None
    scenario = sizing.uplift_scenarios(value).first()
    assert scenario.revenue_recovered_index is None and scenario.break_even_cost_pct is None
    assert scenario.customers_saved == 0
