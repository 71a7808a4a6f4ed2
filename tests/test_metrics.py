import numpy as np
import pandas as pd
import pytest

from stayrate.operators import metrics, model
from stayrate.operators.metrics import classification_metrics


def frame(spark, scores, labels):
    rows = [(float(s), int(y)) for s, y in zip(scores, labels)]
    return spark.createDataFrame(rows, "score double, lapsed int")


def brute_auc(p, y):
    wins = (p[y == 1][:, None] > p[y == 0][None, :]).mean()
    ties = (p[y == 1][:, None] == p[y == 0][None, :]).mean()
    return wins + ties / 2


def brute_ap(p, y):
    total, last = 0.0, 0.0
    for level in sorted(set(p), reverse=True):
        picked = p >= level
        recall = y[picked].sum() / y.sum()
        total += (recall - last) * y[picked].mean()
        last = recall
    return total


@pytest.fixture
def sample():
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 600)
    p = np.round(np.clip(0.3 * y + rng.normal(0.35, 0.2, 600), 0, 1), 2)  # many ties
    return p, y


def test_ties_by_hand(spark):
    df = frame(spark, [0.9, 0.8, 0.8, 0.4, 0.3, 0.1], [1, 0, 1, 0, 1, 0])
    row = classification_metrics(df).first()
    assert row.roc_auc == pytest.approx(6.5 / 9)
    assert row.pr_auc == pytest.approx(0.755555555)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_metrics_equal_brute_force(spark, confs, sample, coalesce):
    confs(spark__sql__adaptive__coalescePartitions__enabled=coalesce)
    p, y = sample
    row = classification_metrics(frame(spark, p, y)).first()
    assert (row.n, row.n_pos) == (len(y), y.sum())
    assert row.roc_auc == pytest.approx(brute_auc(p, y), abs=1e-12)
    assert row.pr_auc == pytest.approx(brute_ap(p, y), abs=1e-12)
    assert row.brier == pytest.approx(((p - y) ** 2).mean(), abs=1e-12)
    assert metrics.metric_brier(frame(spark, p, y)).first()[0] == pytest.approx(row.brier)


def test_groups_equal_separate_frames(spark, confs, sample):
    confs(spark__sql__adaptive__coalescePartitions__enabled="false")
    p, y = sample
    scored = {"as_is": frame(spark, p, y), "worse": frame(spark, 1 - p, y), "flat": frame(spark, p * 0, y)}
    found = {r.model: r for r in model.model_comparison(scored, digits=None).collect()}
    assert found["as_is"].roc_auc == pytest.approx(brute_auc(p, y), abs=1e-12)
    assert found["worse"].roc_auc == pytest.approx(1 - brute_auc(p, y), abs=1e-12)
    assert found["worse"].pr_auc == pytest.approx(brute_ap(1 - p, y), abs=1e-12)
    assert found["flat"].roc_auc == 0.5
    assert [m for m, r in found.items() if r.is_best] == ["as_is"]


def test_one_label_only(spark):
    row = classification_metrics(frame(spark, [0.1, 0.2], [1, 1])).first()
    assert row.roc_auc is None and row.pr_auc == 1.0


def test_lift_equals_pandas(spark, sample):
    p, y = sample
    df = pd.DataFrame({"y": y, "p": p})
    bins = pd.qcut(df.p, 10, labels=False, duplicates="drop") + 1
    df["decile"] = bins.max() + 1 - bins
    table = df.groupby("decile").agg(n=("y", "count"), lapsed=("y", "sum"), prob=("p", "mean")).reset_index()
    table["rate"] = (table.lapsed / table.n * 100).round(1)
    table["capture"] = (table.lapsed / y.sum() * 100).round(1)
    table["cumulated"] = table.capture.cumsum().round(1)
    table["lift"] = (table.rate / (y.sum() / len(y) * 100)).round(2)
    found = metrics.lift_by_decile(frame(spark, p, y)).orderBy("decile").toPandas()
    assert np.allclose(found.to_numpy(float), table.to_numpy(float), atol=1e-9)
    exact = metrics.lift_by_decile(frame(spark, p, y), digits=None).collect()
    assert sum(r.capture_pct for r in exact) == pytest.approx(100)
    top = metrics.top_capture(metrics.lift_by_decile(frame(spark, p, y))).first()
    assert top.top_1_capture_pct == table.capture[0]
    assert top.top_3_capture_pct == pytest.approx(table.capture[:3].sum())


def test_heavily_tied_scores_leave_fewer_deciles(spark):
    p = np.array([0.2] * 80 + [0.5] * 10 + [0.9] * 10)
    y = np.array([0, 1] * 50)
    found = metrics.lift_by_decile(frame(spark, p, y)).orderBy("decile").collect()
    assert [r.decile for r in found] == [1, 2, 3] and sum(r.n_customers for r in found) == 100


def test_calibration_edges_belong_to_the_lower_bin(spark):
    df = frame(spark, [0.0, 0.1, 0.1000001, 0.95, 1.0], [0, 1, 1, 1, 0])
    found = {r.bin: r for r in metrics.calibration_bins(df).collect()}
    assert set(found) == {1, 2, 10}
    assert found[1].n == 2 and found[1].observed_rate == 0.5
    assert found[10].mean_score == pytest.approx(0.975)
