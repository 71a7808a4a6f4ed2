"""Models on a synthetic set with a planted signal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array

from stayrate.config import RetentionConfig
from stayrate.operators import boosting, isotonic, metrics, model
from stayrate.plans import catalogue
from tests.conftest import TEST_DATA

FEATURES = ["recency_days", "signal", "bend", "noise"]
GRID = [
    {"max_depth": depth, "learning_rate": 0.2, "n_trees": 12, "positive_weight": 1.0}
    for depth in (1, 3)
]


def snapshot(seed, n=1500):
    rng = np.random.default_rng(seed)
    signal, bend, noise = rng.normal(size=(3, n))
    recency = np.clip(rng.integers(1, 200, n) + 25 * signal, 1, None)
    logit = 1.2 * signal + 1.8 * (np.abs(bend) > 0.7) - 0.9
    lapsed = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    return pd.DataFrame(
        {
            "customer_id": np.arange(n),
            "recency_days": recency.round(),
            "signal": signal,
            "bend": bend,
            "noise": np.where(noise > 1.5, np.nan, noise),
            "lapsed": lapsed,
        }
    )


@pytest.fixture(scope="module")
def snaps(spark):
    return [spark.createDataFrame(snapshot(seed)).coalesce(2).replace(float("nan"), None) for seed in (1, 2, 3)]


@pytest.fixture(scope="module")
def vectors(snaps):
    return [model.feature_vector(s, FEATURES).cache() for s in snaps]


@pytest.fixture(scope="module")
def boosted(vectors):
    return model.gbt_grid(vectors[0], vectors[1], GRID, RetentionConfig())


@pytest.fixture(scope="module")
def logistic(vectors):
    return model.logistic_select(vectors[0], vectors[1], (0.01, 1.0))


def auc(scored):
    return metrics.metric_roc_auc(scored).first()[0]


def test_missing_values_are_filled(snaps):
    filled = model.feature_vector(snaps[0], FEATURES).select(vector_to_array("features").alias("v"))
    n_missing = snaps[0].where("noise IS NULL").count()
    assert n_missing > 0
    assert filled.where("v[3] = -1").count() == n_missing


def test_age_flag(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 30.0, 1)], "customer_id int, age double, lapsed int")
    found = model.feature_vector(df, ["age"], missing_age_flag=True).orderBy("customer_id").collect()
    assert [list(r.features) for r in found] == [[-1.0, 1.0], [30.0, 0.0]]


def test_standardised_train_has_mean_zero(vectors):
    train, val = model.standardise(vectors[0], vectors[1])
    values = np.array([r[0] for r in train.select(vector_to_array("scaled")).collect()])
    assert np.allclose(values.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(values.std(axis=0), 1, atol=1e-9)
    others = np.array([r[0] for r in val.select(vector_to_array("scaled")).collect()])
    assert not np.allclose(others.mean(axis=0), 0, atol=1e-9)


def test_models_rank_as_the_signal_says(snaps, vectors, logistic, boosted):
    baseline = auc(model.recency_baseline(snaps[2]))
    linear = auc(model.score(logistic.model, vectors[2]))
    trees = auc(model.score(boosted.model, vectors[2]))
    assert trees > linear > baseline > 0.5
    assert boosted.params in GRID
    assert logistic.val_auc == pytest.approx(auc(model.score(logistic.model, vectors[1])), abs=1e-9)


def test_logistic_minimises_the_penalised_loss(vectors, logistic):
    """The coefficients satisfy the first-order condition of C * loss + |w|^2 / 2."""
    scaler, fitted = logistic.model.stages
    train = scaler.transform(vectors[0]).select(vector_to_array("scaled"), "lapsed").collect()
    x, y = np.array([r[0] for r in train]), np.array([r[1] for r in train])
    w, b = np.array(fitted.coefficients), fitted.intercept
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    gradient = logistic.params["C"] * (x.T @ error) + w
    assert np.abs(gradient).max() < 1e-2 * max(1.0, np.abs(w).max())
    assert abs(error.mean()) < 1e-4


def test_grid_covers_every_combination():
    grid = model.tree_grid(RetentionConfig())
    assert len(grid) == 36 and len({tuple(g.values()) for g in grid}) == 36


def test_grid_runs_over_shares_of_rows_and_features():
    grid = model.tree_grid(RetentionConfig(row_subsamples=(0.5, 1.0), feature_subsamples=(0.6, 0.8, 1.0)))
    assert len(grid) == 36 * 6 and len({tuple(g.values()) for g in grid}) == 36 * 6


def test_fewer_trees_are_the_first_of_more(vectors, monkeypatch):
    """One fit per depth, rate and weight serves all numbers of trees, with the models that single fits give."""
    cfg, fits = RetentionConfig(), []
    plain = boosting.fit_grid
    monkeypatch.setattr(boosting, "fit_grid", lambda df, grid, seed: fits.append(len(grid)) or plain(df, grid, seed))
    grid = [{"max_depth": 3, "learning_rate": 0.1, "n_trees": n, "positive_weight": 3.0} for n in (2, 5)]
    both = model.gbt_grid(vectors[0], vectors[1], grid, cfg)
    assert fits == [1]
    alone = [model.gbt_grid(vectors[0], vectors[1], [g], cfg) for g in grid]
    best = max(alone, key=lambda s: s.val_auc)
    assert (both.params, both.val_auc) == (best.params, best.val_auc)
    cut = alone[1].model.first_trees(2)
    rows = lambda m: sorted((r.customer_id, r.score) for r in model.score(m, vectors[1]).collect())
    assert rows(cut) == rows(alone[0].model)


def test_first_of_equal_candidates_wins(vectors):
    same = {"max_depth": 2, "learning_rate": 0.1, "n_trees": 3, "positive_weight": 1.0}
    found = model.gbt_grid(vectors[0], vectors[1], [same, same | {"note": "again"}], RetentionConfig())
    assert found.params == same
    assert found.val_auc == pytest.approx(auc(model.score(found.model, vectors[1])), abs=1e-12)


def test_boosting_is_as_good_as_the_library(vectors, spark):
    """AUC within 0.005 of Spark ML's boosted trees on the same split."""
    from pyspark.ml.classification import GBTClassifier

    grid = [{"max_depth": 3, "learning_rate": 0.1, "n_trees": 40, "positive_weight": 1.0}]
    ours = model.gbt_grid(vectors[0], vectors[1], grid, RetentionConfig())
    theirs = GBTClassifier(
        featuresCol="features", labelCol="lapsed", maxDepth=3, stepSize=0.1, maxIter=40, subsamplingRate=0.8, seed=42
    ).fit(vectors[0])
    both = [auc(model.score(m, vectors[2])) for m in (ours.model, theirs)]
    assert both[0] > both[1] - 0.005


def test_blocks_grow_the_trees_that_one_block_grows(vectors, monkeypatch):
    grid = [boosting.Params(d, 0.2, n, w, 0.8, 0.8) for d, n, w in ((3, 6, 1.0), (2, 4, 3.0))]
    alone = boosting.fit_grid(vectors[0], grid, 7)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 400)
    monkeypatch.setattr(boosting, "TREES_BETWEEN_CHECKPOINTS", 2)
    together = boosting.fit_grid(vectors[0], grid, 7)
    for a, b in zip(alone, together, strict=True):
        assert (a.feature == b.feature).all() and (a.split == b.split).all()
        assert np.allclose(a.value, b.value, atol=1e-6)


@pytest.mark.parametrize("beside", [1, 1000])
def test_few_blocks_are_one_block(vectors, monkeypatch, beside):
    """Models grow beside a few blocks of rows without a job per level, and grow the same trees."""
    grid = [boosting.Params(3, 0.2, 3, 3.0, 0.8, 0.8)]
    alone = boosting.fit_grid(vectors[0], grid, 7)[0]
    called, plain = [], boosting.grow_together
    monkeypatch.setattr(boosting, "grow_together", lambda *args: called.append(1) or plain(*args))
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 300)
    monkeypatch.setattr(boosting, "BESIDE_BLOCKS", beside, raising=False)
    found = boosting.fit_grid(vectors[0], grid, 7)[0]
    assert bool(called) == (beside == 1)
    assert (alone.feature == found.feature).all() and (alone.split == found.split).all()
    assert np.allclose(alone.value, found.value, atol=1e-6)


def test_level_sums_count_opened_nodes_only():
    rng = np.random.default_rng(4)
    block = boosting.Block(rng.integers(0, 64, (500, 6)).astype(np.uint8), rng.integers(0, 2, 500).astype(float), rng.integers(0, 2**63, 500).astype(np.uint64))
    params, node, opened = boosting.Params(3, 0.1, 1, 2.0, 0.8, 0.5), rng.integers(3, 7, 500), np.array([4, 6])
    sample = boosting.sampled(block, rng.normal(size=500), params, 0, 9)
    features = boosting.tree_features(6, 0.5, 9, 0)
    expected = np.zeros((2, 2, len(features), 64))
    for r, *both in zip(sample.rows, *sample.both):
        for f, feature in enumerate(features):
            if node[r] in opened:
                expected[:, list(opened).index(node[r]), f, block.bins[r, feature]] += both
    assert np.allclose(boosting.level_sums(sample, node, opened), expected)


def test_a_split_maximises_the_gain(vectors):
    """The first split of a plain tree against every cut between bins."""
    rows = vectors[0].select(vector_to_array("features").alias("v"), "lapsed").collect()
    values, label = np.array([r.v for r in rows]), np.array([r.lapsed for r in rows], float)
    fitted = boosting.fit_grid(vectors[0], [boosting.Params(1, 1.0, 1, 1.0, 1.0, 1.0)], 0)[0]
    bins = boosting.binned(values, fitted.edges)
    g, h = 0.5 - label, np.full(len(label), 0.25)
    quality = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((quality(bins[:, f] <= b) + quality(bins[:, f] > b), -f, -b) for f in range(4) for b in range(63))
    assert (fitted.feature[0][0], fitted.split[0][0]) == (-best[1], -best[2])
    left = bins[:, -best[1]] <= -best[2]
    assert fitted.value[0][1] == pytest.approx(-g[left].sum() / (h[left].sum() + 1), rel=1e-5)


def test_constant_labels_and_features(spark):
    df = model.feature_vector(spark.createDataFrame([(i, 1.0, 0) for i in range(30)], "customer_id int, x double, lapsed int"), ["x"])
    fitted = boosting.fit_grid(df, [boosting.Params(3, 0.1, 3, 1.0, 0.8, 0.8)], 1)[0]
    scores = {r.score for r in model.score(fitted, df).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    with pytest.raises(ValueError):
        boosting.fit_grid(df.limit(0), [boosting.Params(3, 0.1, 3, 1.0, 0.8, 0.8)], 1)


def test_registered_queries_fit_the_whole_grid(spark, monkeypatch):
    seen = []

    def stop(train, val, grid=None, cfg=None):
        seen.append(len(model.tree_grid(cfg) if grid is None else grid))
        raise InterruptedError

    monkeypatch.setattr(model, "gbt_grid", stop)
    for name in ("gbt_grid", "risk_scores_boosted", "model_comparison"):
        with pytest.raises(InterruptedError):
            catalogue.QUERIES[name](spark, TEST_DATA)
    assert seen == [36] * 3


def test_no_candidates(vectors):
    with pytest.raises(ValueError):
        model.gbt_grid(vectors[0], vectors[1], [])


def pool_adjacent(p, y):
    blocks = []
    for value in np.unique(p):
        blocks.append([value, value, float(y[p == value].sum()), int((p == value).sum())])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs = [x for b in blocks for x in (b[0], b[1])]
    ys = [b[2] / b[3] for b in blocks for _ in (0, 1)]
    return xs, ys


def test_calibration_equals_pooling(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(800), 2)
    y = (rng.random(800) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "score double, lapsed int")
    fitted = model.isotonic_calibrate(df)
    probe = [-1.0, 0.0, 0.123, 0.5, 0.777, 1.0, 3.0]
    asked = spark.createDataFrame([(v,) for v in probe], "raw double")
    found = {r.raw: r.calibrated for r in model.calibrate(fitted, asked, "raw").collect()}
    xs, ys = pool_adjacent(p, y)
    assert [found[v] for v in probe] == pytest.approx(list(np.interp(probe, xs, ys)))


@pytest.mark.parametrize("kind", ["random", "reversed", "constant", "rising", "tied"])
@pytest.mark.parametrize("at_a_time", [7, 100_000])
def test_calibration_in_ranges(spark, monkeypatch, kind, at_a_time):
    """Pooling in ranges that are cut again gives the curve of pooling in one go."""
    monkeypatch.setattr(isotonic, "POOLED_ROWS", at_a_time)
    monkeypatch.setattr(isotonic, "STEPS_AT_A_TIME", 5 if at_a_time == 7 else 100_000)
    rng = np.random.default_rng(8)
    p = rng.random(60) if kind != "tied" else np.round(rng.random(60), 1)
    y = {
        "random": (rng.random(60) < 0.5), "reversed": p < 0.5, "constant": np.ones(60), "rising": p > 0.5, "tied": rng.random(60) < p
    }[kind].astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "score double, lapsed int")
    curve = model.isotonic_calibrate(df)
    probe = [-1.0, 2.0, *p.tolist(), *rng.random(20).tolist()]
    asked = spark.createDataFrame([(v,) for v in probe], "raw double")
    found = {r.raw: r.calibrated for r in model.calibrate(curve, asked, "raw").collect()}
    xs, ys = pool_adjacent(p, y)
    assert [found[v] for v in probe] == pytest.approx(list(np.interp(probe, xs, ys)), abs=1e-9)


def test_calibration_without_scores(spark):
    empty = spark.createDataFrame([], "score double, lapsed int")
    curve = model.isotonic_calibrate(empty)
    asked = spark.createDataFrame([(0.5,), (None,)], "score double")
    assert [r.calibrated for r in model.calibrate(curve, asked).collect()] == [None, None]
    some = model.isotonic_calibrate(spark.createDataFrame([(0.5, 1), (None, 0)], "score double, lapsed int"))
    assert sorted((r.calibrated for r in model.calibrate(some, asked).collect()), key=str) == [1.0, None]


def test_risk_scores(vectors, boosted):
    scored = model.score(boosted.model, vectors[2]).cache()
    found = model.risk_scores(scored, "score").toPandas()
    bins = pd.qcut(found.prob_lapse, 10, labels=False, duplicates="drop")
    assert (found.risk_decile == bins.max() - bins + 1).all()
    assert found.groupby("risk_decile").prob_lapse.mean().is_monotonic_decreasing


def test_importance_finds_the_planted_features(vectors, boosted):
    found = model.feature_importance(boosted.model, vectors[2], FEATURES, n_repeats=2)
    drops = {r.feature: r.auc_drop for r in found.collect()}
    assert set(drops) == set(FEATURES)
    assert min(drops["signal"], drops["bend"]) > 0.05
    assert max(abs(drops["noise"]), abs(drops["recency_days"])) < 0.05


def test_importance_of_an_unused_feature_is_zero(vectors, snaps):
    """Trees that never split on a feature lose nothing by it; drops are within their stated error."""
    fitted = boosting.fit_grid(vectors[0], [boosting.Params(1, 0.5, 3, 1.0, 1.0, 1.0)], 0)[0]
    unused = [f for i, f in enumerate(FEATURES) if not (fitted.feature == i).any()]
    found = {r.feature: r for r in model.feature_importance(fitted, vectors[2], FEATURES, n_top=1).collect()}
    assert unused and all(found[f].auc_drop == 0 and found[f].gain == 0 for f in unused)
    assert sum(r.gain for r in found.values()) == pytest.approx(1)
    assert [f for f, r in found.items() if r.is_top] == [max(found, key=lambda f: found[f].auc_drop)]
    exact = {r.feature: r.auc_drop for r in _exact_drops(fitted, vectors[2])}
    assert all(abs(found[f].auc_drop - exact[f]) <= found[f].auc_error + 1e-12 for f in FEATURES)


def _exact_drops(fitted, vectors):
    """The same permutation (one group), with exact AUCs."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    drawn = vectors.withColumn("d", F.xxhash64("customer_id", F.lit(RetentionConfig().random_seed), F.lit(0)))
    rows = drawn.orderBy("d", "customer_id").select(vector_to_array("features").alias("v"), "lapsed").collect()
    x, y = np.array([r.v for r in rows]), np.array([r.lapsed for r in rows])

    def exact(values):
        p = fitted.probabilities(values, [fitted.n_trees])[0]
        above, ties = (p[y == 1][:, None] > p[y == 0]).mean(), (p[y == 1][:, None] == p[y == 0]).mean()
        return above + ties / 2

    for i, name in enumerate(FEATURES):
        changed = x.copy()
        changed[:, i] = np.roll(x[:, i], -1)
        yield SimpleNamespace(feature=name, auc_drop=exact(x) - exact(changed))
