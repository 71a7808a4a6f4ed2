"""Lapse models on Spark ML: fitting, selection, calibration, scoring and importance.

The train snapshot fits, the val snapshot selects and calibrates, the test snapshot is
scored once.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.config import DEFAULT, RetentionConfig
from stayrate.functions import as_double
from stayrate.operators import boosting
from stayrate.operators.boosting import BoostedTrees
from stayrate.operators.isotonic import IsotonicCurve, pooled_blocks
from stayrate.operators.metrics import classification_metrics, risk_deciles, score_histogram
from stayrate.operators.snapshots import feature_names


#: Rows of about so many customers swap values when a feature is permuted.
SWAPPED_TOGETHER = 50_000
#: Scores are counted between so many edges for importance.
SCORE_EDGES = 1 << 14


class Selected(NamedTuple):
    """The best model, its parameters and its score on the validation snapshot."""

    model: Model | BoostedTrees
    params: dict[str, Any]
    val_auc: float


def feature_vector(
    snap: DataFrame,
    features: Sequence[str] | None = None,
    fill: float = -1.0,
    missing_age_flag: bool = False,
) -> DataFrame:
    """Identifiers, label and ``features``, one dense vector in which NULL is ``fill``.

    ``missing_age_flag`` adds a 0/1 feature for a missing age.
    """
    names = list(features or feature_names())
    filled = [F.coalesce(as_double(name), F.lit(float(fill))).alias(name) for name in names]
    if missing_age_flag:
        filled.append(F.col("age").isNull().cast("double").alias("age_missing"))
        names.append("age_missing")
    ids = [c for c in ("customer_id", "snapshot", "snapshot_date", "lapsed") if c in snap.columns]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    return assembler.transform(snap.select(*ids, *filled)).select(*ids, "features")


def recency_baseline(snap: DataFrame, output: str = "score") -> DataFrame:
    """Recency scaled to [0, 1] over the snapshot, as a stand-in for a risk."""
    recency = F.coalesce(as_double("recency_days"), F.lit(-1.0))
    ends = snap.agg(F.min(recency).alias("lo"), F.max(recency).alias("hi")).first()
    lo, hi = (ends["lo"] or 0.0, ends["hi"] or 0.0)
    scaled = (recency - lo) / (hi - lo + 1e-9)
    return snap.select("customer_id", "lapsed", "recency_days", scaled.alias(output))


def fit_standardiser(train: DataFrame) -> PipelineModel:
    """Centre and scale ``features`` to ``scaled`` by the train means and population deviations.

    Spark divides by the sample deviation; the second stage makes up for the difference.
    ``sample_scaled`` holds the values between the two.
    """
    n = train.count()
    if not n:
        raise ValueError("no rows to fit on")
    scaler = StandardScaler(
        inputCol="features", outputCol="sample_scaled", withMean=True, withStd=True
    ).fit(train)
    factor = math.sqrt(n / max(n - 1, 1))
    weights = Vectors.dense([factor] * scaler.mean.size)
    product = ElementwiseProduct(scalingVec=weights, inputCol="sample_scaled", outputCol="scaled")
    return PipelineModel(stages=[scaler, product])


def standardise(train: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """Add ``scaled`` to ``train`` and to ``others``, fitted on ``train`` only."""
    fitted = fit_standardiser(train)
    return tuple(fitted.transform(df) for df in (train, *others))


def _auc(scored: DataFrame) -> float:
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="probability", labelCol="lapsed", numBins=0
    )
    return evaluator.evaluate(scored)


def _best(
    candidates: Iterable[tuple[dict[str, Any], Estimator, DataFrame]], val: DataFrame
) -> Selected:
    """Fit each estimator on its train frame; keep the first with the highest AUC on ``val``.

    The frames are read once or more per candidate, so pass stored or cached ones.
    """
    best: Selected | None = None
    for params, estimator, train in candidates:
        model = estimator.fit(train)
        auc = _auc(model.transform(val))
        if best is None or auc > best.val_auc:
            best = Selected(model, params, auc)
    if best is None:
        raise ValueError("no candidate parameters given")
    return best


def logistic_select(
    train: DataFrame, val: DataFrame, cs: Sequence[float] = DEFAULT.logistic_c
) -> Selected:
    """L2-penalised logistic regression on standardised features, best inverse penalty C.

    C multiplies the summed log loss; Spark averages the loss over rows, which makes the
    penalty 1 / (C * n).
    """
    n = train.count()
    scaler = fit_standardiser(train)

    def candidates():
        for c in cs:
            regression = LogisticRegression(
                featuresCol="scaled",
                labelCol="lapsed",
                regParam=1.0 / (c * n),
                elasticNetParam=0.0,
                standardization=False,
                maxIter=1000,
            )
            yield {"C": c}, Pipeline(stages=[scaler, regression]), train

    return _best(candidates(), val)


def tree_grid(cfg: RetentionConfig = DEFAULT) -> list[dict[str, Any]]:
    """Every combination of depth, rate, number of trees, weight of the positive class, and the
    shares of rows and of features that each tree sees."""
    names = ("max_depth", "learning_rate", "n_trees", "positive_weight", "row_share", "feature_share")
    axes = (
        cfg.tree_depths, cfg.tree_rates, cfg.tree_counts, cfg.positive_weights, cfg.row_subsamples, cfg.feature_subsamples
    )
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*axes)]


def gbt_grid(
    train: DataFrame,
    val: DataFrame,
    grid: Sequence[Mapping[str, Any]] | None = None,
    cfg: RetentionConfig = DEFAULT,
) -> Selected:
    """Gradient-boosted trees, best parameters of ``grid`` (by default ``tree_grid(cfg)``).

    All models grow together, see ``boosting``. The weight of the positive class multiplies the rows with
    label 1. Combinations that differ only in ``n_trees`` take one fit of the most trees, of which
    the fewer are the first. All are judged in one pass over ``val``; of equal AUCs the first of ``grid`` is
    kept. ``train`` is read three times, so pass a stored or cached frame.
    """
    wanted = [dict(params) for params in (tree_grid(cfg) if grid is None else grid)]
    if not wanted:
        raise ValueError("no candidate parameters given")
    params = [boosting.grid_params(p) for p in wanted]
    longest: dict[tuple, boosting.Params] = {}
    for p in params:
        key = p._replace(n_trees=0)
        longest[key] = max(longest.get(key, p), p, key=lambda q: q.n_trees)
    models = dict(zip(longest, boosting.fit_grid(train, list(longest.values()), cfg.random_seed), strict=True))
    stages = {key: sorted({p.n_trees for p in params if p._replace(n_trees=0) == key}) for key in models}
    places = [(key, n) for key in models for n in stages[key]]
    scores = boosting.staged([(models[key], stages[key]) for key in models], val)
    judged = val.select("lapsed", F.posexplode(scores).alias("place", "score"))
    aucs = {r["place"]: r["roc_auc"] for r in classification_metrics(judged, by=["place"]).collect()}
    found = [aucs.get(places.index((p._replace(n_trees=0), p.n_trees))) for p in params]
    best = max(range(len(found)), key=lambda i: (-1.0 if found[i] is None else found[i], -i))
    model = models[params[best]._replace(n_trees=0)].first_trees(params[best].n_trees)
    return Selected(model, wanted[best], found[best])


def score(model: Model | BoostedTrees, vectors: DataFrame, output: str = "score") -> DataFrame:
    """Identifiers, label and the probability of a lapse."""
    scored = model.transform(vectors)
    ids = [c for c in ("customer_id", "snapshot", "snapshot_date", "lapsed") if c in vectors.columns]
    return scored.select(*ids, vector_to_array("probability")[1].alias(output))


def isotonic_calibrate(
    val_scores: DataFrame, score: str = "score", label: str = "lapsed"
) -> IsotonicCurve:
    """Non-decreasing curve from score to observed rate, fitted on validation scores.

    Rows are counted per different score first; the counts are pooled in ranges of scores.
    """
    return IsotonicCurve(pooled_blocks(score_histogram(val_scores, score, label)))


def calibrate(curve: IsotonicCurve, scored: DataFrame, score: str = "score") -> DataFrame:
    """Add ``calibrated``; scores beyond the fitted range take its ends."""
    return scored.withColumn("calibrated", curve.calibrated(F.col(score)))


def risk_scores(scored: DataFrame, prob: str = "calibrated", bounded: bool = False) -> DataFrame:
    """Per customer: label, probability and risk decile (1 = highest)."""
    probabilities = scored.select("customer_id", "lapsed", F.col(prob).alias("prob_lapse"))
    return risk_deciles(probabilities, "prob_lapse", bounded=bounded)


def model_comparison(
    scored: Mapping[str, DataFrame],
    digits: int | None = 4,
    params: Mapping[str, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """One row per model: ROC-AUC, average precision, Brier score; the best AUC is marked.

    Every frame needs ``lapsed`` and ``score``. All models are evaluated in one pass. With ``params``
    a column of that name has the chosen parameters of each model as JSON, NULL if it has none.
    """
    stacked = None
    for name, df in scored.items():
        part = df.select(F.lit(name).alias("model"), "lapsed", as_double("score").alias("score"))
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no scored frames given")
    found = classification_metrics(stacked, by=["model"], digits=digits)
    best = F.max_by("model", F.struct("roc_auc", "pr_auc")).over(W.partitionBy())  # few models
    found = found.withColumn("is_best", F.col("model") == best)
    if params is None:
        return found
    chosen = F.lit(None).cast("string")
    for name, values in params.items():
        chosen = F.when(F.col("model") == name, json.dumps(dict(values), sort_keys=True)).otherwise(chosen)
    return found.withColumn("params", chosen)


def feature_importance(
    model: Model | BoostedTrees,
    vectors: DataFrame,
    features: Sequence[str] | None = None,
    n_repeats: int = 1,
    seed: int = DEFAULT.random_seed,
    n_top: int = 5,
) -> DataFrame:
    """Per feature ``auc_drop``, what the AUC loses when the feature takes another row's value.

    Rows lie in random groups of about SWAPPED_TOGETHER and in random order in them; each takes the
    values of the next one around. Every feature is replaced in turn and the replaced rows are scored in
    one pass. Scores are counted between SCORE_EDGES common edges, so nothing is sorted; scores
    between the same edges count as ties, which moves a drop by at most ``auc_error``. A feature that
    the model does not use drops exactly 0. ``gain`` is the share of boosted trees' own mean gains
    (NULL for other models), ``is_top`` marks the ``n_top`` largest drops, of equals the first name.
    """
    names = list(features or feature_names())
    n_groups = max(1, vectors.count() // SWAPPED_TOGETHER)
    rows = vectors.select("customer_id", "lapsed", vector_to_array("features").alias("own"))
    stacked = None
    for repeat in range(n_repeats):
        drawn = rows.withColumn("_draw", F.xxhash64("customer_id", F.lit(seed), F.lit(repeat)))
        group = W.partitionBy(F.pmod("_draw", F.lit(n_groups))).orderBy("_draw", "customer_id")
        whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        other = F.coalesce(F.lead("own").over(group), F.first("own").over(whole))
        part = drawn.select(F.lit(repeat).alias("_repeat"), "lapsed", "own", other.alias("other"))
        stacked = part if stacked is None else stacked.unionByName(part)
    variants = F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1)))  # -1 changes nothing
    swapped = F.transform("own", lambda x, i: F.when(i == F.col("_f"), F.col("other")[i]).otherwise(x))
    inputs = stacked.select("_repeat", "lapsed", "own", "other", variants.alias("_f")).select(
        "_repeat", "lapsed", "_f", array_to_vector(swapped).alias("features")
    )
    probability = vector_to_array("probability")[1]
    scored = model.transform(inputs).select("_repeat", "_f", "lapsed", probability.alias("score"))
    counts = score_histogram(
        scored.withColumn("score", F.floor(F.col("score") * SCORE_EDGES)), by=["_repeat", "_f"]
    )  # at most SCORE_EDGES + 1 rows per variant
    below = W.partitionBy("_repeat", "_f").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pairs = F.nullif(F.sum(pos) * F.sum(neg), F.lit(0.0))
    aucs = ranked.groupBy("_repeat", "_f").agg(
        (F.sum(pos * (F.col("_below") + neg / 2)) / pairs).alias("_auc"), (F.sum(pos * neg) / 2 / pairs).alias("_error")
    )
    base = aucs.where(F.col("_f") < 0).select("_repeat", F.col("_auc").alias("_base"), F.col("_error").alias("_base_error"))
    drops = aucs.where(F.col("_f") >= 0).join(base, "_repeat")
    lookup = F.array(*(F.lit(name) for name in names))
    gains = model.gains() if isinstance(model, BoostedTrees) else [None] * len(names)
    gain = F.array(*(F.lit(None if g is None else float(g)).cast("double") for g in gains))
    found = drops.groupBy("_f").agg(
        F.avg(F.col("_base") - F.col("_auc")).alias("auc_drop"), F.avg(F.col("_error") + F.col("_base_error")).alias("auc_error")
    )
    found = found.select(
        F.element_at(lookup, F.col("_f") + 1).alias("feature"), "auc_drop", "auc_error", F.element_at(gain, F.col("_f") + 1).alias("gain")
    )
    place = F.row_number().over(W.orderBy(F.desc_nulls_last("auc_drop"), "feature"))  # a row per feature
    return found.withColumn("is_top", place <= n_top)
