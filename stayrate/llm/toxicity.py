"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words is trained in numpy from confirmed toxic documents and
unlabelled ones. With the class prior p, the risk is

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

so that toxic documents among the unlabelled are not learnt as clean ones. When a step's
bracket is negative, the step goes up its gradient instead, which undoes over-fitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.kernels import features_of_words, pieces, text_bytes
from stayrate.llm.native import stored

BITS, PREFIXES = 18, (5, 6, 7, 8)
#: Rows that are fitted on at most: those with the smallest hashes of their ids.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
PSEUDO, SIGMAS = 1.0, 5.0
EPOCHS, MIN_STEPS, BATCH, RATE, DECAY, SEED = 6, 60, 256, 0.02, 1e-4, 11


def held_out(id_column: Column) -> Column:
    """True for the ids whose labels are never learnt from."""
    return F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 5 == 0


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, starts = text_bytes(batch.column("text"))
        for a, b in pieces(starts):
            numbers, owner = features_of_words(body[starts[a] : starts[b]], starts[a : b + 1] - starts[a], PREFIXES, BITS)
            ends = np.searchsorted(owner, np.arange(b - a + 1))
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("kind").slice(a, b - a), rows], ["kind", "features"])


def feature_values(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """How much more often each feature is in positive documents than in unlabelled ones.

    The log of the ratio of the counts, with pseudo-counts; 0 if the counts lie within
    ``SIGMAS`` standard deviations of each other, which keeps chance words out.
    """
    size = 1 << BITS
    found = np.bincount(np.concatenate(positive), minlength=size)
    expected = np.bincount(np.concatenate(unlabelled), minlength=size) * (len(positive) / len(unlabelled))
    clear = np.abs(found - expected) > SIGMAS * np.sqrt(expected + 1)
    return np.where(clear, np.log((found + PSEUDO) / (expected + PSEUDO)), 0.0)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept. Documents are arrays of feature numbers.

    Adam on mini-batches that hold both kinds in proportion; the loss is logistic. A feature's
    value in a document is its ``feature_values``, over the root of the number of features.
    """
    random = np.random.default_rng(SEED)
    size = 1 << BITS
    if not sum(map(len, positive)) or not sum(map(len, unlabelled)):
        return np.zeros(size, np.float32), float(np.log(prior / (1 - prior)))
    scale = feature_values(positive, unlabelled)
    weights, first, second = np.ones(size), np.zeros(size), np.zeros(size)
    bias, bias_first, bias_second = float(np.log(prior / (1 - prior))), 0.0, 0.0
    steps = max(1, len(unlabelled) // BATCH)
    share = max(8, len(positive) * BATCH // len(unlabelled))
    t = 0
    for _ in range(max(EPOCHS, MIN_STEPS // steps)):
        order_u, order_p = random.permutation(len(unlabelled)), random.permutation(len(positive))
        for s in range(steps):
            mine = [unlabelled[i] for i in order_u[s * BATCH : (s + 1) * BATCH]]
            n_u = len(mine)
            mine += [positive[order_p[(s * share + i) % len(order_p)]] for i in range(share)]
            lengths = np.array([len(x) for x in mine])
            columns = np.concatenate(mine)
            rows = np.repeat(np.arange(len(mine)), lengths)
            value = document_scale(lengths)
            used = scale[columns]
            margin = np.bincount(rows, weights[columns] * used, len(mine)) * value + bias
            toxic = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            u, p = toxic[:n_u], toxic[n_u:]
            loss = np.logaddexp(0, margin)
            negative_risk = loss[:n_u].mean() - prior * loss[n_u:].mean()
            # Slopes of the losses: toxic - 1 for the label 1, toxic for the label 0.
            slope = np.concatenate([u / n_u, -prior * p / len(p)])
            if negative_risk >= 0:
                slope[n_u:] += prior * (p - 1) / len(p)
            else:
                slope = -slope
            t += 1
            part = np.bincount(columns, np.repeat(slope * value, lengths) * used, size) + DECAY * (weights - 1)
            first += 0.1 * (part - first)
            second += 0.01 * (part**2 - second)
            rate = RATE * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            weights -= rate * first / (np.sqrt(second) + 1e-8)
            g = slope.sum()
            bias_first += 0.1 * (g - bias_first)
            bias_second += 0.01 * (g * g - bias_second)
            bias -= rate * bias_first / (np.sqrt(bias_second) + 1e-8)
    return (weights * scale).astype(np.float32), float(bias)


def document_scale(lengths: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(lengths, 64) / 64)


def _scorer(model, text_column: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            body, starts = text_bytes(batch.column(text_column))
            scores = np.zeros(batch.num_rows)
            for a, b in pieces(starts):
                numbers, owner = features_of_words(body[starts[a] : starts[b]], starts[a : b + 1] - starts[a], PREFIXES, BITS)
                total = np.bincount(owner, weights[numbers].astype(np.float64), b - a)
                margin = total * document_scale(np.bincount(owner, minlength=b - a)) + bias
                scores[a:b] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            names = [n for n in batch.schema.names if keep_text or n != text_column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores)], [*names, "score"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, float]:
    """Fit on labelled rows that are not held out: (weights, intercept).

    The prior is the share of toxic rows among them. Positives are rows labelled 1, and the
    unlabelled ones are rows of whatever label, which is not looked at. Ids labelled both ways
    count as toxic; null ids and null labels are not used.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col(id_column)))
    known = stored(usable.groupBy(F.col(id_column).alias("id")).agg(F.max("toxic").alias("toxic")), "known")
    shares = known.agg(F.avg("toxic").alias("prior")).first()
    prior = min(0.95, max(0.001, float(shares["prior"] or 0.01)))
    order = (F.xxhash64("id"), "id")
    chosen = known.where("toxic = 1").orderBy(*order).limit(MAX_POSITIVE).select("id", F.lit(1).alias("kind"))
    rest = known.orderBy(F.hash("id"), "id").limit(MAX_UNLABELLED).select("id", F.lit(0).alias("kind"))
    wanted = stored(chosen.unionByName(rest), "chosen")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # At most MAX_POSITIVE + MAX_UNLABELLED ids.
    picked = texts.join(F.broadcast(wanted), "id").select("kind", "text")
    rows = picked.mapInArrow(_extract, "kind int, features array<int>").toArrow()
    kind = rows.column("kind").to_numpy()
    features = rows.column("features").combine_chunks()
    flat, ends = features.values.to_numpy(), features.offsets.to_numpy()
    all_rows = [flat[ends[i] : ends[i + 1]] for i in range(len(kind))]
    return train(
        [x for x, y in zip(all_rows, kind) if y == 1], [x for x, y in zip(all_rows, kind) if y == 0], prior
    )


def score_toxicity(
    docs: DataFrame, model: tuple[np.ndarray, float], text_column: str = "text", keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``score``, which replaces a column of that name; without the text if wished.

    Only the text decides; null and empty texts get the score of no features.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "score" or c == text_column))
    kept = [f"`{name}` {kind}" for name, kind in plain.dtypes if keep_text or name != text_column]
    return plain.mapInArrow(_scorer(shipped, text_column, keep_text), ", ".join([*kept, "score double"]))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Repeated rows get the same score each; a null id is not held out. Without labels the
    score is the prior's. Empty tables give an empty result; other columns are ignored.
    """
    model = fit_toxicity(docs, labels, id_column, text_column)
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    scored = score_toxicity(plain, model, keep_text=False)
    return scored.select(
        F.col("id").alias(id_column),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
