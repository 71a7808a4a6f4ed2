"""Isotonic calibration by pooling adjacent violators in mergeable blocks.

A block is a run of scores with one rate: its ends, the labels and the rows in it. Pooling two
neighbours whose rates fall gives the same curve in whatever order it is done, so every range of
scores pools its own blocks, and the ranges are cut elsewhere and pooled again until no rate falls
from one range to the next. A task never holds more than about POOLED_ROWS blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.sources import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors have no copy of the package

POOLED_ROWS = 100_000
#: Steps of a curve that are sent to tasks at a time; a longer curve is applied in pieces.
STEPS_AT_A_TIME = 250_000
_BLOCK = "lo double, hi double, positives long, n long"


def pool(blocks: Iterator[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Pool ascending blocks until their rates rise."""
    done: list[tuple[float, float, int, int]] = []
    for lo, hi, positives, n in blocks:
        while done and done[-1][2] * n >= positives * done[-1][3]:
            before = done.pop()
            lo, positives, n = before[0], before[2] + positives, before[3] + n
        done.append((lo, hi, positives, n))
    return done


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    found = pool(rows)
    if found:
        types = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
        columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["lo", "hi", "positives", "n"])


def _falls_between(pooled: DataFrame) -> bool:
    """Whether a rate falls, or stays, from one range to the next; a row per range."""
    rate = F.col("positives") / F.col("n")
    ranges = pooled.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min("lo").alias("lo"), F.min_by(rate, "lo").alias("first"), F.max_by(rate, "lo").alias("last")
    )
    before = F.lag("last").over(W.orderBy("lo"))
    return not ranges.select((F.col("first") <= before).alias("falls")).where("falls").isEmpty()


def pooled_blocks(counts: DataFrame) -> DataFrame:
    """(lo, hi, positives, n) of the rising steps over ``counts`` (score, pos, neg; a row per score)."""
    rows = F.col("pos") + F.col("neg")
    blocks = materialise(
        counts.where((rows > 0) & F.col("score").isNotNull()).select(
            F.col("score").alias("lo"), F.col("score").alias("hi"), F.col("pos").alias("positives"), rows.alias("n")
        )
    )
    turn, size = 0, blocks.count()
    while True:
        # another number of ranges each time, so what met at a cut is inside a range next time
        n_ranges = -(-size // POOLED_ROWS)
        n_ranges = max(n_ranges, 1) if n_ranges < 2 else n_ranges + turn % 2
        placed = blocks.coalesce(1) if n_ranges == 1 else blocks.repartitionByRange(n_ranges, "lo")
        blocks = materialise(placed.sortWithinPartitions("lo").mapInArrow(_pooled, _BLOCK))
        if n_ranges == 1 or not _falls_between(blocks):
            return blocks
        turn, size = turn + 1, blocks.count()


class IsotonicCurve:
    """A rising curve: the rate inside steps, straight lines between them, the end rates beyond.

    ``steps`` is a frame (lo, hi, positives, n). Pieces of at most about STEPS_AT_A_TIME steps are
    fetched and sent to the tasks, so no step of its use holds a curve of any length at once.
    """

    def __init__(self, steps: DataFrame):
        self.steps = steps
        n_pieces = -(-steps.count() // STEPS_AT_A_TIME)
        shares = [i / n_pieces for i in range(1, n_pieces)]
        cuts = sorted(set(steps.approxQuantile("lo", shares, 0.1 / n_pieces))) if shares else []
        self.cuts = cuts if n_pieces else None

    def _piece(self, first: float | None, until: float | None) -> tuple[np.ndarray, np.ndarray]:
        """The knots from the step at ``first`` to the beginning of the step at ``until``."""
        mine = self.steps if first is None else self.steps.where(F.col("lo") >= first)
        mine = mine if until is None else mine.where(F.col("lo") <= until)
        found = mine.select("lo", "hi", (F.col("positives") / F.col("n")).alias("rate")).toPandas().sort_values("lo")
        ends, rates = found[["lo", "hi"]].to_numpy().ravel(), np.repeat(found["rate"].to_numpy(), 2)
        own = np.ones(len(ends), bool)
        own[1::2] = found["hi"].to_numpy() > found["lo"].to_numpy()
        return ends[own], rates[own]

    def calibrated(self, score: Column) -> Column:
        """The rate at ``score``; NULL without a score or without a curve."""
        if self.cuts is None:
            return F.lit(None).cast("double")
        edges = [None, *self.cuts, None]
        found: Column | None = None
        for first, until in reversed(list(zip(edges, edges[1:], strict=False))):
            here = _interpolated(self.steps, *self._piece(first, until))(score.cast("double"))
            found = here if found is None else F.when(score < until, here).otherwise(found)
        return found


def _interpolated(frame: DataFrame, x: np.ndarray, y: np.ndarray):
    shipped = frame.sparkSession.sparkContext.broadcast((x, y))  # bounded: a piece of a curve

    @F.arrow_udf("double")
    def at(score: pa.Array) -> pa.Array:
        known_x, known_y = shipped.value
        values = score.fill_null(0.0).to_numpy(zero_copy_only=False)
        return pa.array(np.interp(values, known_x, known_y), mask=score.is_null().to_numpy(zero_copy_only=False))

    return at
