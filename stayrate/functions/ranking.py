"""Ranks, running totals and quantiles over frames too large for one task.

A window without partitions moves every row to one task. Here rows are range
partitioned on the order instead, each partition is ranked or summed on its own, and
the totals of the partitions before it (one row per partition) are added. The placed
rows are materialised, since range bounds come from a sample and both the totals and
the rows must see the same bounds.

Order columns should be unique together, so that no group of equal keys has to stay in
one partition. To rank by a heavily tied value, add a tie-break, or group by the value
first and carry counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.sources.checkpoints import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def _place(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sort ``df`` across partitions; add the partition and the 1-based row number in it."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ordered.withColumn("_slot", F.monotonically_increasing_id()))
    return placed.select(
        *df.columns,
        F.shiftright("_slot", _ROW_BITS).alias("_part"),
        (F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).alias("_row"),
    )


def _with_offsets(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Add, per total, what the earlier partitions hold and what all of them hold."""
    per_part = placed.groupBy("_part").agg(*(total.alias(name) for name, total in totals.items()))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = per_part.select(
        "_part",
        *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals),
        *(F.sum(n).over(everywhere).alias(f"_all_{n}") for n in totals),
    )
    # One row per range partition: bounded by the number of shuffle partitions.
    return placed.join(F.broadcast(offsets), "_part")


def distributed_rank(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``rank`` (1-based) by ``order`` ascending, and ``n_ranked``, the number of rows."""
    ranked = _with_offsets(_place(df, order), {"rows": F.count(F.lit(1))})
    return ranked.select(
        *df.columns,
        (F.col("_before_rows") + F.col("_row")).alias("rank"),
        F.col("_all_rows").alias("n_ranked"),
    )


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``cum_<c>``, inclusive running sums by ``order``, and ``total_<c>``."""
    placed = _place(df, order)
    offsets = _with_offsets(placed, {c: F.sum(c) for c in sums})
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    return offsets.select(
        *df.columns,
        *((F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums),
        *(F.col(f"_all_{c}").alias(f"total_{c}") for c in sums),
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    bounded: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """One row with ``n`` and the linearly interpolated quantiles ``q0, q1, ...`` of ``value``.

    Values are counted first, so repeated values cost one row; if ``df`` has one row per
    value already, ``weight`` names the column with its number of occurrences. With ``bounded=True`` the
    caller states that the number of different values has a fixed limit (days, ages,
    months), and Spark's exact percentile merges the counts in one task. Otherwise the
    order statistics come from distributed running totals.
    """
    known = df.where(F.col(value).isNotNull())
    if weight is None:
        counts = known.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = known.select(F.col(value).alias("v"), F.col(weight).alias("n"))
    if bounded:
        found = F.percentile("v", [float(p) for p in probs], F.col("n"))
        both = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), found.alias("q"))
        return both.select("n", *(F.col("q")[i].alias(f"q{i}") for i in range(len(probs))))

    ranked = running_totals(counts, ["v"], ["n"])
    value_at = F.col("v").cast("double")
    last = (F.col("total_n") - 1).cast("double")
    picks: list[Column] = []
    for i, p in enumerate(probs):
        position = last * F.lit(float(p))
        picks.append(F.min(F.when(F.col("cum_n") > F.floor(position), value_at)).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("cum_n") > F.ceil(position), value_at)).alias(f"_hi{i}"))
    ends = ranked.agg(F.coalesce(F.max("total_n"), F.lit(0)).alias("n"), *picks)

    def between(i: int, p: float) -> Column:
        position = (F.col("n") - 1).cast("double") * F.lit(float(p))
        weight = position - F.floor(position)
        return F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * weight

    return ends.select("n", *(between(i, p).alias(f"q{i}") for i, p in enumerate(probs)))


def _steps(q: int) -> list[float]:
    return [i * (1.0 / q) for i in range(q)] + [1.0]


def quantile_edges(df: DataFrame, value: str, q: int, bounded: bool = False) -> list[float]:
    """The different edges of the ``q`` quantile bins of ``value``, at most ``q + 1`` numbers.

    ``df`` is evaluated here and again by whoever bins it, so pass a stored or materialised
    frame. ``bounded`` is as in ``exact_quantiles``.
    """
    row = exact_quantiles(df, value, _steps(q), bounded).first()
    return sorted({row[f"q{i}"] for i in range(q + 1)}) if row["n"] else []


def edge_bin(value: str, edges: Sequence[float]) -> Column:
    """The 1-based bin of ``value`` between ``edges``; NULL without at least two of them."""
    if len(edges) < 2:
        return F.lit(None).cast("bigint")
    number: Column = F.lit(1)
    for edge in edges[1:-1]:
        number = number + F.when(F.col(value).cast("double") > edge, 1).otherwise(0)
    return F.when(F.col(value).isNotNull(), number.cast("bigint"))


def quantile_bins(
    df: DataFrame, value: str, q: int, output: str, bounded: bool = False
) -> DataFrame:
    """Add ``output``: the 1-based quantile bin of ``value``.

    Bins are closed on the right and the lowest value belongs to the first. Equal edges
    are merged, which leaves fewer bins; when all values are equal the bin is NULL.
    """
    return df.withColumn(output, edge_bin(value, quantile_edges(df, value, q, bounded)))


def rank_quantile_bins(
    df: DataFrame, value: str, q: int, tiebreak: str, output: str
) -> DataFrame:
    """Add ``output``: the 1-based quantile bin of the rank of ``value``.

    Ties are ranked by ``tiebreak``, so the bins are evenly filled whatever the ties.
    A single row has no bin.
    """
    ranked = distributed_rank(df, [value, tiebreak])
    steps = ranked.withColumn("_span", F.col("n_ranked") - 1)
    # ceil((rank - 1) * q / span) in whole numbers, at least 1
    bin_number = F.expr(f"greatest(1L, ((rank - 1) * {q} + _span - 1) div nullif(_span, 0))")
    return steps.withColumn(output, F.when(F.col("_span") > 0, bin_number)).select(
        *df.columns, output
    )
