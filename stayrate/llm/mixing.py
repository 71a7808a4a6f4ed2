"""Mix sources to target weights by Efraimidis-Spirakis sampling.

A source's target in words may be a multiple of what it has. Its complete epochs take every
document; the rest is a weighted sample without replacement: each document draws an
exponential key, divided by its quality weight, and the smallest keys are taken until the
words they add up to reach the rest of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.ranking import running_totals
from stayrate.llm.native import n_words, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Weights of documents labelled good, labelled bad, and not labelled.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.8


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``.

    Sources in the order of their code points, null last, weigh ``weights`` over and over,
    and share the whole size. What a share has above ``max_epochs`` times its source's size
    goes to the others by weight, until none is above. That is a common factor on the
    weights, cut at each source's limit: sources reach their limit in the order of
    limit / weight, so running sums in that order tell the factor.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    named = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    limited = named.withColumn("limit", F.col("source_size") * float(max_epochs)).withColumn(
        "reach", F.col("limit") / F.col("weight")
    )
    everything = W.partitionBy(F.lit(0))
    earlier = W.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    summed = limited.withColumns(
        {
            "whole": F.sum("source_size").over(everything),
            "full": F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)),
            "heavy": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        }
    )
    factor = (F.col("whole") - F.col("full")) / F.col("heavy")
    summed = summed.withColumn("factor", factor)
    # The first in that order whose limit the factor does not pass; its equals share the factor.
    holds = F.when(F.col("factor") <= F.col("reach"), F.struct("reach", "full", "factor"))
    with_factor = summed.withColumn("factor", F.min(holds).over(everything)["factor"])
    target = F.least("limit", F.col("weight") * F.col("factor"))
    return with_factor.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def exponential_key(id_column: Column, weight: Column, seed: str = "mix") -> Column:
    """``-ln(u) / weight`` with a uniform ``u`` in (0, 1) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(id_column.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def quality_weights(labels: DataFrame, id_column: str = "doc_id", quality_column: str = "quality") -> DataFrame:
    """One weight per labelled id; labels that disagree give their mean weight."""
    weight = F.when(F.col(quality_column) == 1, GOOD).when(F.col(quality_column) == 0, BAD).otherwise(UNKNOWN)
    known = labels.where(F.col(id_column).isNotNull())
    return known.groupBy(F.col(id_column).alias("id")).agg(F.avg(weight).alias("w"))


def mix(
    docs: DataFrame,
    weights_by_id: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, times, taken.

    ``size`` counts words, ``times`` how often the mix takes the document, ``taken`` is
    their product. The last document of a sample is taken if at least half of it fits, so a
    source misses its target by at most half a document. ``weights_by_id`` has ``id`` and
    ``w``; ids without one weigh ``UNKNOWN``. Null texts and blank ones have size 0: they are
    taken in complete epochs, and in the sample when they fit. A null source is a source.
    Repeated rows count as documents of their own with the same key; rows that agree in
    everything are taken alike or differ only in which of them is taken. Empty tables give
    an empty result. ``carry`` names whole-number columns that are returned too; they break ties.
    """
    carried = [f"carry_{i}" for i in range(len(carry))]
    plain = docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).cast("string").alias("source"),
        n_words(F.col(text_column)).alias("size"),
        *(F.col(c).alias(name) for c, name in zip(carry, carried)),
    )
    weighed = plain.join(weights_by_id, "id", "left")
    slim = stored(
        weighed.select(
            "id", "source", "size", *carried, exponential_key(F.col("id"), F.coalesce("w", F.lit(UNKNOWN))).alias("key")
        ),
        "sized",
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, max_epochs), "targets")
    rank = targets.select("source", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("nr"))
    # Order by the source's number: a null source then needs no case of its own.
    numbered = slim.join(rank, slim["source"].eqNullSafe(rank["source"])).select("id", "size", *carried, "key", "nr")
    totals = stored(running_totals(numbered, ["nr", "key", "id", "size", *carried], ["size"]), "running")
    nr = W.orderBy(F.col("source").asc_nulls_last())
    plan = targets.withColumns(
        {
            "nr": F.row_number().over(nr),
            "before": F.coalesce(
                F.sum("source_size").over(nr.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ),
            "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
        }
    )
    found = totals.join(plan, "nr")
    so_far = F.col("cum_size") - F.col("before") - F.col("size")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (so_far + F.col("size") / 2 <= rest) & (F.col("epochs") < max_epochs) & (rest > 0)
    times = F.col("epochs").cast("long") + F.when(extra, 1).otherwise(0)
    return found.select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        times.cast("long").alias("times"),
        (times * F.col("size")).cast("long").alias("taken"),
        *(F.col(name).alias(c) for c, name in zip(carry, carried)),
    )
