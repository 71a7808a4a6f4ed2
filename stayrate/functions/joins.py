"""Joins of a large table with a lookup table on keys that may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
SALTS = 64
#: A lookup table is repeated to about so many rows at most.
MAX_REPEATED_ROWS = 2_000_000


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    max_broadcast_rows: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Join ``fact`` with ``lookup`` on ``key`` so that no key's rows meet in one task.

    ``lookup`` is counted; up to ``max_broadcast_rows`` rows it is broadcast and ``fact``
    stays where it is. A larger one is repeated under ``salts`` salts, and each row of
    ``fact`` draws its salt from its other columns. Spark splits the rows of a hot key by itself
    where its skew handling is on; there are fewer salts then, or none, so that repeating makes
    no more than MAX_REPEATED_ROWS rows. It is never left to Spark to broadcast, which sizes a
    repeated table as if it were not. ``how`` is ``inner``, ``left``,
    ``left_semi`` or ``left_anti``: joins in which rows of ``lookup`` alone give no result.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot do a {how} join")
    max_broadcast_rows = MAX_BROADCAST_ROWS if max_broadcast_rows is None else max_broadcast_rows
    salts = SALTS if salts is None else salts
    if lookup.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return fact.join(F.broadcast(lookup), key, how)
    if _splits_hot_keys(fact.sparkSession):
        salts = min(salts, MAX_REPEATED_ROWS // lookup.count())
    if salts < 2:
        return fact.join(lookup.hint("merge"), key, how)
    others = [c for c in fact.columns if c != key]
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [key, "_salt"], how).drop("_salt")


def _splits_hot_keys(spark: SparkSession) -> bool:
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(name).lower() == "true" for name in names)
