"""Column expressions on text shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The runs of other than ASCII white space; an empty array for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of ``words``, without keeping them."""
    return F.size(words(text)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shingles(found: Column, k: int) -> Column:
    """The runs of ``k`` words, joined by a space; all words as one run if there are fewer."""
    many = F.transform(
        F.sequence(F.lit(1), F.size(found) - (k - 1)),
        lambda i: F.array_join(F.slice(found, i, k), " "),
    )
    return (
        F.when(F.size(found) == 0, F.array().cast("array<string>"))
        .when(F.size(found) < k, F.array(F.array_join(found, " ")))
        .otherwise(many)
    )


def row_key(*columns: Column) -> Column:
    """A 64-bit number that rows with equal values share; null differs from every value."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def _spelled(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def row_digest(*columns: Column) -> Column:
    """128 bits that rows with equal values share; null differs from every value."""
    parts = [_spelled(c.cast("string")) for c in columns]
    return F.md5(F.concat(*parts).cast("binary"))


def table(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` in the shared folder and read it back, so that later steps share it; options are Parquet's."""
    from stayrate.sources import scratch_path

    target = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
