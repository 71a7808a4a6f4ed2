"""Exact duplicates by a two-pass Bloom filter.

The first pass puts a hash of every text in a blocked Bloom filter whose cells remember
whether they were hit once or more. The second pass tests every hash: a row whose cells
were all hit more than once may be repeated and is shuffled by its digest; every other row
is unique and passes straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.native import SPACE, stored

#: The filter's size in 64-bit blocks. The largest filter is fixed, so it may be broadcast;
#: beyond about 100 million texts more unique rows take the shuffle, with the same result.
MIN_BLOCKS, MAX_BLOCKS, BLOCKS_PER_ROW = 1 << 10, 1 << 22, 0.5


def normalised(text: Column) -> Column:
    """``text`` with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def filter_blocks(rows: int) -> int:
    """The number of blocks, a power of two, for so many rows."""
    blocks = MIN_BLOCKS
    while blocks < min(MAX_BLOCKS, rows * BLOCKS_PER_ROW):
        blocks *= 2
    return blocks


def _cells(digests: DataFrame, blocks: int) -> DataFrame:
    """Add the block and the mask of two bits that a digest sets in it."""
    bit = "shiftrightunsigned(h, {}) & 63"
    one, two = (f"cast({bit.format(shift)} AS int)" for shift in (40, 50))
    return digests.withColumns(
        {
            "block": F.pmod(F.col("h"), F.lit(blocks)),
            "bits": F.expr(f"array({one}, {two})"),
            "mask": F.expr(f"shiftleft(1L, {one}) | shiftleft(1L, {two})"),
        }
    )


def repeated_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """First pass: per block, the bits that more than one row sets."""
    cells = _cells(digests, blocks).select("block", F.explode(F.array_distinct("bits")).alias("bit"))
    hit = cells.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hit.groupBy("block").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("filter")
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after ``normalised``; of equal texts the smallest
    id is kept. Null texts are empty and equal to each other. Rows that repeat an id and a
    text are one group like any other, and each of them is reported; all of them are kept
    if theirs is the smallest id. A null id is never smaller than another id. Empty tables
    give an empty result; other columns of ``docs`` are ignored.
    """
    text = normalised(F.col(text_column))
    digests = stored(
        docs.select(
            F.col(id_column).alias("id"), text.alias("t")
        ).select("id", F.sha2("t", 256).alias("sha"), F.xxhash64("t").alias("h")),
        "digests",
    )
    blocks = filter_blocks(digests.count())
    # At most MAX_BLOCKS rows of 16 bytes.
    seen = F.broadcast(repeated_filter(digests, blocks))
    tested = _cells(digests, blocks).join(seen, "block", "left").select(
        "id",
        "sha",
        F.coalesce(F.col("mask").bitwiseAND(F.col("filter")) == F.col("mask"), F.lit(False)).alias("maybe"),
    )
    groups = (
        tested.where("maybe").groupBy("sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    both = (
        tested.where("maybe").join(groups, "sha").select("id", "keep_id", "group_size", "sha")
    ).unionByName(
        tested.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    )
    return both.select(
        F.col("id").alias(id_column),
        F.col("keep_id").alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
