"""Shards of nearly equal size by longest-processing-time scheduling.

Groups that must stay together are taken by falling size; each goes to the shard with the
least load, which a heap holds. Groups of one size are alike, so the schedule is made on
(size, number of groups), of which there are at most sqrt(2 * total size): the sizes
present are different whole numbers and their sum is at most the total. Groups then find
their shard by their rank among those of their size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.ranking import distributed_rank
from stayrate.llm.native import n_bytes, stored

SPANS = "size long, shard int, first long, last long"


def schedule(runs: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, int, int, int]]:
    """Assign runs of (size, count), largest size first; yields (size, shard, first, last).

    Of the groups of a size, numbered from 1, those from first to last go to the shard.
    Equal loads go to the smallest shard number. Rounds in which every shard gets one group
    leave the order of the shards as it is once their loads lie within one size of each
    other, so they are dealt at once.
    """
    loads = [(0, shard) for shard in range(n_shards)]
    heapq.heapify(loads)
    for size, count in runs:
        given = [0] * n_shards
        left = count
        while left:
            if left >= n_shards and max(loads)[0] - loads[0][0] <= size:
                rounds, left = divmod(left, n_shards)
                for shard in range(n_shards):
                    given[shard] += rounds
                loads = [(load + rounds * size, shard) for load, shard in loads]
                heapq.heapify(loads)
                continue
            load, shard = loads[0]
            heapq.heapreplace(loads, (load + size, shard))
            given[shard] += 1
            left -= 1
        first = 1
        for shard, number in enumerate(given):
            if number:
                yield size, shard, first, first + number - 1
                first += number


def _scheduler(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs():
            for batch in batches:
                yield from zip(batch.column("size").to_pylist(), batch.column("n").to_pylist())

        rows = []
        names = ["size", "shard", "first", "last"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names
            )

        for row in schedule(runs(), n_shards):
            rows.append(row)
            if len(rows) == 50_000:
                yield batch()
                rows.clear()
        yield batch()

    return run


def assign_shards(groups: DataFrame, n_shards: int, key: str = "key", size: str = "size") -> DataFrame:
    """``key`` and ``shard`` for groups of ``size`` (at least 1); keys must be unique."""
    by_size = groups.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    # Summed in many tasks; one then reads a row per different size, at most sqrt(2 * total size) of them.
    spans = by_size.repartition(1).sortWithinPartitions(F.desc("size")).mapInArrow(_scheduler(n_shards), SPANS)
    spans = stored(spans, "spans")
    ranked = distributed_rank(groups.select(F.col(key).alias("key"), F.col(size).alias("size")), ["size", "key"])
    starts = stored(ranked, "ranked")
    before = starts.groupBy("size").agg((F.min("rank") - 1).alias("before"))
    placed = starts.join(before, "size").withColumn("number", F.col("rank") - F.col("before"))
    # A size has at most n_shards spans: the join makes that many rows per group at most.
    found = placed.join(spans, (placed["size"] == spans["size"]) & F.col("number").between(F.col("first"), F.col("last")))
    return found.select(F.col("key").alias(key), "shard")


def shard_documents(
    docs: DataFrame,
    n_shards: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
    group: Column | None = None,
) -> DataFrame:
    """Put every row into one of ``n_shards`` shards: id, size, text_crc32, shard, slot.

    Rows with equal texts stay together, or those with an equal ``group``. A row's size is
    its text's UTF-8 bytes plus 1; null texts count as empty and are equal to empty ones.
    Slots number the rows of a shard from 0 without gaps, by id and checksum. Repeated rows
    get a slot each. A group larger than a shard's fair share makes its shard larger than
    the others. Empty tables give an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    key = F.sha2(text, 256) if group is None else F.sha2(F.coalesce(group.cast("string"), F.lit("")), 256)
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            key.alias("key"),
            (n_bytes(F.col(text_column)) + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        ),
        "sizes",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    placed = rows.join(assign_shards(groups, n_shards), "key").select("id", "size", "crc", "shard")
    ranked = stored(distributed_rank(placed, ["shard", "id", "crc", "size"]), "slots")
    # One row per shard.
    starts = F.broadcast(ranked.groupBy("shard").agg(F.min("rank").alias("start")))
    return ranked.join(starts, "shard").select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
