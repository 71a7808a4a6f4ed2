"""Token counts: an exact histogram of encoded lengths, and what follows from it.

Documents are encoded in tasks, which return counts per length only. Suffix sums over the
lengths then answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lengths are summed in blocks of so many, so no window holds more rows than that.
BLOCK = 4096


def _encoder(ranks_file: bytes, pattern: str):
    import tiktoken

    known = tiktoken.__dict__.setdefault("_length_encoders", {})  # kept while the worker lives
    key = hash((ranks_file, pattern))
    if key not in known:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        known[key] = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return known[key]


def _counter(ranks_file, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_file.value, pattern)
        lengths: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                lengths[len(encoder.encode_ordinary(text.as_py() or ""))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(lengths.keys(), pa.int64()), pa.array(lengths.values(), pa.int64())], ["length", "n"]
        )

    return run


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """``length`` (tokens) and ``n_docs`` over whole texts; null and empty texts have length 0.

    ``ranks_path`` names a file of ranks of a byte-level BPE, which the driver reads, and
    ``pattern`` is what cuts texts before merging. Repeated rows count each; an empty table
    gives an empty result; other columns are ignored.
    """
    with open(ranks_path, "rb") as ranks:
        shipped = docs.sparkSession.sparkContext.broadcast(ranks.read())
    counted = docs.select(text_column).mapInArrow(_counter(shipped, pattern), "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Add running sums to a histogram: a row answers for its length as a context limit.

    ``docs_at_most``, ``tokens_at_most``: documents no longer than that, and their tokens;
    ``docs_longer``: the others; ``truncated_tokens``: all tokens if every document is cut at
    that length; ``share_at_most``: the share of documents that fit, whose inverse is the
    quantile. Windows run inside blocks of lengths and over the totals of the blocks.
    """
    cut = histogram.withColumns(
        {"block": F.floor(F.col("length") / BLOCK), "tokens": F.col("length") * F.col("n_docs")}
    )
    totals = cut.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    offsets = totals.select(
        "block",
        *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("bd", "bt")),
        F.sum("bd").over(whole).alias("all_docs"),
        F.sum("bt").over(whole).alias("all_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    docs_longer = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("bd_later")
    tokens_longer = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("bt_later")
    summed = cut.join(offsets, "block").withColumns({"docs_longer": docs_longer, "tokens_longer": tokens_longer})
    return summed.select(
        "length",
        "n_docs",
        "docs_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_at_most"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("share_at_most"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: ``tokens`` if every document is cut at ``limit``, which need not be a length."""
    fits = F.col("length") <= limit
    found = sums.agg(
        F.coalesce(F.max(F.when(fits, F.col("tokens_at_most"))), F.lit(0)).alias("t"),
        F.coalesce(F.max(F.when(fits, F.col("docs_at_most"))), F.lit(0)).alias("d"),
        F.coalesce(F.max("docs_at_most"), F.lit(0)).alias("all"),
    )
    return found.select((F.col("t") + limit * (F.col("all") - F.col("d"))).alias("tokens"))


def length_quantiles(sums: DataFrame, probs: list[float]) -> DataFrame:
    """One row: per probability the smallest length that so many documents do not exceed."""
    return sums.agg(
        *(F.min(F.when(F.col("share_at_most") >= p, F.col("length"))).alias(f"q{i}") for i, p in enumerate(probs))
    )
