"""The operators as queries over a directory of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm import (
    alignment,
    decontaminate,
    exact_dedup,
    mixing,
    near_dedup,
    piece_codec,
    ranked_search,
    sharding,
    suffix_dedup,
    token_counts,
    tool_calls,
    toxicity,
    url_filter,
)
from stayrate.llm.native import table
from stayrate.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _op1(spark: SparkSession, path: str) -> DataFrame:
    turns = table(spark, path, "conversations")
    calls, results = tool_calls.calls_of_turns(turns)
    linked = tool_calls.link_calls(calls, results, tool_calls.TURN_TOOLS)
    return linked.unionByName(tool_calls.turns_without_part(turns))


def _op2(spark: SparkSession, path: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, path, "documents"), table(spark, path, "benchmark"))


def _op3(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = token_counts.length_histogram(table(spark, path, "documents"), ranks, public_tokenizers.PATTERN)
    return token_counts.suffix_sums(found)


def _op4(spark: SparkSession, path: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, path, "documents"))


def _op5(spark: SparkSession, path: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, path, "documents"))


def _op6(spark: SparkSession, path: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, path, "documents"), k=4, percent=80)


def _op7(spark: SparkSession, path: str) -> DataFrame:
    return sharding.shard_documents(table(spark, path, "documents"), 16)


def _op8(spark: SparkSession, path: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, path, "pages"))


def _op9(spark: SparkSession, path: str) -> DataFrame:
    return toxicity.toxicity(table(spark, path, "documents"), table(spark, path, "labels"))


def _op10(spark: SparkSession, path: str) -> DataFrame:
    quality = mixing.quality_weights(table(spark, path, "labels"))
    mixed = mixing.mix(table(spark, path, "documents"), quality)
    return mixed.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "times", "taken")


def _op11(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_codec.decode_ids(piece_codec.encode_texts(table(spark, path, "documents"), model), model)
    ids = F.array_join("ids", ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _op12(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    models = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(table(spark, path, "documents"), *models)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def _op13(spark: SparkSession, path: str) -> DataFrame:
    return ranked_search.search(table(spark, path, "documents"), table(spark, path, "benchmark"), 50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_call_linking": _op1,
    "op2_benchmark_decontamination": _op2,
    "op3_token_counts": _op3,
    "op4_exact_dedup": _op4,
    "op5_suffix_dedup": _op5,
    "op6_minhash_near_dedup": _op6,
    "op7_sharding": _op7,
    "op8_url_filter": _op8,
    "op9_toxicity": _op9,
    "op10_source_mixing": _op10,
    "op11_piece_codec": _op11,
    "op12_token_alignment": _op12,
    "op13_ranked_search": _op13,
}
