"""From raw documents to shards of training text: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from stayrate.llm.native import row_key, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on labels of ``docs``.

    Null and empty texts have the score of no features and stay unless that is toxic; equal texts
    fare alike. Rows keep all their columns, whatever their names. Empty documents stay empty.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    names = {"score": "score"}
    while names["score"] in docs.columns:  # the score takes the place of a column of its name
        names["score"] += "_"
    scored = toxicity.score_toxicity(docs.withColumnsRenamed(names), model)
    return scored.where("score < 0.5").select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; all that have no words.

    Rows count by id and text, so other texts of an id and rows without one have groups of their
    own. A group keeps its smallest id, null ids last, and one of exactly repeated rows: the least
    by its columns. Rows keep all their columns, whatever their names. Empty documents stay empty.
    """
    row = row_key(F.col("doc_id"), F.col("text")).alias("row")
    found = near_dedup.near_duplicates(docs.select(row, "text"), id_column="row")
    counted = found.groupBy("row", "component_id", (F.col("n_shingles") == 0).alias("blank")).agg(F.count(F.lit(1)).alias("n"))
    ids = docs.select(row, "doc_id").distinct()
    rows = stored(counted.join(ids, "row"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n")
    first = rows.where("not blank").groupBy("component_id").agg(F.min(order).alias("first"))
    wanted = first.select("first.row", (F.col("first.n") > 1).alias("again"))
    blank = rows.where("blank").select("row", F.lit(False).alias("again"))
    whole = docs.select(row, F.expr("struct(*)").alias("doc"))
    taken = stored(whole.join(wanted.unionByName(blank), "row"), "taken")
    again = taken.where("again").groupBy("row").agg(F.min("doc").alias("doc"))
    return taken.where("not again").select("doc.*").unionByName(again.select("doc.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none; equal rows fare alike. Rows keep all their columns, whatever
    their names. Empty documents stay empty, and without items all documents stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source like others; null and empty texts have no size and are taken with whole
    epochs. Of equal rows those that are less by their columns are taken more often, where a source's
    target ends among them. Rows keep all their columns, whatever their names. Empty documents stay empty.
    """
    quality = mixing.quality_weights(table(spark, sf_dir, "labels"))
    row = row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("row")
    mixed = mixing.mix(docs.select("doc_id", "source", "text", row), quality, carry=["row"])
    by_row = stored(mixed.groupBy("row", "times").agg(F.count(F.lit(1)).alias("n")), "times")
    # Of equal rows some may be taken once more than the others, where a source's target ends.
    least = by_row.groupBy("row").agg(F.min("times").alias("times"), F.max(F.struct("times", "n")).alias("most"))
    taken = docs.select(row, F.expr("struct(*)").alias("doc")).join(least.where("most.times > 0"), "row")
    even = taken.where("times = most.times").drop("most")
    nr = F.row_number().over(W.partitionBy("row").orderBy("doc"))
    uneven = taken.where("times < most.times").withColumn("nr", nr)
    dealt = uneven.withColumn("times", F.when(F.col("nr") <= F.col("most.n"), F.col("most.times")).otherwise(F.col("times")))
    both = even.unionByName(dealt.drop("most", "nr")).where("times > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return both.select("doc", copies.alias("copy")).select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix; equal texts share a shard.

    Null texts count as empty. Repeated rows have a slot each. Empty documents give an empty result.
    """
    return sharding.shard_documents(docs, 16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
