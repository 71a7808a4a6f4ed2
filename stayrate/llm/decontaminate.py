"""Find short benchmark items inside long documents by containment.

A document contains an item if it has at least ``threshold`` of the item's different word
shingles. Items are partitioned by the number of their shingles, and the sketch of an item
is its shingles with the smallest hashes: as many as its partition's largest item may miss,
plus one. A document that contains the item misses fewer than that, so it has a shingle of
the sketch: the search overlooks nothing. Documents with fewer shingles than a partition
asks for are not searched for its items. Candidates are confirmed on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.native import row_digest, shingles, stored

SHINGLE_WORDS, THRESHOLD = 5, 0.8


def match_words(text: Column) -> Column:
    """Runs of letters and digits in lower case: punctuation and case do not matter."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), 0)


def _hashes(found: Column, k: int) -> Column:
    """The hashes of ``shingles(found, k)``."""
    many = F.transform(
        F.sequence(F.lit(1), F.size(found) - (k - 1)),
        lambda i: F.xxhash64(F.array_join(F.slice(found, i, k), " ")),
    )
    return (
        F.when(F.size(found) == 0, F.array().cast("array<long>"))
        .when(F.size(found) < k, F.array(F.xxhash64(F.array_join(found, " "))))
        .otherwise(many)
    )


def item_shingles(items: DataFrame, id_column: str, text_column: str, k: int) -> DataFrame:
    """item, key, item_shingles, n_item, n_words: one row per different (id, text) that has words."""
    found = items.select(F.col(id_column).alias("item"), match_words(F.col(text_column)).alias("found"))
    sets = found.withColumn("item_shingles", F.array_distinct(shingles(F.col("found"), k)))
    keyed = sets.where(F.size("found") > 0).select(
        "item", F.sha2(F.to_json(F.struct("item", "item_shingles")), 256).alias("key"), "item_shingles",
        F.size("found").alias("n_words"),
    )
    return keyed.dropDuplicates(["key"]).withColumn("n_item", F.size("item_shingles"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """key, needed, h: the smallest hashes of each item, by its size partition.

    A partition holds the sizes from one power of two up to the next.
    """
    largest = F.least(F.expr("shiftleft(1, int(floor(log2(n_item))) + 1) - 1"), F.lit(1 << 30))
    smallest = F.expr("shiftleft(1, int(floor(log2(n_item))))")
    may_miss = F.floor(largest * F.lit(1 - threshold) + 1e-9).cast("int")
    hashed = F.array_sort(F.transform("item_shingles", lambda s: F.xxhash64(s)))
    return items.select(
        "key",
        F.ceil(smallest * F.lit(threshold) - 1e-9).alias("needed"),
        F.explode(F.slice(hashed, 1, may_miss + 1)).alias("h"),
    )


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    k: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_shared, n_item, containment.

    Words are runs of letters and digits in lower case. Items with fewer than ``k`` words are
    one shingle of all their words, which is looked for in documents of any length. Null
    or blank texts and items match nothing. Rows that repeat an id are searched one by one and
    reported once, with their best containment, also if the id is null. Empty tables give an
    empty result; other columns are ignored.
    """
    known = stored(item_shingles(items, item_id_column, item_text_column, k), "items")
    # Documents are also cut at the lengths of the items that have fewer than k words.
    short = sorted(r[0] for r in known.where(F.col("n_words") < k).select("n_words").distinct().collect())
    found = docs.select(F.col(id_column).alias("doc"), match_words(F.col(text_column)).alias("found"))
    hashes = [_hashes(F.col("found"), n) for n in (k, *short)]
    probes = found.select("doc", F.size("found").alias("n"), F.explode(F.concat(*hashes) if short else hashes[0]).alias("h"))
    # No hint: the sketches are broadcast if Spark finds them small, shuffled otherwise.
    hits = probes.join(sketches(known, threshold), "h").where(F.greatest(F.lit(1), F.col("n") - (k - 1)) >= F.col("needed"))
    per_doc = stored(
        hits.select("doc", "key").distinct().groupBy("doc").agg(F.collect_list("key").alias("keys")), "candidates"
    )
    same = F.col("doc").eqNullSafe(F.col("candidate"))
    again = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text")).join(
        per_doc.withColumnRenamed("doc", "candidate"), same
    )
    sets = again.select("doc", "keys", match_words(F.col("text")).alias("found")).select(
        "doc", "keys", F.array_distinct(F.concat(*(shingles(F.col("found"), n) for n in (k, *short)))).alias("doc_shingles")
    )
    pairs = sets.select("doc", "doc_shingles", F.explode("keys").alias("key")).join(known.drop("n_words"), "key")
    shared = pairs.withColumn("n_shared", F.size(F.array_intersect("doc_shingles", "item_shingles")))
    kept = shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9))
    best = kept.groupBy("doc", "item").agg(
        F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("best")
    )
    return best.select(
        F.col("doc").alias(id_column),
        F.col("item").alias(item_id_column),
        F.col("best.n_shared").cast("long").alias("n_shared"),
        F.col("best.n_item").cast("long").alias("n_item"),
        F.col("best.containment").alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item; ``options`` as for ``contained_items``.

    Rows are judged by id and text: other texts of an id, and other rows without one, stay. Rows keep
    all their columns, whatever their names; null and empty texts contain nothing and stay.
    """
    id_column, text_column = options.pop("id_column", "doc_id"), options.pop("text_column", "text")
    row = row_digest(F.col(id_column), F.col(text_column)).alias("row")
    found = contained_items(docs.select(row, F.col(text_column).alias("text")), items, id_column="row", **options)
    whole = docs.select(row, F.expr("struct(*)").alias("doc"))
    return whole.join(found.select("row").distinct(), "row", "left_anti").select("doc.*")
