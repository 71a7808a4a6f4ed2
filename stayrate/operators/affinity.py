"""Products bought together: a basket is what one customer buys on one day."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.config import DEFAULT
from stayrate.functions import joins, lookup_join, n_rows, ratio
from stayrate.sources.checkpoints import materialise

_BASKET = ["customer_id", "t_dat"]

#: Pairs are formed between blocks of at most so many items of a basket.
BLOCK_ITEMS = 1000


def basket_rows(txn: DataFrame, art: DataFrame, item_col: str = "product_type_name") -> DataFrame:
    """Basket and item of every transaction of a known article; repeats are kept."""
    items = art.select("article_id", F.col(item_col).alias("item"))
    known = txn.where(F.col("customer_id").isNotNull() & F.col("t_dat").isNotNull())
    rows = known.select(*_BASKET, "article_id")
    return lookup_join(rows, items, "article_id").select(*_BASKET, "item")


def baskets(txn: DataFrame, art: DataFrame, item_col: str = "product_type_name") -> DataFrame:
    """The different items of each basket; a missing item name stays as NULL."""
    return basket_rows(txn, art, item_col).distinct()


def n_baskets(rows: DataFrame) -> DataFrame:
    return rows.select(*_BASKET).distinct().agg(n_rows().alias("n_baskets"))


def item_counts(rows: DataFrame) -> DataFrame:
    """Baskets per item."""
    distinct = rows.where(F.col("item").isNotNull()).select(*_BASKET, "item").distinct()
    return distinct.groupBy("item").agg(n_rows().alias("n_baskets"))


def item_names(df: DataFrame, column: str = "item") -> DataFrame:
    """The different names in ``column``."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("item")).distinct()


def basket_types(rows: DataFrame) -> DataFrame:
    """Different item sets, sorted, and the number of baskets that hold exactly that set.

    Items of a basket are gathered once each, so repeated rows cost nothing beyond the map
    side. Small sets are repeated by many baskets, so all counts follow from far fewer rows.
    """
    sets = rows.groupBy(*_BASKET).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return sets.groupBy("items").agg(n_rows().alias("n"))


def _spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly: they are small in bytes, but each stands for many pairs."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _items_of_types(types: DataFrame) -> DataFrame:
    """Baskets per item, and under a NULL item the number of all baskets."""
    marked = F.concat(F.array(F.lit(None).cast("string")), "items")
    return types.select("n", F.explode(marked).alias("item")).groupBy("item").agg(F.sum("n").alias("n_baskets"))


def _blocks(types: DataFrame) -> DataFrame:
    """Every two blocks of a set once: ``left`` and ``right``, which are the same for ``own``.

    Sets up to BLOCK_ITEMS have one block. Blocks of a larger set are dealt out, so no task
    has all its pairs, and are as long as any.
    """
    n_blocks = F.greatest(F.ceil(F.size("items") / BLOCK_ITEMS).cast("int"), F.lit(1))
    block = lambda i: F.slice("items", F.col(i) * BLOCK_ITEMS + 1, BLOCK_ITEMS)
    left = types.select("n", "items", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("i"))
    both = left.select("n", "items", "i", F.explode(F.sequence(F.col("i"), n_blocks - 1)).alias("j"))
    cut = both.select("n", (F.col("i") == F.col("j")).alias("own"), block("i").alias("left"), block("j").alias("right"))
    return _spread(cut)


def _without_rare(types: DataFrame, frequent: DataFrame) -> DataFrame:
    """The sets without items that are not ``frequent``, if these are most items of sets; else as they are.

    Both need to be stored.
    """
    often = frequent.agg(F.sum("n_baskets")).first()[0] or 0
    if 2 * often >= (types.agg(F.sum(F.col("n") * F.size("items"))).first()[0] or 0):
        return types
    numbered = types.withColumn("set", F.monotonically_increasing_id())  # before items: one number for a set
    items = numbered.select("set", "n", F.explode("items").alias("item"))
    kept = lookup_join(items, frequent.select("item"), "item", "left_semi")
    return kept.groupBy("set").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("item")).alias("items")).drop("set")


def _pairs_of_types(types: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """Each item is combined with those after it; counts are summed before any shuffle.

    Only items of ``frequent`` take part, if it is given. If they are too many to broadcast, the
    rest leave the sets before, where they make up most of them, and their pairs are counted elsewhere.
    """
    if frequent is not None and frequent.limit(joins.MAX_BROADCAST_ROWS + 1).count() > joins.MAX_BROADCAST_ROWS:
        types, frequent = _without_rare(types, frequent), None
    kept = lambda df, side: df if frequent is None else df.join(
        F.broadcast(frequent.select(F.col("item").alias(side))), side, "left_semi"
    )
    first = _blocks(types).select("n", "own", "right", F.posexplode("left").alias("i", "item_a"))
    rest = F.when(F.col("own"), F.slice("right", F.col("i") + 2, F.size("right"))).otherwise(F.col("right"))
    pairs = kept(first, "item_a").select("n", "item_a", F.explode(rest).alias("item_b"))
    return kept(pairs, "item_b").groupBy("item_a", "item_b").agg(F.sum("n").alias("pair_count"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Baskets per pair of different items, ``item_a`` before ``item_b`` bytewise."""
    return _pairs_of_types(basket_types(rows))


class _Counted(NamedTuple):
    """What thresholds need: item sets, baskets in all, the least count, and items that reach it."""

    types: DataFrame
    total: int
    least: int
    frequent: DataFrame


def _counted(rows: DataFrame, min_support: float, min_pairs: int | None) -> _Counted:
    types = materialise(_spread(basket_types(rows)))
    items = materialise(_items_of_types(types))
    total = items.where(F.col("item").isNull()).agg(F.coalesce(F.sum("n_baskets"), F.lit(0))).first()[0]
    least = max(1, int(min_support * total), min_pairs or 0)
    return _Counted(types, total, least, items.where(F.col("item").isNotNull() & (F.col("n_baskets") >= least)))


def affinity_pairs(
    rows: DataFrame,
    min_support: float = DEFAULT.min_support,
    min_pairs: int | None = DEFAULT.min_pair_count,
) -> DataFrame:
    """Support, confidence both ways and lift of the pairs in enough baskets.

    A pair is kept from ``max(1, int(min_support * baskets))`` baskets on, and from
    ``min_pairs`` if given. Items in fewer baskets cannot be part of such a pair and leave before
    pairs are formed. One plan serves any number of items.
    """
    types, total, least, frequent = _counted(rows, min_support, min_pairs)
    pairs = _pairs_of_types(types, frequent)
    item = lambda side: frequent.select(
        F.col("item").alias(f"item_{side}"), F.col("n_baskets").alias(f"_n_{side}")
    )
    counted = pairs.where(F.col("pair_count") >= least).join(item("a"), "item_a").join(item("b"), "item_b")
    share = lambda column: ratio(column, F.lit(total))
    together, a, b = share("pair_count"), share("_n_a"), share("_n_b")
    return counted.select(
        F.col("item_a").alias("item_A"),
        F.col("item_b").alias("item_B"),
        "pair_count",
        (together * 100.0).alias("support_pct"),
        (ratio(together, a) * 100.0).alias("confidence_A_to_B_pct"),
        (ratio(together, b) * 100.0).alias("confidence_B_to_A_pct"),
        ratio(ratio(together, a), b).alias("lift"),
    )


def affinity_triples(
    rows: DataFrame,
    min_support: float = DEFAULT.min_support,
    min_pairs: int | None = DEFAULT.min_pair_count,
) -> DataFrame:
    """Sets of three items in enough baskets, with their support and lift.

    Every two items of such a set are in as many baskets, so sets are grown from frequent
    pairs only: a pair of a basket, then each item after it that makes frequent pairs with both.
    Thresholds are those of ``affinity_pairs``; lift is against three independent items.
    """
    types, total, least, frequent = _counted(rows, min_support, min_pairs)
    pairs = materialise(_pairs_of_types(types, frequent).where(F.col("pair_count") >= least).select("item_a", "item_b"))
    side = lambda a, b: pairs.select(F.col("item_a").alias(a), F.col("item_b").alias(b))
    first = types.where(F.size("items") > 2).select("n", "items", F.posexplode("items").alias("i", "item_a"))
    first = _spread(first.join(frequent.select(F.col("item").alias("item_a")), "item_a", "left_semi"))
    rest = F.slice("items", F.col("i") + 2, F.size("items"))
    second = first.select("n", "item_a", rest.alias("items")).select("n", "item_a", "items", F.posexplode("items").alias("j", "item_b"))
    second = second.join(side("item_a", "item_b"), ["item_a", "item_b"], "left_semi")
    third = second.select("n", "item_a", "item_b", F.explode(F.slice("items", F.col("j") + 2, F.size("items"))).alias("item_c"))
    third = third.join(side("item_a", "item_c"), ["item_a", "item_c"], "left_semi")
    third = third.join(side("item_b", "item_c"), ["item_b", "item_c"], "left_semi")
    counted = third.groupBy("item_a", "item_b", "item_c").agg(F.sum("n").alias("set_count")).where(F.col("set_count") >= least)
    share = lambda column: ratio(column, F.lit(total))
    expected = F.lit(1.0)
    for name in ("item_a", "item_b", "item_c"):
        counted = counted.join(frequent.select(F.col("item").alias(name), F.col("n_baskets").alias(f"_n_{name}")), name)
        expected = expected * share(f"_n_{name}")
    return counted.select(
        F.col("item_a").alias("item_A"),
        F.col("item_b").alias("item_B"),
        F.col("item_c").alias("item_C"),
        "set_count",
        (share("set_count") * 100.0).alias("support_pct"),
        ratio(share("set_count"), expected).alias("lift"),
    )


def affinity_top(pairs: DataFrame, n: int = DEFAULT.top_n_pairs) -> DataFrame:
    """The ``n`` pairs with the highest lift; equal lifts in the order of their names."""
    return pairs.orderBy(F.desc("lift"), "item_A", "item_B").limit(n)
