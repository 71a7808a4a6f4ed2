import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.functions import lookup_join
from stayrate.operators import affinity as aff
from tests.conftest import plan_of

SCHEMA = "customer_id string, t_dat date, item string"


def baskets(spark, contents):
    rows = [(str(i), item) for i, items in enumerate(contents) for item in items]
    df = spark.createDataFrame(rows, "customer_id string, item string")
    return df.select("customer_id", F.lit("2020-01-01").cast("date").alias("t_dat"), "item")


def brute_pairs(contents):
    pairs = Counter()
    for items in contents:
        pairs.update(itertools.combinations(sorted({i for i in items if i is not None}), 2))
    return dict(pairs)


def pair_dict(df):
    return {(r.item_a, r.item_b): r.pair_count for r in df.collect()}


@pytest.fixture(params=[30, 200], ids=["one word", "four words"])
def random_baskets(request):
    rng = np.random.default_rng(5)
    names = [f"i{k:03d}" for k in range(request.param)]
    popular = names[::7] * 3 + names
    contents = [list(rng.choice(popular, rng.integers(1, 9))) for _ in range(300)]
    return [*contents, [None], [None, "i000"], names * 3]  # the last one holds every item


@pytest.fixture(params=["whole", "blocks"])
def form(request, monkeypatch):
    """Run a test with whole sets and with sets cut into blocks."""
    if request.param == "blocks":
        monkeypatch.setattr(aff, "BLOCK_ITEMS", 2)


def test_hand_made_example(spark, form):
    rows = baskets(spark, ["AB", "AC", "ABC", "D", "B"])
    found = {(r.item_A, r.item_B): r for r in aff.affinity_pairs(rows, 0.0).collect()}
    assert set(found) == {("A", "B"), ("A", "C"), ("B", "C")}
    ab = found[("A", "B")]
    assert ab.pair_count == 2 and ab.support_pct == pytest.approx(40.0)
    assert ab.confidence_A_to_B_pct == pytest.approx(200 / 3)
    assert ab.confidence_B_to_A_pct == pytest.approx(200 / 3)
    assert ab.lift == pytest.approx(10 / 9)
    top = aff.affinity_top(aff.affinity_pairs(rows, 0.0), 1).collect()
    assert [(r.item_A, r.item_B) for r in top] == [("A", "C")]


def test_pair_counts_equal_brute_force(spark, form, random_baskets):
    rows = baskets(spark, random_baskets)
    assert pair_dict(aff.pair_counts(rows)) == brute_pairs(random_baskets)
    assert aff.n_baskets(rows).first()[0] == len(random_baskets)


@pytest.mark.parametrize("floor", [None, 4])
def test_support_threshold(spark, form, random_baskets, floor):
    rows = baskets(spark, random_baskets)
    least = max(1, int(0.01 * len(random_baskets)), floor or 0)
    expected = {k: n for k, n in brute_pairs(random_baskets).items() if n >= least}
    found = aff.affinity_pairs(rows, 0.01, floor)
    counts = {(r.item_A, r.item_B): r.pair_count for r in found.collect()}
    assert counts == expected and 0 < len(expected) < len(brute_pairs(random_baskets))


def test_items_of_unknown_articles_vanish_and_missing_names_stay(make):
    txn = make.txn(
        [
            ("2020-01-01", "x", "a"),
            ("2020-01-01", "x", "a"),
            ("2020-01-01", "x", "nameless"),
            ("2020-01-01", "y", "unknown"),
            ("2020-01-02", "x", "nameless"),
        ]
    )
    art = make.art([("a", "t", "g"), ("nameless", None, "g")])
    found = aff.baskets(txn, art)
    assert found.count() == 3
    assert aff.n_baskets(found).first()[0] == 2
    assert [tuple(r) for r in aff.item_counts(found).collect()] == [("t", 1)]
    assert aff.affinity_pairs(found).count() == 0


def test_no_baskets(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert aff.affinity_pairs(rows).count() == 0
    assert aff.pair_counts(rows).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_in_both_forms(spark, confs, how):
    confs(spark__sql__autoBroadcastJoinThreshold="-1")
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    lookup = spark.range(5, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    names = ["k", "id", "v"] if how in ("inner", "left") else ["k", "id"]
    plain = sorted(map(str, fact.join(lookup, "k", how).select(*names).collect()))
    small = lookup_join(fact, lookup, "k", how)
    large = lookup_join(fact, lookup, "k", how, max_broadcast_rows=10, salts=4)
    for joined in (small, large):
        assert sorted(map(str, joined.select(*names).collect())) == plain
    assert "BroadcastHashJoin" in plan_of(small)
    assert "SortMergeJoin" in plan_of(large) and "_salt" in plan_of(large)


def test_large_lookup_is_neither_broadcast_nor_repeated_much(spark, confs, tmp_path, monkeypatch):
    """Spark would broadcast all repeats of a table whose file is small."""
    confs(spark__sql__autoBroadcastJoinThreshold="10m")
    fact = spark.range(3000).select((F.col("id") % 50).alias("k"), "id")
    spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.parquet(f"{tmp_path}/t")
    lookup = spark.read.parquet(f"{tmp_path}/t")
    for most, salted in ((2_000_000, True), (80, True), (60, False)):
        monkeypatch.setattr("stayrate.functions.joins.MAX_REPEATED_ROWS", most)
        joined = lookup_join(fact, lookup, "k", max_broadcast_rows=10)
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and ("_salt" in plan) == salted
        assert joined.count() == 2400 and joined.agg(F.sum("v")).first()[0] == 60 * sum(range(0, 80, 2))
    confs(spark__sql__adaptive__skewJoin__enabled="false")  # then salts are all that splits a hot key
    assert "_salt" in plan_of(lookup_join(fact, lookup, "k", max_broadcast_rows=10))


def test_hot_key_of_a_large_lookup_is_split(spark, confs, monkeypatch):
    confs(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="16k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
    )
    monkeypatch.setattr("stayrate.functions.joins.MAX_REPEATED_ROWS", 0)
    fact = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), "id")
    lookup = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = lookup_join(fact, lookup, "k", max_broadcast_rows=10)
    assert len(joined.collect()) == 60_000
    assert "skew=true" in plan_of(joined)


def test_lookup_join_rejects_other_joins(spark):
    with pytest.raises(ValueError):
        lookup_join(spark.range(1), spark.range(1), "id", "full")


def test_large_and_repeated_sets(spark):
    names = [f"i{k:04d}" for k in range(1500)]
    rows = baskets(spark, [names, names[:2], names[:2], [None]])
    found = {tuple(r["items"]): r.n for r in aff.basket_types(rows).collect()}
    assert found == {tuple(names): 1, tuple(names[:2]): 2, (): 1}
    assert aff.pair_counts(rows).agg(F.count("*"), F.max("pair_count")).first()[:] == (1500 * 1499 // 2, 3)


@pytest.mark.parametrize("n_items", [64, 5000])
def test_one_plan_for_any_number_of_items(spark, n_items):
    """The same operators, pairs dealt out over all partitions, no interpreted filter per set."""
    rng = np.random.default_rng(3)
    rows = baskets(spark, [[f"i{k:04d}" for k in rng.integers(0, n_items, 4)] for _ in range(200)])
    pairs = aff.affinity_pairs(rows, 0.0, 1)
    plan = plan_of(pairs)
    assert "REPARTITION_BY_NUM" in plan and "filter(" not in plan
    steps = [line.split("[")[0].strip(" +-:*(0123456789)").split(" ")[0] for line in plan.splitlines()]
    if not hasattr(test_one_plan_for_any_number_of_items, "steps"):
        test_one_plan_for_any_number_of_items.steps = steps
    assert steps == test_one_plan_for_any_number_of_items.steps


@pytest.mark.parametrize("min_support, pruned", [(0.0, False), (0.01, True)])
def test_pairs_of_more_items_than_are_broadcast(spark, random_baskets, monkeypatch, min_support, pruned):
    """No set or pair moves to meet the frequent items; rare ones leave before if they are most items of sets."""
    contents = [*random_baskets, *([f"rare{i}{k}" for k in range(40)] + [None] for i in range(60))]
    expected = {k: n for k, n in brute_pairs(contents).items() if n >= max(2, int(min_support * len(contents)))}
    cut, plain = [], aff._without_rare
    monkeypatch.setattr("stayrate.functions.joins.MAX_BROADCAST_ROWS", 3)
    monkeypatch.setattr(aff, "_without_rare", lambda types, frequent: cut.append(types) or cut.append(plain(types, frequent)) or cut[-1])
    if not pruned:
        contents = random_baskets
        expected = {k: n for k, n in brute_pairs(contents).items() if n >= 2}
    found = aff.affinity_pairs(baskets(spark, contents), min_support, 2)
    before, after = (df.agg(F.sum(F.size("items"))).first()[0] for df in cut)
    assert (after < before) == pruned
    assert {(r.item_A, r.item_B): r.pair_count for r in found.collect()} == expected and expected
    assert pruned or "LeftSemi" not in plan_of(found)


def brute_triples(contents, least):
    found = Counter()
    for items in contents:
        found.update(itertools.combinations(sorted({i for i in items if i is not None}), 3))
    return {k: n for k, n in found.items() if n >= least}


@pytest.mark.parametrize("floor", [None, 3])
def test_triples_equal_brute_force(spark, random_baskets, floor):
    contents = [items if len(items) < 50 else items[:20] for items in random_baskets]
    rows = baskets(spark, contents)
    least = max(1, int(0.004 * len(contents)), floor or 0)
    found = aff.affinity_triples(rows, 0.004, floor).collect()
    assert {(r.item_A, r.item_B, r.item_C): r.set_count for r in found} == brute_triples(contents, least)
    share = Counter(i for items in contents for i in set(items))
    some = found[0]
    expected = some.set_count / len(contents) / np.prod([share[i] / len(contents) for i in some[:3]])
    assert some.lift == pytest.approx(expected)
    assert aff.affinity_triples(rows.limit(0)).count() == 0
