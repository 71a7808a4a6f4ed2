import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrate.functions import (
    distributed_rank,
    exact_quantiles,
    quantile_bins,
    rank_quantile_bins,
    running_totals,
)
from tests.conftest import plan_of

SIZES = (2, 3, 7, 100, 1003)


@pytest.fixture(params=["coalesced", "spread"])
def partitions(request, confs):
    if request.param == "spread":
        confs(spark__sql__adaptive__coalescePartitions__enabled="false")


def frame(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "tied": rng.integers(0, 9, n).astype(float),
            "x": rng.normal(size=n),
        }
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("n", SIZES)
def test_bins_equal_qcut(spark, partitions, n):
    pdf, df = frame(spark, n)
    binned = rank_quantile_bins(df, "tied", 5, "id", "by_rank")
    binned = quantile_bins(binned, "tied", 5, "merged", bounded=True)
    binned = quantile_bins(binned, "x", 10, "deciles")
    found = binned.toPandas().sort_values("id").reset_index(drop=True)
    pdf = pdf.sort_values("id").reset_index(drop=True)  # rank(method="first") then breaks ties by id
    cut = lambda v, q: pd.qcut(v, q, labels=False, duplicates="drop") + 1
    assert found["by_rank"].tolist() == cut(pdf["tied"].rank(method="first"), 5).tolist()
    assert found["merged"].tolist() == cut(pdf["tied"], 5).tolist()
    assert found["deciles"].tolist() == cut(pdf["x"], 10).tolist()


def test_rank_and_running_totals(spark, partitions):
    pdf, df = frame(spark, 2000, seed=1)
    ranked = distributed_rank(df, ["tied", "id"]).toPandas().sort_values(["tied", "id"])
    assert ranked["rank"].tolist() == list(range(1, 2001))
    assert (ranked["n_ranked"] == 2000).all()
    sums = running_totals(df, ["tied", "id"], ["id", "x"]).toPandas().sort_values(["tied", "id"])
    assert sums["cum_id"].tolist() == sums["id"].cumsum().tolist()
    assert np.allclose(sums["cum_x"], sums["x"].cumsum())
    assert (sums["total_id"] == pdf["id"].sum()).all()


def test_quantiles_equal_numpy(spark, partitions):
    pdf, df = frame(spark, 777, seed=2)
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    row = exact_quantiles(df, "x", probs).first()
    found = [row[f"q{i}"] for i in range(len(probs))]
    assert np.allclose(found, np.quantile(pdf["x"], probs), rtol=0, atol=1e-12)
    tied = exact_quantiles(df, "tied", probs, bounded=True).first()
    assert [tied[f"q{i}"] for i in range(len(probs))] == pytest.approx(
        np.quantile(pdf["tied"], probs)
    )


def test_merged_edges(spark):
    values = [0.0] * 6 + [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    found = [r["bin"] for r in quantile_bins(df, "v", 5, "bin").orderBy("id").collect()]
    assert found == [1, 1, 1, 1, 1, 1, 2, 2, 3, 3]


def test_equal_values_and_nulls_have_no_bin(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id int, v double")
    assert [r["bin"] for r in quantile_bins(df, "v", 5, "bin").collect()] == [None] * 3
    df = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, None)], "id int, v double")
    found = {r["id"]: r["bin"] for r in quantile_bins(df, "v", 5, "bin").collect()}
    assert found[3] is None and found[1] == 1 and found[2] is not None


def test_single_row_has_no_rank_bin(spark):
    df = spark.createDataFrame([(1, 5.0)], "id int, v double")
    assert rank_quantile_bins(df, "v", 5, "id", "bin").first()["bin"] is None


def test_empty_frames(spark):
    df = spark.createDataFrame([], "id int, v double")
    assert distributed_rank(df, ["v", "id"]).count() == 0
    assert running_totals(df, ["v"], ["id"]).count() == 0
    row = exact_quantiles(df, "v", [0.5]).first()
    assert row["n"] == 0 and row["q0"] is None
    assert quantile_bins(df, "v", 5, "bin").count() == 0


def test_one_value_in_a_third_of_the_rows_spreads(spark, confs):
    """The tie-break splits the rows of a hot value over several partitions."""
    confs(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v")
    )
    ranked = distributed_rank(df, ["v", "id"])
    hot = ranked.where(F.col("v") == 7)
    assert hot.count() == 10_001
    parts = hot.withColumn("p", F.spark_partition_id()).select("p").distinct().count()
    assert parts > 1
    assert ranked.agg(F.count_distinct("rank"), F.max("rank")).first() == (30_000, 30_000)


def test_wide_frames_are_not_moved_to_one_task(spark):
    _, df = frame(spark, 100)
    plan = plan_of(distributed_rank(df, ["tied", "id"]))
    # The only single partition is that of the offsets, one row per partition.
    assert plan.count("SinglePartition") <= 1
    assert plan.index("BroadcastExchange") < plan.index("SinglePartition")
