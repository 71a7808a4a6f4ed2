"""The headline numbers of the analysis in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions import ratio, side_by_side


def headline_kpis(
    segments: DataFrame,
    retention: DataFrame,
    lift: DataFrame,
    sizing: DataFrame,
    scenarios: DataFrame,
    top_pairs: DataFrame,
    uplift_pp: float = 5,
) -> DataFrame:
    """Combine the results of the stages.

    The arguments are ``segment_summary``, ``avg_retention``, ``lift_by_decile``,
    ``value_at_risk``, ``uplift_scenarios`` and ``affinity_top``. The base lapse rate,
    and with it the largest share of lapses one decile can hold, comes from the data.
    """
    champions = segments.where(F.col("segment") == "Champions").select(
        F.col("customer_share_pct").alias("champions_customer_pct"),
        F.col("revenue_share_pct").alias("champions_revenue_pct"),
    )
    month_six = retention.select(F.col("avg_m6").alias("avg_retention_m6"))
    top = F.col("decile") == 1
    base = ratio(F.sum("n_lapsed"), F.sum("n_customers"))
    risk = lift.agg(
        F.max(F.when(top, F.col("lapse_rate_pct"))).alias("top_decile_precision_pct"),
        F.max(F.when(top, F.col("capture_pct"))).alias("top_decile_capture_pct"),
        (base * 100.0).alias("base_rate_pct"),
        ratio(F.lit(10.0), base).alias("max_capture_pct"),
    )
    risk = risk.withColumn(
        "capture_of_max_pct", ratio("top_decile_capture_pct", "max_capture_pct") * 100.0
    )
    value = sizing.select("n_target_customers", "value_lost_index", "total_revenue_index")
    scenario = scenarios.where(F.col("uplift_pp") == float(uplift_pp)).select(
        F.col("revenue_recovered_index").alias("uplift_recovered_index"),
        F.col("break_even_cost_pct").alias("uplift_break_even_pct"),
    )
    pair = top_pairs.orderBy(F.desc("lift"), "item_A", "item_B").limit(1).select(
        F.col("item_A").alias("top_pair_a"),
        F.col("item_B").alias("top_pair_b"),
        F.col("lift").alias("top_pair_lift"),
    )
    return side_by_side(champions, month_six, risk, value, scenario, pair)
