"""What a retention programme could recover, as an index of the label window's revenue."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.config import DEFAULT, RetentionConfig
from stayrate.functions import as_double, ratio, round_even
from stayrate.operators.purchases import purchase_days
from stayrate.operators.snapshots import window_at


def window_spend(
    txn: DataFrame, date: datetime.date | str, label_weeks: int = DEFAULT.label_window_weeks
) -> DataFrame:
    """Spend per customer in the ``label_weeks`` from ``date`` on."""
    start = window_at(date).date
    end = start + datetime.timedelta(weeks=label_weeks)
    day = F.col("t_dat")
    inside = purchase_days(txn.where((day >= F.lit(start)) & (day < F.lit(end))))
    return inside.groupBy("customer_id").agg(F.sum("spend").alias("spend"))


def cohort_value(scores: DataFrame, seg: DataFrame, spend: DataFrame) -> DataFrame:
    """Scored customers with their segment and their spend in the window, 0 if none.

    Segments are usually those of the full history, which looks past the snapshot date;
    for segments as of that date, compute them from the earlier transactions.
    """
    scored = scores.select("customer_id", "risk_decile", "lapsed")
    segments = seg.select("customer_id", "segment")
    joined = scored.join(segments, "customer_id", "left").join(spend, "customer_id", "left")
    return joined.select(
        "customer_id",
        "risk_decile",
        "lapsed",
        "segment",
        F.coalesce("spend", F.lit(0).cast(spend.schema["spend"].dataType)).alias("actual_spend"),
    )


def revenue_index(value: DataFrame, base: float = DEFAULT.revenue_index_base) -> DataFrame:
    """Spend of the scored customers, and the factor that turns it into ``base``."""
    total = value.agg(as_double(F.sum("actual_spend")).alias("total_revenue"))
    return total.withColumn("multiplier", ratio(F.lit(base), "total_revenue"))


def _is_target(deciles: Sequence[int], segments: Sequence[str]) -> Column:
    inside = F.col("risk_decile").isin(*deciles) & F.col("segment").isin(*segments)
    return F.coalesce(inside, F.lit(False))


def target_group(
    value: DataFrame,
    deciles: Sequence[int] = DEFAULT.target_deciles,
    segments: Sequence[str] = DEFAULT.target_segments,
) -> DataFrame:
    """Customers of the riskiest deciles in the valuable segments."""
    return value.where(_is_target(deciles, segments))


def _target_totals(value: DataFrame, cfg: RetentionConfig) -> DataFrame:
    """All that sizing needs, from one pass over the scored customers."""
    target = _is_target(cfg.target_deciles, cfg.target_segments)
    retained = target & (F.col("lapsed") == 0)
    spend = F.col("actual_spend")
    sums = value.agg(
        F.count(F.when(target, 1)).alias("n_target"),
        F.count(F.when(retained, 1)).alias("n_retained"),
        as_double(F.coalesce(F.sum(F.when(target, spend)), F.lit(0))).alias("target_spend"),
        as_double(F.sum(F.when(retained, spend))).alias("retained_spend"),
        as_double(F.sum(spend)).alias("total_revenue"),
    )
    return sums.withColumns(
        {
            "avg_retained": ratio("retained_spend", "n_retained"),
            "multiplier": ratio(F.lit(cfg.revenue_index_base), "total_revenue"),
        }
    )


def value_at_risk(value: DataFrame, cfg: RetentionConfig = DEFAULT, digits: int | None = None) -> DataFrame:
    """What the target group would have spent had all of it stayed, beyond what it did spend.

    Index values are NULL when nobody in the target group was retained.
    """
    lost = F.col("n_target") * F.col("avg_retained") - F.col("target_spend")
    return _target_totals(value, cfg).select(
        F.col("n_target").alias("n_target_customers"),
        "n_retained",
        "total_revenue",
        F.lit(cfg.revenue_index_base).cast("double").alias("total_revenue_index"),
        round_even(F.col("avg_retained") * F.col("multiplier"), digits).alias("avg_retained_index"),
        round_even(lost * F.col("multiplier"), digits).alias("value_lost_index"),
    )


def uplift_scenarios(
    value: DataFrame,
    uplifts_pp: Sequence[float] | None = None,
    cfg: RetentionConfig = DEFAULT,
    rounded: bool = True,
) -> DataFrame:
    """Customers saved, revenue recovered and break-even cost per assumed uplift.

    ``rounded`` gives two digits for the index, three for the share and one for the cost.
    """
    uplifts = cfg.retention_uplift_pp if uplifts_pp is None else uplifts_pp
    scenarios = F.array(*(F.lit(float(pp)) for pp in uplifts))
    saved = F.col("n_target") * (F.col("uplift_pp") / 100.0)
    gained = F.col("saved") * F.col("avg_retained")
    digits = (2, 3, 1) if rounded else (None, None, None)
    per_contact = ratio(F.col("gained"), "n_target")
    return (
        _target_totals(value, cfg)
        .select("*", F.explode(scenarios).alias("uplift_pp"))
        .withColumn("saved", saved)
        .withColumn("gained", gained)
        .select(
            "uplift_pp",
            F.floor("saved").alias("customers_saved"),
            round_even(F.col("gained") * F.col("multiplier"), digits[0]).alias(
                "revenue_recovered_index"
            ),
            round_even(ratio("gained", "total_revenue") * 100.0, digits[1]).alias(
                "share_of_total_pct"
            ),
            round_even(ratio(per_contact, "avg_retained") * 100.0, digits[2]).alias(
                "break_even_cost_pct"
            ),
        )
    )


def assumptions(value: DataFrame, cfg: RetentionConfig = DEFAULT) -> DataFrame:
    """The parameters behind the sizing, as text."""
    index = F.col("avg_retained") * F.col("multiplier")
    entries = (
        ("target_risk_deciles", F.lit(", ".join(str(d) for d in cfg.target_deciles))),
        ("target_segments", F.lit(", ".join(cfg.target_segments))),
        ("avg_retained_spend_index", index.cast("decimal(18,6)").cast("string")),
        ("label_window_weeks", F.lit(str(cfg.label_window_weeks))),
        ("uplift_pp", F.lit(", ".join(str(pp) for pp in cfg.retention_uplift_pp))),
    )
    rows = F.array(
        *(F.struct(F.lit(name).alias("parameter"), text.alias("value")) for name, text in entries)
    )
    return _target_totals(value, cfg).select(F.inline(rows))
