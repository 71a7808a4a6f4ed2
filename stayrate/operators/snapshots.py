"""Customer features and lapse labels as of chosen dates.

For a snapshot date T, the population is the customers who bought in the lookback
window before T; features use days before T only; a customer has lapsed when they buy
nothing in [T, T + label window).
"""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.config import DEFAULT, RetentionConfig
from stayrate.functions import as_double, clean_age, n_rows, ratio, round_even, share_pct
from stayrate.operators.purchases import purchase_days, purchase_days_with_articles, with_gaps

_KEYS = ["snapshot", "snapshot_date", "customer_id"]

ALL_TIME_FEATURES = (
    "txn_count_all",
    "spend_all",
    "active_days_all",
    "recency_days",
    "tenure_days",
    "avg_item_price",
    "n_purchase_days",
    "online_share",
    "n_distinct_articles",
)
GAP_FEATURES = ("avg_gap_days", "max_gap_days", "min_gap_days")
DEMO_FEATURES = ("age", "is_club_active", "news_regular")


class SnapshotWindow(NamedTuple):
    name: str
    date: datetime.date
    label_end: datetime.date


def trailing_features(cfg: RetentionConfig = DEFAULT) -> tuple[str, ...]:
    stems = ("txn_count", "spend", "active_days")
    return tuple(f"{stem}_{w}w" for w in cfg.feature_windows_weeks for stem in stems)


def feature_names(cfg: RetentionConfig = DEFAULT) -> list[str]:
    """The model's feature columns, in the order of the snapshot table."""
    return [
        *ALL_TIME_FEATURES[:5],
        *trailing_features(cfg),
        *ALL_TIME_FEATURES[5:],
        *GAP_FEATURES,
        "avg_basket_size",
        *DEMO_FEATURES,
    ]


def feature_families(cfg: RetentionConfig = DEFAULT) -> dict[str, list[str]]:
    """The features of purchases by the values of days that they are made of."""
    weeks = cfg.feature_windows_weeks
    counts = ["txn_count_all", "active_days_all", "recency_days", "tenure_days", "n_purchase_days", "avg_basket_size"]
    return {
        "counts": counts + [f"{stem}_{w}w" for w in weeks for stem in ("txn_count", "active_days")],
        "spend": ["spend_all", "avg_item_price", *(f"spend_{w}w" for w in weeks)],
        "online": ["online_share"],
        "gaps": list(GAP_FEATURES),
        "articles": ["n_distinct_articles"],
    }


def snapshot_calendar(
    txn: DataFrame,
    label_weeks: int = DEFAULT.label_window_weeks,
    spacing_weeks: int = DEFAULT.snapshot_spacing_weeks,
) -> DataFrame:
    """The train, val and test dates, counted back from the last transaction."""
    last = F.col("max_date")
    label, spacing = 7 * label_weeks, 7 * spacing_weeks
    entries = [
        F.struct(
            F.lit(name).alias("snapshot"),
            F.date_sub(last, label + back * spacing).alias("snapshot_date"),
            F.date_sub(last, back * spacing).alias("label_end"),
        )
        for name, back in (("train", 2), ("val", 1), ("test", 0))
    ]
    latest = txn.agg(F.max("t_dat").alias("max_date")).where(last.isNotNull())
    return latest.select(F.inline(F.array(*entries)))


def snapshot_windows(txn: DataFrame, cfg: RetentionConfig = DEFAULT) -> list[SnapshotWindow]:
    """The three rows of ``snapshot_calendar``, read so that dates become scan filters.

    Without transactions the dates count back from 1970, so that what is built on them is empty.
    """
    weeks = cfg.label_window_weeks, cfg.snapshot_spacing_weeks
    rows = snapshot_calendar(txn, *weeks).collect()
    if not rows:
        day = txn.sparkSession.range(1).select(_date(datetime.date(1970, 1, 1)).alias("t_dat"))
        rows = snapshot_calendar(day, *weeks).collect()
    return sorted((SnapshotWindow(*row) for row in rows), key=lambda w: w.date)


def window_at(
    date: datetime.date | str, cfg: RetentionConfig = DEFAULT, name: str = "as_of"
) -> SnapshotWindow:
    if isinstance(date, str):
        date = datetime.date.fromisoformat(date)
    return SnapshotWindow(name, date, date + datetime.timedelta(weeks=cfg.label_window_weeks))


def _date(value: datetime.date) -> Column:
    return F.lit(value).cast("date")


def _per_window(days: DataFrame, windows: Sequence[SnapshotWindow]) -> DataFrame:
    """Repeat each day for the snapshots that it matters to, as history or as label."""
    calendar = F.array(
        *(
            F.struct(
                F.lit(w.name).alias("snapshot"),
                _date(w.date).alias("snapshot_date"),
                _date(w.label_end).alias("label_end"),
            )
            for w in windows
        )
    )
    last_day = max(w.label_end for w in windows)
    repeated = days.where(F.col("t_dat") < _date(last_day)).select("*", F.inline(calendar))
    return repeated.where(F.col("t_dat") < F.col("label_end"))


def _customer_features(
    days: DataFrame,
    windows: Sequence[SnapshotWindow],
    cfg: RetentionConfig,
    provenance: bool = False,
    cut: bool = False,
) -> DataFrame:
    """All features but demographics, and the label, per snapshot and customer of its population.

    ``days`` holds one row per customer and day with its gap, partitioned by customer, so
    grouping by customer and snapshot needs no further shuffle. The number of different
    articles is left out when ``days`` does not count new ones.

    ``provenance`` adds ``source_<family>``, the latest day whose values entered the family's
    features, noted where the values are picked. ``cut`` removes the days from each snapshot's
    date on before anything is picked, for all customers with earlier days; labels are then void.
    """
    articles = ["n_distinct_articles"] if "n_new_articles" in days.columns else []
    T, day = F.col("snapshot_date"), F.col("t_dat")
    age = F.datediff(T, day)  # days before T; positive means history
    history = age > 0
    used: dict[str, list[Column]] = {}

    def entered(family: str, value: Column, when: Column) -> Column:
        picked = F.when(when, value)
        used.setdefault(family, []).append(F.max(F.when(picked.isNotNull(), day)))
        return picked

    def total(column: str, family: str, when: Column = history) -> Column:
        return F.sum(entered(family, F.col(column), when))

    n_days = lambda when: F.count(entered("counts", F.lit(1), when))

    trailing = []
    for weeks in cfg.feature_windows_weeks:
        recent = history & (age <= 7 * weeks)
        trailing += [
            F.coalesce(total("n_items", "counts", recent), F.lit(0)).alias(f"txn_count_{weeks}w"),
            as_double(total("spend", "spend", recent)).alias(f"spend_{weeks}w"),
            n_days(recent).alias(f"active_days_{weeks}w"),
        ]
    gap = entered("gaps", F.col("gap_days"), history)
    past = entered("counts", age, history)
    repeated = _per_window(days, windows)
    if cut:
        repeated = repeated.where(day < T)
    sums = [
        total("n_items", "counts").alias("txn_count_all"),
        total("spend", "spend").alias("_spend"),
        total("n_priced", "spend").alias("_priced"),
        total("n_online", "online").alias("_online"),
        n_days(history).alias("active_days_all"),
        F.min(past).cast("bigint").alias("recency_days"),
        F.max(past).cast("bigint").alias("tenure_days"),
        *(total("n_new_articles", "articles").alias(name) for name in articles),
        *trailing,
        ratio(F.sum(gap), F.count(gap)).alias("avg_gap_days"),
        as_double(F.max(gap)).alias("max_gap_days"),
        as_double(F.min(gap)).alias("min_gap_days"),
        F.when(F.count(F.when(~history, 1)) > 0, 0).otherwise(1).cast("bigint").alias("lapsed"),
    ]
    latest = lambda days: F.greatest(*days) if len(days) > 1 else days[0]
    sources = {f"source_{family}": latest(days) for family, days in used.items()} if provenance else {}
    noted = [value.alias(name) for name, value in sources.items()]
    features = repeated.groupBy(*_KEYS).agg(*sums, *noted)
    if not cut:
        features = features.where(F.col("recency_days") <= 7 * cfg.lookback_weeks)
    return features.select(
        *_KEYS,
        "txn_count_all",
        as_double("_spend").alias("spend_all"),
        "active_days_all",
        "recency_days",
        "tenure_days",
        *trailing_features(cfg),
        ratio("_spend", "_priced").alias("avg_item_price"),
        F.col("active_days_all").alias("n_purchase_days"),
        ratio("_online", "txn_count_all").alias("online_share"),
        *articles,
        *GAP_FEATURES,
        ratio("txn_count_all", F.greatest("active_days_all", F.lit(1))).alias("avg_basket_size"),
        "lapsed",
        *sources,
    )


def _demographics(cust: DataFrame, cfg: RetentionConfig) -> DataFrame:
    flag = lambda column, value: (
        F.when(F.col(column) == value, 1).otherwise(0).cast("double")
    )
    return cust.select(
        "customer_id",
        as_double(clean_age("age", cfg.min_age, cfg.max_age)).alias("age"),
        flag("club_member_status", "ACTIVE").alias("is_club_active"),
        flag("fashion_news_frequency", "Regularly").alias("news_regular"),
    )


def _history(
    txn: DataFrame,
    windows: Sequence[SnapshotWindow],
    cfg: RetentionConfig,
    articles: bool = False,
    weeks: int | None = None,
    provenance: bool = False,
) -> DataFrame:
    """Condense the transactions and compute the features.

    ``weeks`` limits how far back the scan reads, for features that need no more than
    the lookback window.
    """
    needed = txn.where(F.col("t_dat") < _date(max(w.label_end for w in windows)))
    if weeks is not None:
        start = min(w.date for w in windows) - datetime.timedelta(weeks=weeks)
        needed = needed.where(F.col("t_dat") >= _date(start))
    condense = purchase_days_with_articles if articles else purchase_days
    days = with_gaps(condense(needed, cfg.online_channel))
    return _customer_features(days, windows, cfg, provenance)


def snapshots(
    txn: DataFrame,
    cust: DataFrame,
    windows: Sequence[SnapshotWindow],
    cfg: RetentionConfig = DEFAULT,
    articles: bool = True,
    provenance: bool = False,
) -> DataFrame:
    """Features and labels for several snapshot dates at once, one row per date and customer.

    The transactions are condensed once for all dates. Customers that the customer table
    lacks have NULL demographics. Without ``articles`` the different articles are not counted,
    which saves an exchange. ``provenance`` adds the latest source day of every feature family, as
    ``source_counts``, ``source_spend``, ``source_online``, ``source_gaps`` and ``source_articles``,
    which ``leakage_report`` reads.
    """
    features = _history(txn, windows, cfg, articles=articles, provenance=provenance)
    joined = features.join(_demographics(cust, cfg), "customer_id", "left")
    names = [name for name in feature_names(cfg) if articles or name != "n_distinct_articles"]
    sources = [c for c in features.columns if c.startswith("source_")]
    return joined.select("customer_id", *names, *sources, "lapsed", "snapshot_date", "snapshot")


def snapshot(
    txn: DataFrame, cust: DataFrame, date: datetime.date | str, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """Features and labels as of one date."""
    return snapshots(txn, cust, [window_at(date, cfg)], cfg).drop("snapshot")


def population(
    txn: DataFrame, date: datetime.date | str, lookback_weeks: int = DEFAULT.lookback_weeks
) -> DataFrame:
    """Customers who bought in the ``lookback_weeks`` before ``date``."""
    end = window_at(date).date
    start = end - datetime.timedelta(weeks=lookback_weeks)
    day = F.col("t_dat")
    inside = txn.where((day >= _date(start)) & (day < _date(end)))
    return inside.where(F.col("customer_id").isNotNull()).select("customer_id").distinct()


def features_all_time(
    txn: DataFrame, date: datetime.date | str, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """Counts, spend, recency, tenure, prices, online share and articles over all history."""
    history = _history(txn, [window_at(date, cfg)], cfg, articles=True)
    return history.select("customer_id", *ALL_TIME_FEATURES)


def features_trailing(
    txn: DataFrame, date: datetime.date | str, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """Count, spend and active days in each trailing window; spend is NULL in an empty one."""
    weeks = max(cfg.lookback_weeks, *cfg.feature_windows_weeks)
    history = _history(txn, [window_at(date, cfg)], cfg, weeks=weeks)
    return history.select("customer_id", *trailing_features(cfg))


def features_gap(
    txn: DataFrame, date: datetime.date | str, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """Mean, longest and shortest gap between purchase days; NULL with a single day."""
    return _history(txn, [window_at(date, cfg)], cfg).select("customer_id", *GAP_FEATURES)


def avg_basket_size(
    txn: DataFrame, date: datetime.date | str, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """Items per purchase day."""
    return _history(txn, [window_at(date, cfg)], cfg).select("customer_id", "avg_basket_size")


def features_demo(
    cust: DataFrame, pop: DataFrame, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """Plausible age and membership flags of the population's known customers."""
    return _demographics(cust, cfg).join(pop, "customer_id", "left_semi")


def lapse_label(
    txn: DataFrame, date: datetime.date | str, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """1 for customers of the population without a purchase in the label window, else 0."""
    history = _history(txn, [window_at(date, cfg)], cfg, weeks=cfg.lookback_weeks)
    return history.select("customer_id", "lapsed")


def recency_and_label(
    txn: DataFrame, date: datetime.date | str, cfg: RetentionConfig = DEFAULT
) -> DataFrame:
    """Recency and label of the population, which is all that the recency baseline needs."""
    history = _history(txn, [window_at(date, cfg)], cfg, weeks=cfg.lookback_weeks)
    return history.select("customer_id", "recency_days", "lapsed")


def _families_of(snaps: DataFrame) -> tuple[dict[str, list[str]], RetentionConfig]:
    """The families whose features ``snaps`` has, and a configuration with its trailing windows."""
    weeks = tuple(int(c[10:-1]) for c in snaps.columns if c.startswith("txn_count_") and c[10:-1].isdigit())
    cfg = dataclasses.replace(DEFAULT, feature_windows_weeks=weeks)
    present = {f: [c for c in names if c in snaps.columns] for f, names in feature_families(cfg).items()}
    return {f: names for f, names in present.items() if names}, cfg


def _differs(a: Column, b: Column) -> Column:
    """Whether two values differ by more than the order of a sum can change them."""
    close = F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return ~F.coalesce(close, a.isNull() & b.isNull())


def _marked(snaps: DataFrame, txn: DataFrame | None, online_channel: int) -> tuple[DataFrame, list[str]]:
    """``snaps`` with ``_differs_<family>``, NULL where the values can't be taken again; and the families.

    The features are taken once more for each date from days that were cut off before it.
    """
    families, cfg = _families_of(snaps)
    cfg = dataclasses.replace(cfg, online_channel=online_channel)
    dates = [r[0] for r in snaps.select("snapshot_date").distinct().collect()] if txn is not None else []
    windows = [window_at(date, cfg, str(date)) for date in dates if date is not None]
    again: list[str] = []
    if windows:
        before = txn.where(F.col("t_dat") < _date(max(w.date for w in windows)))
        stored = "n_items" in txn.columns  # days already condensed keep what they count
        condense = purchase_days_with_articles if "articles" in families and not stored else purchase_days
        taken = _customer_features(with_gaps(condense(before, online_channel)), windows, cfg, cut=True)
        again = [c for names in families.values() for c in names if c in taken.columns]
        renamed = taken.select("customer_id", "snapshot_date", *(F.col(c).alias(f"_again_{c}") for c in again))
        snaps = snaps.join(renamed, ["customer_id", "snapshot_date"], "left")
    marks = {}
    for family, names in families.items():
        found = [_differs(F.col(c), F.col(f"_again_{c}")) for c in names if c in again]
        marks[f"_differs_{family}"] = reduce(Column.__or__, found) if found else F.lit(None).cast("boolean")
    return snaps.withColumns(marks), list(families)


def leakage_report(
    snaps: DataFrame, txn: DataFrame | None = None, online_channel: int = DEFAULT.online_channel
) -> DataFrame:
    """Per snapshot date and feature family: rows, last source day, rows that differ, and safety.

    ``max_source_date`` is the latest ``source_<family>`` (see ``snapshots``), NULL if ``snaps`` has
    none. With the transactions, or their purchase days, every feature is taken once more from days
    cut off before the date; ``n_differing`` counts the rows with another value, NULL if the family
    can't be taken again (articles need days that count new ones). A family is safe if its sources
    lie before the date and nothing differs, NULL if neither is known.
    """
    marked, families = _marked(snaps, txn, online_channel)
    entries = [
        F.struct(
            F.lit(family).alias("family"),
            (F.col(f"source_{family}") if f"source_{family}" in snaps.columns else F.lit(None).cast("date")).alias(
                "source"
            ),
            F.col(f"_differs_{family}").alias("differs"),
        )
        for family in families
    ]
    rows = marked.select("snapshot_date", F.inline(F.array(*entries)))
    differing = F.when(F.count("differs") > 0, F.count(F.when(F.col("differs"), 1)))
    found = rows.groupBy("snapshot_date", "family").agg(
        n_rows().alias("n_rows"), F.max("source").alias("max_source_date"), differing.alias("n_differing")
    )
    past = F.col("max_source_date") < F.col("snapshot_date")
    same = F.col("n_differing") == 0
    safe = F.when(~past | ~same, False).when(past | same, True)
    return found.withColumn("is_safe", safe)


def leakage_guard(
    snaps: DataFrame, txn: DataFrame | None = None, online_channel: int = DEFAULT.online_channel
) -> DataFrame:
    """Per snapshot: the last day its features used, by its smallest recency, and whether it is past.

    A snapshot with source days of any feature family on or after its date is not safe. With the
    transactions (or their purchase days), every feature is taken once more as in
    ``leakage_report``; a snapshot with other values is not safe either.
    """
    marked, families = _marked(snaps, txn, online_channel)
    bad = [F.coalesce(F.col(f"_differs_{f}"), F.lit(False)) for f in families]
    bad += [
        F.coalesce(F.col(c) >= F.col("snapshot_date"), F.lit(False)) for c in snaps.columns if c.startswith("source_")
    ]
    wrong = reduce(Column.__or__, bad) if bad else F.lit(False)
    latest = marked.groupBy("snapshot_date").agg(F.min("recency_days").alias("_least"), F.max(wrong).alias("_wrong"))
    used = F.date_sub("snapshot_date", F.col("_least").cast("int"))
    return latest.select(
        "snapshot_date",
        used.alias("max_source_date"),
        ((used < F.col("snapshot_date")) & ~F.col("_wrong")).alias("is_safe"),
    )


def check_leakage(snaps: DataFrame, txn: DataFrame | None = None) -> None:
    """Raise if features of a snapshot used its own date or later ones; ``txn`` as in ``leakage_guard``."""
    leaking = leakage_guard(snaps, txn).where(~F.col("is_safe")).collect()  # one row per snapshot
    if leaking:
        raise ValueError(f"features use data from the label window: {leaking}")


def snapshot_summary(snaps: DataFrame, digits: int | None = 1) -> DataFrame:
    """Per snapshot: customers, lapsed customers, lapse rate and number of features."""
    id_columns = {"customer_id", "lapsed", "snapshot_date", "snapshot"}
    n_features = len([c for c in snaps.columns if c not in id_columns and not c.startswith("source_")])
    sums = snaps.groupBy("snapshot", "snapshot_date").agg(
        n_rows().alias("n_customers"), F.sum("lapsed").alias("n_lapsed")
    )
    return sums.select(
        "*",
        share_pct("n_lapsed", "n_customers", digits).alias("lapse_rate_pct"),
        F.lit(n_features).cast("bigint").alias("n_features"),
    )


def gap_distribution(
    txn: DataFrame, probs: Sequence[float] = (0.5, 0.75, 0.9, 0.95), digits: int | None = 1
) -> DataFrame:
    """Quantiles and mean of all gaps between purchase days, in days."""
    gaps = with_gaps(purchase_days(txn)).where(F.col("gap_days").isNotNull())
    per_gap = gaps.groupBy("gap_days").agg(n_rows().alias("n"))  # one row per number of days
    found = per_gap.agg(
        F.percentile("gap_days", list(probs), F.col("n")).alias("_q"),
        F.sum("n").alias("n_gaps"),
        F.sum(F.col("gap_days") * F.col("n")).alias("_sum"),
    )
    mean = ratio("_sum", "n_gaps")
    quantiles = (F.col("_q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probs))
    return found.select(*quantiles, round_even(mean, digits).alias("mean_gap"), "n_gaps")
