"""Parameters of the analysis, passed explicitly to the operators that need them."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class SegmentRule:
    """A named box in (recency, frequency, monetary) quantile space."""

    name: str
    recency: tuple[int, ...]
    frequency: tuple[int, ...]
    monetary: tuple[int, ...]


# Segment boxes in the order they are tried; the first match wins.
SEGMENT_RULES = (
    SegmentRule("Champions", recency=(4, 5), frequency=(4, 5), monetary=(4, 5)),
    SegmentRule("Loyal", recency=(3, 4, 5), frequency=(3, 4, 5), monetary=(3, 4, 5)),
    SegmentRule("At_risk", recency=(1, 2), frequency=(3, 4, 5), monetary=(3, 4, 5)),
    SegmentRule("Promising", recency=(3, 4, 5), frequency=(1, 2), monetary=(1, 2, 3)),
    SegmentRule("Lapsed", recency=(1, 2), frequency=(1, 2), monetary=(1, 2, 3)),
)
# Fixed value: the segment of customers that no box matches.
OTHER_SEGMENT = "Other"


@dataclass(frozen=True)
class RetentionConfig:
    random_seed: int = 42
    sample_fraction: float = 0.10

    label_window_weeks: int = 12
    snapshot_spacing_weeks: int = 12
    lookback_weeks: int = 52
    feature_windows_weeks: tuple[int, ...] = (4, 12, 26)

    n_quantiles: int = 5
    segment_rules: tuple[SegmentRule, ...] = SEGMENT_RULES

    min_age: int = 15
    max_age: int = 100
    channels: tuple[int, ...] = (1, 2)
    online_channel: int = 2

    min_support: float = 0.005
    min_pair_count: int | None = None
    top_n_pairs: int = 20

    logistic_c: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    tree_depths: tuple[int, ...] = (3, 5, 7)
    tree_rates: tuple[float, ...] = (0.05, 0.1)
    tree_counts: tuple[int, ...] = (200, 400)
    positive_weights: tuple[float, ...] = (1.0, 3.0, 5.0)
    row_subsamples: tuple[float, ...] = (0.8,)
    feature_subsamples: tuple[float, ...] = (0.8,)

    target_deciles: tuple[int, ...] = (1,)
    target_segments: tuple[str, ...] = ("Champions", "Loyal", "Promising")
    retention_uplift_pp: tuple[int, ...] = (2, 5, 10)
    revenue_index_base: float = 100.0


DEFAULT = RetentionConfig()


def _rule(name: str, box: Mapping[str, Any]) -> SegmentRule:
    return SegmentRule(
        name,
        recency=tuple(box["recency_q"]),
        frequency=tuple(box["frequency_q"]),
        monetary=tuple(box["monetary_q"]),
    )


def config_from_mapping(settings: Mapping[str, Any]) -> RetentionConfig:
    """Build a config from a nested mapping, such as a parsed YAML settings file.

    Keys that are left out keep their defaults. Segment boxes are tried in the order
    of ``SEGMENT_RULES``, whatever order the mapping lists them in; boxes under other
    names are not evaluated.
    """
    top_level = (
        "random_seed",
        "sample_fraction",
        "label_window_weeks",
        "snapshot_spacing_weeks",
        "lookback_weeks",
    )
    values: dict[str, Any] = {key: settings[key] for key in top_level if key in settings}
    if "feature_windows_weeks" in settings:
        values["feature_windows_weeks"] = tuple(settings["feature_windows_weeks"])

    rfm = settings.get("rfm", {})
    if "n_quantiles" in rfm:
        values["n_quantiles"] = rfm["n_quantiles"]
    if "segments" in rfm:
        boxes = rfm["segments"]
        if unknown := set(boxes) - {default.name for default in SEGMENT_RULES}:
            raise ValueError(f"unknown segments: {sorted(unknown)}")
        values["segment_rules"] = tuple(
            _rule(default.name, boxes[default.name])
            for default in SEGMENT_RULES
            if default.name in boxes
        )

    affinity = settings.get("affinity", {})
    for key in ("min_support", "top_n_pairs"):
        if key in affinity:
            values[key] = affinity[key]

    model = settings.get("model", {})
    if "logistic_C" in model:
        values["logistic_c"] = tuple(float(c) for c in model["logistic_C"])
    grid = model.get("xgb_param_grid", {})
    for key, field in (
        ("max_depth", "tree_depths"),
        ("learning_rate", "tree_rates"),
        ("n_estimators", "tree_counts"),
        ("scale_pos_weight", "positive_weights"),
    ):
        if key in grid:
            values[field] = tuple(grid[key])
    for key, field in (("subsample", "row_subsamples"), ("colsample_bytree", "feature_subsamples")):
        if key in grid:
            values[field] = tuple(float(v) for v in grid[key])

    sizing = settings.get("sizing", {})
    for key, field in (
        ("target_deciles", "target_deciles"),
        ("retention_uplift_pp", "retention_uplift_pp"),
    ):
        if key in sizing:
            values[field] = tuple(sizing[key])
    if "revenue_index_base" in sizing:
        values["revenue_index_base"] = float(sizing["revenue_index_base"])

    return dataclasses.replace(DEFAULT, **values)


def load_config(path: str) -> RetentionConfig:
    """Read a YAML settings file. Needs PyYAML, which is optional."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("load_config needs PyYAML; use config_from_mapping instead") from error
    with open(path) as handle:
        return config_from_mapping(yaml.safe_load(handle) or {})
