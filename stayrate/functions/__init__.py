from stayrate.functions.expressions import (
    as_double,
    clean_age,
    month_start,
    months_after,
    n_rows,
    ratio,
    round_even,
    share_pct,
    side_by_side,
    week_start,
)
from stayrate.functions.joins import lookup_join
from stayrate.functions.ranking import (
    distributed_rank,
    edge_bin,
    exact_quantiles,
    quantile_bins,
    quantile_edges,
    rank_quantile_bins,
    running_totals,
)

__all__ = [
    "as_double",
    "clean_age",
    "distributed_rank",
    "edge_bin",
    "exact_quantiles",
    "lookup_join",
    "month_start",
    "months_after",
    "n_rows",
    "quantile_bins",
    "quantile_edges",
    "rank_quantile_bins",
    "ratio",
    "round_even",
    "running_totals",
    "share_pct",
    "side_by_side",
    "week_start",
]
