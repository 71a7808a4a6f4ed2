"""SQL with the same results as the catalogue's queries, written against the warehouse tables.

Each statement is put together from common table expressions: the retail view of the
warehouse, and what later steps build on. They follow the definitions of the results,
not the plans of the Spark operators: window functions over whole tables, distinct
counts and correlated subqueries.
"""

from __future__ import annotations

_PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"

_TXN = f"""txn AS (
  SELECT CAST(o_orderdate AS DATE) AS t_dat, o_custkey AS customer_id, l_partkey AS article_id,
         {_PRICE} AS price,
         CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 ELSE 1 END AS BIGINT)
           AS sales_channel_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_CUST = """cust AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'ACTIVE' ELSE c_mktsegment END AS club_member_status,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Regularly' ELSE 'NONE' END AS fashion_news_frequency,
         CAST(FLOOR(c_acctbal / 100) AS BIGINT) AS age
  FROM customer)"""


def _art(item: str = "p_name") -> str:
    return f"""art AS (
  SELECT p_partkey AS article_id, {item} AS product_type_name, p_type AS product_group_name FROM part)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _even(expression: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"round_even(({expression}) * {scale}, 0) / {scale}"


def _double(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _share(part: str, whole: str, digits: int | None = None) -> str:
    share = f"{_double(part)} / {_double(whole)} * 100.0"
    return share if digits is None else _even(share, digits)


# Ingest

_COUNTS = """
  SELECT 'transactions' AS "table", count(*) AS row_count FROM txn
  UNION ALL SELECT 'customers', count(*) FROM cust
  UNION ALL SELECT 'articles', count(*) FROM art"""
_STATS = """
  SELECT 'transactions' AS "table", 'min_date' AS stat, CAST(min(t_dat) AS VARCHAR) AS value FROM txn
  UNION ALL SELECT 'transactions', 'max_date', CAST(max(t_dat) AS VARCHAR) FROM txn
  UNION ALL SELECT 'transactions', 'distinct_customers',
    CAST(count(DISTINCT customer_id) AS VARCHAR) FROM txn
  UNION ALL SELECT 'transactions', 'distinct_articles',
    CAST(count(DISTINCT article_id) AS VARCHAR) FROM txn
  UNION ALL SELECT 'customers', 'distinct_customers',
    CAST(count(DISTINCT customer_id) AS VARCHAR) FROM cust
  UNION ALL SELECT 'articles', 'distinct_articles',
    CAST(count(DISTINCT article_id) AS VARCHAR) FROM art"""
_IN_SAMPLE = (
    "CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '42'), 1, 8) AS BIGINT) % 10000 < 1000"
)
_SCHEMA_ROWS = (
    ("transactions", "t_dat", "date"),
    ("transactions", "customer_id", "bigint"),
    ("transactions", "article_id", "bigint"),
    ("transactions", "price", "decimal(12,2)"),
    ("transactions", "sales_channel_id", "bigint"),
    ("customers", "customer_id", "bigint"),
    ("customers", "club_member_status", "string"),
    ("customers", "fashion_news_frequency", "string"),
    ("customers", "age", "bigint"),
    ("articles", "article_id", "bigint"),
    ("articles", "product_type_name", "string"),
    ("articles", "product_group_name", "string"),
)


def _schema_values() -> str:
    seen: dict[str, int] = {}
    rows = []
    for table, column, dtype in _SCHEMA_ROWS:
        seen[table] = seen.get(table, 0) + 1
        rows.append(f"('{table}', {seen[table]}, '{column}', '{dtype}')")
    return ", ".join(rows)


_BASE = (_TXN, _CUST, _art())

ORACLES: dict[str, str] = {
    "read_tables": _with(*_BASE)
    + _STATS
    + " UNION ALL SELECT 'transactions', 'spend', CAST(sum(price) AS VARCHAR) FROM txn",
    "read_tables_parquet": _with(*_BASE) + _COUNTS,
    "schema_profile": _with(*_BASE, f"counts AS ({_COUNTS})")
    + f"""SELECT s."table", CAST(s.position AS BIGINT) AS position, s."column", s.dtype, c.row_count
  FROM (VALUES {_schema_values()}) AS s("table", position, "column", dtype)
  JOIN counts c ON c."table" = s."table" """,
    "table_stats": _with(*_BASE) + _STATS,
    "hash_sample_ids": _with(_CUST) + f"SELECT DISTINCT customer_id FROM cust WHERE {_IN_SAMPLE}",
    "sample_tables": _with(
        _TXN, _CUST, _art(), f"ids AS (SELECT DISTINCT customer_id FROM cust WHERE {_IN_SAMPLE})"
    )
    + """
  SELECT 'transactions' AS "table", count(*) AS row_count FROM txn JOIN ids USING (customer_id)
  UNION ALL SELECT 'customers', count(*) FROM cust JOIN ids USING (customer_id)
  UNION ALL SELECT 'articles', count(*) FROM art""",
    "sample_transactions": _with(
        _TXN, _CUST, f"ids AS (SELECT DISTINCT customer_id FROM cust WHERE {_IN_SAMPLE})"
    )
    + """SELECT CAST(t_dat AS VARCHAR) AS t_dat, customer_id, article_id, price, sales_channel_id
  FROM txn JOIN ids USING (customer_id)""",
    "write_clustered": _with(_TXN)
    + f"""SELECT CAST(t_dat AS VARCHAR) AS t_dat, count(*) AS n_txns, {_double('sum(price)')} AS revenue
  FROM txn GROUP BY t_dat""",
    "reconcile_counts": _with(*_BASE, f"counts AS ({_COUNTS})")
    + """SELECT "table", row_count AS raw_rows, row_count AS stored_rows, true AS matches FROM counts""",
}

_MONTHLY = f"""monthly AS (
  SELECT CAST(date_trunc('month', t_dat) AS DATE) AS month, {_double('sum(price)')} AS revenue,
         count(*) AS n_txns
  FROM txn GROUP BY 1)"""
ORACLES["write_result"] = (
    _with(_TXN, _MONTHLY)
    + """SELECT CAST(month AS VARCHAR) AS month, revenue, n_txns, fmt
  FROM monthly, (VALUES ('parquet'), ('json'), ('csv')) AS f(fmt)"""
)

# Data quality

_GAPS = """gaps AS (
  SELECT t_dat, CAST(t_dat - lag(t_dat) OVER (ORDER BY t_dat) AS BIGINT) AS gap_days
  FROM (SELECT DISTINCT t_dat FROM txn))"""
_MISSING_AGE = f"""SELECT count(*) FILTER (WHERE age IS NULL) AS n_missing, count(*) AS n_customers,
  {_share('count(*) FILTER (WHERE age IS NULL)', 'count(*)', 2)} AS pct FROM"""
_PRICES = f"""SELECT count(*) AS n_txn, {_double('min(price)')} AS min_price,
    {_double('max(price)')} AS max_price, {_double('sum(price)')} / count(price) AS mean_price,
    round(quantile_cont(CAST(price AS DOUBLE), 0.25), 6) AS p25,
    round(quantile_cont(CAST(price AS DOUBLE), 0.5), 6) AS p50,
    round(quantile_cont(CAST(price AS DOUBLE), 0.75), 6) AS p75,
    round(quantile_cont(CAST(price AS DOUBLE), 0.99), 6) AS p99
  FROM txn"""


def _distribution(table: str, column: str) -> str:
    pct = _share("count(*)", "sum(count(*)) OVER ()", 2)
    return f"SELECT {column}, count(*) AS n, {pct} AS pct FROM {table} GROUP BY {column}"


def _line(check: str, count: str, source: str, treatment: str, pct: str = "NULL",
          detail: str = "NULL", affected: str = "0") -> str:
    return f"""SELECT '{check}' AS "check", CAST({count} AS BIGINT) AS count,
      CAST({pct} AS DOUBLE) AS pct, CAST({detail} AS VARCHAR) AS detail, '{treatment}' AS treatment,
      CAST({affected} AS BIGINT) AS rows_affected FROM {source}"""


def _text(name: str) -> str:
    return f"'{name}=' || CAST(CAST({name} AS DECIMAL(28,4)) AS VARCHAR)"


_NO_BUYER = "NOT EXISTS (SELECT 1 FROM txn t WHERE t.customer_id = c.customer_id)"
_UNDER, _OVER = "count(*) FILTER (WHERE age < 15)", "count(*) FILTER (WHERE age > 100)"


def _listing(column: str, table: str) -> str:
    return f"""(SELECT count(*) AS count, string_agg(entry, '; ' ORDER BY entry) AS detail FROM (
      SELECT coalesce(CAST({column} AS VARCHAR), 'missing') || '=' || count(*) AS entry
      FROM {table} GROUP BY {column}))"""


_REPORT_LINES = (
    _line("transactions", "count(*)", "txn", "starting count"),
    _line("customers", "count(*)", "cust", "starting count"),
    _line("articles", "count(*)", "art", "starting count"),
    _line(
        "duplicate_transactions", "count(*)",
        """(SELECT row_number() OVER (PARTITION BY t_dat, customer_id, article_id, price,
          sales_channel_id) AS rn FROM txn) WHERE rn > 1""",
        "kept: several units of one article may be bought together",
    ),
    _line(
        "missing_age", "count(*) FILTER (WHERE age IS NULL)", "cust", "kept as NULL",
        pct=_share("count(*) FILTER (WHERE age IS NULL)", "count(*)", 2),
    ),
    _line(
        "implausible_age", f"{_UNDER} + {_OVER}", "cust", "set to NULL outside 15..100",
        detail=f"'under=' || {_UNDER} || ', over=' || {_OVER} || ', range=' || min(age) || '..' || max(age)",
        affected=f"{_UNDER} + {_OVER}",
    ),
    _line(
        "customers_without_transactions", f"count(*) FILTER (WHERE {_NO_BUYER})", "cust c",
        "excluded: no history to analyse",
        pct=_share(f"count(*) FILTER (WHERE {_NO_BUYER})", "count(*)", 2),
        affected=f"count(*) FILTER (WHERE {_NO_BUYER})",
    ),
    _line(
        "unknown_customers", "count(*)",
        "txn t WHERE NOT EXISTS (SELECT 1 FROM cust c WHERE c.customer_id = t.customer_id)",
        "kept without metadata",
    ),
    _line(
        "unknown_articles", "count(*)",
        "txn t WHERE NOT EXISTS (SELECT 1 FROM art a WHERE a.article_id = t.article_id)",
        "kept without metadata",
    ),
    _line(
        "invalid_price", "count(*) FILTER (WHERE price IS NULL OR price <= 0)", "txn",
        "kept and flagged",
    ),
    _line(
        "price_distribution", "n_txn", f"({_PRICES})", "no outliers removed",
        detail=" || ', ' || ".join(
            _text(n) for n in ("min_price", "p25", "p50", "p75", "p99", "max_price", "mean_price")
        ),
    ),
    _line(
        "single_purchase_customers", "count(*) FILTER (WHERE n = 1)",
        "(SELECT customer_id, count(*) AS n FROM txn GROUP BY customer_id)", "kept",
        pct=_share("count(*) FILTER (WHERE n = 1)", "count(*)", 2),
    ),
    _line(
        "date_gaps", "count(*) FILTER (WHERE gap_days > 1)", "gaps", "no action",
        detail="""'max_gap=' || max(gap_days) || coalesce(' around ' || CAST((SELECT t_dat FROM gaps
          WHERE gap_days > 1 ORDER BY gap_days DESC, t_dat LIMIT 1) AS VARCHAR), '')""",
    ),
    _line(
        "sales_channels", "count", _listing("sales_channel_id", "txn"), "used as a feature",
        detail="detail",
    ),
    _line(
        "club_status", "count", _listing("club_member_status", "cust"), "missing kept as a category",
        detail="detail",
    ),
)

ORACLES.update(
    {
        "q_duplicate_rows": """SELECT count(*) AS n_duplicates FROM (
  SELECT row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn > 1""",
        "q_duplicate_transactions": _with(_TXN)
        + """SELECT count(*) AS n_duplicates FROM (SELECT row_number() OVER (PARTITION BY t_dat,
  customer_id, article_id, price, sales_channel_id) AS rn FROM txn) WHERE rn > 1""",
        "q_missing_age": _with(_CUST)
        + _MISSING_AGE
        + " cust",
        "q_implausible_age": _with(_CUST)
        + f"""SELECT {_UNDER} AS n_under, {_OVER} AS n_over, {_UNDER} + {_OVER} AS n_implausible,
  min(age) AS min_age, max(age) AS max_age, median(age) AS median_age FROM cust""",
        "clean_age": _with(_CUST)
        + """SELECT customer_id,
  CAST(CASE WHEN age < 15 OR age > 100 THEN NULL ELSE age END AS DOUBLE) AS age FROM cust""",
        "q_customers_no_txn": _with(_TXN, _CUST)
        + f"""SELECT count(*) FILTER (WHERE missing) AS n_no_txn, count(*) AS n_customers,
  {_share('count(*) FILTER (WHERE missing)', 'count(*)', 2)} AS pct
  FROM (SELECT NOT EXISTS (SELECT 1 FROM txn t WHERE t.customer_id = c.customer_id) AS missing FROM cust c)""",
        "q_orphan_customers": _with(_TXN, _CUST)
        + """SELECT count(*) AS n_orphans, count(DISTINCT customer_id) AS n_unknown_keys FROM txn t
  WHERE NOT EXISTS (SELECT 1 FROM cust c WHERE c.customer_id = t.customer_id)""",
        "q_orphan_articles": _with(_TXN, _art())
        + """SELECT count(*) AS n_orphans, count(DISTINCT article_id) AS n_unknown_keys FROM txn t
  WHERE NOT EXISTS (SELECT 1 FROM art a WHERE a.article_id = t.article_id)""",
        "q_price_validity": _with(_TXN)
        + """SELECT count(*) FILTER (WHERE price IS NULL) AS n_null,
  count(*) FILTER (WHERE price <= 0) AS n_non_positive,
  count(*) FILTER (WHERE price IS NULL OR price <= 0) AS n_invalid FROM txn""",
        "q_price_distribution": _with(_TXN) + _PRICES,
        "q_single_purchase": _with(_TXN)
        + f"""SELECT count(*) FILTER (WHERE n = 1) AS n_single, count(*) AS n_buyers,
  {_share('count(*) FILTER (WHERE n = 1)', 'count(*)', 2)} AS pct
  FROM (SELECT customer_id, count(*) AS n FROM txn GROUP BY customer_id)""",
        "q_date_gaps": _with(_TXN, _GAPS)
        + """SELECT count(*) AS n_days, count(*) FILTER (WHERE gap_days > 1) AS n_gaps,
  max(gap_days) AS max_gap_days FROM gaps""",
        "q_max_gap_date": _with(_TXN, _GAPS)
        + """SELECT CAST(t_dat AS VARCHAR) AS t_dat, gap_days FROM gaps WHERE gap_days > 1
  ORDER BY gap_days DESC, t_dat LIMIT 1""",
        "q_channel_distribution": _with(_TXN) + _distribution("txn", "sales_channel_id"),
        "q_club_distribution": _with(_CUST) + _distribution("cust", "club_member_status"),
        "quality_report": _with(
            *_BASE, _GAPS, "lines AS (" + "\n UNION ALL ".join(_REPORT_LINES) + ")"
        )
        + """SELECT *, CAST(sum(rows_affected) OVER () AS BIGINT) AS total_rows_affected FROM lines""",
    }
)

# Revenue descriptives

_WEEK = "CAST(date_trunc('week', t_dat) AS DATE)"
_WEEKLY = f"""weekly AS (
  SELECT {_WEEK} AS week, {_double('sum(price)')} AS revenue, count(*) AS n_txns,
         count(DISTINCT customer_id) AS n_customers
  FROM txn GROUP BY 1)"""
_BASE_WEEK = "(SELECT revenue FROM weekly ORDER BY week LIMIT 1 OFFSET 1)"
_INDEXED = f"""indexed AS (
  SELECT week, revenue, {_even(f'revenue / {_BASE_WEEK} * 100.0', 1)} AS rev_index FROM weekly)"""
_SEASONAL = f"""seasonal AS (
  SELECT month, revenue, n_txns,
         {_even('revenue / (SELECT median(revenue) FROM monthly) * 100.0', 1)} AS rev_index
  FROM monthly)"""
_REVENUE = """revenue AS (
  SELECT customer_id, sum(price) AS total_rev FROM txn GROUP BY customer_id)"""
_CURVE = """curve AS (
  SELECT row_number() OVER (ORDER BY total_rev, customer_id) AS r, count(*) OVER () AS n,
         CAST(sum(total_rev) OVER (ORDER BY total_rev, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
           / CAST(sum(total_rev) OVER () AS DOUBLE) AS cum_rev
  FROM revenue)"""

ORACLES.update(
    {
        "weekly_revenue": _with(_TXN, _WEEKLY)
        + "SELECT CAST(week AS VARCHAR) AS week, revenue, n_txns, n_customers FROM weekly",
        "weekly_index": _with(_TXN, _WEEKLY, _INDEXED)
        + "SELECT CAST(week AS VARCHAR) AS week, revenue, rev_index FROM indexed",
        "weekly_extremes": _with(_TXN, _WEEKLY, _INDEXED)
        + """SELECT count(*) AS n_weeks,
  (SELECT CAST(week AS VARCHAR) FROM indexed ORDER BY rev_index DESC, week LIMIT 1) AS peak_week,
  max(rev_index) AS peak_index,
  (SELECT CAST(week AS VARCHAR) FROM indexed ORDER BY rev_index, week LIMIT 1) AS trough_week,
  min(rev_index) AS trough_index FROM indexed""",
        "channel_weekly": _with(_TXN)
        + f"""SELECT CAST({_WEEK} AS VARCHAR) AS week, sales_channel_id,
  {_double('sum(price)')} AS revenue, count(*) AS n_txns FROM txn GROUP BY 1, 2""",
        "channel_share": _with(_TXN)
        + f"""SELECT sales_channel_id, {_double('sum(price)')} AS revenue,
  {_share('sum(price)', '(SELECT sum(price) FROM txn)', 1)} AS pct FROM txn GROUP BY 1""",
        "channel_weekly_share": _with(_TXN)
        + f"""SELECT CAST({_WEEK} AS VARCHAR) AS week,
  {_share('coalesce(sum(price) FILTER (WHERE sales_channel_id = 1), 0)', 'sum(price)')} AS channel_1_pct,
  {_share('coalesce(sum(price) FILTER (WHERE sales_channel_id = 2), 0)', 'sum(price)')} AS channel_2_pct,
  {_share('coalesce(sum(price) FILTER (WHERE sales_channel_id IS NULL OR sales_channel_id NOT IN (1, 2)), 0)', 'sum(price)')} AS other_pct
  FROM txn GROUP BY 1""",
        "product_mix": _with(_TXN, _art())
        + f"""SELECT product_group_name, {_double('sum(price)')} AS revenue,
  {_share('sum(price)', '(SELECT sum(price) FROM txn)', 1)} AS pct
  FROM txn t LEFT JOIN art a
    ON t.article_id = a.article_id GROUP BY 1""",
        "customer_revenue": _with(_TXN, _REVENUE)
        + f"SELECT customer_id, {_double('total_rev')} AS total_rev FROM revenue",
        "lorenz_curve": _with(_TXN, _REVENUE, _CURVE)
        + """SELECT p.point, c.r AS rank, CAST(c.r AS DOUBLE) / c.n AS customer_share,
  round(c.cum_rev, 9) AS revenue_share
  FROM (SELECT unnest(generate_series(1, 100)) AS point) p
  JOIN curve c ON c.r = ceil(p.point * c.n / 100.0)""",
        "top_share": _with(_TXN, _REVENUE, _CURVE)
        + """SELECT CAST(f.fraction AS DOUBLE) AS fraction, round(1 - c.cum_rev, 9) AS revenue_share
  FROM (VALUES (0.1, 0.9), (0.2, 0.8)) AS f(fraction, below)
  JOIN curve c ON c.r = floor(c.n * CAST(f.below AS DOUBLE)) + 1""",
        "gini": _with(_TXN, _REVENUE, _CURVE)
        + """SELECT max(n) AS n_customers, round(1 - 2 * sum(area), 9) AS gini FROM (
  SELECT n, (cum_rev + lag(cum_rev) OVER (ORDER BY r)) / 2 / n AS area FROM curve)""",
        "monthly_revenue": _with(_TXN, _MONTHLY)
        + "SELECT CAST(month AS VARCHAR) AS month, revenue, n_txns FROM monthly",
        "seasonality_index": _with(_TXN, _MONTHLY, _SEASONAL)
        + """SELECT CAST(month AS VARCHAR) AS month, revenue, n_txns, rev_index,
  month = (SELECT month FROM seasonal ORDER BY rev_index DESC, month LIMIT 1) AS is_peak FROM seasonal""",
        "seasonality_peak": _with(_TXN, _MONTHLY, _SEASONAL)
        + """SELECT count(*) AS n_months,
  (SELECT CAST(month AS VARCHAR) FROM seasonal ORDER BY rev_index DESC, month LIMIT 1) AS peak_month,
  max(rev_index) AS peak_index FROM seasonal""",
    }
)

# RFM segmentation


def _qcut(value: str, source: str, q: int) -> str:
    """Bin by linearly interpolated quantile edges; equal edges are merged."""
    probs = ", ".join(repr(i * (1.0 / q)) for i in range(q)) + ", 1.0"
    edges = f"""(SELECT list_sort(list_distinct(quantile_cont(CAST({value} AS DOUBLE), [{probs}])))
      FROM {source})"""
    return f"""CASE WHEN len({edges}) > 1 THEN greatest(1, len(list_filter({edges}[:-2],
      lambda e: {value} > e))) END"""


_RFM = """rfm AS (
  SELECT customer_id, datediff('day', max(t_dat), (SELECT max(t_dat) FROM txn)) AS recency_days,
         count(DISTINCT t_dat) AS frequency, sum(price) AS monetary
  FROM txn GROUP BY customer_id)"""
_RANKED = """ranked AS (
  SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS f_rank,
         row_number() OVER (ORDER BY monetary, customer_id) AS m_rank
  FROM rfm)"""
_SCORES = f"""scores AS (
  SELECT *, 6 - {_qcut('recency_days', 'ranked', 5)} AS R_q, {_qcut('f_rank', 'ranked', 5)} AS F_q,
         {_qcut('m_rank', 'ranked', 5)} AS M_q
  FROM ranked)"""
_SEGMENTS = """segments AS (
  SELECT *, CASE
    WHEN R_q >= 4 AND F_q >= 4 AND M_q >= 4 THEN 'Champions'
    WHEN R_q >= 3 AND F_q >= 3 AND M_q >= 3 THEN 'Loyal'
    WHEN R_q <= 2 AND F_q >= 3 AND M_q >= 3 THEN 'At_risk'
    WHEN R_q >= 3 AND F_q <= 2 AND M_q <= 3 THEN 'Promising'
    WHEN R_q <= 2 AND F_q <= 2 AND M_q <= 3 THEN 'Lapsed'
    ELSE 'Other' END AS segment
  FROM scores)"""
_SEG = (_RFM, _RANKED, _SCORES, _SEGMENTS)
_INDEX = f"""{_double('sum(monetary)')} / count(*)
    / ((SELECT {_double('sum(monetary)')} / count(*) FROM segments)) * 100.0"""
_SUMMARY = f"""summary AS (
  SELECT segment, count(*) AS n_customers, {_double('sum(monetary)')} AS total_revenue,
    {_double('sum(recency_days)')} / count(*) AS avg_recency,
    {_double('sum(frequency)')} / count(*) AS avg_frequency,
    {_double('sum(monetary)')} / count(*) AS avg_monetary,
    {_share('sum(monetary)', '(SELECT sum(monetary) FROM segments)', 1)} AS revenue_share_pct,
    {_share('count(*)', '(SELECT count(*) FROM segments)', 1)} AS customer_share_pct,
    {_INDEX} AS avg_monetary_index
  FROM segments GROUP BY segment)"""

ORACLES.update(
    {
        "rfm_metrics": _with(_TXN, _RFM)
        + f"""SELECT customer_id, recency_days, frequency, {_double('monetary')} AS monetary FROM rfm""",
        "quantile_bins": _with(_TXN, _RFM)
        + f"""SELECT customer_id, {_qcut('recency_days', 'rfm', 5)} AS recency_bin,
  {_qcut('monetary', 'rfm', 10)} AS monetary_bin, {_qcut('frequency', 'rfm', 20)} AS frequency_bin
  FROM rfm""",
        "rank_quantile_bins": _with(_TXN, _RFM, _RANKED)
        + f"""SELECT customer_id, frequency, {_qcut('f_rank', 'ranked', 5)} AS frequency_bin
  FROM ranked""",
        "rfm_scores": _with(_TXN, *_SEG) + "SELECT customer_id, R_q, F_q, M_q FROM scores",
        "rfm_segment": _with(_TXN, *_SEG) + "SELECT customer_id, segment FROM segments",
        "rfm_integrity": _with(_TXN, *_SEG)
        + """SELECT count(DISTINCT customer_id) AS n_customers,
  count(*) - count(DISTINCT customer_id) AS n_duplicated,
  count(*) FILTER (WHERE segment IS NULL) AS n_without_segment FROM segments""",
        "segment_summary": _with(_TXN, *_SEG, _SUMMARY) + "SELECT * FROM summary",
        "segment_monetary_index": _with(_TXN, *_SEG)
        + f"""SELECT segment, {_INDEX} AS avg_monetary_index FROM segments GROUP BY segment""",
        "quintile_bounds": _with(_TXN, *_SEG)
        + """SELECT 'recency_days' AS metric, R_q AS quantile, min(recency_days) AS lowest,
  max(recency_days) AS highest FROM segments GROUP BY R_q
  UNION ALL SELECT 'frequency', F_q, min(frequency), max(frequency) FROM segments GROUP BY F_q""",
        "audit_quintiles": _with(_TXN, *_SEG)
        + """SELECT count(DISTINCT customer_id) AS n_customers,
  count(*) FILTER (WHERE NOT (R_q BETWEEN 1 AND 5 AND F_q BETWEEN 1 AND 5 AND M_q BETWEEN 1 AND 5))
    AS n_bad_scores,
  count(*) FILTER (WHERE segment IS NULL) AS n_without_segment,
  count(*) - count(DISTINCT customer_id) AS n_duplicated FROM segments""",
        "audit_segment_rules": _with(_TXN, *_SEG)
        + """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_mismatched,
  count(DISTINCT segment) AS n_segments FROM segments""",
    }
)

# Cohort retention

_FIRST = """first_purchase AS (
  SELECT customer_id, min(t_dat) AS first_date,
         CAST(date_trunc('month', min(t_dat)) AS DATE) AS cohort_month,
         first(sales_channel_id ORDER BY t_dat, sales_channel_id) AS first_channel
  FROM txn GROUP BY customer_id)"""
_ACTIVITY = """monthly_activity AS (
  SELECT DISTINCT customer_id, CAST(date_trunc('month', t_dat) AS DATE) AS activity_month FROM txn)"""
_COHORTS = """activity AS (
  SELECT cohort_month, first_channel, activity_month,
         datediff('month', cohort_month, activity_month) AS months_since,
         count(DISTINCT customer_id) AS n_customers
  FROM first_purchase JOIN monthly_activity USING (customer_id) GROUP BY ALL)"""


def _retention(key: str) -> str:
    return f"""retention AS (
  SELECT {key}, months_since, n_customers, cohort_size,
         {_share('n_customers', 'cohort_size', 1)} AS retention_pct
  FROM (SELECT {key}, months_since, CAST(sum(n_customers) AS BIGINT) AS n_customers
        FROM activity GROUP BY ALL)
  JOIN (SELECT {key}, count(*) AS cohort_size FROM first_purchase GROUP BY 1) USING ({key}))"""


_COHORT = (_FIRST, _ACTIVITY, _COHORTS, _retention("cohort_month"))
_CHANNEL = (_FIRST, _ACTIVITY, _COHORTS, _retention("first_channel"))
_CELLS = ", ".join(
    f"max(retention_pct) FILTER (WHERE months_since = {m}) AS m{m}" for m in range(13)
)
_MATRIX = f"""matrix AS (
  SELECT cohort_month, {_CELLS} FROM retention GROUP BY cohort_month
  HAVING count(DISTINCT months_since) FILTER (WHERE months_since BETWEEN 0 AND 12) >= 6)"""
_AVG_RETENTION = """SELECT round(avg(m3), 9) AS avg_m3, round(avg(m6), 9) AS avg_m6,
  count(*) AS n_cohorts FROM matrix"""

ORACLES.update(
    {
        "first_purchase": _with(_TXN, _FIRST)
        + """SELECT customer_id, CAST(first_date AS VARCHAR) AS first_date,
  CAST(cohort_month AS VARCHAR) AS cohort_month, first_channel FROM first_purchase""",
        "monthly_activity": _with(_TXN, _ACTIVITY)
        + "SELECT customer_id, CAST(activity_month AS VARCHAR) AS activity_month FROM monthly_activity",
        "cohort_activity": _with(_TXN, _FIRST, _ACTIVITY, _COHORTS)
        + """SELECT CAST(cohort_month AS VARCHAR) AS cohort_month, first_channel,
  CAST(activity_month AS VARCHAR) AS activity_month, months_since, n_customers FROM activity""",
        "cohort_sizes": _with(_TXN, _FIRST)
        + """SELECT CAST(cohort_month AS VARCHAR) AS cohort_month, count(*) AS cohort_size
  FROM first_purchase GROUP BY 1""",
        "cohort_retention": _with(_TXN, *_COHORT)
        + """SELECT CAST(cohort_month AS VARCHAR) AS cohort_month, months_since, n_customers,
  cohort_size, retention_pct FROM retention""",
        "retention_matrix": _with(_TXN, *_COHORT, _MATRIX)
        + "SELECT * REPLACE (CAST(cohort_month AS VARCHAR) AS cohort_month) FROM matrix",
        "avg_retention": _with(_TXN, *_COHORT, _MATRIX) + _AVG_RETENTION,
        "channel_sizes": _with(_TXN, _FIRST)
        + "SELECT first_channel, count(*) AS cohort_size FROM first_purchase GROUP BY 1",
        "channel_retention": _with(_TXN, *_CHANNEL)
        + """SELECT first_channel, months_since, n_customers, cohort_size, retention_pct
  FROM retention""",
        "channel_retention_at_risk": _with(_TXN, *_CHANNEL)
        + f"""SELECT r.first_channel, r.months_since, r.n_customers, a.cohort_size,
  {_share('r.n_customers', 'a.cohort_size', 1)} AS retention_pct
  FROM retention r, LATERAL (
    SELECT count(*) AS cohort_size FROM first_purchase p
    WHERE p.first_channel = r.first_channel AND CAST(p.cohort_month + to_months(CAST(r.months_since AS INTEGER)) AS DATE)
      <= (SELECT max(t_dat) FROM txn)) a""",
        "channel_gaps": _with(_TXN, *_CHANNEL)
        + """, at_six AS (
  SELECT first_channel, CAST(coalesce(max(n_customers) FILTER (WHERE months_since = 6), 0) AS BIGINT) AS n_active,
         CAST(coalesce(max(retention_pct) FILTER (WHERE months_since = 6), 0) AS DOUBLE) AS retention_pct
  FROM retention GROUP BY first_channel)
SELECT *, round((SELECT max(retention_pct) FROM at_six) - retention_pct, 9) AS gap_pp FROM at_six""",
        "channel_gap_m6": _with(_TXN, *_CHANNEL)
        + """SELECT a.retention_pct AS channel_1_pct, b.retention_pct AS channel_2_pct,
  round(abs(a.retention_pct - b.retention_pct), 9) AS gap_pp,
  CAST(CASE WHEN a.retention_pct > b.retention_pct THEN 1 ELSE 2 END AS BIGINT) AS better_channel
  FROM retention a, retention b
  WHERE a.first_channel = 1 AND b.first_channel = 2 AND a.months_since = 6 AND b.months_since = 6""",
    }
)

# Snapshots

_CALENDAR = """calendar AS (
  SELECT snapshot, CAST((SELECT max(t_dat) FROM txn) - back * 84 - 84 AS DATE) AS snapshot_date,
         CAST((SELECT max(t_dat) FROM txn) - back * 84 AS DATE) AS label_end
  FROM (VALUES ('train', 2), ('val', 1), ('test', 0)) AS c(snapshot, back))"""
_POP = """pop AS (
  SELECT DISTINCT c.snapshot, c.snapshot_date, c.label_end, t.customer_id
  FROM calendar c JOIN txn t ON t.t_dat >= c.snapshot_date - 364 AND t.t_dat < c.snapshot_date)"""


def _trailing(weeks: int) -> str:
    inside = f"FILTER (WHERE t.t_dat >= p.snapshot_date - {7 * weeks})"
    return f"""count(*) {inside} AS txn_count_{weeks}w,
         CAST(sum(t.price) {inside} AS DOUBLE) AS spend_{weeks}w,
         count(DISTINCT t.t_dat) {inside} AS active_days_{weeks}w"""


_FEATURES = f"""features AS (
  SELECT p.snapshot, p.snapshot_date, p.customer_id, count(*) AS txn_count_all,
         {_double('sum(t.price)')} AS spend_all, count(DISTINCT t.t_dat) AS active_days_all,
         datediff('day', max(t.t_dat), p.snapshot_date) AS recency_days,
         datediff('day', min(t.t_dat), p.snapshot_date) AS tenure_days,
         {_trailing(4)}, {_trailing(12)}, {_trailing(26)},
         {_double('sum(t.price)')} / count(t.price) AS avg_item_price,
         count(DISTINCT t.t_dat) AS n_purchase_days,
         {_double('count(*) FILTER (WHERE t.sales_channel_id = 2)')} / count(*) AS online_share,
         count(DISTINCT t.article_id) AS n_distinct_articles
  FROM pop p JOIN txn t ON t.customer_id = p.customer_id AND t.t_dat < p.snapshot_date
  GROUP BY p.snapshot, p.snapshot_date, p.customer_id)"""
_DAY_GAPS = """day_gaps AS (
  SELECT customer_id, t_dat, datediff('day', lag(t_dat) OVER w, t_dat) AS gap_days
  FROM (SELECT DISTINCT customer_id, t_dat FROM txn) WINDOW w AS (PARTITION BY customer_id ORDER BY t_dat))"""
_GAP_FEATURES = """gap_features AS (
  SELECT p.snapshot, p.customer_id, CAST(sum(gap_days) AS DOUBLE) / count(gap_days) AS avg_gap_days,
         CAST(max(gap_days) AS DOUBLE) AS max_gap_days, CAST(min(gap_days) AS DOUBLE) AS min_gap_days
  FROM pop p JOIN day_gaps g ON g.customer_id = p.customer_id AND g.t_dat < p.snapshot_date
  WHERE gap_days IS NOT NULL GROUP BY p.snapshot, p.customer_id)"""
_DEMO = """demo AS (
  SELECT customer_id,
         CAST(CASE WHEN age < 15 OR age > 100 THEN NULL ELSE age END AS DOUBLE) AS age,
         CAST(CASE WHEN club_member_status = 'ACTIVE' THEN 1 ELSE 0 END AS DOUBLE) AS is_club_active,
         CAST(CASE WHEN fashion_news_frequency = 'Regularly' THEN 1 ELSE 0 END AS DOUBLE) AS news_regular
  FROM cust)"""
_LABEL = """label AS (
  SELECT p.snapshot, p.customer_id, CAST(CASE WHEN EXISTS (
    SELECT 1 FROM txn t WHERE t.customer_id = p.customer_id AND t.t_dat >= p.snapshot_date
      AND t.t_dat < p.label_end) THEN 0 ELSE 1 END AS BIGINT) AS lapsed
  FROM pop p)"""
_SNAPS = """snaps AS (
  SELECT f.* EXCLUDE (snapshot_date, snapshot), g.avg_gap_days, g.max_gap_days, g.min_gap_days,
         CAST(f.txn_count_all AS DOUBLE) / greatest(f.n_purchase_days, 1) AS avg_basket_size,
         d.age, d.is_club_active, d.news_regular, l.lapsed, f.snapshot_date, f.snapshot
  FROM features f LEFT JOIN gap_features g USING (snapshot, customer_id)
  LEFT JOIN demo d ON d.customer_id = f.customer_id JOIN label l USING (snapshot, customer_id))"""
_TO_LABEL = (_CALENDAR, _POP, _LABEL)
_SNAP = (_CALENDAR, _POP, _FEATURES, _DAY_GAPS, _GAP_FEATURES, _DEMO, _LABEL, _SNAPS)
_TEST = "WHERE snapshot = 'test'"
_TRAILING_NAMES = ", ".join(
    f"txn_count_{w}w, spend_{w}w, active_days_{w}w" for w in (4, 12, 26)
)
_FEATURE_NAMES = (
    "txn_count_all spend_all active_days_all recency_days tenure_days "
    "txn_count_4w spend_4w active_days_4w txn_count_12w spend_12w active_days_12w "
    "txn_count_26w spend_26w active_days_26w avg_item_price n_purchase_days online_share "
    "n_distinct_articles avg_gap_days max_gap_days min_gap_days avg_basket_size age "
    "is_club_active news_regular"
).split()


def _windowed(having: str, lapsed: int, labelled: str) -> str:
    return (
        _with(_TXN, _CALENDAR, _POP, _LABEL)
        + f"""SELECT CAST(c.snapshot_date AS VARCHAR) AS snapshot_date, count(*) AS {labelled},
  count(*) FILTER (WHERE {having}) AS n_violations
  FROM (SELECT l.snapshot, l.customer_id, count(t.t_dat) AS n
        FROM label l JOIN calendar c USING (snapshot)
        LEFT JOIN txn t ON t.customer_id = l.customer_id AND t.t_dat >= c.snapshot_date
          AND t.t_dat < c.label_end
        WHERE l.lapsed = {lapsed} GROUP BY l.snapshot, l.customer_id)
  JOIN calendar c USING (snapshot) GROUP BY c.snapshot_date"""
    )


_SNAPSHOT_ROW = "* REPLACE (CAST(snapshot_date AS VARCHAR) AS snapshot_date)"

ORACLES.update(
    {
        "snapshot_calendar": _with(_TXN, _CALENDAR)
        + """SELECT snapshot, CAST(snapshot_date AS VARCHAR) AS snapshot_date,
  CAST(label_end AS VARCHAR) AS label_end FROM calendar""",
        "population": _with(_TXN, _CALENDAR, _POP) + f"SELECT customer_id FROM pop {_TEST}",
        "features_all_time": _with(_TXN, _CALENDAR, _POP, _FEATURES)
        + f"""SELECT customer_id, txn_count_all, spend_all, active_days_all, recency_days,
  tenure_days, avg_item_price, n_purchase_days, online_share, n_distinct_articles
  FROM features {_TEST}""",
        "features_trailing": _with(_TXN, _CALENDAR, _POP, _FEATURES)
        + f"SELECT customer_id, {_TRAILING_NAMES} FROM features {_TEST}",
        "features_gap": _with(_TXN, _CALENDAR, _POP, _DAY_GAPS, _GAP_FEATURES)
        + f"""SELECT p.customer_id, avg_gap_days, max_gap_days, min_gap_days
  FROM pop p LEFT JOIN gap_features g USING (snapshot, customer_id) {_TEST}""",
        "avg_basket_size": _with(_TXN, _CALENDAR, _POP, _FEATURES)
        + f"""SELECT customer_id, CAST(txn_count_all AS DOUBLE) / n_purchase_days AS avg_basket_size
  FROM features {_TEST}""",
        "features_demo": _with(_TXN, _CUST, _CALENDAR, _POP, _DEMO)
        + f"""SELECT d.* FROM demo d JOIN pop p USING (customer_id) {_TEST}""",
        "lapse_label": _with(_TXN, *_TO_LABEL) + f"SELECT customer_id, lapsed FROM label {_TEST}",
        "snapshot": _with(_TXN, _CUST, *_SNAP)
        + f"SELECT {_SNAPSHOT_ROW.replace('* ', '* EXCLUDE (snapshot) ')} FROM snaps {_TEST}",
        "snapshots": _with(_TXN, _CUST, *_SNAP) + f"SELECT {_SNAPSHOT_ROW} FROM snaps",
        "leakage_guard": _with(_TXN, _CALENDAR, _POP)
        + """SELECT CAST(p.snapshot_date AS VARCHAR) AS snapshot_date,
  CAST(max(t.t_dat) AS VARCHAR) AS max_source_date, max(t.t_dat) < p.snapshot_date AS is_safe
  FROM pop p JOIN txn t ON t.customer_id = p.customer_id AND t.t_dat < p.snapshot_date
  GROUP BY p.snapshot_date""",
        "leakage_report": _with(_TXN, _CALENDAR, _POP)
        + """, visits AS (
  SELECT DISTINCT p.snapshot_date, p.customer_id, t.t_dat, t.t_dat > min(t.t_dat) OVER (
    PARTITION BY p.snapshot_date, p.customer_id) AS again
  FROM pop p JOIN txn t ON t.customer_id = p.customer_id AND t.t_dat < p.snapshot_date)
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, family, count(DISTINCT customer_id) AS n_rows,
  CAST(max(t_dat) FILTER (WHERE again OR family <> 'gaps') AS VARCHAR) AS max_source_date,
  CAST(0 AS BIGINT) AS n_differing,
  max(t_dat) FILTER (WHERE again OR family <> 'gaps') < snapshot_date AS is_safe
  FROM visits, (VALUES ('counts'), ('spend'), ('online'), ('gaps'), ('articles')) AS f(family)
  GROUP BY snapshot_date, family""",
        "snapshot_summary": _with(_TXN, *_TO_LABEL)
        + f"""SELECT snapshot, CAST(snapshot_date AS VARCHAR) AS snapshot_date, count(*) AS n_customers,
  CAST(sum(lapsed) AS BIGINT) AS n_lapsed, {_share('sum(lapsed)', 'count(*)', 1)} AS lapse_rate_pct,
  CAST(25 AS BIGINT) AS n_features
  FROM label JOIN calendar USING (snapshot) GROUP BY snapshot, snapshot_date""",
        "gap_distribution": _with(_TXN, _DAY_GAPS)
        + f"""SELECT quantile_cont(gap_days, 0.5) AS p50, quantile_cont(gap_days, 0.75) AS p75,
  quantile_cont(gap_days, 0.9) AS p90, quantile_cont(gap_days, 0.95) AS p95,
  {_even('CAST(sum(gap_days) AS DOUBLE) / count(gap_days)', 1)} AS mean_gap, count(gap_days) AS n_gaps
  FROM day_gaps""",
        "audit_unique": _with(_TXN, _CALENDAR, _POP)
        + """SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date,
  count(DISTINCT customer_id) AS n_keys, count(*) - count(DISTINCT customer_id) AS n_duplicated
  FROM pop GROUP BY snapshot_date""",
        "audit_feature_dates": _with(_TXN, _CALENDAR, _POP)
        + """SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, count(*) AS n_customers,
  count(*) FILTER (WHERE snapshot_date - last_day < 1) AS n_not_before,
  CAST(0 AS BIGINT) AS n_wrong_recency, CAST(max(last_day) AS VARCHAR) AS max_source_date
  FROM (SELECT p.snapshot_date, p.customer_id, max(t.t_dat) AS last_day
        FROM pop p JOIN txn t ON t.customer_id = p.customer_id AND t.t_dat < p.snapshot_date
        GROUP BY ALL)
  GROUP BY snapshot_date""",
        "audit_label_retained": _windowed("n = 0", 0, "n_retained"),
        "audit_label_lapsed": _windowed("n > 0", 1, "n_lapsed"),
        "audit_spacing": _with(_TXN, _CALENDAR)
        + """SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, gap_days, gap_days = 84 AS is_spaced
  FROM (SELECT snapshot_date, CAST(snapshot_date - lag(snapshot_date) OVER (ORDER BY snapshot_date)
    AS BIGINT) AS gap_days FROM calendar) WHERE gap_days IS NOT NULL""",
    }
)

# Model metrics, on recency as the score

_HISTORY = """history AS (
  SELECT p.snapshot, p.customer_id, l.lapsed, datediff('day', max(t.t_dat), p.snapshot_date) AS recency_days
  FROM pop p JOIN label l USING (snapshot, customer_id)
  JOIN txn t ON t.customer_id = p.customer_id AND t.t_dat < p.snapshot_date
  GROUP BY p.snapshot, p.snapshot_date, p.customer_id, l.lapsed)"""


def _scored(snapshot: str, name: str) -> str:
    return f"""{name} AS (
  SELECT customer_id, lapsed, recency_days,
         CAST(recency_days - min(recency_days) OVER () AS DOUBLE)
           / (CAST(max(recency_days) OVER () - min(recency_days) OVER () AS DOUBLE) + 1e-9) AS score
  FROM history WHERE snapshot = '{snapshot}')"""


_BASELINE = (*_TO_LABEL, _HISTORY, _scored("test", "scored"))
_HIST = """hist AS (
  SELECT score, count(*) FILTER (WHERE lapsed = 1) AS pos, count(*) FILTER (WHERE lapsed = 0) AS neg
  FROM scored GROUP BY score)"""


def _auc(source: str) -> str:
    return f"""CAST((SELECT sum(a.pos * (CASE WHEN b.score < a.score THEN 2 * b.neg
      WHEN b.score = a.score THEN b.neg ELSE 0 END)) FROM {source} a, {source} b) AS DOUBLE)
    / CAST((SELECT 2 * sum(pos) * sum(neg) FROM {source}) AS DOUBLE)"""


def _average_precision(source: str) -> str:
    return f"""(SELECT sum(pos / total * tp / flagged) FROM (
      SELECT CAST(pos AS DOUBLE) AS pos, CAST(sum(pos) OVER () AS DOUBLE) AS total,
        CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp,
        CAST(sum(pos + neg) OVER (ORDER BY score DESC) AS DOUBLE) AS flagged
      FROM {source}))"""


_DECILES = f"""deciles AS (
  SELECT *, max(bin) OVER () + 1 - bin AS decile
  FROM (SELECT *, {_qcut('score', 'scored', 10)} AS bin FROM scored))"""
_LIFT = f"""lift AS (
  SELECT decile, n_customers, n_lapsed, avg_prob, lapse_rate_pct, capture_pct,
    {_even('sum(capture_pct) OVER (ORDER BY decile)', 1)} AS cum_capture_pct,
    {_even('lapse_rate_pct / base', 2)} AS lift
  FROM (SELECT decile, count(*) AS n_customers, CAST(sum(lapsed) AS BIGINT) AS n_lapsed,
      round(sum(score) / count(*), 9) AS avg_prob,
      {_share('sum(lapsed)', 'count(*)', 1)} AS lapse_rate_pct,
      {_share('sum(lapsed)', 'sum(sum(lapsed)) OVER ()', 1)} AS capture_pct,
      {_double('sum(sum(lapsed)) OVER ()')} / {_double('sum(count(*)) OVER ()')} * 100.0 AS base
    FROM deciles GROUP BY decile))"""
_MODELS = f"""models AS (
  SELECT 'recency' AS model, lapsed, score FROM scored
  UNION ALL SELECT 'constant', lapsed, 0.5 FROM scored
  UNION ALL SELECT 'inverted', lapsed, 1 - score FROM scored)"""


def _model_row(name: str) -> str:
    hist = f"""(SELECT score, count(*) FILTER (WHERE lapsed = 1) AS pos,
      count(*) FILTER (WHERE lapsed = 0) AS neg FROM models WHERE model = '{name}' GROUP BY score)"""
    return f"""SELECT '{name}' AS model, count(*) AS n, CAST(sum(lapsed) AS BIGINT) AS n_pos,
    {_auc(hist)} AS roc_auc, round({_average_precision(hist)}, 9) AS pr_auc,
    round(avg((score - lapsed) * (score - lapsed)), 9) AS brier
    FROM models WHERE model = '{name}'"""


_VECTOR = ", ".join(
    f"coalesce(CAST({name} AS DOUBLE), -1.0) AS {name}" for name in _FEATURE_NAMES
)
_FILLED = f"filled AS (SELECT snapshot, customer_id, lapsed, {_VECTOR} FROM snaps)"
_SCALED = ", ".join(
    f"""round(CASE WHEN s.dev_{n} = 0 THEN 0 ELSE (f.{n} - s.mean_{n}) / s.dev_{n} END, 6) AS {n}"""
    for n in _FEATURE_NAMES
)
_MOMENTS = ", ".join(f"avg({n}) AS mean_{n}, stddev_pop({n}) AS dev_{n}" for n in _FEATURE_NAMES)
# Isotonic regression by its min-max formula over all intervals of different scores, then
# linear interpolation between neighbouring scores and the end values beyond them.
_ISOTONIC = (
    _scored("val", "val_scored"),
    """levels AS (
  SELECT row_number() OVER (ORDER BY score) AS i, score, count(*) AS n, sum(lapsed) AS pos
  FROM val_scored GROUP BY score)""",
    """means AS (
  SELECT a.i AS lo, b.i AS hi, CAST(b.pos - a.pos AS DOUBLE) / CAST(b.n - a.n AS DOUBLE) AS mean
  FROM (SELECT i, sum(pos) OVER (ORDER BY i) - pos AS pos, sum(n) OVER (ORDER BY i) - n AS n FROM levels) a
  JOIN (SELECT i, sum(pos) OVER (ORDER BY i) AS pos, sum(n) OVER (ORDER BY i) AS n FROM levels) b
    ON a.i <= b.i)""",
    """fitted AS (
  SELECT i, score, max(least_mean) AS y FROM (
    SELECT l.i, l.score, m.lo, min(m.mean) AS least_mean
    FROM levels l JOIN means m ON m.lo <= l.i AND m.hi >= l.i GROUP BY ALL)
  GROUP BY i, score)""",
    """steps AS (
  SELECT score AS x0, y AS y0, lead(score) OVER (ORDER BY i) AS x1, lead(y) OVER (ORDER BY i) AS y1
  FROM fitted)""",
)

ORACLES.update(
    {
        "feature_vector": _with(_TXN, _CUST, *_SNAP)
        + f"SELECT customer_id, lapsed, {_VECTOR} FROM snaps {_TEST}",
        "standardise": _with(
            _TXN, _CUST, *_SNAP, _FILLED,
            f"moments AS (SELECT {_MOMENTS} FROM filled WHERE snapshot = 'train')",
        )
        + f"SELECT f.customer_id, {_SCALED} FROM filled f, moments s WHERE f.snapshot = 'test'",
        "recency_baseline": _with(_TXN, *_BASELINE)
        + "SELECT customer_id, lapsed, recency_days, score FROM scored",
        "isotonic_calibrate": _with(_TXN, *_BASELINE, *_ISOTONIC)
        + """SELECT t.customer_id, round(CASE
    WHEN t.score <= (SELECT min(score) FROM fitted) THEN (SELECT min(y) FROM fitted)
    WHEN t.score >= (SELECT max(score) FROM fitted) THEN (SELECT max(y) FROM fitted)
    ELSE s.y0 + (s.y1 - s.y0) * (t.score - s.x0) / (s.x1 - s.x0) END, 6) AS calibrated
  FROM scored t LEFT JOIN steps s ON t.score >= s.x0 AND t.score < s.x1""",
        "metric_roc_auc": _with(_TXN, *_BASELINE, _HIST) + f"SELECT {_auc('hist')} AS roc_auc",
        "metric_avg_precision": _with(_TXN, *_BASELINE, _HIST)
        + f"SELECT round({_average_precision('hist')}, 9) AS pr_auc",
        "metric_brier": _with(_TXN, *_BASELINE)
        + "SELECT round(avg((score - lapsed) * (score - lapsed)), 9) AS brier FROM scored",
        "baseline_comparison": _with(
            _TXN, *_BASELINE, _MODELS,
            "found AS ("
            + " UNION ALL ".join(_model_row(n) for n in ("recency", "constant", "inverted"))
            + ")",
        )
        + """SELECT *, model = (SELECT model FROM found ORDER BY roc_auc DESC, pr_auc DESC LIMIT 1)
    AS is_best FROM found""",
        "lift_by_decile": _with(_TXN, *_BASELINE, _DECILES, _LIFT) + "SELECT * FROM lift",
        "top_capture": _with(_TXN, *_BASELINE, _DECILES, _LIFT)
        + f"""SELECT {_even('sum(capture_pct) FILTER (WHERE decile <= 1)', 1)} AS top_1_capture_pct,
  {_even('sum(capture_pct) FILTER (WHERE decile <= 3)', 1)} AS top_3_capture_pct FROM lift""",
        "calibration_bins": _with(_TXN, *_BASELINE)
        + """SELECT CAST(greatest(ceil(score * 10), 1) AS BIGINT) AS bin, count(*) AS n,
  CAST(sum(lapsed) AS DOUBLE) / count(*) AS observed_rate,
  round(sum(score) / count(*), 9) AS mean_score FROM scored GROUP BY 1""",
        "risk_scores": _with(_TXN, *_BASELINE, _DECILES)
        + """SELECT customer_id, lapsed, score AS prob_lapse, decile AS risk_decile FROM deciles""",
    }
)

# Basket affinity

_BASKETS = """baskets AS (
  SELECT DISTINCT t.customer_id, t.t_dat, a.product_type_name AS item
  FROM txn t JOIN art a ON a.article_id = t.article_id)"""
_ITEMS = "items AS (SELECT item, count(*) AS n FROM baskets WHERE item IS NOT NULL GROUP BY item)"
_PAIRS = """pairs AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS pair_count
  FROM baskets a JOIN baskets b ON a.customer_id = b.customer_id AND a.t_dat = b.t_dat
    AND a.item < b.item
  GROUP BY 1, 2)"""
_TOTAL = "total AS (SELECT count(*) AS n FROM (SELECT DISTINCT customer_id, t_dat FROM baskets))"


def _affinity(item: str, support: float) -> tuple[str, ...]:
    affinity = f"""affinity AS (
  SELECT item_a AS item_A, item_b AS item_B, pair_count, sab * 100.0 AS support_pct,
         sab / sa * 100.0 AS confidence_A_to_B_pct, sab / sb * 100.0 AS confidence_B_to_A_pct,
         sab / sa / sb AS lift
  FROM (SELECT item_a, item_b, pair_count, CAST(pair_count AS DOUBLE) / t.n AS sab,
               CAST(a.n AS DOUBLE) / t.n AS sa, CAST(b.n AS DOUBLE) / t.n AS sb
        FROM pairs JOIN items a ON a.item = item_a JOIN items b ON b.item = item_b, total t
        WHERE pair_count >= greatest(1, floor(CAST({support} AS DOUBLE) * t.n))))"""
    return (_art(item), _BASKETS, _ITEMS, _PAIRS, _TOTAL, affinity)


_TOP = "FROM affinity ORDER BY lift DESC, item_A, item_B LIMIT"


def _article_pairs() -> tuple[str, ...]:
    pairs = _affinity("CAST(p_partkey AS VARCHAR)", 0)
    return (*pairs[:-1], pairs[-1].replace("greatest(1, ", "greatest(2, "))


_TRIPLES = """triples AS (
  SELECT a.item AS item_A, b.item AS item_B, c.item AS item_C, count(*) AS set_count
  FROM baskets a JOIN baskets b ON a.customer_id = b.customer_id AND a.t_dat = b.t_dat AND a.item < b.item
  JOIN baskets c ON a.customer_id = c.customer_id AND a.t_dat = c.t_dat AND b.item < c.item
  GROUP BY 1, 2, 3)"""

ORACLES.update(
    {
        "baskets": _with(_TXN, _art(), _BASKETS)
        + "SELECT customer_id, CAST(t_dat AS VARCHAR) AS t_dat, item FROM baskets",
        "n_baskets": _with(_TXN, _art(), _BASKETS)
        + """SELECT count(*) AS n_baskets FROM (SELECT DISTINCT t.customer_id, t.t_dat
  FROM txn t JOIN art a ON a.article_id = t.article_id)""",
        "item_counts": _with(_TXN, _art("p_brand"), _BASKETS, _ITEMS)
        + "SELECT item, n AS n_baskets FROM items",
        "basket_types": _with(_TXN, _art("p_brand"), _BASKETS)
        + """SELECT items, count(*) AS n FROM (
    SELECT coalesce(string_agg(item, '|' ORDER BY item), '') AS items
    FROM baskets GROUP BY customer_id, t_dat) GROUP BY items""",
        "pair_counts": _with(_TXN, _art("p_brand"), _BASKETS, _PAIRS) + "SELECT * FROM pairs",
        "affinity_pairs": _with(_TXN, *_affinity("p_name", 0.004)) + "SELECT * FROM affinity",
        "affinity_pairs_articles": _with(_TXN, *_article_pairs())
        + "SELECT * REPLACE (round(lift, 9) AS lift) FROM affinity",
        "affinity_triples": _with(_TXN, _art("p_brand"), _BASKETS, _ITEMS, _TOTAL, _TRIPLES)
        + """SELECT item_A, item_B, item_C, set_count, CAST(set_count AS DOUBLE) / t.n * 100.0 AS support_pct,
    round(CAST(set_count AS DOUBLE) / t.n / (CAST(a.n AS DOUBLE) / t.n * (CAST(b.n AS DOUBLE) / t.n)
      * (CAST(c.n AS DOUBLE) / t.n)), 9) AS lift
  FROM triples JOIN items a ON a.item = item_A JOIN items b ON b.item = item_B JOIN items c ON c.item = item_C, total t
  WHERE set_count >= greatest(1, floor(CAST(0.002 AS DOUBLE) * t.n))""",
        "affinity_top": _with(_TXN, *_affinity("p_brand", 0.005)) + f"SELECT * {_TOP} 20",
    }
)

# Sizing and headline numbers

_SPEND = """spend AS (
  SELECT customer_id, sum(price) AS spend FROM txn, (SELECT * FROM calendar WHERE snapshot = 'test') c
  WHERE t_dat >= c.snapshot_date AND t_dat < c.label_end GROUP BY customer_id)"""
_VALUE = """value AS (
  SELECT d.customer_id, d.decile AS risk_decile, d.lapsed, s.segment,
         coalesce(w.spend, 0) AS actual_spend
  FROM deciles d LEFT JOIN segments s USING (customer_id) LEFT JOIN spend w USING (customer_id))"""
_TARGET = "coalesce(risk_decile = 1 AND segment IN ('Champions', 'Loyal', 'Promising'), false)"
_TOTALS = f"""totals AS (
  SELECT count(*) FILTER (WHERE {_TARGET}) AS n_target,
         count(*) FILTER (WHERE {_TARGET} AND lapsed = 0) AS n_retained,
         CAST(coalesce(sum(actual_spend) FILTER (WHERE {_TARGET}), 0) AS DOUBLE) AS target_spend,
         CAST(sum(actual_spend) FILTER (WHERE {_TARGET} AND lapsed = 0) AS DOUBLE)
           / nullif(count(*) FILTER (WHERE {_TARGET} AND lapsed = 0), 0) AS avg_retained,
         CAST(sum(actual_spend) AS DOUBLE) AS total_revenue
  FROM value)"""
_RISK = """risk AS (
  SELECT n_target AS n_target_customers, n_retained, total_revenue,
         CAST(100.0 AS DOUBLE) AS total_revenue_index,
         round(avg_retained * 100.0 / total_revenue, 9) AS avg_retained_index,
         round((n_target * avg_retained - target_spend) * 100.0 / total_revenue, 9) AS value_lost_index
  FROM totals)"""
_SCENARIOS = """scenarios AS (
  SELECT CAST(pp AS DOUBLE) AS uplift_pp,
         CAST(floor(n_target * (pp / 100.0)) AS BIGINT) AS customers_saved,
         round(n_target * (pp / 100.0) * avg_retained * 100.0 / total_revenue, 9) AS revenue_recovered_index,
         round(n_target * (pp / 100.0) * avg_retained / total_revenue * 100.0, 9) AS share_of_total_pct,
         round(CASE WHEN n_target > 0 AND avg_retained > 0
           THEN n_target * (pp / 100.0) * avg_retained / n_target / avg_retained * 100.0 END, 9)
           AS break_even_cost_pct
  FROM totals, (SELECT CAST(u AS DOUBLE) AS pp FROM (VALUES (2), (5), (10)) AS v(u)))"""
_SIZING = (*_SEG, *_BASELINE, _DECILES, _SPEND, _VALUE, _TOTALS)

ORACLES.update(
    {
        "window_spend": _with(_TXN, _CALENDAR, _SPEND)
        + f"SELECT customer_id, {_double('spend')} AS spend FROM spend",
        "cohort_value": _with(_TXN, *_SIZING)
        + "SELECT * REPLACE (CAST(actual_spend AS DOUBLE) AS actual_spend) FROM value",
        "revenue_index": _with(_TXN, *_SIZING)
        + "SELECT total_revenue, 100.0::DOUBLE / total_revenue AS multiplier FROM totals",
        "target_group": _with(_TXN, *_SIZING)
        + f"""SELECT * REPLACE (CAST(actual_spend AS DOUBLE) AS actual_spend) FROM value
  WHERE {_TARGET}""",
        "value_at_risk": _with(_TXN, *_SIZING, _RISK) + "SELECT * FROM risk",
        "uplift_scenarios": _with(_TXN, *_SIZING, _SCENARIOS) + "SELECT * FROM scenarios",
        "assumptions": _with(_TXN, *_SIZING)
        + """SELECT 'target_risk_deciles' AS parameter, '1' AS value
  UNION ALL SELECT 'target_segments', 'Champions, Loyal, Promising'
  UNION ALL SELECT 'avg_retained_spend_index',
    CAST(CAST(avg_retained * (100.0::DOUBLE / total_revenue) AS DECIMAL(18,6)) AS VARCHAR) FROM totals
  UNION ALL SELECT 'label_window_weeks', '12'
  UNION ALL SELECT 'uplift_pp', '2, 5, 10'""",
        "headline_kpis": _with(
            _TXN, *_SIZING, _RISK, _SCENARIOS, _SUMMARY, _LIFT, *_COHORT, _MATRIX,
            *_affinity("p_name", 0.004),
        )
        + f"""SELECT
  (SELECT customer_share_pct FROM summary WHERE segment = 'Champions') AS champions_customer_pct,
  (SELECT revenue_share_pct FROM summary WHERE segment = 'Champions') AS champions_revenue_pct,
  (SELECT round(avg(m6), 9) FROM matrix) AS avg_retention_m6,
  (SELECT lapse_rate_pct FROM lift WHERE decile = 1) AS top_decile_precision_pct,
  (SELECT capture_pct FROM lift WHERE decile = 1) AS top_decile_capture_pct,
  round(base * 100.0, 9) AS base_rate_pct, round(10.0 / base, 9) AS max_capture_pct,
  (SELECT round(capture_pct / (10.0 / base) * 100.0, 9) FROM lift WHERE decile = 1) AS capture_of_max_pct,
  n_target_customers, value_lost_index, total_revenue_index,
  (SELECT revenue_recovered_index FROM scenarios WHERE uplift_pp = 5) AS uplift_recovered_index,
  (SELECT break_even_cost_pct FROM scenarios WHERE uplift_pp = 5) AS uplift_break_even_pct,
  (SELECT item_A {_TOP} 1) AS top_pair_a, (SELECT item_B {_TOP} 1) AS top_pair_b,
  (SELECT round(lift, 9) {_TOP} 1) AS top_pair_lift
  FROM risk, (SELECT CAST(sum(n_lapsed) AS DOUBLE) / sum(n_customers) AS base FROM lift)""",
    }
)
