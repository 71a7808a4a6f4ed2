"""DuckDB SQL with the same results, for the operators that SQL can express."""

_SPACE = "[\\x20\\x09-\\x0D]+"

_OP2 = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
sh(kind, id, s) AS (
  SELECT 'i', item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[x:x + 4], ' ') FOR x IN range(1, len(w) - 3)] END) FROM i
  UNION
  SELECT 'd', doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[x:x + 4], ' ') FOR x IN range(1, len(w) - 3)] END) FROM d),
size AS (SELECT id AS item_id, count(*) AS n_item FROM sh WHERE kind = 'i' GROUP BY 1),
shared AS (SELECT b.id AS doc_id, a.id AS item_id, count(*) AS n_shared
  FROM sh a JOIN sh b ON a.s = b.s AND a.kind = 'i' AND b.kind = 'd' GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN size USING (item_id) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)
"""

_OP4 = f"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_OP10 = f"""
WITH RECURSIVE q AS (SELECT doc_id, avg(CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 ELSE 0.8 END) AS w
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> ''))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / coalesce(w, 0.8) AS key
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1)::INT % 3]::DOUBLE AS weight
  FROM d GROUP BY 1),
fill(nr, factor, whole, bound) AS (
  SELECT 0, sum(source_size) / sum(weight), sum(source_size)::DOUBLE, 0::BIGINT FROM s
  UNION ALL
  SELECT nr + 1, (SELECT (f.whole - coalesce(sum(3.0 * source_size) FILTER (3.0 * source_size < weight * f.factor), 0))
      / sum(weight) FILTER (3.0 * source_size >= weight * f.factor) FROM s),
    f.whole, (SELECT count(*) FROM s WHERE 3.0 * source_size < weight * f.factor)
  FROM fill f WHERE nr < 60 AND f.bound < (SELECT count(*) FROM s WHERE 3.0 * source_size < weight * f.factor)),
t AS (SELECT source, source_size, least(3.0 * source_size, weight * (SELECT max_by(factor, nr) FROM fill)) AS target FROM s),
r AS (SELECT d.*, source_size, target, floor(target / source_size)::BIGINT AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, epochs + (before + size / 2 <= target - epochs * source_size AND epochs < 3
    AND target - epochs * source_size > 0)::BIGINT AS times FROM r)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, times, (times * size)::BIGINT AS taken FROM m
"""

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

_OP13 = f"""
WITH i AS (SELECT DISTINCT item_id, {_TERMS} AS t FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
p AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM i) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS weight
  FROM p, whole GROUP BY t, docs),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM p JOIN w USING (t) JOIN size USING (doc_id) JOIN i USING (t), whole GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
"""

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": _OP2,
    "op4_exact_dedup": _OP4,
    "op10_source_mixing": _OP10,
    "op13_ranked_search": _OP13,
}
