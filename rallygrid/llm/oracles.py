"""SQL twins of the llm queries, where SQL can express them on whole tables."""

ORACLES = {
    "p2_found": """
SELECT match_id, odds_id FROM (
  SELECT m.match_id, o.odds_id,
    row_number() OVER (PARTITION BY m.match_id ORDER BY abs(epoch_us(m.match_date) - epoch_us(o."Date")), o.odds_id) AS rn
  FROM training_matches m JOIN atp_odds o ON lower(trim(m.pair_key)) = lower(trim(o.pair_key))
   AND abs(epoch_us(m.match_date) - epoch_us(o."Date")) <= 604800000000
) WHERE rn = 1
""",
    # Of twelve words with at most one replaced, the first or the last six are untouched.
    "p8_found": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, w[i:i+5] AS a, w[i+6:i+11] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
t AS (SELECT item_id, w[i:i+5] AS a, w[i+6:i+11] AS b FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM d JOIN t ON d.a = t.a WHERE len(list_filter(range(1, 7), lambda k: d.b[k] = t.b[k])) >= 5
UNION
SELECT DISTINCT doc_id, item_id FROM d JOIN t ON d.b = t.b WHERE len(list_filter(range(1, 7), lambda k: d.a[k] = t.a[k])) >= 5
""",
}
