"""The llm queries as DuckDB SQL, where SQL can express them over whole tables."""

_PAIRS = """WITH m AS (SELECT DISTINCT chunk_id, entity_id FROM entities WHERE chunk_id IS NOT NULL),
n AS (SELECT count(DISTINCT chunk_id) AS baskets FROM m),
c AS (SELECT entity_id, count(*) AS n FROM m WHERE entity_id IS NOT NULL GROUP BY 1),
p AS (SELECT a.entity_id AS item_a, b.entity_id AS item_b, count(*) AS together
  FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.entity_id < b.entity_id GROUP BY 1, 2),
q AS (SELECT p.*, x.n AS n_a, y.n AS n_b, n.baskets FROM p JOIN c x ON x.entity_id = item_a JOIN c y ON y.entity_id = item_b, n)"""

_RANKS = """WITH v AS (
  SELECT query_id, id, source, min(CASE WHEN source = 'Vector' THEN distance ELSE -score END) AS v FROM search_results
  WHERE query_id IS NOT NULL AND id IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, source ORDER BY v) AS r FROM v WHERE v IS NOT NULL AND NOT isnan(v)),
f AS (SELECT query_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + r)), 12) AS rrf, count(*) AS sources, max(r) AS worst FROM r GROUP BY ALL),
s AS (SELECT query_id, count(DISTINCT source) AS n FROM r GROUP BY ALL)"""

_GRAM = "list_transform(range(1, len(w) - 10), lambda i: list_slice(w, i, i + 11))"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

_NEAR = """WITH v AS (
  SELECT id, max(CAST(vector AS DOUBLE[])) AS v FROM chunks WHERE vector IS NOT NULL AND id IS NOT NULL GROUP BY id),
u AS (SELECT * FROM v WHERE list_aggregate(list_transform(v, lambda x: abs(x)), 'max') > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5 AND c >= 0.85"""

_NEAREST = _NEAR[: _NEAR.index("SELECT DISTINCT least")].replace("ON a.id <> b.id)", "ON a.id <> b.id WHERE CAST('0x' || substr(md5(a.id), 1, 4) AS INT) % 20 = 0)") + (
    "SELECT a AS id, b AS other, round(c, 4) AS cosine, r AS rank FROM r WHERE r <= 5"
)

SQL = {
    "p3_found": _NEAR,
    "p3_neighbours": _NEAREST,
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('quote')} AS w FROM eval_items UNION ALL SELECT item_id, {_WORDS.format('question')} FROM eval_items),
dg AS (SELECT DISTINCT doc_id, unnest({_GRAM}) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest({_GRAM}) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p8_spans": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('quote')} AS w FROM eval_items UNION ALL SELECT item_id, {_WORDS.format('question')} FROM eval_items),
dg AS (SELECT doc_id, unnest({_GRAM}) AS g, unnest(range(len(w) - 11)) AS at0 FROM d WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest({_GRAM}) AS g FROM i WHERE len(w) >= 12),
h AS (SELECT DISTINCT doc_id, item_id, at0 FROM dg JOIN ig USING (g))
SELECT doc_id, item_id, count(*) AS windows, min(at0) AS first_word, max(at0) + 12 AS end_word FROM h GROUP BY doc_id, item_id""",
    "p2_found": _PAIRS + """
SELECT item_a AS entity_a, item_b AS entity_b FROM q WHERE together >= 5 AND together * baskets >= 5 * n_a * n_b
AND EXISTS (SELECT 1 FROM relations r WHERE least(r.from_entity, r.to_entity) = item_a AND greatest(r.from_entity, r.to_entity) = item_b)""",
    "p2_association": _PAIRS + """,
d AS (SELECT *, CAST(together AS DOUBLE) AS ab, CAST(n_a AS DOUBLE) AS a, CAST(n_b AS DOUBLE) AS b, CAST(baskets AS DOUBLE) AS t FROM q)
SELECT item_a, item_b, together, n_a, n_b, round(ab * t / (a * b), 6) AS lift, round(log2(ab * t / (a * b)), 6) AS pmi,
  round(CASE WHEN ab >= t THEN 1.0 ELSE log2(ab * t / (a * b)) / -log2(ab / t) END, 6) AS npmi, round(ab / (a + b - ab), 6) AS jaccard,
  round(2 * (ab * ln(ab / (a * b / t)) + CASE WHEN a > ab THEN (a - ab) * ln((a - ab) / (a * (t - b) / t)) ELSE 0 END
    + CASE WHEN b > ab THEN (b - ab) * ln((b - ab) / ((t - a) * b / t)) ELSE 0 END
    + CASE WHEN t - a - b + ab > 0 THEN (t - a - b + ab) * ln((t - a - b + ab) / ((t - a) * (t - b) / t)) ELSE 0 END), 6) AS g2
FROM d""",
    "p2_files": """WITH m AS (SELECT DISTINCT source_file, entity_id FROM entities WHERE source_file IS NOT NULL AND entity_id IS NOT NULL),
c AS (SELECT entity_id, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT a.entity_id AS item_a, b.entity_id AS item_b, count(*) AS together FROM m a JOIN m b ON a.source_file = b.source_file AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT p.*, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT source_file) FROM entities) AS baskets FROM p JOIN c x ON x.entity_id = item_a JOIN c y ON y.entity_id = item_b""",
    "p9_limits": """WITH o AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS own FROM documents WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT m.source, coalesce(own, 0) AS own, coalesce(weight, 0) * (SELECT sum(own) FROM o) AS wanted, coalesce(max_repeats, 0) * coalesce(own, 0) AS most FROM mix_targets m LEFT JOIN o USING (source) WHERE m.source IS NOT NULL)
SELECT source, own, round(least(wanted, CAST(most AS DOUBLE)), 2) AS planned, wanted > most AS short, true AS close, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS twice FROM t""",
    "p7_found": _RANKS + """
SELECT query_id, id FROM f JOIN s USING (query_id) WHERE n >= 2 AND sources = n AND worst <= 2""",
    "p7_ranking": _RANKS + """
SELECT query_id, id, rrf, sources, rank() OVER (PARTITION BY query_id ORDER BY rrf DESC) AS position FROM f""",
}
