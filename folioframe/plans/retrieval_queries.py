"""Retrieval, graph, store and text queries over the project's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioframe.functions import text as T, values as V
from folioframe.operators import graph as G, retrieval as R, store as S
from folioframe.operators.incremental import latest
from folioframe.streaming import changes as CH
from folioframe.session import table
from folioframe.stash import exists, fingerprint, publish, shared_folder

QUERY = "persistent translator checkpoint ranking"
STD = R.WORDS
FILE_SQL = "(SELECT min(file_path) FROM c)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk once, as last written, with a unit vector."""
    raw = table(spark, d, "chunks")
    rows = latest(raw, "id", [F.col("added_at"), F.col("text")], ["text", "vector", "file_path", "parent_id", "breadcrumbs", "doc_type"])
    return rows.withColumn("vector", V.l2_normalize(F.col("vector")))


_OPEN: dict[str, R.TextIndex] = {}


def text_index(spark: SparkSession, d: str) -> R.TextIndex:
    """The written index of a folder's chunks, made by the first search and read by all others until the table changes."""
    root = f"{shared_folder(spark).rstrip('/')}/index-{R.FORMAT}-{fingerprint(spark, f'{d}/chunks.parquet')}"
    if not exists(spark, root):
        made = f"{root}-{uuid.uuid4().hex}"
        R.TextIndex.build(chunks(spark, d), made)
        publish(spark, made, root)  # whole or not at all, whoever else makes it
        _OPEN.pop(root, None)
    if root not in _OPEN or _OPEN[root].spark is not spark:  # one of a session that has ended can't be read
        _OPEN[root] = R.TextIndex(spark, root)
    return _OPEN[root]


def _query_row(rows: DataFrame) -> tuple[str, list[float]]:
    """The chunk that serves as query: the smallest id with a usable vector (one row)."""
    r = rows.where(F.col("vector").isNotNull() & (V.norm(F.col("vector")) > 0)).orderBy("id").select("id", "vector").first()
    return (r["id"], list(r["vector"])) if r else ("", [])


def _first_file(rows: DataFrame) -> str:
    return rows.agg(F.min("file_path")).first()[0]


def ret_knn_top20(spark, d):
    rows = text_index(spark, d).chunks
    own, q = _query_row(rows)
    return R.vector_leg(rows, q, threshold=1.5, exclude=own).select("id", F.round("distance", 4).alias("distance"), F.round("similarity", 3).alias("similarity"), "rank_v")


def ret_knn_filtered(spark, d):
    rows = text_index(spark, d).chunks
    own, q = _query_row(rows)
    return R.vector_leg(rows, q, threshold=2.5, file=_first_file(rows), exclude=own).select("id", F.round("distance", 4).alias("distance"), "rank_v")


def ret_bm25_top20(spark, d):
    index = text_index(spark, d)
    return R.keyword_leg(index.chunks, QUERY, fields={"text_words": STD["text_words"]}, index=index).select("id", F.round("score", 4).alias("score"), "rank_k")


def ret_bm25_multifield(spark, d):
    index = text_index(spark, d)
    return R.keyword_leg(index.chunks, QUERY, fields=STD, index=index).select("id", F.round("score", 4).alias("score"), F.round("score100", 3).alias("score100"), "rank_k")


def ret_bm25_unindexed(spark, d):
    """The same without a written index: the chunks are analysed for the query."""
    return R.keyword_leg(chunks(spark, d), QUERY, fields=STD).select("id", F.round("score", 4).alias("score"), F.round("score100", 3).alias("score100"), "rank_k")


def ret_bm25_all_fields(spark, d):
    """The default six fields, three of them stemmed, so that other forms of a word are found."""
    index = text_index(spark, d)
    return R.keyword_leg(index.chunks, QUERY, index=index).select("id", F.round("score", 4).alias("score"), "rank_k")


def ret_hybrid_rrf(spark, d):
    index = text_index(spark, d)
    own, q = _query_row(index.chunks)
    return R.hybrid_search(index.chunks, q, QUERY, threshold=1.5, exclude=own, fields=STD, index=index).select("id", F.round("score", 4).alias("score"), "source", "rank_v", "rank_k")


def ret_hybrid_source_filter(spark, d):
    index = text_index(spark, d)
    own, q = _query_row(index.chunks)
    return R.hybrid_search(index.chunks, q, QUERY, threshold=2.5, file=_first_file(index.chunks), exclude=own, fields=STD, index=index).select("id", F.round("score", 4).alias("score"), "source")


def ret_merge_two_hops(spark, d):
    index = text_index(spark, d)
    own, q = _query_row(index.chunks)
    return R.two_hops(index.chunks, q, QUERY, threshold=1.5, exclude=own, fields=STD, index=index).select("id", F.round("score", 4).alias("score"), "source")


def ret_key_terms(spark, d):
    return R.key_terms(table(spark, d, "documents"), QUERY, k=20)


def ret_sibling_context(spark, d):
    return R.sibling_context(chunks(spark, d))


def ret_route(spark, d):
    """Where the question goes, by the kinds of the chunks it finds."""
    index = text_index(spark, d)
    hits = R.keyword_leg(index.chunks, QUERY, fields=STD, index=index).select("id").join(index.chunks.select("id", "doc_type", "file_path"), "id")
    return R.route(hits).select("route", F.size("files").alias("files"))


def ret_answer_context(spark, d):
    index = text_index(spark, d)
    hits = R.keyword_leg(index.chunks, QUERY, fields=STD, index=index).select("id", "score").join(index.chunks.select("id", "text", "file_path", "doc_type"), "id")
    return R.answer_context(R.within_budget(R.display_choice(hits), R.context_budget(4096, 512)))


def txt_index_postings(spark, d):
    """The index of the plain text fields as a table."""
    return R.postings(chunks(spark, d), STD).select("field", "term", "id", "tf", "length")


# graph
def ent_extract(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text", "file_path")
    return G.extract_entities(docs).groupBy("entity_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def ent_dedup(spark, d):
    return G.distinct_entities(table(spark, d, "entities"), F.col("mention_id"))


def rel_cooccurrence(spark, d):
    return G.cooccurrence_relations(table(spark, d, "entities")).select("from_entity", "to_entity", "source_file")


def graph_degree_top(spark, d):
    return G.top_entities(table(spark, d, "relations"), 50)


def graph_relation_histogram(spark, d):
    return G.relation_histogram(table(spark, d, "relations"))


def graph_counts(spark, d):
    e, r = table(spark, d, "entities"), table(spark, d, "relations")
    return e.agg(F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("mentions")).select("*", r.agg(F.count(F.lit(1))).scalar().alias("relations"))


def graph_one_hop(spark, d):
    return G.one_hop(table(spark, d, "relations"), _hub(spark, d), n=20)


def _hub(spark, d):
    return G.top_entities(table(spark, d, "relations"), 1).first()["entity_id"]


def graph_one_hop_confident(spark, d):
    return G.one_hop(table(spark, d, "relations"), _hub(spark, d), least_confidence=0.4, n=20)


def graph_two_hop(spark, d):
    return G.two_hops(table(spark, d, "relations"), _hub(spark, d))


def graph_induced(spark, d):
    return G.induced_graph(table(spark, d, "relations"), 20)


def graph_chunks_of_entity(spark, d):
    return G.chunks_of(table(spark, d, "entities"), _hub(spark, d))


def graph_relation_lines(spark, d):
    ents = G.distinct_entities(table(spark, d, "entities"), F.col("mention_id"))
    return G.relation_lines(table(spark, d, "relations"), ents, [_hub(spark, d)])


# store and registry
def _registry(spark, d):
    r = table(spark, d, "file_registry")
    return latest(r.where("indexed_at is not null"), "file_path", [F.col("indexed_at"), F.lower("content_hash")], ["content_hash", "indexed_at"])


def _files(spark, d):
    f = table(spark, d, "files_now")
    return latest(f, "file_path", [F.col("seen_at"), F.col("arrived_at")], ["content_hash", "size_bytes"])


def idx_file_states(spark, d):
    return S.file_states(_files(spark, d), _registry(spark, d))


def idx_deleted(spark, d):
    return S.deleted_files(_registry(spark, d), _files(spark, d))


def idx_upsert_latest(spark, d):
    return _registry(spark, d).select("file_path", F.lower("content_hash").alias("content_hash"), "indexed_at")


def idx_delete_prefix(spark, d):
    return S.without_folder(table(spark, d, "chunks"), "/vault/field").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def idx_replace_files(spark, d):
    """All files with a known time of change are read again: what they held is replaced by what is new."""
    docs = table(spark, d, "documents")
    again = docs.where("modified_at is not null and file_path is not null").select("doc_id", "file_path", F.lit(0).cast("bigint").alias("n_chars"))
    return S.replace_files(docs.select("doc_id", "file_path", "n_chars"), again)


def idx_file_chunks(spark, d):
    rows = table(spark, d, "chunks")
    return S.file_chunks(rows, _first_file(rows))


def idx_counts(spark, d):
    return table(spark, d, "chunks").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("file_path").alias("files"))


def idx_all_texts(spark, d):
    return S.all_texts(table(spark, d, "chunks")).select("id", F.length("text").alias("n"))


def idx_should_index(spark, d):
    return table(spark, d, "files_now").select("file_path").distinct().select("file_path", S.should_index(F.col("file_path")).alias("ok"), S.file_class(F.col("file_path")).alias("class"), T.path_tags(F.col("file_path")).alias("tags"))


# text functions
def txt_preprocess_query(spark, d):
    return table(spark, d, "eval_items").select("item_id", T.sanitize_query(T.preprocess_query(F.col("question"))).alias("q"))


def txt_tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(T.word_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def txt_clean_minimal(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean(F.col("text"), "minimal")).alias("h"))


def txt_clean_default(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("t"))


def txt_clean_aggressive(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text"), "aggressive").alias("t"))


def _block_text():
    """Blocks read by OCR have their text in ``text``, born-digital ones in ``normalized_text``."""
    return F.coalesce("text", "normalized_text")


def txt_cell_type(spark, d):
    cells = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\| ([^|\n]+) "), 1)).alias("c"))
    more = table(spark, d, "page_blocks").select(_block_text().alias("c"))
    return cells.unionByName(more).groupBy(T.cell_type(F.col("c")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def txt_mojibake(spark, d):
    """Lines that would give themselves away if the text were read as Latin-1."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", F.size(T.mojibake_lines(wrong)).alias("lines")).where("lines > 0")


def txt_bigram_similarity(spark, d):
    """How much a document's heading is like the name of its file."""
    docs = table(spark, d, "documents").where("heading is not null and file_path is not null")
    a, b = F.lower("heading"), F.lower(T.file_name(F.col("file_path")))
    return docs.select("doc_id", F.round(T.bigram_similarity(a, b), 6).alias("s"))


def txt_line_dedup(spark, d):
    """Lines that stand in several documents of a source."""
    lines = table(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 20")
    return lines.groupBy("source", "line").agg(F.count_distinct("doc_id").alias("docs")).where("docs > 1")


def txt_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_text(F.col("text"), 40).alias("t"), T.token_count(F.col("text")).alias("n"))


def txt_predicates(spark, d):
    b = table(spark, d, "page_blocks").select("block_id", _block_text().alias("t"))
    t = F.col("t")
    return b.select("block_id", T.ends_incomplete(t).alias("open"), T.is_list_item(t).alias("list"), T.is_footnote_marker(t).alias("note"), T.is_url_start(t).alias("url"), T.numbered_heading_level(t).cast("bigint").alias("level"), T.strip_page_number(t).alias("bare"))


def txt_garbled(spark, d):
    b = table(spark, d, "page_blocks").select("page_source", _block_text().alias("t")).where("t is not null")
    return b.groupBy("page_source").agg(F.sum(T.garbled_characters(F.col("t"))).alias("garbled"), F.sum(F.length("t")).alias("chars"))


def txt_path_tags(spark, d):
    return table(spark, d, "chunks").select("file_path").distinct().select("file_path", T.file_name(F.col("file_path")).alias("name"), T.path_tags(F.col("file_path")).alias("tags"))


def txt_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", V.content_hash(F.col("text")).alias("sha"), V.path_hash(F.col("file_path")).alias("md5"))


def num_excel_date(spark, d):
    return table(spark, d, "part").select("p_partkey", V.excel_date(F.col("p_partkey") + 0.25).alias("stamp"), V.excel_date(F.col("p_partkey").cast("double")).alias("day"))


def num_render(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.cell_number(F.col("o_totalprice")).alias("shown"), V.cell_number(F.floor("o_totalprice").cast("double")).alias("whole"))


# events: the streaming semantics as batch queries
def evt_tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def evt_sliding(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def evt_session(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def evt_debounce(spark, d):
    """Batches of events with at most a minute between neighbours, over all users."""
    told = CH.quiet_batches(table(spark, d, "events"), 60)
    return told.groupBy("batch").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types")).select("start", "n", "types")


def evt_dedup(spark, d):
    e = table(spark, d, "events")
    return e.dropDuplicates(["user_id", "event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


# evaluation
def _normal(c):
    return F.array_join(T.word_tokens(c), " ")


def _quoted(spark, d):
    """Items whose quote some document holds, word for word; the items are a fixed, small set (240), so they go to every document."""
    quotes = table(spark, d, "eval_items").where("quote is not null").select("item_id", _normal(F.col("quote")).alias("q"))
    asked = quotes.agg(F.collect_list(F.struct("item_id", "q")).alias("qs")).scalar()
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", _normal(F.col("text")).alias("t"))
    held = docs.withColumn("qs", asked).select("doc_id", F.explode(F.filter("qs", lambda x: F.col("t").contains(x["q"]))).alias("x"))
    return held.select("doc_id", "x.item_id")


def eval_accuracy_by_type(spark, d):
    """Share of questions that pass, by type, with a total: refusals if they have no answer, others if the corpus holds their quote."""
    found = _quoted(spark, d).select("item_id").distinct().withColumn("held", F.lit(True))
    items = table(spark, d, "eval_items").join(found, "item_id", "left")
    passed = F.when(F.col("must_refuse"), F.col("answer_gold").isNull()).otherwise(F.coalesce("held", F.lit(False)))
    return items.withColumn("passed", passed.cast("int")).rollup("qtype").agg(F.round(F.avg("passed"), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def eval_hit_rate(spark, d):
    """Of the questions whose quote the corpus holds, the share with such a document among the first five found for the question."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", F.lit("").alias("file_path"))
    one = {"text_words": STD["text_words"]}
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.filter(T.word_tokens(F.col("question")), lambda t: ~t.isin(*T.STOP_WORDS)).alias("terms"))
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    index = R.postings(docs, one).join(F.broadcast(terms), "term", "left_semi")  # the words of 240 questions
    hits = R.hits_of_queries(index, R.field_stats(docs, one), asked, 5).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"))
    held = _quoted(spark, d)
    good = held.join(hits, ["item_id", "doc_id"]).select("item_id").distinct().withColumn("hit", F.lit(1))
    return held.select("item_id").distinct().join(good, "item_id", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("hit_rate"), F.count(F.lit(1)).alias("questions"))


QUERIES = {
    k: v for k, v in list(globals().items()) if callable(v) and not isinstance(v, type) and k.split("_")[0] in ("ret", "txt", "ent", "rel", "graph", "idx", "num", "evt", "eval")
}

# ---------------------------------------------------------------------------------------------------------------- SQL
_C = """c0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC, text DESC) AS rn FROM chunks WHERE id IS NOT NULL),
c1 AS (SELECT id, text, CAST(vector AS DOUBLE[]) AS v, file_path, parent_id, breadcrumbs, doc_type FROM c0 WHERE rn = 1),
c AS (SELECT * EXCLUDE v, list_transform(v, lambda x: x / CASE WHEN sqrt(list_sum(list_transform(v, lambda y: y * y))) > 0 THEN sqrt(list_sum(list_transform(v, lambda y: y * y))) ELSE 1 END) AS vector FROM c1)"""
_Q = """q AS (SELECT id AS qid, vector AS qv FROM c WHERE vector IS NOT NULL AND list_sum(list_transform(vector, lambda x: abs(x))) > 0 ORDER BY id LIMIT 1)"""
_DIST = "list_sum(list_transform(list_zip(vector, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _knn(threshold: float, where: str = "") -> str:
    return f"""n0 AS (SELECT id, {_DIST} AS distance FROM c, q WHERE vector IS NOT NULL AND id <> qid {where}),
n1 AS (SELECT * FROM n0 ORDER BY distance, id LIMIT 20), n2 AS (SELECT * FROM n1 WHERE distance <= {threshold}),
n3 AS (SELECT *, CASE WHEN count(*) OVER () >= 3 THEN least(min(distance) OVER () * 1.5, {threshold}) ELSE {threshold} END AS cut FROM n2),
knn AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank_v FROM n3 WHERE distance <= cut)"""


_TERMS = "(" + ", ".join(repr(t) for w in QUERY.split() for t in (w, *(w[i : i + 2] for i in range(len(w) - 1)))) + ")"
_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_NAME = "list_extract(string_split(replace(file_path, '\\', '/'), '/'), -1)"
_TAGS = "array_to_string(list_filter(list_slice(string_split(replace(file_path, '\\', '/'), '/'), 1, -2), lambda p: p NOT IN ('', '.', '..', 'Users', 'home', '/')), ' ')"


def _bm25(fields: tuple[tuple[str, str, float], ...], where: str = "", own: str = "") -> str:
    union = " UNION ALL ".join(f"SELECT id, '{n}' AS field, CAST({b} AS DOUBLE) AS boost, {_W.format(e)} AS t FROM c, q" for n, e, b in fields)
    return f"""f AS ({union}), st AS (SELECT field, count(*) AS docs, avg(len(t)) AS al FROM f GROUP BY field),
p AS (SELECT field, boost, term, id, count(*) AS tf, max(l) AS l FROM (SELECT field, boost, id, len(t) AS l, unnest(t) AS term FROM f) WHERE term IN {_TERMS} GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
b0 AS (SELECT p.id, sum(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))) AS score
  FROM p JOIN df USING (field, term) JOIN st USING (field) {where} {own} GROUP BY p.id),
b1 AS (SELECT * FROM b0 ORDER BY score DESC, id LIMIT 20),
b2 AS (SELECT *, count(*) OVER () AS n, max(score) OVER () AS best FROM b1), b3 AS (SELECT id, score FROM b2 WHERE n < 3 OR best <= 0 OR score >= 0.3 * best),
bm AS (SELECT id, score, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 0.001) * 100 AS score100, row_number() OVER (ORDER BY score DESC, id) AS rank_k FROM b3)"""


_STD = (("file_name_words", _NAME, 5), ("text_words", "text", 3), ("path_words", _TAGS, 2))
_FUSE = """fu AS (SELECT coalesce(knn.id, bm.id) AS id, least(100, 6100 * (coalesce(0.6 / (60 + rank_v), 0) + coalesce(0.4 / (60 + rank_k), 0))) AS score,
CASE WHEN rank_v IS NOT NULL AND rank_k IS NOT NULL THEN 'Hybrid' WHEN rank_v IS NOT NULL THEN 'Vector' ELSE 'Keyword' END AS source, rank_v, rank_k
FROM knn FULL OUTER JOIN bm ON knn.id = bm.id ORDER BY score DESC, id LIMIT 10)"""
_IN_FILE = "JOIN (SELECT id FROM c WHERE file_path = (SELECT min(file_path) FROM c)) ff ON ff.id = p.id"
_HUB = "(SELECT e FROM deg ORDER BY degree DESC, e LIMIT 1)"
_DEG = """ed AS (SELECT DISTINCT from_entity AS a, to_entity AS b, relation_type FROM relations WHERE from_entity IS NOT NULL AND to_entity IS NOT NULL),
deg AS (SELECT e, count(*) AS degree FROM (SELECT a AS e FROM ed UNION ALL SELECT b FROM ed) GROUP BY e)"""
_REG = """reg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC, lower(content_hash) DESC NULLS LAST) AS rn FROM file_registry WHERE indexed_at IS NOT NULL AND file_path IS NOT NULL) WHERE rn = 1),
fn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seen_at DESC, arrived_at DESC, content_hash DESC NULLS LAST) AS rn FROM files_now WHERE file_path IS NOT NULL) WHERE rn = 1)"""


def _hop(where: str) -> str:
    return f"""WITH {_DEG}, r AS (SELECT * FROM relations WHERE {where}),
n AS (SELECT to_entity AS e, relation_type FROM r WHERE from_entity = {_HUB} UNION SELECT from_entity, relation_type FROM r WHERE to_entity = {_HUB})
SELECT n.e AS entity_id, n.relation_type, degree FROM n JOIN deg ON n.e = deg.e WHERE n.e <> {_HUB} ORDER BY degree DESC, entity_id, relation_type LIMIT 20"""


_EVAL = f"""dn AS (SELECT doc_id, array_to_string({_W.format('text')}, ' ') AS t FROM documents WHERE text IS NOT NULL),
held AS (SELECT doc_id, item_id FROM dn JOIN eval_items ON contains(t, array_to_string({_W.format('quote')}, ' ')))"""
_CLASSES = " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in S.CLASSES.items())
_EXT = f"CASE WHEN {_NAME} LIKE '%.%' THEN lower(list_extract(string_split({_NAME}, '.'), -1)) ELSE '' END"
_BAD = f"starts_with({_NAME}, '.') OR starts_with({_NAME}, '~') OR ends_with({_NAME}, '~') OR ext IN ({', '.join(repr(x) for x in S.TEMPORARY)})"
_OK = f"NOT ({_BAD}) AND ext IN ({', '.join(repr(x) for x in S.INDEXED)})"

SQL = {
    "ret_knn_top20": f"WITH {_C}, {_Q}, {_knn(1.5)} SELECT id, round(distance, 4) AS distance, round(greatest(100 - 50 * distance, 0), 3) AS similarity, rank_v FROM knn",
    "ret_knn_filtered": f"WITH {_C}, {_Q}, {_knn(2.5, 'AND file_path = ' + FILE_SQL)} SELECT id, round(distance, 4) AS distance, rank_v FROM knn",
    "ret_bm25_top20": f"WITH {_C}, {_Q}, {_bm25(_STD[1:2])} SELECT id, round(score, 4) AS score, rank_k FROM bm",
    "ret_bm25_multifield": f"WITH {_C}, {_Q}, {_bm25(_STD)} SELECT id, round(score, 4) AS score, round(score100, 3) AS score100, rank_k FROM bm",
    "ret_hybrid_rrf": f"WITH {_C}, {_Q}, {_knn(1.5)}, {_bm25(_STD, own="WHERE p.id <> (SELECT qid FROM q)")}, {_FUSE} SELECT id, round(score, 4) AS score, source, rank_v, rank_k FROM fu",
    "ret_hybrid_source_filter": f"WITH {_C}, {_Q}, {_knn(2.5, 'AND file_path = ' + FILE_SQL)}, {_bm25(_STD, _IN_FILE, "WHERE p.id <> (SELECT qid FROM q)")}, {_FUSE} SELECT id, round(score, 4) AS score, source FROM fu",
    "ret_sibling_context": f"""WITH {_C}, s AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a, parent_id IS NOT NULL AND parent_id <> '' AS has FROM c
WINDOW w AS (PARTITION BY file_path, parent_id ORDER BY coalesce(try_cast(nullif(regexp_extract(id, '(\\d+)$', 1), '') AS BIGINT), 0), id)),
t AS (SELECT id, '[上级] ' || left(nullif(list_extract(string_split(breadcrumbs, ' > '), -1), ''), 200) AS u, CASE WHEN has AND b <> '' THEN '[前文] ' || left(b, 200) END AS b, CASE WHEN has AND a <> '' THEN '[后文] ' || left(a, 200) END AS a FROM s),
x AS (SELECT id, u, CASE WHEN coalesce(length(u), 0) + length(b) <= 500 THEN b END AS b, a FROM t)
SELECT id, nullif(concat_ws(chr(10), u, b, CASE WHEN coalesce(length(u), 0) + coalesce(length(b), 0) + length(a) <= 500 THEN a END), '') AS context FROM x""",
    "ret_bm25_unindexed": f"WITH {_C}, {_Q}, {_bm25(_STD)} SELECT id, round(score, 4) AS score, round(score100, 3) AS score100, rank_k FROM bm",
    "ret_route": f"WITH {_C}, {_Q}, {_bm25(_STD)} SELECT CASE WHEN n = 0 THEN 'text' WHEN n > 1 THEN 'pending_table_selection' ELSE 'table' END AS route, n AS files FROM (SELECT count(DISTINCT file_path) FILTER (WHERE doc_type = 'tabular') AS n FROM bm JOIN c USING (id))",
    "txt_index_postings": f"WITH {_C}, f AS ({' UNION ALL '.join(f'''SELECT id, '{n}' AS field, {_W.format(e)} AS t FROM c''' for n, e, _ in _STD)}) SELECT field, term, id, count(*) AS tf, max(l) AS length FROM (SELECT field, id, len(t) AS l, unnest(t) AS term FROM f) GROUP BY ALL",
    "ent_dedup": """WITH t AS (SELECT entity_id, name, mention_id, CASE lower(trim(entity_type)) WHEN 'person' THEN 'Person' WHEN 'organization' THEN 'Organization' WHEN 'organisation' THEN 'Organization' WHEN 'technology' THEN 'Technology' ELSE 'Concept' END AS k FROM entities WHERE entity_id IS NOT NULL)
SELECT entity_id, arg_min(name, mention_id) FILTER (WHERE name IS NOT NULL) AS name, coalesce(arg_min(k, mention_id) FILTER (WHERE k <> 'Concept'), 'Concept') AS entity_type, count(*) AS mentions FROM t GROUP BY entity_id""",
    "rel_cooccurrence": """WITH m AS (SELECT DISTINCT chunk_id, entity_id, source_file FROM entities WHERE chunk_id IS NOT NULL AND entity_id IS NOT NULL)
SELECT DISTINCT a.entity_id AS from_entity, b.entity_id AS to_entity, a.source_file FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.source_file = b.source_file AND a.entity_id < b.entity_id""",
    "graph_degree_top": f"WITH {_DEG} SELECT e AS entity_id, degree FROM deg ORDER BY degree DESC, e LIMIT 50",
    "graph_relation_histogram": "SELECT coalesce(" + "CASE lower(trim(relation_type)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.RELATION_ALIASES.items()) + " END, nullif(lower(trim(relation_type)), ''), 'related-to') AS relation_type, count(*) AS n FROM relations GROUP BY 1",
    "graph_counts": "SELECT count(DISTINCT entity_id) AS entities, count(*) AS mentions, (SELECT count(*) FROM relations) AS relations FROM entities",
    "graph_one_hop": _hop("true"), "graph_one_hop_confident": _hop("confidence >= 0.4"),
    "graph_two_hop": f"""WITH {_DEG}, b0 AS (SELECT a, b FROM ed WHERE a <> b UNION SELECT b, a FROM ed WHERE a <> b), f AS (SELECT b AS e FROM b0 WHERE a = {_HUB}),
s AS (SELECT DISTINCT b AS e FROM b0 WHERE a IN (SELECT e FROM f)) SELECT e AS entity_id, min(d) AS depth FROM (SELECT e, 1 AS d FROM f UNION ALL SELECT e, 2 FROM s) WHERE e <> {_HUB} GROUP BY e""",
    "graph_induced": f"WITH {_DEG}, t AS (SELECT e FROM deg ORDER BY degree DESC, e LIMIT 20) SELECT from_entity, to_entity, relation_type, count(*) AS weight FROM relations WHERE from_entity IN (SELECT e FROM t) AND to_entity IN (SELECT e FROM t) GROUP BY ALL",
    "graph_chunks_of_entity": f"WITH {_DEG} SELECT DISTINCT chunk_id FROM entities WHERE entity_id = {_HUB} AND chunk_id IS NOT NULL",
    "idx_file_states": f"""WITH {_REG}, x AS (SELECT fn.file_path, fn.content_hash AS h, reg.content_hash AS o, reg.indexed_at AS done, {_EXT.replace('file_path', 'fn.file_path')} AS ext FROM fn LEFT JOIN reg ON fn.file_path = reg.file_path)
SELECT file_path, CASE {_CLASSES} ELSE 'other' END AS file_class, CASE WHEN ext NOT IN ({', '.join(repr(x) for x in S.INDEXED)}) THEN 'Unsupported' WHEN NOT ({_OK}) THEN 'Ignored' WHEN done IS NULL THEN 'Unindexed' WHEN lower(h) IS DISTINCT FROM lower(o) THEN 'Outdated' ELSE 'Indexed' END AS state FROM x""",
    "idx_deleted": f"WITH {_REG} SELECT DISTINCT file_path FROM reg WHERE file_path NOT IN (SELECT file_path FROM fn)",
    "idx_upsert_latest": f"WITH {_REG} SELECT file_path, lower(content_hash) AS content_hash, indexed_at FROM reg",
    "idx_delete_prefix": "SELECT doc_type, count(*) AS n FROM chunks WHERE file_path IS NULL OR NOT starts_with(file_path, '/vault/field/') GROUP BY doc_type",
    "idx_replace_files": """WITH n AS (SELECT doc_id, file_path, CAST(0 AS BIGINT) AS n_chars FROM documents WHERE modified_at IS NOT NULL AND file_path IS NOT NULL)
SELECT doc_id, file_path, n_chars FROM documents WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM n) UNION ALL SELECT * FROM n""",
    "idx_file_chunks": "SELECT id, substring(min(text), 1, 200) AS preview FROM chunks WHERE file_path = (SELECT min(file_path) FROM chunks) GROUP BY id",
    "idx_counts": "SELECT count(*) AS docs, count(DISTINCT file_path) AS files FROM chunks",
    "idx_all_texts": "SELECT id, length(text) AS n FROM chunks WHERE id NOT LIKE '%-doc-summary'",
    "idx_should_index": f"WITH x AS (SELECT DISTINCT file_path, {_EXT} AS ext FROM files_now) SELECT file_path, {_OK} AS ok, CASE {_CLASSES} ELSE 'other' END AS class, {_TAGS} AS tags FROM x",
    "txt_tokens": f"SELECT term, count(*) AS n FROM (SELECT unnest({_W.format('text')}) AS term FROM documents) GROUP BY term",
    "txt_line_dedup": "SELECT source, line, count(DISTINCT doc_id) AS docs FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20 GROUP BY source, line HAVING count(DISTINCT doc_id) > 1",
    "txt_truncate": "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS t, len(regexp_extract_all(text, '\\S+')) AS n FROM documents",
    "txt_path_tags": f"SELECT DISTINCT file_path, {_NAME} AS name, {_TAGS} AS tags FROM chunks",
    "txt_hashes": "SELECT doc_id, sha256(text) AS sha, md5(file_path) AS md5 FROM documents",
    "txt_bigram_similarity": f"""WITH h AS (SELECT doc_id, lower(heading) AS x, lower({_NAME}) AS y FROM documents WHERE heading IS NOT NULL AND file_path IS NOT NULL),
g AS (SELECT *, CASE WHEN length(x) < 2 THEN [] ELSE list_transform(range(1, length(x)), lambda i: substring(x, i, 2)) END AS a, CASE WHEN length(y) < 2 THEN [] ELSE list_transform(range(1, length(y)), lambda i: substring(y, i, 2)) END AS b FROM h)
SELECT doc_id, round(CASE WHEN x = y THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * len(list_filter(a, lambda v: list_contains(b, v))) / (len(a) + len(b)) END, 6) AS s FROM g""",
    "txt_mojibake": """SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[äöüéè°ñ\\x{FEFF}]'))) AS lines FROM documents WHERE lines > 0""",
    "num_render": "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.6f', o_totalprice), '0'), '.') END AS shown, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole FROM orders",
    "ret_key_terms": """WITH w AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '(\\p{Han}+)', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+')) AS w FROM documents),
t AS (SELECT unnest(CASE WHEN regexp_full_match(w, '\\p{Han}{2,}') THEN list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) ELSE [w] END) AS term FROM w)
SELECT term, count(*) AS n FROM t WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN """ + _TERMS + " AND term NOT IN (" + ", ".join(repr(x) for x in T.STOP_WORDS) + ") GROUP BY term ORDER BY n DESC, term LIMIT 20",
    "txt_garbled": r"SELECT page_source, CAST(sum(length(text) - length(regexp_replace(text, '[\x{FFFD}\p{Co}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'))) AS BIGINT) AS garbled, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT page_source, coalesce(text, normalized_text) AS text FROM page_blocks) WHERE text IS NOT NULL GROUP BY page_source",
    "num_excel_date": "SELECT p_partkey, CASE WHEN p_partkey >= 1 THEN strftime(DATE '1899-12-30' + CAST(p_partkey + CASE WHEN p_partkey <= 59 THEN 1 ELSE 0 END AS INT), '%Y-%m-%d') || ' 06:00:00' END AS stamp, CASE WHEN p_partkey >= 1 THEN strftime(DATE '1899-12-30' + CAST(p_partkey + CASE WHEN p_partkey <= 59 THEN 1 ELSE 0 END AS INT), '%Y-%m-%d') END AS day FROM part",
    "evt_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    "evt_sliding": "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s",
    "evt_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k""",
    "evt_debounce": """WITH g AS (SELECT event_type, ts, CASE WHEN ts <= lag(ts) OVER (ORDER BY ts) + INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT event_type, ts, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM s GROUP BY k""",
    "evt_dedup": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "eval_accuracy_by_type": f"""WITH {_EVAL}
SELECT qtype, round(avg(CASE WHEN must_refuse THEN CAST(answer_gold IS NULL AS INT) ELSE CAST(item_id IN (SELECT item_id FROM held) AS INT) END), 6) AS accuracy, count(*) AS n FROM eval_items GROUP BY ROLLUP (qtype)""",
    "eval_hit_rate": f"""WITH {_EVAL},
t AS (SELECT doc_id AS id, {_W.format('text')} AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS docs, avg(len(t)) AS al FROM t),
p AS (SELECT term, id, count(*) AS tf, max(l) AS l FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
a AS (SELECT DISTINCT item_id, unnest({_W.format('question')}) AS term FROM eval_items), b AS (SELECT * FROM a WHERE term NOT IN ({", ".join(repr(x) for x in T.STOP_WORDS)})),
s AS (SELECT item_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 9) AS score FROM b JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL),
r AS (SELECT item_id, id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS k FROM s),
g AS (SELECT DISTINCT item_id FROM held JOIN r USING (item_id, doc_id) WHERE k <= 5)
SELECT round(avg(CAST(item_id IN (SELECT item_id FROM g) AS INT)), 6) AS hit_rate, count(*) AS questions FROM (SELECT DISTINCT item_id FROM held)""",
}
