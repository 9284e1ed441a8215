"""Queries of readers, writers, text and value functions, page operators, scripts and streams, each with its DuckDB text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioframe.functions import text as T, values as V
from folioframe.operators import graph as G, page_tables as PT, pages as P, retrieval as R, sheets as SH, store as S
from folioframe.plans import indexing as IX, retrieval_queries as RQ, sqltools as SQ
from folioframe.plans.document_queries import _B, _blocks
from folioframe.session import table
from folioframe.sources import files as FI
from folioframe.stash import Stash
from folioframe.streaming import changes as CH


def _place(spark: SparkSession) -> str:
    """A new place in the shared folder; it is deleted with the session's other intermediates."""
    return f"{Stash(spark).root}/{uuid.uuid4().hex}"


# -- readers ----------------------------------------------------------------------------------------------------------
def src_dispatch(spark, d):
    """Which reader takes each file seen."""
    return table(spark, d, "files_now").select("file_path").distinct().select("file_path", FI.reader_of(F.col("file_path")).alias("reader"))


def src_page_ranges(spark, d):
    spec = F.concat_ws(",", F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + 2), F.col("p_size") + 5, F.lit("48-"))
    return table(spark, d, "part").select("p_partkey", F.array_join(FI.page_indexes(spec, F.lit(50)), ",").alias("pages"))


def src_select_pages(spark, d):
    return FI.select_pages(table(spark, d, "page_blocks"), FI.page_range("1-3,5,8-", 9), "page_index").select("block_id")


def src_documents(spark, d):
    """Every document written as a file of its own format, the folder walked, and the files read again."""
    docs = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    files = docs.select(F.concat(F.lit("/in/"), "name").alias("file_path"), "content")
    return FI.text_documents(files).select("file_path", F.md5("text").alias("h"))


def src_page_documents(spark, d):
    """Blocks written as page documents, a line each, and read back."""
    b = table(spark, d, "page_blocks").where("file_path is not null")
    block = F.struct(F.col("block_id").cast("string").alias("block_id"), "role", F.coalesce("text", "normalized_text").alias("normalized_text"), F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]).alias("bbox"))
    pages = b.groupBy("file_path", "page_index").agg(F.collect_list(block).alias("blocks")).groupBy(F.col("file_path").alias("doc_id")).agg(F.collect_list(F.struct("page_index", "blocks")).alias("pages"))
    place = _place(spark)
    FI.export(pages, place, "json")
    return FI.page_ir(spark, place, lines=True).select("doc", F.col("page").cast("bigint").alias("page"), "block_id", F.round("x", 3).alias("x"), "role", F.md5("text").alias("h"))


# -- writers ----------------------------------------------------------------------------------------------------------
def snk_append(spark, d):
    """Chunks appended in two batches, partitioned by kind of document."""
    place, rows = _place(spark), table(spark, d, "chunks").select("id", "text", "file_path", "doc_type")
    S.append_chunks(rows.where("doc_type = lower(doc_type)"), place)
    S.append_chunks(rows.where("doc_type != lower(doc_type) or doc_type is null"), place)
    return spark.read.parquet(place).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def snk_delete_file(spark, d):
    rows = table(spark, d, "chunks")
    return S.without_file(rows, RQ._first_file(rows)).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def snk_delete_sources(spark, d):
    """Entities without those of files that the scan doesn't see any more."""
    seen, e = table(spark, d, "files_now").select("file_path"), table(spark, d, "entities")
    gone = e.select(F.col("source_file").alias("file_path")).distinct().join(seen, "file_path", "left_anti")
    return S.without_sources(e, gone).select("mention_id")


def snk_upsert_entities(spark, d):
    """The ends of relations written over the entities: the last writer wins on all columns."""
    old = table(spark, d, "entities").where("entity_id is not null").groupBy("entity_id").agg(F.min("name").alias("name"), F.min("source_file").alias("source_file"))
    new = table(spark, d, "relations").where("from_entity is not null").groupBy(F.col("from_entity").alias("entity_id")).agg(F.lit("linked").alias("name"), F.max("source_file").alias("source_file"))
    return S.upsert(old, new, ["entity_id"])


def snk_upsert_relations(spark, d):
    r = table(spark, d, "relations").where("from_entity is not null and to_entity is not null")
    key = ["from_entity", "to_entity", "relation_type"]
    old = r.groupBy(*key).agg(F.lit(0.0).alias("confidence"))
    new = r.where("confidence >= 0.5").groupBy(*key).agg(F.round(F.max("confidence"), 4).cast("double").alias("confidence"))
    return S.upsert(old, new, key)


def snk_valid_cache(spark, d):
    """Files whose cached tables are still theirs, by time and size."""
    f = table(spark, d, "files_now").where("last_modified is not null and size_bytes is not null")
    now = f.groupBy("file_path").agg(F.max("last_modified").alias("mtime"), F.max("size_bytes").alias("size"))
    kept = f.groupBy("file_path").agg(F.min("last_modified").alias("mtime"), F.min("size_bytes").alias("size"))
    return S.valid_cache(now, kept)


def snk_table_names(spark, d):
    return table(spark, d, "chunks").select("file_path").distinct().where("file_path is not null").select("file_path", SQ.cache_name(F.col("file_path"), F.lit("Sheet 1")).alias("name"))


def snk_export(spark, d):
    """Documents as JSON lines and back."""
    place = _place(spark)
    FI.export(table(spark, d, "documents").select("doc_id", "text", "source"), place, "json")
    return spark.read.schema("doc_id bigint, text string, source string").json(place).select("doc_id", F.md5("text").alias("h"), "source")


def snk_index_versions(spark, d):
    """Two commits of an index: the second one's rows are current, the first one's files are left alone until then."""
    index = IX.Index(spark, _place(spark))
    rows = table(spark, d, "chunks").select("id", "text", F.lit(None).cast("array<float>").alias("vector"), "file_path", "parent_id", "breadcrumbs", "doc_type")
    empty = {n: spark.createDataFrame([], s) for n, s in IX.TABLES.items()}
    index.commit({**empty, "chunks": rows.where("doc_type = 'tabular'")})
    index.commit({**empty, "chunks": index.read("chunks").unionByName(rows.where("doc_type = 'text'"))})
    return index.read("chunks").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def snk_unfinished_pages(spark, d):
    """Pages of which no born-digital block was stored."""
    b = table(spark, d, "page_blocks").where("file_path is not null and page_index is not null")
    pages = b.select(F.col("file_path").alias("doc"), F.col("page_index").alias("page")).distinct()
    done = b.where("page_source = 'BornDigital'").select(F.col("file_path").alias("doc"), F.col("page_index").alias("page"), F.lit("Done").alias("status"))
    return IX.unfinished_pages(pages, done)


# -- text -------------------------------------------------------------------------------------------------------------
def str_truncate_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_bytes(F.col("text"), F.lit(41)).alias("t"))


def str_tables(spark, d):
    """The nations of a region as Markdown, HTML and CSV."""
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])).alias("rows"))
    head = F.array(F.lit("key"), F.lit("name"))
    return rows.select("n_regionkey", T.markdown_table(head, F.col("rows")).alias("md"), T.html_table(head, F.col("rows")).alias("html"), F.array_join(F.transform("rows", lambda r: T.csv_line(r)), "\n").alias("csv"))


def str_fences(spark, d):
    answer = F.concat(F.lit("<think>first {this}\n</think>\n```json\n"), F.col("p_name"), F.lit("\n```\n"))
    return table(spark, d, "part").select("p_partkey", T.strip_fences(answer).alias("t"))


def str_uncommon(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.uncommon_cjk_ratio(F.col("text"), "的一是在不了有和人这中大为上个国我以要他"), 6).alias("r")).where("r is not null")


def str_key_values(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", "n", T.key_value(F.col("line")).alias("kv")).where("kv is not null").select("doc_id", F.col("n").cast("bigint").alias("n"), "kv.key", "kv.value")


def str_heading_levels(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", F.col("n").cast("bigint").alias("n"), T.numbered_heading_level(F.col("line")).cast("bigint").alias("level")).where("level is not null")


def str_urls(spark, d):
    """Addresses broken over lines are one again."""
    spans = F.array(F.concat(F.lit("https://h.example/"), "p_partkey"), F.concat(F.lit("a/"), "p_size"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(P.merge_url_spans(spans), "|").alias("spans"))


# -- values -----------------------------------------------------------------------------------------------------------
def val_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", SQ.number_text(F.col("o_totalprice")).alias("two"), SQ.number_text(F.floor("o_totalprice").cast("double")).alias("whole"))


def val_headers(spark, d):
    return table(spark, d, "part").select("p_partkey", V.merge_headers(F.array(F.col("p_brand"), F.lit(" "), F.col("p_brand"), F.col("p_type"))).alias("name"))


def val_maps(spark, d):
    m = F.create_map(F.lit("title"), F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", V.map_get(m, "Brand#11", "none").alias("type"), V.map_get(m, "title", "none").alias("title"))


def val_contains(spark, d):
    """Blocks of a page that lie in another block by more than 80 per cent."""
    b = _blocks(spark, d).select("doc", "page", "block_id", P.box().alias("b"))
    a, c = b.alias("a"), b.alias("c")
    j = a.join(c, (F.col("a.doc") == F.col("c.doc")) & (F.col("a.page") == F.col("c.page")) & (F.col("a.block_id") != F.col("c.block_id")))
    return j.where(V.contains(F.col("a.b"), F.col("c.b"))).select(F.col("a.block_id").alias("outer"), F.col("c.block_id").alias("inner"))


def val_breadcrumbs(spark, d):
    c = table(spark, d, "chunks").where("breadcrumbs is not null")
    trail = F.array_append(F.split("breadcrumbs", " > "), F.lit("leaf"))
    return c.select("id", V.breadcrumbs(trail).alias("trail"), V.last_breadcrumb(F.col("breadcrumbs")).alias("last")).distinct()


# -- JSON of models ---------------------------------------------------------------------------------------------------
def jsn_graph_answers(spark, d):
    """A model's answer per pair of entities, taken apart again."""
    r = table(spark, d, "relations").where("from_entity is not null and to_entity is not null and relation_type is not null").select("from_entity", "to_entity", "relation_type").distinct()
    node = lambda c: F.struct(F.col(c).alias("name"), F.lit("tool").alias("type"))
    body = F.to_json(F.struct(F.array(node("from_entity"), node("to_entity")).alias("entities"), F.array(F.struct(F.col("from_entity").alias("from"), F.col("to_entity").alias("to"), F.col("relation_type").alias("type"))).alias("relations")))
    told = r.select(V.parse_graph_answer(F.concat(F.lit("Here is {what} I found:\n```json\n"), body, F.lit("\n``` and no more."))).alias("a"))
    x = told.select(F.col("a.entities").alias("e"), F.get("a.relations", 0).alias("r"))
    return x.select(F.get("e", 0)["name"].alias("one"), F.get("e", 1)["name"].alias("two"), V.entity_type(F.get("e", 0)["type"]).alias("kind"), V.relation_type(F.col("r.type")).alias("relation"))


def jsn_html_tables(spark, d):
    """Tables as HTML with a cell over two columns, read into rows."""
    html = F.concat(F.lit("<table><tr><th colspan=2>"), F.col("p_brand"), F.lit("</th></tr><tr><td>"), F.col("p_type"), F.lit("</td><td>"), F.col("p_size"), F.lit("</td></tr></table>"))
    rows = table(spark, d, "part").select("p_partkey", PT.html_tables(html).alias("rows"))
    return rows.select("p_partkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("cells"))


# -- pages ------------------------------------------------------------------------------------------------------------
def pg_noise(spark, d):
    return P.drop_noise(_blocks(spark, d)).select("block_id", F.md5("text").alias("h"))


def pg_watermarks(spark, d):
    return _blocks(spark, d).where(P.is_watermark(300.0, 300.0)).select("block_id")


def pg_chart_labels(spark, d):
    return P.drop_chart_labels(_blocks(spark, d)).select("block_id")


def pg_lists(spark, d):
    return P.mark_lists(_blocks(spark, d)).select("block_id", "role")


def pg_ocr_confidence(spark, d):
    """Mean confidence of a page's recognised blocks."""
    return P.ocr_confidence(table(spark, d, "page_blocks").select(F.col("file_path").alias("doc"), F.col("page_index").alias("page"), "page_source", "confidence")).select("doc", "page", F.round("confidence", 5).alias("confidence"), "blocks")


def pg_glyph_cells(spark, d):
    """The cell of a grid of four by four in which each block lies."""
    b = _blocks(spark, d)
    cells = b.select("doc", "page").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(
        "doc", "page", "cell", ((F.col("cell") % 4) * 153.0).alias("x"), (F.floor(F.col("cell") / 4) * 198.0).alias("y"), F.lit(153.0).alias("width"), F.lit(198.0).alias("height")
    )
    return P.glyph_cells(b.select("doc", "page", F.col("block_id").alias("char_id"), "x", "y", "width", "height"), cells).select(F.col("char_id").alias("block_id"), F.col("cell").cast("bigint").alias("cell"))


def pg_proportional(spark, d):
    """Titles and lists of a page paired in proportion with its other blocks."""
    b = _blocks(spark, d)
    order = lambda rows: rows.withColumn("ordinal", F.row_number().over(RQ.Window.partitionBy("doc", "page").orderBy("block_id")) - 1)
    heads, rest = order(b.where("role in ('Title', 'Heading', 'List')")), order(b.where("role not in ('Title', 'Heading', 'List')"))
    return P.proportional_pairs(heads.select("doc", "page", "block_id", "ordinal"), rest.select("doc", "page", "block_id", "ordinal")).select("block_id", "partner_id")


def pg_unobscured_tables(spark, d):
    b = _blocks(spark, d)
    tables = b.where("height >= 60").select("doc", "page", F.col("block_id").alias("table_id"), "x", "y", "width", "height")
    return P.unobscured_tables(tables, b.where("height < 60")).select("table_id")


def pg_without_formulas(spark, d):
    b = _blocks(spark, d)
    formulas = b.where("role = 'Unknown'").groupBy("doc", "page").agg(F.collect_list("block_id").alias("block_ids"))
    return P.without_covered(b, formulas).select("block_id")


def pg_table_lines(spark, d):
    """Rows and cells of a table as lines of text."""
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])).alias("rows"))
    tables = rows.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("doc"), F.lit(0).alias("page"), F.lit("t1").alias("table_id"), F.array(F.lit("key"), F.lit("name")).alias("headers"), "rows")
    none = spark.createDataFrame([], "doc string, page int, role string, text string")
    return P.rag_lines(none, tables).select("doc", "line_type", "text")


def pg_column_types(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(F.array(F.col("p_partkey").cast("string"), F.col("p_name"), F.concat(F.col("p_size"), F.lit("%")))).alias("rows"))
    return PT.column_types(rows.select(F.col("p_brand").alias("doc"), F.lit("t").alias("table_id"), "rows")).select("doc", F.col("column").cast("bigint").alias("column"), "type")


# -- sheets and SQL ---------------------------------------------------------------------------------------------------
def sql_script(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_in")
    script = "SELECT o_custkey, count(*) AS n FROM orders_in GROUP BY o_custkey; -- first\nSELECT n, count(*) AS customers FROM step_0 GROUP BY n;\nSELECT n, customers FROM step_1 WHERE n > 1"
    return SQ.run_script(spark, script)[0]


def sql_count(spark, d):
    return SQ.count_of(spark, d, "SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000")


def sql_schema(spark, d):
    return spark.createDataFrame([(n,) for n, _ in SQ.schema_of(table(spark, d, "part"))], "name string")


def sql_summaries(spark, d):
    """Whether a table is told in full or in short, and of how many rows."""
    told = [(n, *[SQ.summary(table(spark, d, n))[i] for i in (0, 2)]) for n in ("region", "nation", "part")]
    return spark.createDataFrame(told, "name string, kind string, rows bigint")


def sql_largest_tables(spark, d):
    return spark.createDataFrame(SQ.largest_first({n: table(spark, d, n) for n in ("region", "nation", "supplier", "part")}), "name string, rows bigint")


def sql_typed(spark, d):
    """A block of text cells as a typed table."""
    rows = table(spark, d, "part").agg(F.lit("x").alias("source_id"), F.collect_list(F.array(F.col("p_partkey").cast("string"), F.concat(F.lit(" "), F.col("p_retailprice").cast("string")), F.when(F.col("p_size") > 25, "true").otherwise("no"), F.col("p_name"))).alias("rows"))
    return SH.typed_table(rows, ["k", "price", "big", "name"], ["Int", "Float", "Bool", "Int"])


# -- retrieval and graph ----------------------------------------------------------------------------------------------
def ret_vector_only(spark, d):
    """A query without text: the vector leg alone."""
    index = RQ.text_index(spark, d)
    own, q = RQ._query_row(index.chunks)
    return R.hybrid_search(index.chunks, q, "", threshold=1.5, exclude=own, fields=RQ.STD, index=index).select("id", F.round("score", 4).alias("score"), "source")


def ret_search_all(spark, d):
    """The best hits over the keyword and the hybrid lists, as if they were two indexes."""
    h = table(spark, d, "search_results").where("score is not null and id is not null")
    best = lambda s: h.where(F.col("source") == s).groupBy("id").agg(F.max("score").alias("score"))
    return IX.search_all([best("Keyword"), best("Hybrid")], 25).select("id", F.round("score", 6).alias("score"), F.col("index").cast("bigint").alias("index"))


def graph_answers(spark, d):
    """Names and types of the entities of all files by rule, per file."""
    docs = table(spark, d, "chunks").select("id", "text", "file_path")
    return G.extract_with_model(docs, lambda t: F.lit('{"entities": [{"name": "Alpha", "type": "tool"}]}'), 200).groupBy("entity_type").agg(F.count_if(F.col("entity_id") == "alpha").alias("told")).where("told > 0")


# -- streams ----------------------------------------------------------------------------------------------------------
def _file_events(spark, d):
    """The event table as events of a watched folder."""
    kind = F.when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "click", "modify").otherwise("create")
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/u/"), F.col("user_id")).alias("path"), kind.alias("kind"))


def stm_pending(spark, d):
    return CH.pending(_file_events(spark, d))


def stm_applied(spark, d):
    """The events as a stream of files, applied batch by batch; what was removed and read again, in total."""
    source, state, log = _place(spark), _place(spark), _place(spark)
    _file_events(spark, d).write.json(source)
    write = lambda what: lambda df: df.withColumn("what", F.lit(what)).write.mode("append").parquet(log)
    CH.apply_changes(CH.event_stream(spark, source), state, write("remove"), write("update"), lambda todo, n: None).awaitTermination()
    return spark.read.schema("path string, what string").parquet(log).groupBy("path", "what").agg(F.count(F.lit(1)).alias("n"))


def _streamed(spark, d, plan, name: str) -> DataFrame:
    """The result of a streaming plan over the events, read file by file to the end."""
    source = _place(spark)
    table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value").write.parquet(source)
    stream = spark.readStream.schema("user_id bigint, event_type string, ts timestamp, value double").parquet(source)
    target = f"streamed_{name}_{uuid.uuid4().hex}"
    plan(stream).writeStream.format("memory").queryName(target).outputMode("complete").option("checkpointLocation", _place(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(target)


def stm_tumbling(spark, d):
    out = _streamed(spark, d, lambda s: CH.windowed_counts(s, "1 day", late="3650 days"), "day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stm_sliding(spark, d):
    out = _streamed(spark, d, lambda s: CH.windowed_counts(s, "2 days", "1 day", late="3650 days"), "slide")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stm_deduplicated(spark, d):
    return CH.deduplicated(table(spark, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not isinstance(v, type) and k.split("_")[0] in ("src", "snk", "str", "val", "jsn", "pg", "sql", "ret", "graph", "stm")}

# ---------------------------------------------------------------------------------------------------------------- SQL
_EXT = RQ._EXT
_MD = "'| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey)"
_HTML = "'<table><tr><th>key</th><th>name</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>'"
_READERS = " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in FI.READERS.items())
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents"
_LABEL = r"regexp_matches(trim(text), '^[+-]?\d{1,3}(,\d{3})*(\.\d+)?\s*(%|％|年|月|万|亿|k|K|M)?$|^[+-]?\d+(\.\d+)?\s*(%|％|年|月|万|亿|k|K|M)?$')"
_PEND = """e AS (SELECT '/u/' || user_id AS path, CASE event_type WHEN 'purchase' THEN 'remove' WHEN 'click' THEN 'modify' ELSE 'create' END AS kind, ts FROM events),
o AS (SELECT *, CASE kind WHEN 'create' THEN 0 WHEN 'modify' THEN 1 ELSE 2 END AS o FROM e),
g AS (SELECT path, max(CASE WHEN kind = 'remove' THEN (ts, o) END) AS g, max(CASE WHEN kind <> 'remove' THEN (ts, o) END) AS c FROM o GROUP BY path),
pend AS (SELECT path, g IS NOT NULL AS remove, c IS NOT NULL AND (g IS NULL OR c > g) AS update FROM g)"""
_PB = "coalesce(text, normalized_text)"


def _clean(preset: str) -> str:
    """The clean-up presets as SQL."""
    t = "text"
    for chars, plain in T._SWAPS:
        t = f"translate({t}, '{chars}', '{plain * len(chars)}')"
    t = f"translate({t}, '{T._ZERO_WIDTH}', '')"
    if preset != "minimal":
        low = "lower(trim(x))"
        noise = rf"regexp_matches({low}, '^(page|seite|p\.?)?\s*[-–—]?\s*\d+\s*[-–—]?(\s*(of|von|/)\s*\d+)?$') OR regexp_matches({low}, '^(confidential|internal copy|draft|all rights reserved|copyright)\b.{{0,60}}$') OR regexp_matches({low}, '\.{{4,}}\s*\d+$')"
        t = rf"array_to_string(list_filter(string_split(regexp_replace({t}, '\p{{Co}}', '', 'g'), chr(10)), lambda x: NOT ({noise})), chr(10))"
    if preset == "aggressive":
        t = rf"regexp_replace(array_to_string(list_filter(string_split({t}, chr(10)), lambda x: NOT regexp_full_match(trim(x), '[^\p{{L}}\p{{N}}]')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"
    t = rf"regexp_replace(regexp_replace(regexp_replace({t}, '[ \t]+\n', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


_END = r"""[.!?:;。！？：；…"”’)\]）】]$"""
_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '(page|p\.|seite|第)\s*\d+\s*(页)?(\s*(of|/|von)\s*\d+)?', '', 'g'), '^[-–—\s]*\d+[-–—\s]*(of\s*\d+)?', ''), '[-–—\s]*\d+[-–—\s]*$', ''))"
_SCORES = rf"""t AS (SELECT * FROM b WHERE text IS NOT NULL),
g AS (SELECT doc, page, sum(length(text)) AS chars, sum(length(text) - length(regexp_replace(text, '[\x{{FFFD}}\p{{Co}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'))) AS bad,
  least(1.0, (max(x + width) - min(x)) * (max(y + height) - min(y)) / (612.0 * 792.0)) AS coverage, list_sort(list(height / len(string_split(text, chr(10))))) AS heights FROM t GROUP BY doc, page),
c AS (SELECT doc, page, ch, count(*) AS c FROM (SELECT doc, page, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM t) GROUP BY ALL),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY doc, page) AS p FROM c), h AS (SELECT doc, page, 0.0 - sum(p * ln(p)) AS h, count(*) AS d FROM p GROUP BY doc, page),
m AS (SELECT g.doc, g.page, chars, CASE WHEN chars > 0 THEN (chars - bad) / chars ELSE 0.0 END AS printable, CASE WHEN chars > 0 THEN bad / chars ELSE 0.0 END AS garbled, coverage, heights[len(heights) // 2 + 1] AS font,
  CASE WHEN chars > 0 THEN coalesce(d, 0) / chars ELSE 0.0 END AS "unique", coalesce(h / greatest(ln(d), 1.0), 0.0) AS entropy FROM g LEFT JOIN h ON g.doc IS NOT DISTINCT FROM h.doc AND g.page IS NOT DISTINCT FROM h.page),
s AS (SELECT *, 0.2 * printable + 0.35 * (1 - 1 / (1 + exp(-40 * (garbled - 0.1)))) + 0.15 / (1 + exp(-0.05 * (chars - 50))) + 0.15 * least(1.0, coverage * 2) + 0.15 * entropy AS score,
  array_to_string(list_filter([CASE WHEN chars < 20 THEN 'few_characters' END, CASE WHEN garbled > 0.1 THEN 'garbled' END, CASE WHEN coverage < 0.05 THEN 'low_coverage' END, CASE WHEN entropy < 0.5 THEN 'low_entropy' END], lambda f: f IS NOT NULL), ',') AS flags FROM m)"""
_NUM = r"[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?"
SQL = {
    "src_dispatch": f"WITH x AS (SELECT DISTINCT file_path, {_EXT} AS ext FROM files_now) SELECT file_path, CASE {_READERS} END AS reader FROM x",
    "src_page_ranges": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size - 1, least(p_size + 2, 50)), list_filter([p_size + 4], lambda x: x < 50), [47, 48, 49]))), ',') AS pages FROM part",
    "src_select_pages": "SELECT block_id FROM page_blocks WHERE page_index IN (0, 1, 2, 4, 7, 8)",
    "src_documents": "SELECT '/in/doc-' || doc_id || '.md' AS file_path, md5(text) AS h FROM documents WHERE text IS NOT NULL",
    "src_page_documents": f"SELECT file_path AS doc, page_index AS page, CAST(block_id AS VARCHAR) AS block_id, round(CAST(x AS DOUBLE), 3) AS x, role, md5({_PB}) AS h FROM page_blocks WHERE file_path IS NOT NULL",
    "snk_append": "SELECT doc_type, count(*) AS n, count(DISTINCT id) AS ids FROM chunks GROUP BY doc_type",
    "snk_delete_file": "SELECT file_path, count(*) AS n FROM chunks WHERE file_path IS DISTINCT FROM (SELECT min(file_path) FROM chunks) GROUP BY file_path",
    "snk_delete_sources": "SELECT mention_id FROM entities WHERE source_file IS NULL OR source_file IN (SELECT file_path FROM files_now)",
    "snk_upsert_entities": """WITH o AS (SELECT entity_id, min(name) AS name, min(source_file) AS source_file FROM entities WHERE entity_id IS NOT NULL GROUP BY entity_id),
n AS (SELECT from_entity AS entity_id, 'linked' AS name, max(source_file) AS source_file FROM relations WHERE from_entity IS NOT NULL GROUP BY from_entity)
SELECT * FROM o WHERE entity_id NOT IN (SELECT entity_id FROM n) UNION ALL SELECT * FROM n""",
    "snk_upsert_relations": """SELECT from_entity, to_entity, relation_type, CAST(coalesce(round(CAST(max(confidence) FILTER (WHERE confidence >= 0.5) AS DOUBLE), 4), 0) AS DOUBLE) AS confidence
FROM relations WHERE from_entity IS NOT NULL AND to_entity IS NOT NULL GROUP BY ALL""",
    "snk_valid_cache": """SELECT file_path FROM files_now WHERE last_modified IS NOT NULL AND size_bytes IS NOT NULL AND file_path IS NOT NULL GROUP BY file_path HAVING max(last_modified) = min(last_modified) AND max(size_bytes) = min(size_bytes)""",
    "snk_table_names": """WITH p AS (SELECT DISTINCT file_path FROM chunks WHERE file_path IS NOT NULL),
h AS (SELECT file_path, list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(range(1, strlen(file_path) + 1), lambda i: CAST('0x' || substr(hex(encode(file_path)), 2 * i - 1, 2) AS UBIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM p)
SELECT file_path, 'f' || lpad(lower(to_hex(h % 16777216)), 6, '0') || '_sheet_1' AS name FROM h""",
    "snk_export": "SELECT doc_id, md5(text) AS h, source FROM documents",
    "snk_index_versions": "SELECT doc_type, count(*) AS n FROM chunks WHERE doc_type IN ('tabular', 'text') GROUP BY doc_type",
    "snk_unfinished_pages": "SELECT file_path AS doc, page_index AS page FROM page_blocks WHERE file_path IS NOT NULL AND page_index IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE page_source = 'BornDigital') = 0",
    "str_truncate_bytes": "SELECT doc_id, CASE WHEN strlen(text) <= 41 THEN text ELSE left(text, list_max(list_filter(range(0, 42), lambda k: strlen(left(text, k)) <= 41))) END AS t FROM documents",
    "str_tables": f"SELECT n_regionkey, {_MD} AS md, {_HTML} AS html, string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY n_regionkey",
    "str_fences": "SELECT p_partkey, p_name AS t FROM part",
    "str_uncommon": r"""WITH x AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\p{Han}]', '', 'g')) AS h, length(regexp_replace(text, '[^的一是在不了有和人这中大为上个国我以要他]', '', 'g')) AS u FROM documents)
SELECT doc_id, round((h - u) / h, 6) AS r FROM x WHERE n >= 10 AND h >= 5""",
    "str_key_values": rf"""WITH l AS ({_LINES}) SELECT doc_id, n, trim(regexp_extract(line, '^([^:：\n]{{1,30}})[:：]', 1)) AS key, trim(regexp_extract(line, '^[^:：\n]{{1,30}}[:：]\s*(.*)$', 1)) AS value
FROM l WHERE regexp_matches(line, '^[^:：\n]{{1,30}}[:：]\s*\S')""",
    "str_heading_levels": rf"""WITH l AS ({_LINES}), m AS (SELECT doc_id, n, regexp_extract(trim(line), '^(\d{{1,2}}(?:\.\d{{1,2}}){{0,4}})\.?\s+\p{{L}}', 1) AS m FROM l)
SELECT doc_id, n, len(string_split(m, '.')) AS level FROM m WHERE m <> ''""",
    "str_urls": "SELECT p_partkey, 'https://h.example/' || p_partkey || 'a/' || p_size || '|' || p_name AS spans FROM part",
    "val_numbers": "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.2f', o_totalprice), '0'), '.') END AS two, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole FROM orders",
    "val_headers": "SELECT p_partkey, p_brand || '_' || p_type AS name FROM part",
    "val_maps": "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN p_type ELSE 'none' END AS type, p_name AS title FROM part",
    "val_contains": f"""WITH {_B}, j AS (SELECT a.block_id AS o, c.block_id AS i, greatest(least(a.x + a.width, c.x + c.width) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.height, c.y + c.height) - greatest(a.y, c.y), 0) AS both_, c.width * c.height AS area
FROM b a JOIN b c ON a.doc = c.doc AND a.page = c.page AND a.block_id <> c.block_id) SELECT o AS outer, i AS inner FROM j WHERE area > 0 AND both_ / area > 0.8""",
    "val_breadcrumbs": "SELECT DISTINCT id, breadcrumbs || ' > leaf' AS trail, list_extract(string_split(breadcrumbs, ' > '), -1) AS last FROM chunks WHERE breadcrumbs IS NOT NULL",
    "jsn_graph_answers": "SELECT one, two, 'Technology' AS kind, coalesce(CASE lower(trim(t)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.RELATION_ALIASES.items()) + " END, nullif(lower(trim(t)), ''), 'related-to') AS relation FROM (SELECT DISTINCT from_entity AS one, to_entity AS two, relation_type AS t FROM relations WHERE from_entity IS NOT NULL AND to_entity IS NOT NULL AND relation_type IS NOT NULL)",
    "jsn_html_tables": "SELECT p_partkey, p_brand || '|' || p_brand || '/' || p_type || '|' || p_size AS cells FROM part",
    "pg_noise": rf"""WITH {_B}, k AS (SELECT block_id, CASE WHEN role = 'PageNumber' THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[\p{{P}}\p{{S}}\s]*')), chr(10)) END AS t FROM b)
SELECT block_id, md5(t) AS h FROM k WHERE t <> ''""",
    "pg_watermarks": f"""WITH {_B}, s AS (SELECT *, width * height / 90000.0 AS share FROM b WHERE coalesce(role, '') NOT IN ('Header', 'Footer', 'PageNumber') AND strlen(text) >= 2)
SELECT block_id FROM s WHERE (({" OR ".join(f"contains(lower(text), '{w}')" for w in P.WATERMARK_WORDS)}) AND share > 0.03) OR (share > 0.2 AND length(text) < 50 AND NOT ({" OR ".join(f"contains(lower(text), '{w}')" for w in P.CONTACT_WORDS)}))
OR (height > 0 AND width > 5 * height AND share > 0.15 AND length(text) < 30)""",
    "pg_chart_labels": f"""WITH {_B}, l AS (SELECT *, {_LABEL} AS l FROM b),
h AS (SELECT doc, page, count(*) AS n, (max(x + width) - min(x)) * (max(y + height) - min(y)) AS s FROM l WHERE l GROUP BY doc, page)
SELECT block_id FROM l LEFT JOIN h USING (doc, page) WHERE NOT coalesce(l AND n >= 4 AND s <= 0.7 * 612 * 792, false)""",
    "pg_lists": rf"""WITH {_B} SELECT block_id, CASE WHEN role = 'Body' AND (regexp_matches(ltrim(text), '^[-*+•●▪■◦‣]\s+\S') OR regexp_matches(ltrim(text), '^(\d{{1,3}}[.)、]|[(（]\d{{1,3}}[)）]|[a-zA-Z][.)]|[ivxIVX]{{1,5}}[.)])\s*\S')) THEN 'List' ELSE role END AS role FROM b""",
    "pg_ocr_confidence": "SELECT file_path AS doc, page_index AS page, round(avg(CAST(confidence AS DOUBLE)), 5) AS confidence, count(confidence) AS blocks FROM page_blocks WHERE page_source = 'Ocr' GROUP BY ALL",
    "pg_glyph_cells": f"""WITH {_B}, g AS (SELECT cell, (cell % 4) * 153.0 AS gx, (cell // 4) * 198.0 AS gy FROM (SELECT unnest(range(16)) AS cell)),
j AS (SELECT block_id, cell, x + width / 2 BETWEEN gx AND gx + 153 AND y + height / 2 BETWEEN gy AND gy + 198 AS centre, greatest(least(x + width, gx + 153) - greatest(x, gx), 0) * greatest(least(y + height, gy + 198) - greatest(y, gy), 0) AS share FROM b, g)
SELECT block_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY NOT centre, CASE WHEN centre THEN 0 ELSE -share END, cell) AS k FROM j WHERE centre OR share > 0) WHERE k = 1""",
    "pg_proportional": f"""WITH {_B}, h AS (SELECT doc, page, block_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc, page) AS n FROM b WHERE role IN ('Title', 'Heading', 'List') WINDOW w AS (PARTITION BY doc, page ORDER BY block_id)),
r AS (SELECT doc, page, block_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc, page) AS m FROM b WHERE role NOT IN ('Title', 'Heading', 'List') WINDOW w AS (PARTITION BY doc, page ORDER BY block_id))
SELECT h.block_id, r.block_id AS partner_id FROM h JOIN r ON h.doc = r.doc AND h.page = r.page AND r.i = h.i * m // n""",
    "pg_unobscured_tables": f"""WITH {_B}, t AS (SELECT * FROM b WHERE height >= 60),
c AS (SELECT t.block_id, sum(greatest(least(t.x + t.width, o.x + o.width) - greatest(t.x, o.x), 0) * greatest(least(t.y + t.height, o.y + o.height) - greatest(t.y, o.y), 0) / (t.width * t.height)) AS cover FROM t JOIN b o ON t.doc = o.doc AND t.page = o.page AND o.height < 60 GROUP BY t.block_id)
SELECT block_id AS table_id FROM t WHERE block_id NOT IN (SELECT block_id FROM c WHERE cover > 0.3)""",
    "pg_without_formulas": f"WITH {_B} SELECT block_id FROM b WHERE role <> 'Unknown' OR role IS NULL OR doc IS NULL OR page IS NULL",
    "pg_table_lines": """WITH r AS (SELECT 'r' || n_regionkey AS doc, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_nationkey AS k, n_name AS n FROM nation)
SELECT doc, 'TableRow' AS line_type, '[page=0 table=t1 row=' || i || '] key=' || k || ' | name=' || n AS text FROM r
UNION ALL SELECT doc, 'TableCell', '[page=0 table=t1 row=' || i || '] key: ' || k FROM r UNION ALL SELECT doc, 'TableCell', '[page=0 table=t1 row=' || i || '] name: ' || n FROM r""",
    "pg_column_types": """SELECT DISTINCT p_brand AS doc, c AS column, t AS type FROM part, (VALUES (0, 'Number'), (1, 'Text'), (2, 'Percent')) x(c, t)""",
    "sql_script": "SELECT n, customers FROM (SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n) WHERE n > 1",
    "sql_count": "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000",
    "sql_schema": "SELECT column_name AS name FROM (DESCRIBE part)",
    "sql_summaries": "SELECT name, CASE WHEN rows <= 100 THEN 'full' ELSE 'summary' END AS kind, rows FROM (SELECT 'region' AS name, count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part)",
    "sql_largest_tables": "SELECT 'region' AS name, count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part",
    "sql_typed": "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_retailprice AS DOUBLE) AS price, p_size > 25 AS big, TRY_CAST(p_name AS BIGINT) AS name FROM part",
    "ret_vector_only": f"WITH {RQ._C}, {RQ._Q}, {RQ._knn(1.5)} SELECT id, round(least(100, 6100 * 0.6 / (60 + rank_v)), 4) AS score, 'Vector' AS source FROM knn ORDER BY rank_v LIMIT 10",
    "ret_search_all": """WITH h AS (SELECT id, source, max(score) AS score FROM search_results WHERE score IS NOT NULL AND id IS NOT NULL AND source IN ('Keyword', 'Hybrid') GROUP BY ALL)
SELECT id, round(score, 6) AS score, CASE source WHEN 'Keyword' THEN 0 ELSE 1 END AS index FROM h ORDER BY h.score DESC, index, id LIMIT 25""",
    "graph_answers": "SELECT 'Technology' AS entity_type, count(*) AS told FROM chunks WHERE strlen(text) >= 200",
    "stm_pending": f"WITH {_PEND} SELECT * FROM pend",
    "stm_applied": f"WITH {_PEND} SELECT path, 'remove' AS what, 1 AS n FROM pend WHERE remove UNION ALL SELECT path, 'update', 1 FROM pend WHERE update",
    "stm_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stm_sliding": "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY s, event_type",
    "stm_deduplicated": "SELECT DISTINCT user_id, event_type FROM events",
    # texts for queries of the other modules
    "txt_clean_minimal": f"SELECT doc_id, md5({_clean('minimal')}) AS h FROM documents",
    "txt_clean_default": f"SELECT doc_id, {_clean('default')} AS t FROM documents",
    "txt_clean_aggressive": f"SELECT doc_id, {_clean('aggressive')} AS t FROM documents",
    "txt_preprocess_query": rf"""WITH a AS (SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(question, '([A-Za-z0-9])([{T.CJK}])', '\1 \2', 'g'), '([{T.CJK}])([A-Za-z0-9])', '\1 \2', 'g'), '\s+', ' ', 'g')) AS q FROM eval_items),
b AS (SELECT item_id, array_to_string(list_filter(string_split(q, ' '), lambda w, i: strlen(w) > 2 OR list_position(string_split(q, ' '), w) = i), ' ') AS q FROM a)
SELECT item_id, trim(regexp_replace(translate(q, '{T.QUERY_MARKS.replace("'", "''")}', '{" " * len(T.QUERY_MARKS)}'), '\s+', ' ', 'g')) AS q FROM b""",
    "txt_cell_type": rf"""WITH c AS (SELECT unnest(regexp_extract_all(text, '\| ([^|\n]+) ', 1)) AS v FROM documents UNION ALL SELECT {_PB} FROM page_blocks), t AS (SELECT trim(v) AS c FROM c)
SELECT CASE WHEN c IS NULL OR c = '' THEN 'Unknown' WHEN regexp_matches(c, '^{_NUM}\s*[%％‰]$') THEN 'Percent' WHEN regexp_matches(c, '^[-(]?\s*[$€£¥￥]\s*{_NUM}\)?$') OR regexp_matches(c, '^{_NUM}\s*([$€£¥￥元]|万元|亿元|USD|EUR|CNY|RMB)$') THEN 'Currency'
WHEN regexp_matches(c, '^\d{{4}}[-/.年]\d{{1,2}}([-/.月]\d{{1,2}}日?)?$') OR regexp_matches(c, '^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}$') THEN 'Date' WHEN regexp_matches(c, '^{_NUM}([eE][+-]?\d+)?$') OR regexp_matches(c, '^\({_NUM}\)$') THEN 'Number' ELSE 'Text' END AS kind, count(*) AS n FROM t GROUP BY 1""",
    "txt_predicates": rf"""WITH t AS (SELECT block_id, {_PB} AS t FROM page_blocks)
SELECT block_id, NOT regexp_matches(rtrim(t), '[.!?:;。！？：；…"”’)\]）】]$') AS open,
CASE WHEN regexp_matches(ltrim(t), '^[-*+•●▪■◦‣]\s+\S') THEN 'unordered' WHEN regexp_matches(ltrim(t), '^(\d{{1,3}}[.)、]|[(（]\d{{1,3}}[)）]|[a-zA-Z][.)]|[ivxIVX]{{1,5}}[.)])\s*\S') THEN 'ordered' END AS list,
regexp_matches(ltrim(t), '^([¹²³⁰-⁹]+|\[\d{{1,3}}\]|\d{{1,2}}\s+\S|[*†‡§]\s*\S|注\d*[:：])') AS note, regexp_matches(trim(t), '^(https?://|ftp://|www\.)\S') AS url,
CASE WHEN regexp_extract(trim(t), '^(\d{{1,2}}(?:\.\d{{1,2}}){{0,4}})\.?\s+\p{{L}}', 1) <> '' THEN len(string_split(regexp_extract(trim(t), '^(\d{{1,2}}(?:\.\d{{1,2}}){{0,4}})\.?\s+\p{{L}}', 1), '.')) END AS level,
trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '(page|p\.|seite|第)\s*\d+\s*(页)?(\s*(of|/|von)\s*\d+)?', '', 'g'), '^[-–—\s]*\d+[-–—\s]*(of\s*\d+)?', ''), '[-–—\s]*\d+[-–—\s]*$', '')) AS bare FROM t""",
    "graph_relation_lines": f"""WITH {RQ._DEG}, n AS (SELECT entity_id, arg_min(name, mention_id) FILTER (WHERE name IS NOT NULL) AS name FROM entities WHERE entity_id IS NOT NULL GROUP BY entity_id),
h AS (SELECT DISTINCT from_entity, to_entity, relation_type FROM relations WHERE from_entity = {RQ._HUB} OR to_entity = {RQ._HUB}),
l AS (SELECT DISTINCT {RQ._HUB} AS entity_id, a.name || ' -[' || relation_type || ']-> ' || b.name AS line FROM h JOIN n a ON a.entity_id = from_entity JOIN n b ON b.entity_id = to_entity)
SELECT entity_id, line FROM l ORDER BY line LIMIT 5""",
    "pg_footnotes": rf"""WITH {_B}, f AS (SELECT *, height / len(string_split(text, chr(10))) AS font FROM b), m AS (SELECT *, avg(font) FILTER (WHERE role = 'Body') OVER (PARTITION BY doc, page) AS body FROM f)
SELECT block_id FROM m WHERE role = 'Footnote' OR (y >= 0.85 * 792 AND (regexp_matches(ltrim(text), '^([¹²³⁰-⁹]+|\[\d{{1,3}}\]|\d{{1,2}}\s+\S|[*†‡§]\s*\S|注\d*[:：])') OR coalesce(font < 0.85 * body, false)))""",
    "pg_markdown": rf"""WITH {_B}, l AS (SELECT doc, page, y, x, block_id, CASE role WHEN 'Title' THEN '# ' || text WHEN 'Heading' THEN '## ' || text WHEN 'List' THEN '- ' || regexp_replace(text, '^\s*[-*•●]\s*', '') WHEN 'Caption' THEN '*' || text || '*' ELSE text END AS l
FROM b WHERE text IS NOT NULL AND role NOT IN ('Header', 'Footer', 'PageNumber')) SELECT doc, page, length(string_agg(l, chr(10) || chr(10) ORDER BY y, x, block_id)) AS n FROM l GROUP BY doc, page""",
    "pg_orphans": rf"""WITH {_B}, w AS (SELECT *, lag(text) OVER o AS pt, lag(role) OVER o AS pr, lag(y + height) OVER o AS pb, row_number() OVER o AS n FROM b WINDOW o AS (PARTITION BY doc, page ORDER BY y, x, block_id)),
f AS (SELECT *, CASE WHEN coalesce(NOT regexp_matches(rtrim(pt), '{_END}') AND length(text) <= 15 AND y - pb BETWEEN -5 AND 30 AND role = 'Body' AND pr = 'Body', false) THEN 0 ELSE 1 END AS new FROM w),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY n) AS g FROM f)
SELECT arg_min(block_id, n) AS block_id, coalesce(length(string_agg(text, '' ORDER BY n)), 0) AS n FROM g GROUP BY doc, page, g""",
    "pg_scores": f"""WITH {_B}, {_SCORES} SELECT doc, page, chars, {", ".join(f'round({c}, 5) AS {c}' for c in ("printable", "garbled", "coverage", "font", '"unique"', "entropy", "score"))}, flags FROM s""",
    "pg_strategy": f"""WITH {_B}, {_SCORES} SELECT CASE WHEN score >= 0.6 THEN 'FastTrack' ELSE 'FastTrackPlusModels' END AS strategy, count(*) AS pages, count(*) FILTER (WHERE score < 0.3) AS ocr FROM s GROUP BY 1""",
    "pg_headers_footers": rf"""WITH {_B}, e AS (SELECT doc, page, block_id, CASE WHEN y + height <= 0.08 * 792 THEN 'Header' ELSE 'Footer' END AS side, {_BARE.format('text')} AS bare FROM b WHERE y + height <= 0.08 * 792 OR y >= 0.92 * 792),
n AS (SELECT doc, side, bare, count(DISTINCT page) AS pages, min(page) AS p0, max(page) AS p1, CASE WHEN length(bare) < 2 THEN [] ELSE list_transform(range(1, length(bare)), lambda i: substring(bare, i, 2)) END AS g FROM e WHERE bare IS NOT NULL GROUP BY doc, side, bare),
h AS (SELECT a.doc, a.side, a.bare, a.pages, a.p0, a.p1, c.bare AS pattern FROM n a JOIN n c ON a.doc = c.doc AND a.side = c.side AND (a.bare = c.bare
  OR (len(a.g) > 0 AND len(c.g) > 0 AND 2.0 * len(list_filter(c.g, lambda v: list_contains(a.g, v))) / (len(a.g) + len(c.g)) >= 0.8))),
k AS (SELECT doc, side, pattern FROM h GROUP BY ALL HAVING max(pages) > 1 OR min(p0) < max(p1)),
m AS (SELECT DISTINCT block_id, side FROM e JOIN (SELECT DISTINCT doc, side, bare FROM h JOIN k USING (doc, side, pattern)) r USING (doc, side, bare)),
t AS (SELECT b.block_id, b.role, m.side, count(*) FILTER (WHERE m.side IS NULL) OVER (PARTITION BY b.doc, b.page) AS rest FROM b LEFT JOIN m ON b.block_id = m.block_id)
SELECT block_id, CASE WHEN side IS NOT NULL AND rest > 0 THEN side ELSE role END AS role FROM t""",
}
