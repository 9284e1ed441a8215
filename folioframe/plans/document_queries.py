"""Queries of trees, sheets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioframe.functions import values as V
from folioframe.operators import page_tables as PT, pages as P, sheets as SH, trees as TR
from folioframe.plans import sqltools
from folioframe.plans.pages import process_pages
from folioframe.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Every document under a path of its own, as many share one in the table."""
    return table(spark, d, "documents").select(F.concat(F.lit("/docs/"), F.col("doc_id")).alias("file_path"), "text")


def tree_nodes(spark, d):
    return TR.markdown_tree(_docs(spark, d)).select("id", "parent_id", "level", "title", "tokens")


def tree_headings(spark, d):
    return TR.markdown_tree(_docs(spark, d)).where("ordinal > 0").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("deepest"))


def tree_flatten(spark, d):
    chunks = TR.chunks_of_trees(TR.markdown_tree(_docs(spark, d)))
    return chunks.select("id", "parent_id", "breadcrumbs", F.length("text").alias("n"))


def tree_thin(spark, d):
    return TR.markdown_tree(_docs(spark, d), threshold=50).groupBy("file_path").agg(F.count(F.lit(1)).alias("nodes"), F.sum("tokens").alias("tokens"))


def tree_outline(spark, d):
    return TR.outlines(TR.markdown_tree(_docs(spark, d)))


def tree_pages(spark, d):
    """Trees from pages: the blocks of a page are its content, headings marked by their role."""
    b = table(spark, d, "page_blocks").withColumn("text", F.coalesce("text", "normalized_text")).where("text is not null and coalesce(role, '') not in ('Header', 'Footer', 'PageNumber')")
    line = F.when(F.col("role").isin("Title", "Heading"), F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    pages = b.groupBy("file_path", F.col("page_index").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "block_id", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("content"))
    return TR.page_tree(pages).select("id", "parent_id", "level", "title", "page", "tokens")


def _strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def tab_infer_types(spark, d):
    return SH.infer_types(_strings(table(spark, d, "orders")).select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"))


def tab_column_stats(spark, d):
    return sqltools.column_stats(_strings(table(spark, d, "part"))).select("column", "nulls", "numeric", "min", "max", F.round("avg", 4).alias("avg"), "distinct")


def tab_keyword_index(spark, d):
    return SH.keyword_index(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


def tab_forward_fill(spark, d):
    e = table(spark, d, "events").withColumn("last_type", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")))
    return SH.forward_fill(e, ["last_type"], ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "last_type")


def _cells(spark, d):
    """The cells of the pipe tables of all documents, a sheet per document."""
    piped = F.filter(F.split("text", "\n"), lambda x: x.startswith("|") & ~x.startswith("|--"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(piped).alias("row", "line"))
    cells = lines.select("doc_id", "row", F.posexplode(F.split(F.regexp_replace("line", r"^\|\s*|\s*\|\s*$", ""), r"\s*\|\s*")).alias("col", "raw"))
    return cells.select(F.col("doc_id").cast("string").alias("file"), F.lit("text").alias("sheet"), "row", "col", F.lit("str").alias("kind"), "raw")


def tab_blocks(spark, d):
    b = SH.data_blocks(_cells(spark, d))
    return b.select("source_id", F.array_join("names", "|").alias("names"), F.array_join("types", "|").alias("types"), "row_count")


def tab_profiles(spark, d):
    return SH.profiles(SH.data_blocks(_cells(spark, d)))


def tab_row_features(spark, d):
    return SH.row_features(_cells(spark, d)).select("file", "row", "filled", "numeric", "texts")


def tab_auto_sql_distinct(spark, d):
    """The rule-made query of a listing question, run over the part table."""
    part = table(spark, d, "part")
    sql = sqltools.listing_sql("list all p_brand p_type", {"part": part.columns})
    return spark.sql(sql.replace("`part`", "{part}"), part=part)


def tab_union_all(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    sql = sqltools.listing_sql("list all nation", {"customers": c.columns, "suppliers": s.columns})
    return spark.sql(sql.replace("`customers`", "{customers}").replace("`suppliers`", "{suppliers}"), customers=c, suppliers=s)


def tab_page(spark, d):
    return sqltools.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], number=3, size=25)


# pages
def _blocks(spark, d):
    """Each page as it was read last."""
    b = table(spark, d, "page_blocks")
    last = b.groupBy("file_path", "page_index").agg(F.max("read_at").alias("read_at"))
    rows = b.join(last, ["file_path", "page_index", "read_at"], "left_semi")
    return rows.select(F.col("file_path").alias("doc"), F.col("page_index").alias("page"), "block_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], "role", F.coalesce("text", "normalized_text").alias("text"))


def pg_scores(spark, d):
    s = P.page_scores(_blocks(spark, d))
    return s.select("doc", "page", "chars", *[F.round(c, 5).alias(c) for c in ("printable", "garbled", "coverage", "font", "unique", "entropy", "score")], F.array_join("flags", ",").alias("flags"))


def pg_strategy(spark, d):
    s = P.page_scores(_blocks(spark, d))
    return s.groupBy(P.parse_strategy(F.col("score"), F.lit(False), model=True).alias("strategy")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(P.needs_ocr(F.col("score"), F.col("chars"), F.lit(0))).alias("ocr"))


def pg_headers_footers(spark, d):
    return P.mark_headers_footers(_blocks(spark, d), any_page=True).select("block_id", "role")


def pg_reading_order(spark, d):
    return P.reading_order(_blocks(spark, d)).select("block_id", "position")


def pg_postprocess(spark, d):
    return P.postprocess(_blocks(spark, d)).select("block_id", "role", F.length("text").alias("n"))


def pg_orphans(spark, d):
    return P.merge_orphans(_blocks(spark, d)).select("block_id", F.length("text").alias("n"))


def pg_footnotes(spark, d):
    return P.mark_footnotes(_blocks(spark, d).withColumn("font", F.col("height") / F.size(F.split("text", "\n")))).where("role = 'Footnote'").select("block_id")


def pg_label_blocks(spark, d):
    """Blocks of the last reading labelled by the blocks of any other reading of the page they overlap best."""
    b, raw = _blocks(spark, d), table(spark, d, "page_blocks")
    regions = raw.join(b.select("block_id"), "block_id", "left_anti").select(F.col("file_path").alias("doc"), F.col("page_index").alias("page"), F.col("role").alias("label"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    return P.label_blocks(b, regions).where("label is not null").select("block_id", "label")


def pg_outside_tables(spark, d):
    """Blocks that lie in no tall body block, the tall ones taken as tables."""
    b = _blocks(spark, d)
    tables = b.where("height >= 100").select("doc", "page", F.col("block_id").alias("table_id"), "x", "y", "width", "height", F.lit("ruled").alias("kind"), F.lit(3).alias("rows"))
    return P.outside_tables(b, tables).select("block_id")


def pg_nearest_rows(spark, d):
    b = _blocks(spark, d)
    noise = b.where("height <= 12").select("doc", "page", F.col("block_id").alias("noise_id"), "y")
    return P.nearest_rows(noise, b.where("height > 12").select("doc", "page", F.col("block_id").alias("row_id"), "y")).select("noise_id", "row_id", F.round("gap", 3).alias("gap"))


def pg_rag_lines(spark, d):
    return P.rag_lines(_blocks(spark, d)).select("doc", "page", "line_type", "text")


def pg_markdown(spark, d):
    return P.markdown_pages(_blocks(spark, d)).select("doc", "page", F.length("markdown").alias("n"))


def _glyphs(spark, d):
    """The blocks' text laid out glyph by glyph: each line over the width of its block, blanks left free."""
    b = _blocks(spark, d).where("text is not null and doc is not null and page is not null")
    lines = b.select("doc", "page", "x", "y", "width", (F.col("height") / F.size(F.split("text", "\n"))).alias("h"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    glyphs = lines.withColumn("step", F.col("width") / F.greatest(F.length("line"), F.lit(1))).select("*", F.posexplode(F.split("line", "")).alias("j", "ch")).where("trim(ch) != ''")
    return glyphs.select("doc", "page", "ch", (F.col("x") + F.col("j") * F.col("step")).alias("x"), (F.col("y") + F.col("i") * F.col("h")).alias("y"), F.col("step").alias("width"), (F.col("h") * 0.8).alias("height"), (F.col("h") * 0.8).alias("font_size"), F.lit(False).alias("bold"))


def pg_pipeline(spark, d):
    """All pages from their glyphs to text, in one call."""
    return process_pages(_glyphs(spark, d)).pages.select("doc", "page", "source", "strategy", F.round("score", 4).alias("score"), F.length("markdown").alias("chars"))


def pg_pipeline_letters(spark, d):
    """Nothing but noise is lost on the way: letters that the blocks before the clean-up hold, by document."""
    found = P.blocks_from_chars(_glyphs(spark, d))
    return found.groupBy("doc").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("letters"))


def pg_stream_tables(spark, d):
    """Borderless tables from the text pieces of table lines in documents, laid out on a grid."""
    cells = _cells(spark, d)
    pieces = cells.select(F.col("file").alias("doc"), F.lit(0).alias("page"), (F.col("col") * 100.0).alias("x"), (F.col("row") * 12.0).alias("y"), (F.length("raw") * 5.0).alias("width"), F.lit(10.0).alias("height"), F.col("raw").alias("text"))
    return PT.stream_tables(pieces).select("doc", "table_id", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("rows"), F.round("confidence", 4).alias("confidence"))


def pg_markdown_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", PT.markdown_rows(F.col("text")).alias("rows")).where(F.size("rows") > 0).select("doc_id", F.size("rows").alias("rows"), F.array_join(F.get("rows", 0), "|").alias("head"))


def geo_iou(spark, d):
    """Boxes of the same page that overlap."""
    b = _blocks(spark, d).select("doc", "page", "block_id", P.box().alias("b"))
    a, c = b.alias("a"), b.alias("c")
    j = a.join(c, (F.col("a.doc") == F.col("c.doc")) & (F.col("a.page") == F.col("c.page")) & (F.col("a.block_id") < F.col("c.block_id")))
    return j.select(F.col("a.block_id").alias("one"), F.col("c.block_id").alias("other"), F.round(V.iou(F.col("a.b"), F.col("c.b")), 6).alias("iou")).where("iou > 0")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k.split("_")[0] in ("tree", "tab", "pg", "geo")}

_B = """b AS (SELECT file_path AS doc, page_index AS page, block_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, role, coalesce(text, normalized_text) AS text, read_at
FROM page_blocks p WHERE read_at = (SELECT max(q.read_at) FROM page_blocks q WHERE q.file_path = p.file_path AND q.page_index = p.page_index))"""
_INTER = "greatest(least({0}.x + {0}.width, {1}.x + {1}.width) - greatest({0}.x, {1}.x), 0) * greatest(least({0}.y + {0}.height, {1}.y + {1}.height) - greatest({0}.y, {1}.y), 0)"
_IOU = "({i}) / ({0}.width * {0}.height + {1}.width * {1}.height - ({i}))"


def _iou(a: str, c: str) -> str:
    return _IOU.format(a, c, i=_INTER.format(a, c))


SQL = {
    "pg_pipeline_letters": rf"WITH {_B} SELECT doc, CAST(sum(length(regexp_replace(text, '\s', '', 'g'))) AS BIGINT) AS letters FROM b WHERE text IS NOT NULL AND doc IS NOT NULL AND page IS NOT NULL GROUP BY doc HAVING letters > 0",
    "tree_headings": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, length(regexp_extract(line, '^ {0,3}(#{1,6})', 1)) AS level FROM l WHERE regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)'))
SELECT '/docs/' || doc_id AS file_path, count(*) AS n, max(level) AS deepest FROM h GROUP BY doc_id""",
    "tab_infer_types": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count(v) = 0 THEN 'Empty' WHEN count(*) FILTER (WHERE k = 'String') > 0 OR (count(*) FILTER (WHERE k = 'DateTime') > 0 AND count(DISTINCT k) > 1) THEN 'String'
WHEN max(k) = 'DateTime' THEN 'DateTime' WHEN count(*) FILTER (WHERE k = 'Float') > 0 THEN 'Float' WHEN count(*) FILTER (WHERE k = 'Int') > 0 THEN 'Int' ELSE 'Bool' END AS "type"
FROM (SELECT v, CASE WHEN lower(v) IN ('true', 'false') THEN 'Bool' WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'Int' WHEN regexp_full_match(replace(v, ',', ''), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'Float'
WHEN regexp_matches(v, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}') THEN 'DateTime' WHEN v IS NOT NULL THEN 'String' END AS k FROM (SELECT nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM orders))"""
        for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    ),
    "tab_column_stats": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, {str(n).lower()} AS numeric, {f'CAST(min({c}) AS DOUBLE)' if n else 'NULL'} AS min, {f'CAST(max({c}) AS DOUBLE)' if n else 'NULL'} AS max, {f'round(avg({c}), 4)' if n else 'NULL'} AS avg, {'NULL' if n else f'count(DISTINCT {c})'} AS \"distinct\" FROM part"
        for c, n in (("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True))
    ),
    "tab_keyword_index": "SELECT p_brand AS value FROM part UNION SELECT p_type FROM part",
    "tab_forward_fill": """SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS last_type FROM events""",
    "tab_auto_sql_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "tab_union_all": "SELECT DISTINCT c_nationkey AS nation FROM customer UNION ALL SELECT DISTINCT s_nationkey FROM supplier",
    "tab_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
    "pg_label_blocks": f"""WITH {_B}, r AS (SELECT file_path AS doc, page_index AS page, role, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height FROM page_blocks WHERE block_id NOT IN (SELECT block_id FROM b)),
j AS (SELECT block_id, r.role AS label, {_iou('b', 'r')} AS iou FROM b JOIN r ON b.doc = r.doc AND b.page = r.page)
SELECT block_id, label FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY iou DESC, label DESC) AS n FROM j WHERE iou > 0.3) WHERE n = 1 AND label IS NOT NULL""",
    "pg_outside_tables": f"""WITH {_B} SELECT block_id FROM b WHERE NOT EXISTS (SELECT 1 FROM b t WHERE t.height >= 100 AND t.doc = b.doc AND t.page = b.page
AND b.x + b.width / 2 BETWEEN t.x AND t.x + t.width AND b.y + b.height / 2 BETWEEN t.y AND t.y + t.height)""",
    "pg_nearest_rows": f"""WITH {_B}, j AS (SELECT n.block_id AS noise_id, r.block_id AS row_id, abs(n.y - r.y) AS gap FROM b n JOIN b r ON n.doc = r.doc AND n.page = r.page AND n.height <= 12 AND r.height > 12)
SELECT noise_id, row_id, round(gap, 3) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY noise_id ORDER BY gap, row_id) AS k FROM j) WHERE k = 1""",
    "pg_rag_lines": f"""WITH {_B} SELECT doc, page, 'Block' AS line_type, '[page=' || (page + 1) || '] ' || regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') AS text FROM b WHERE text IS NOT NULL AND role NOT IN ('Header', 'Footer', 'PageNumber')""",
    "pg_markdown_rows": r"""WITH r AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '|') AND NOT regexp_full_match(x, '\s*\|[\s:|-]+\|?\s*')) AS rows FROM documents)
SELECT doc_id, len(rows) AS rows, array_to_string(list_transform(string_split(regexp_replace(trim(rows[1]), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)), '|') AS head FROM r WHERE len(rows) > 0""",
    "tab_row_features": r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|') AND NOT starts_with(x, '|--')) AS ls FROM documents),
r AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS row FROM l),
c AS (SELECT doc_id, row, nullif(trim(unnest(regexp_split_to_array(regexp_replace(line, '^\|\s*|\s*\|\s*$', '', 'g'), '\s*\|\s*'))), '') AS v FROM r)
SELECT CAST(doc_id AS VARCHAR) AS file, row, count(v) AS filled, count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+(\.[0-9]*)?')) AS numeric, count(v) FILTER (WHERE NOT regexp_full_match(v, '[+-]?[0-9]+(\.[0-9]*)?')) AS texts FROM c GROUP BY doc_id, row""",
    "geo_iou": f"WITH {_B} SELECT a.block_id AS one, c.block_id AS other, round({_iou('a', 'c')}, 6) AS iou FROM b a JOIN b c ON a.doc = c.doc AND a.page = c.page AND a.block_id < c.block_id WHERE round({_iou('a', 'c')}, 6) > 0",
}
