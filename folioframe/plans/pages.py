"""Pages from their glyphs to clean blocks, tables and text in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from folioframe.operators import page_tables as PT, pages as P
from folioframe.stash import Stash

CHARS = "doc string, page int, ch string, x double, y double, width double, height double, font_size double, bold boolean"
LINES = "doc string, page int, x1 double, y1 double, x2 double, y2 double"
_BOX = ("x", "y", "width", "height")


@dataclass
class Pages:
    """``blocks`` in reading order, ``tables``, ``pages`` (score, strategy, source, markdown) and ``lines`` of text for retrieval."""

    blocks: DataFrame
    tables: DataFrame
    pages: DataFrame
    lines: DataFrame


def process_pages(
    chars: DataFrame, rules: DataFrame | None = None, *, ocr: DataFrame | None = None, vlm: DataFrame | None = None, regions: DataFrame | None = None, paths: DataFrame | None = None,
    page_width: float = 612.0, page_height: float = 792.0, force_ocr: bool = False,
) -> Pages:
    """Every page of every document from its glyphs (``CHARS``) and drawn lines (``LINES``).

    Glyphs become lines, columns and blocks; pages are scored; ``ocr`` blocks are put to pages that need it, ``vlm`` blocks
    to pages whose text reads badly; running headers and footers are marked; tables are found, ruled ones before borderless ones and
    kept once where they overlap, and blocks within them left out; layout ``regions`` name the roles of blocks; what remains goes
    through the clean-up chain and gets its reading order. All inputs but ``chars`` may be missing; a page without glyphs has rows only if
    OCR or a model read it. Nothing is gathered but the rows of one page.
    """
    spark = chars.sparkSession
    stash = Stash(spark)
    glyphs = chars.where("doc is not null and page is not null")
    found = P.blocks_from_chars(glyphs, page_width).withColumnRenamed("block", "block_id").withColumn("block_id", F.col("block_id").cast("bigint"))
    own = stash.put(found.select("doc", "page", "block_id", *_BOX, "role", "font", "text"))
    scores = stash.put(P.page_scores(own, page_width, page_height))
    blocks, source = own, own.select("doc", "page").distinct().withColumn("source", F.lit("BornDigital"))
    if ocr is not None:
        needed = scores.where(P.needs_ocr(F.col("score"), F.col("chars"), F.lit(0), "force_all" if force_ocr else "auto")).select("doc", "page")
        unread = ocr.select("doc", "page").distinct().join(scores.select("doc", "page"), ["doc", "page"], "left_anti")
        read = ocr.join(needed.unionByName(unread), ["doc", "page"], "left_semi").withColumn("block_id", F.col("block_id") + 1_000_000)
        merged = stash.put(P.merge_ocr(blocks, read, force_ocr))
        blocks, source = merged.select(*own.columns), merged.select("doc", "page", "source").distinct()
    if vlm is not None:
        order = F.row_number().over(P.Window.partitionBy("doc", "page").orderBy("y", "x", "block_id")) - 1
        cols = [*own.columns, "ordinal"]
        blocks = P.fuse_vlm(blocks.withColumn("ordinal", order).select(*cols), vlm.withColumn("ordinal", order).select(*cols), scores).drop("ordinal")
    if regions is not None:
        blocks = P.label_blocks(blocks, P.suppress_overlaps(regions)).withColumn("role", F.coalesce("label", "role")).drop("label")
    blocks = stash.put(P.mark_headers_footers(blocks, page_height).select(*own.columns))
    pieces = glyph_pieces(glyphs, page_width)
    tables = PT.page_tables(rules, glyphs, pieces) if rules is not None else PT.stream_tables(pieces)
    tables = stash.put(PT.dedup_tables(tables))
    outside = P.outside_tables(blocks, tables.select("doc", "page", *_BOX, "kind", F.size("rows").alias("rows")))
    clean = stash.put(P.postprocess(outside, page_width, page_height))
    ordered = stash.put(clean.join(P.reading_order(clean), ["doc", "page", "block_id"]))
    text = P.markdown_pages(ordered.withColumn("y", F.col("position").cast("double")))
    graphics = F.lit(False)
    pages = source.join(scores, ["doc", "page"], "left")
    if paths is not None:
        figures = PT.figure_regions(paths, page_width, page_height).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("figures"))
        pages = pages.join(figures, ["doc", "page"], "left")
        graphics = F.coalesce(F.col("figures") > 0, F.lit(False))
    pages = pages.withColumn("strategy", P.parse_strategy(F.coalesce("score", F.lit(0.0)), graphics, regions is not None, vlm is not None)).join(text, ["doc", "page"], "left")
    return Pages(ordered, tables, pages.select("doc", "page", "source", "score", "strategy", "markdown"), P.rag_lines(ordered, tables))


def glyph_pieces(chars: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Pieces of text lines between wide gaps: doc, page, box, text. Glyphs are grouped by page."""
    import pandas as pd

    schema = "doc string, page int, x double, y double, width double, height double, text string"

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for line in P.cluster_lines(part[["ch", "x", "y", "width", "height"]].to_dict("records")):
            for g in P.split_at_gaps(line, page_width):
                text = P.line_text(g)
                if text:
                    x, y = min(c["x"] for c in g), min(c["y"] for c in g)
                    out.append((key[0], int(key[1]), x, y, max(c["x"] + c["width"] for c in g) - x, max(c["y"] + c["height"] for c in g) - y, text))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return chars.where("ch is not null").groupBy("doc", "page").applyInPandas(run, schema)
