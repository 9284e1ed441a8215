"""Page operators: glyphs to blocks, reading order, filters and marks of blocks, page scores, fusion, rendering.

Blocks are rows (doc, page, block_id, x, y, width, height, role, text), y growing downwards. What depends on the order of
rows within a page runs per page in pandas, which the page bounds; everything else is Columns, joins and windows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioframe.functions import text as T, values as V

# Thresholds of layout in points or shares.
LINE_GAP, PARAGRAPH_FONT, PARAGRAPH_MEDIAN, INDENT, WIDE_GAP = 3.0, 1.8, 1.5, 1.5, 0.06
NARROW_COLUMN, UNEVEN_COLUMNS, TITLE_SIZE, TITLE_WIDTH = 0.15, 3.0, 14.0, 0.8
WATERMARK_WORDS = ("confidential", "draft", "sample", "watermark", "do not copy", "internal use only", "不得复制", "机密", "草稿", "样本", "仅供内部使用", "版权所有")
CONTACT_WORDS = ("http", "www", "微博", "微信", "邮箱", "电话", "热线", "@", "qr", "二维码", ".com", ".cn", ".org")
BLOCK = "doc string, page int, block int, x double, y double, width double, height double, role string, font double, text string"


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")])


# -- glyphs to blocks -------------------------------------------------------------------------------------------------
def cluster_lines(glyphs: list[dict], gap: float = LINE_GAP) -> list[list[dict]]:
    """A glyph joins the first line whose running mean of centres is nearer than ``gap``."""
    lines: list[list] = []
    for g in sorted(glyphs, key=lambda g: (g["y"], g["x"])):
        c = g["y"] + g["height"] / 2
        for line in lines:
            if abs(line[0] - c) < gap:
                line[1].append(g)
                line[0] += (c - line[0]) / len(line[1])
                break
        else:
            lines.append([c, [g]])
    return [sorted(gs, key=lambda g: g["x"]) for _, gs in sorted(lines, key=lambda x: x[0])]


def split_at_gaps(line: list[dict], page_width: float) -> list[list[dict]]:
    """A line is cut where the gap is wider than ``WIDE_GAP`` of the page and three glyph heights."""
    parts = [[line[0]]]
    for a, b in zip(line, line[1:]):
        if b["x"] - a["x"] - a["width"] > max(WIDE_GAP * page_width, 3 * a["height"]):
            parts.append([])
        parts[-1].append(b)
    return parts


def line_text(line: list[dict]) -> str:
    out = line[0]["ch"]
    for a, b in zip(line, line[1:]):
        space = b["x"] - a["x"] - a["width"] > 0.25 * a["height"] and not a["ch"].isspace() and not b["ch"].isspace()
        out += (" " if space else "") + b["ch"]
    return out.strip()


def columns_of(spans: list[tuple[float, float]], page_width: float) -> list[tuple[float, float]]:
    """Columns from the x-intervals of lines: merged unless ``WIDE_GAP`` apart, narrow ones dropped, uneven ones given up."""
    merged: list[list[float]] = []
    for a, b in sorted(spans):
        if merged and a - merged[-1][1] <= WIDE_GAP * page_width:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    wide = [(a, b) for a, b in merged if b - a >= NARROW_COLUMN * page_width]
    if len(wide) < 2 or max(b - a for a, b in wide) > UNEVEN_COLUMNS * min(b - a for a, b in wide):
        return [(0.0, page_width)]
    return wide


def paragraphs(lines: list[dict]) -> list[list[dict]]:
    """Lines of a column to paragraphs: a new one after a gap of 1.8 font sizes or 1.5 upper-median gaps, at a list item, and
    at an indent of 1.5 font sizes."""
    gaps = sorted(b["y"] - a["y"] - a["height"] for a, b in zip(lines, lines[1:]))
    middle = gaps[len(gaps) // 2] if gaps else 0.0
    out = [[lines[0]]] if lines else []
    for a, b in zip(lines, lines[1:]):
        gap = b["y"] - a["y"] - a["height"]
        item = re.match(r"\s*([-*•●]\s|\d{1,3}[.)、]\s)", b["text"])
        if gap > PARAGRAPH_FONT * a["font"] or (middle > 0 and gap > PARAGRAPH_MEDIAN * middle) or item or b["x"] - a["x"] > INDENT * a["font"]:
            out.append([])
        out[-1].append(b)
    return out


def block_role(text: str, font: float, bold: bool, width: float, page_width: float) -> str:
    if re.match(r"\s*([-*•●]\s|\d{1,3}[.)、]\s|[(（]\d+[)）])", text):
        return "List"
    return "Title" if (font > TITLE_SIZE or bold) and width < TITLE_WIDTH * page_width else "Body"


def blocks_from_chars(chars: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Blocks of every page from its glyphs (doc, page, ch, x, y, width, height, font_size, bold)."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        glyphs = part[["ch", "x", "y", "width", "height", "font_size", "bold"]].to_dict("records")
        lines = []
        for raw in cluster_lines(glyphs):
            for piece in split_at_gaps(raw, page_width):
                text = line_text(piece)
                if text:
                    x, y = min(g["x"] for g in piece), min(g["y"] for g in piece)
                    right, low = max(g["x"] + g["width"] for g in piece), max(g["y"] + g["height"] for g in piece)
                    lines.append({"x": x, "y": y, "width": right - x, "height": low - y, "text": text, "font": float(np.median([g["font_size"] for g in piece])), "bold": sum(bool(g["bold"]) for g in piece) * 2 > len(piece)})
        cols = columns_of([(n["x"], n["x"] + n["width"]) for n in lines], page_width)
        place = lambda n: min(range(len(cols)), key=lambda i: abs((cols[i][0] + cols[i][1]) / 2 - n["x"] - n["width"] / 2))
        out = []
        for c in range(len(cols)):
            for p in paragraphs(sorted((n for n in lines if place(n) == c), key=lambda n: (n["y"], n["x"]))):
                x, y = min(n["x"] for n in p), min(n["y"] for n in p)
                w, h = max(n["x"] + n["width"] for n in p) - x, max(n["y"] + n["height"] for n in p) - y
                text = "\n".join(n["text"] for n in p)
                font = float(np.mean([n["font"] for n in p]))
                out.append((key[0], int(key[1]), len(out), x, y, w, h, block_role(text, font, all(n["bold"] for n in p), w, page_width), font, text))
        return pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")])

    return chars.where("ch is not null").groupBy("doc", "page").applyInPandas(run, BLOCK)


def xy_cut(boxes: list[tuple[float, float, float, float]], depth: int = 0) -> list[int]:
    """Reading order by recursive cuts through empty strips: the wider of the best horizontal and vertical strip, at least
    2 per cent of the extent and 5 points; without one, top to bottom and left to right."""

    def order(idx: list[int], level: int) -> list[int]:
        if len(idx) <= 1:
            return idx
        best = None
        for axis in (1, 0):
            ivs = sorted((boxes[i][axis], boxes[i][axis] + boxes[i][axis + 2], i) for i in idx)
            extent = max(b for _, b, _ in ivs) - ivs[0][0]
            high = ivs[0][1]
            for a, b, _ in ivs[1:]:
                if a - high >= max(0.02 * extent, 5.0) and (best is None or a - high > best[0]):
                    best = (a - high, axis, (a + high) / 2)
                high = max(high, b)
        if best is None or level >= 20:
            return sorted(idx, key=lambda i: (boxes[i][1], boxes[i][0]))
        _, axis, cut = best
        first = [i for i in idx if boxes[i][axis] + boxes[i][axis + 2] <= cut]
        return order(first, level + 1) + order([i for i in idx if i not in set(first)], level + 1)

    return order(list(range(len(boxes))), depth)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``position`` (from 0) by XY-cut per page."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["block_id"], kind="stable").reset_index(drop=True)
        at = np.empty(len(part), int)
        at[xy_cut(list(zip(part["x"], part["y"], part["width"], part["height"])))] = np.arange(len(part))
        return part.assign(position=at)[["doc", "page", "block_id", "position"]]

    kind = dict(blocks.dtypes)["block_id"]
    return blocks.select("doc", "page", "block_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]).groupBy("doc", "page").applyInPandas(run, f"doc string, page int, block_id {kind}, position int")


def suppress_overlaps(regions: DataFrame, most: float = 0.5) -> DataFrame:
    """Non-maximum suppression per page and label: the surest region stays, those that overlap it by more IoU go."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["confidence", "x", "y"], ascending=[False, True, True], kind="stable").to_dict("records")
        kept: list[dict] = []
        for r in rows:
            if all(r["label"] != k["label"] or _iou(r, k) <= most for k in kept):
                kept.append(r)
        return pd.DataFrame(kept, columns=part.columns)

    return regions.groupBy("doc", "page").applyInPandas(run, regions.schema)


def _iou(a: dict, b: dict) -> float:
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    both = max(w, 0.0) * max(h, 0.0)
    whole = a["width"] * a["height"] + b["width"] * b["height"] - both
    return both / whole if whole > 0 else 0.0


# -- joins of boxes ---------------------------------------------------------------------------------------------------
def label_blocks(blocks: DataFrame, regions: DataFrame, least: float = 0.3) -> DataFrame:
    """Blocks with the label of the layout region they overlap best (IoU above ``least``), null if none."""
    b = blocks.withColumn("__b", box())
    r = regions.select("doc", "page", F.col("label").alias("region_label"), box().alias("__r"))
    near = b.select("doc", "page", "block_id", "__b").join(r, ["doc", "page"]).withColumn("iou", V.iou(F.col("__b"), F.col("__r"))).where(F.col("iou") > least)
    best = near.groupBy("doc", "page", "block_id").agg(F.max(F.struct("iou", "region_label")).alias("m"))
    return blocks.join(best, ["doc", "page", "block_id"], "left").withColumn("label", F.col("m.region_label")).drop("m")


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose centre lies in no table; stream tables keep blocks with more than twice as many lines as the table has
    rows. ``tables``: doc, page, x, y, width, height, kind, rows."""
    t = tables.select(F.col("doc").alias("td"), F.col("page").alias("tp"), box().alias("__t"), F.col("kind").alias("tk"), F.col("rows").alias("tr"))
    lines = F.size(F.split("text", "\n"))
    inside = (F.col("doc") == F.col("td")) & (F.col("page") == F.col("tp")) & V.center_in(box(), F.col("__t")) & ~((F.col("tk") == "stream") & (lines > 2 * F.col("tr")))
    return blocks.join(t, inside, "left_anti")


def unobscured_tables(tables: DataFrame, blocks: DataFrame, most: float = 0.3) -> DataFrame:
    """Tables of which blocks cover no more than this share."""
    b = blocks.select("doc", "page", box().alias("__b"))
    cover = tables.select("doc", "page", "table_id", box().alias("__t")).join(b, ["doc", "page"]).groupBy("doc", "page", "table_id").agg(F.sum(V.overlap(F.col("__t"), F.col("__b")) / V.area(F.col("__t"))).alias("cover"))
    return tables.join(cover.where(F.col("cover") > most), ["doc", "page", "table_id"], "left_anti")


def without_covered(blocks: DataFrame, formulas: DataFrame) -> DataFrame:
    """Blocks that no formula claims; ``formulas`` has ``block_ids``."""
    return blocks.join(formulas.select("doc", "page", F.explode("block_ids").alias("block_id")), ["doc", "page", "block_id"], "left_anti")


def nearest_rows(noise: DataFrame, data: DataFrame) -> DataFrame:
    """For each noise row (doc, page, noise_id, y) the data row (row_id, y) of the page that is nearest in height, the first of equals."""
    d = data.select("doc", "page", "row_id", F.col("y").alias("__y"))
    near = noise.join(d, ["doc", "page"]).groupBy("doc", "page", "noise_id").agg(F.min(F.struct(F.abs(F.col("y") - F.col("__y")).alias("gap"), "row_id")).alias("m"))
    return near.select("doc", "page", "noise_id", F.col("m.row_id").alias("row_id"), F.col("m.gap").alias("gap"))


def glyph_cells(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """Each glyph with its grid cell: the first that holds its centre, else the one it overlaps most. ``cells``: doc, page, cell, box."""
    g = chars.select("doc", "page", "char_id", box().alias("__g"))
    c = cells.select("doc", "page", "cell", box().alias("__c"))
    j = g.join(c, ["doc", "page"]).withColumn("centre", V.center_in(F.col("__g"), F.col("__c"))).withColumn("share", V.overlap(F.col("__g"), F.col("__c"))).where("centre or share > 0")
    best = j.groupBy("doc", "page", "char_id").agg(F.min(F.struct((~F.col("centre")).alias("o"), F.when(F.col("centre"), 0.0).otherwise(-F.col("share")).alias("s"), "cell")).alias("m"))
    return best.select("doc", "page", "char_id", F.col("m.cell").alias("cell"))


def proportional_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Block i of n on the left with block floor(i * m / n) of m on the right, per page. Both: doc, page, ordinal (from 0)."""
    sizes = lambda df, n: df.groupBy("doc", "page").agg(F.count(F.lit(1)).alias(n))
    told = left.join(sizes(left, "n"), ["doc", "page"]).join(sizes(right, "m"), ["doc", "page"])
    told = told.withColumn("partner", F.floor(F.col("ordinal") * F.col("m") / F.col("n")).cast("int"))
    r = right.select("doc", "page", F.col("ordinal").alias("partner"), F.col("block_id").alias("partner_id"))
    return told.select("doc", "page", "block_id", "partner").join(r, ["doc", "page", "partner"], "left").drop("partner")


# -- filters and marks ------------------------------------------------------------------------------------------------
def drop_noise(blocks: DataFrame) -> DataFrame:
    """Blocks without their lines of punctuation only; blocks that have no other line go, page numbers stay."""
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^[\p{P}\p{S}\s]*$"))
    kept = F.when(F.col("role") == "PageNumber", F.col("text")).otherwise(F.array_join(lines, "\n"))
    return blocks.withColumn("text", kept).where("text != ''")


def is_watermark(page_width: float = 612.0, page_height: float = 792.0) -> Column:
    """A watermark word over more than 3 per cent of the page, a large nearly empty block without contact data, or a flat wide one.

    Running blocks and texts below two bytes are none.
    """
    share = F.col("width") * F.col("height") / (page_width * page_height)
    low, n = F.lower("text"), F.length("text")
    contact = F.greatest(*[low.contains(w) for w in CONTACT_WORDS])
    word = F.greatest(*[low.contains(w) for w in WATERMARK_WORDS])
    flat = (F.col("height") > 0) & (F.col("width") > 5 * F.col("height"))
    marked = (word & (share > 0.03)) | ((share > 0.2) & (n < 50) & ~contact) | (flat & (share > 0.15) & (n < 30))
    running = F.coalesce(F.col("role").isin("Header", "Footer", "PageNumber"), F.lit(False))
    return F.coalesce(marked & ~running & (F.octet_length("text") >= 2), F.lit(False))


def is_chart_label(text: Column) -> Column:
    """A number, percentage or year as charts carry them."""
    return F.trim(text).rlike(r"^[+-]?\d{1,3}(,\d{3})*(\.\d+)?\s*(%|％|年|月|万|亿|k|K|M)?$|^[+-]?\d+(\.\d+)?\s*(%|％|年|月|万|亿|k|K|M)?$")


def drop_chart_labels(blocks: DataFrame, page_width: float = 612.0, page_height: float = 792.0, least: int = 4) -> DataFrame:
    """Without the labels of charts: pages with at least ``least`` of them whose hull covers at most 70 per cent of the page
    lose the labels in that hull."""
    w = Window.partitionBy("doc", "page")
    label = is_chart_label(F.col("text"))
    right, low = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    told = blocks.withColumn("__l", label).withColumn("__n", F.count_if("__l").over(w))
    hull = lambda f, c: f(F.when(F.col("__l"), c)).over(w)
    size = (hull(F.max, right) - hull(F.min, F.col("x"))) * (hull(F.max, low) - hull(F.min, F.col("y")))
    told = told.withColumn("__s", size)
    return told.where(~(F.col("__l") & (F.col("__n") >= least) & (F.col("__s") <= 0.7 * page_width * page_height))).drop("__l", "__n", "__s")


def merge_orphans(blocks: DataFrame, most: int = 15) -> DataFrame:
    """Short blocks (up to ``most`` characters) right below a block that ends in the middle of a sentence are put to it:
    doc, page, block_id (of the first), text. The gap lies between -5 and 30 points."""
    w = Window.partitionBy("doc", "page").orderBy("y", "x", "block_id")
    gap = F.col("y") - F.lag(F.col("y") + F.col("height")).over(w)
    orphan = T.ends_incomplete(F.lag("text").over(w)) & (F.length("text") <= most) & gap.between(-5, 30) & (F.col("role") == "Body") & (F.lag("role").over(w) == "Body")
    told = blocks.withColumn("__o", F.coalesce(orphan, F.lit(False)))
    told = told.withColumn("__g", F.sum(F.when(F.col("__o"), 0).otherwise(1)).over(w)).withColumn("__n", F.row_number().over(w))
    rows = told.groupBy("doc", "page", "__g").agg(F.array_sort(F.collect_list(F.struct("__n", "block_id", "text"))).alias("b"))
    return rows.select("doc", "page", F.get("b", 0)["block_id"].alias("block_id"), F.array_join(F.transform("b", lambda x: x["text"]), "").alias("text"))


def without_orphans(blocks: DataFrame, most: int = 15) -> DataFrame:
    """Blocks with the short blocks that go on with them put to them, all columns kept."""
    merged = merge_orphans(blocks, most).select("doc", "page", "block_id", F.col("text").alias("__text"))
    return blocks.join(merged, ["doc", "page", "block_id"]).withColumn("text", F.col("__text")).select(*blocks.columns)


def join_urls(blocks: DataFrame) -> DataFrame:
    """Addresses that a line break cuts in two are one line again."""
    return blocks.withColumn("text", F.array_join(merge_url_spans(F.split("text", "\n")), "\n"))


def merge_url_spans(spans: Column) -> Column:
    """An array of texts in which the pieces of a broken address are one."""
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    return F.aggregate(
        spans, F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) > 0) & T.is_url_start(last(acc)) & T.is_url_continuation(x), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat(last(acc), F.trim(x)))).otherwise(F.array_append(acc, x)),
    )


def mark_footnotes(blocks: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Role Footnote in the lowest 15 per cent of a page for blocks with a footnote mark or a font below 85 per cent of the
    body's (mean of the blocks' means)."""
    body = F.avg(F.when(F.col("role") == "Body", F.col("font"))).over(Window.partitionBy("doc", "page"))
    low = F.col("y") >= 0.85 * page_height
    note = low & (T.is_footnote_marker(F.col("text")) | (F.col("font") < 0.85 * body))
    return blocks.withColumn("role", F.when(F.coalesce(note, F.lit(False)), "Footnote").otherwise(F.col("role")))


def mark_lists(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("role", F.when((F.col("role") == "Body") & T.is_list_item(F.col("text")).isNotNull(), "List").otherwise(F.col("role")))


def mark_headers_footers(blocks: DataFrame, page_height: float = 792.0, zone: float = 0.08, similar: float = 0.8, any_page: bool = False) -> DataFrame:
    """Role Header or Footer for blocks of the outer zones whose text, without page numbers, is much like a candidate's that
    stands on two pages or more. Candidates come from a document's first page, or with ``any_page`` from all. A page all of
    whose blocks would be marked keeps its roles."""
    side = F.when(F.col("y") + F.col("height") <= zone * page_height, "Header").when(F.col("y") >= (1 - zone) * page_height, "Footer")
    edge = blocks.withColumn("side", side).where("side is not null").withColumn("bare", T.strip_page_number(F.col("text"))).select("doc", "page", "block_id", "side", "bare")
    first = F.min("page").over(Window.partitionBy("doc"))
    candidates = edge.withColumn("first", first).where(F.lit(any_page) | (F.col("page") == F.col("first"))).select("doc", "side", F.col("bare").alias("pattern")).distinct()
    # texts are compared once each, however many pages carry them
    bares = edge.groupBy("doc", "side", "bare").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("on"), F.max("page").alias("to"))
    like = (F.col("bare") == F.col("pattern")) | (T.bigram_similarity(F.col("pattern"), F.col("bare")) >= similar)
    hits = bares.join(candidates, ["doc", "side"]).where(like)
    known = hits.groupBy("doc", "side", "pattern").agg(F.max("pages").alias("pages"), F.min("on").alias("on"), F.max("to").alias("to")).where("pages > 1 or `on` < `to`")
    running = hits.join(known.select("doc", "side", "pattern"), ["doc", "side", "pattern"]).select("doc", "side", "bare").distinct()
    marked = edge.join(running, ["doc", "side", "bare"]).select("doc", "page", "block_id", "side").distinct()
    w = Window.partitionBy("doc", "page")
    told = blocks.join(marked, ["doc", "page", "block_id"], "left").withColumn("left_over", F.count_if(F.col("side").isNull()).over(w))
    return told.withColumn("role", F.when(F.col("side").isNotNull() & (F.col("left_over") > 0), F.col("side")).otherwise(F.col("role"))).drop("side", "left_over")


def postprocess(blocks: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """The chain of clean-up steps on blocks: noise, watermarks, orphans, chart labels, footnotes, lists, addresses. Rows that can't be
    placed (null doc or page) are left out; a missing ``font`` is the height of a line."""
    font = F.coalesce("font", F.col("height") / F.size(F.split("text", "\n"))) if "font" in blocks.columns else F.col("height") / F.size(F.split("text", "\n"))
    out = blocks.where("doc is not null and page is not null").transform(drop_noise).where(~is_watermark(page_width, page_height)).transform(without_orphans)
    out = out.withColumn("font", font).transform(drop_chart_labels, page_width, page_height).transform(mark_footnotes, page_height)
    return out.transform(mark_lists).transform(join_urls).select(*blocks.columns)


# -- scores and strategies --------------------------------------------------------------------------------------------
def page_scores(blocks: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """How well a page's text can be read, 0 to 1, with its measures and flags: printable share, garbled rate, share of the
    page the hull of its blocks covers, median line height (the upper one), distinct share and entropy of characters."""
    b = blocks.where("text is not null")
    geo = b.groupBy("doc", "page").agg(
        F.concat_ws("", F.array_sort(F.collect_list("text"))).alias("all"), F.max(F.col("x") + F.col("width")).alias("r"), F.min("x").alias("l"),
        F.max(F.col("y") + F.col("height")).alias("b"), F.min("y").alias("t"), F.array_sort(F.collect_list(F.col("height") / F.size(F.split("text", "\n")))).alias("heights"),
    )
    n = F.length("all")
    garbled = T.garbled_characters(F.col("all"))
    chars = geo.select("doc", "page", F.explode(F.split("all", "")).alias("ch")).where("ch != ''").groupBy("doc", "page", "ch").agg(F.count(F.lit(1)).alias("c"))
    total = Window.partitionBy("doc", "page")
    p = F.col("c") / F.sum("c").over(total)
    spread = chars.withColumn("h", -p * F.log(p)).groupBy("doc", "page").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("distinct"))
    told = geo.join(spread, ["doc", "page"], "left").select(
        "doc", "page", n.alias("chars"), F.when(n > 0, (n - garbled) / n).otherwise(0.0).alias("printable"), F.when(n > 0, garbled / n).otherwise(0.0).alias("garbled"),
        F.least(F.lit(1.0), (F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) / (page_width * page_height)).alias("coverage"),
        F.get("heights", F.floor(F.size("heights") / 2).cast("int")).alias("font"), F.when(n > 0, F.coalesce("distinct", F.lit(0)) / n).otherwise(0.0).alias("unique"),
        F.coalesce(F.col("h") / F.greatest(F.log("distinct"), F.lit(1.0)), F.lit(0.0)).alias("entropy"),
    )
    score = 0.2 * F.col("printable") + 0.35 * (1 - V.sigmoid(F.col("garbled"), 0.1, 40.0)) + 0.15 * V.sigmoid(F.col("chars"), 50.0, 0.05) + 0.15 * F.least(F.lit(1.0), F.col("coverage") * 2) + 0.15 * F.col("entropy")
    flags = F.array_compact(F.array(F.when(F.col("chars") < 20, F.lit("few_characters")), F.when(F.col("garbled") > 0.1, F.lit("garbled")), F.when(F.col("coverage") < 0.05, F.lit("low_coverage")), F.when(F.col("entropy") < 0.5, F.lit("low_entropy"))))
    return told.withColumn("score", score).withColumn("flags", flags)


def parse_strategy(score: Column, has_graphics: Column, model: bool = False, vlm: bool = False) -> Column:
    """FastTrack for readable pages, else with layout models, else with a vision model, as far as they are at hand."""
    return F.when((score >= 0.6) & ~has_graphics, "FastTrack").when(F.lit(vlm) & (score < 0.3), "FastTrackPlusVlm").when(F.lit(model), "FastTrackPlusModels").otherwise("FastTrack")


def needs_ocr(score: Column, chars: Column, images: Column, mode: str = "auto", least: float = 0.3) -> Column:
    """Whether a page is read by OCR: never, always (``force_all``), or if its score is low or it is an image without text."""
    if mode != "auto":
        return F.lit(mode == "force_all")
    return (score < least) | ((chars == 0) & (images > 0))


def ocr_confidence(blocks: DataFrame) -> DataFrame:
    """Mean confidence of the recognised blocks of a page: doc, page, ``confidence``, ``blocks`` that have one."""
    read = blocks.where("page_source = 'Ocr'")
    return read.groupBy("doc", "page").agg(F.avg(F.col("confidence").cast("double")).alias("confidence"), F.count("confidence").alias("blocks"))


def merge_ocr(blocks: DataFrame, ocr: DataFrame, force_all: bool = False) -> DataFrame:
    """OCR blocks put to a page's own: they replace them if forced or the page has none, else are appended; ``source`` says
    Ocr, BornDigital or Mixed for the page."""
    have = blocks.select("doc", "page").distinct().withColumn("own", F.lit(True))
    read = ocr.select("doc", "page").distinct().withColumn("ocr", F.lit(True))
    state = have.join(read, ["doc", "page"], "full_outer").withColumn("source", F.when(F.col("ocr").isNull(), "BornDigital").when(F.lit(force_all) | F.col("own").isNull(), "Ocr").otherwise("Mixed"))
    own = blocks.join(state.where("source != 'Ocr'").select("doc", "page", "source"), ["doc", "page"])
    return own.unionByName(ocr.join(state.select("doc", "page", "source"), ["doc", "page"]), allowMissingColumns=True)


def fuse_vlm(blocks: DataFrame, vlm: DataFrame, scores: DataFrame) -> DataFrame:
    """A vision model's blocks put to a page's own (both doc, page, ordinal, block_id, role, text): where the text scores above
    0.5 only roles are taken, block by proportional block; else the model's blocks replace them if there are more than
    twice as many."""
    counts = lambda df, n: df.groupBy("doc", "page").agg(F.count(F.lit(1)).alias(n))
    state = scores.select("doc", "page", "score").join(counts(blocks, "n"), ["doc", "page"], "left").join(counts(vlm, "m"), ["doc", "page"])
    replace = state.where((F.col("score") <= 0.5) & (F.col("m") > 2 * F.coalesce("n", F.lit(0)))).select("doc", "page")
    roles = state.where("score > 0.5").select("doc", "page")
    named = proportional_pairs(blocks, vlm).join(vlm.select("doc", "page", F.col("block_id").alias("partner_id"), F.col("role").alias("vlm_role")), ["doc", "page", "partner_id"]).join(roles, ["doc", "page"], "left_semi")
    own = blocks.join(replace, ["doc", "page"], "left_anti").join(named.select("doc", "page", "block_id", "vlm_role"), ["doc", "page", "block_id"], "left")
    own = own.withColumn("role", F.coalesce("vlm_role", "role")).select(*blocks.columns)
    return own.unionByName(vlm.join(replace, ["doc", "page"], "left_semi").select(*blocks.columns))


# -- output -----------------------------------------------------------------------------------------------------------
def rag_lines(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One line per block, table row and table cell: doc, page, line_type, text. Pages count from 1 in block lines and from 0
    in cell lines. ``tables``: doc, page, table_id, headers, rows."""
    out = blocks.where("text is not null and role not in ('Header', 'Footer', 'PageNumber')").select("doc", "page", F.lit("Block").alias("line_type"), F.format_string("[page=%d] %s", F.col("page") + 1, F.regexp_replace("text", r"\s*\n\s*", " ")).alias("text"))
    if tables is None:
        return out
    rows = tables.select("doc", "page", "table_id", "headers", F.posexplode("rows").alias("i", "row"))
    name = lambda j: F.coalesce(F.get("headers", j), F.concat(F.lit("col"), (j + 1).cast("string")))
    pairs = F.array_join(F.transform("row", lambda c, j: F.concat(name(j), F.lit("="), c)), " | ")
    row_lines = rows.select("doc", "page", F.lit("TableRow").alias("line_type"), F.concat(F.format_string("[page=%d table=%s row=%d] ", F.col("page"), "table_id", "i"), pairs).alias("text"))
    cells = rows.select("doc", "page", "table_id", "headers", "i", F.posexplode("row").alias("j", "c")).where("trim(c) != ''")
    cell_lines = cells.select("doc", "page", F.lit("TableCell").alias("line_type"), F.format_string("[page=%d table=%s row=%d] %s: %s", F.col("page"), "table_id", "i", name(F.col("j")), "c").alias("text"))
    return out.unionByName(row_lines).unionByName(cell_lines)


def markdown_pages(blocks: DataFrame) -> DataFrame:
    """One Markdown text per page: titles and headings marked, lists with hyphens, running blocks left out, by position."""
    line = (
        F.when(F.col("role") == "Title", F.concat(F.lit("# "), F.col("text"))).when(F.col("role") == "Heading", F.concat(F.lit("## "), F.col("text")))
        .when(F.col("role") == "List", F.concat(F.lit("- "), F.regexp_replace("text", r"^\s*[-*•●]\s*", ""))).when(F.col("role") == "Caption", F.concat(F.lit("*"), F.col("text"), F.lit("*"))).otherwise(F.col("text"))
    )
    rows = blocks.where("text is not null and role not in ('Header', 'Footer', 'PageNumber')").select("doc", "page", F.struct("y", "x", "block_id", line.alias("l")).alias("b"))
    return rows.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["l"]), "\n\n").alias("markdown"))
