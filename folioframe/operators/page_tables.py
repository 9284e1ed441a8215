"""Tables, figures and formulas of pages: ruled and borderless tables, merged cells, confidence, HTML and Markdown tables."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioframe.functions import text as T

TABLE = "doc string, page int, table_id string, kind string, x double, y double, width double, height double, headers array<string>, rows array<array<string>>, confidence double"
_NAMES = [c.split()[0] for c in TABLE.split(", ")]


def snap(values: list[float], gap: float = 3.0) -> list[float]:
    """Nearby coordinates made one (their mean), sorted."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][-1] <= gap:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(g) / len(g) for g in out]


def grid_cells(xs: list[float], ys: list[float], glyphs: list[tuple[float, float, str]]) -> list[list[str]]:
    """Text of the cells between grid lines, glyphs in reading order; a glyph belongs where its centre lies."""
    cells = [["" for _ in xs[1:]] for _ in ys[1:]]
    for cx, cy, ch in glyphs:
        i, j = int(np.searchsorted(ys, cy, "right")) - 1, int(np.searchsorted(xs, cx, "right")) - 1
        if 0 <= i < len(cells) and 0 <= j < len(cells[i]):
            cells[i][j] += ch
    return [[c.strip() for c in row] for row in cells]


def ruled_tables(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """Tables between drawn lines (doc, page, x1, y1, x2, y2): with two horizontal and two vertical lines and four at least
    the full grid; with three horizontal lines and no vertical one (booktabs) rows by text lines and columns by gaps.
    ``confidence`` is null, as it is measured for borderless tables only. ``chars``: doc, page, ch, x, y, width, height."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        flat = left[(left.y1 - left.y2).abs() < 2]
        tall = left[(left.x1 - left.x2).abs() < 2]
        right = right.sort_values(["y", "x"], kind="stable")
        glyphs = [(x + w / 2, y + h / 2, c) for x, y, w, h, c in zip(right.x, right.y, right.width, right.height, right.ch)]
        if len(flat) >= 2 and len(tall) >= 2 and len(left) >= 4:
            ys, xs, kind = snap([*flat.y1]), snap([*tall.x1]), "ruled"
        elif len(flat) >= 3 and not len(tall):
            top, low = flat.y1.min(), flat.y1.max()
            inside = [g for g in glyphs if top <= g[1] <= low]
            if not inside:
                return pd.DataFrame(columns=_NAMES)
            rows = snap([g[1] for g in inside])
            ys = [top, *[(a + b) / 2 for a, b in zip(rows, rows[1:])], low]
            xs, kind = [flat.x1.min(), *column_cuts([(g[0] - 2, g[0] + 2) for g in inside], 12.0), flat.x2.max()], "booktabs"
        else:
            return pd.DataFrame(columns=_NAMES)
        if len(xs) < 2 or len(ys) < 2:
            return pd.DataFrame(columns=_NAMES)
        cells = grid_cells(xs, ys, glyphs)
        return pd.DataFrame([(key[0], int(key[1]), f"{key[0]}-{key[1]}-t0", kind, xs[0], ys[0], xs[-1] - xs[0], ys[-1] - ys[0], cells[0], cells[1:], None)], columns=_NAMES)

    return lines.groupBy("doc", "page").cogroup(chars.groupBy("doc", "page")).applyInPandas(run, TABLE)


def column_cuts(spans: list[tuple[float, float]], gap: float) -> list[float]:
    """Middles of the empty strips wider than ``gap`` between x-intervals."""
    cuts, high = [], None
    for a, b in sorted(spans):
        if high is not None and a - high > gap:
            cuts.append((a + high) / 2)
        high = b if high is None else max(high, b)
    return cuts


def stream_tables(lines: DataFrame, least_rows: int = 3, gap: float = 12.0, least: float = 0.3) -> DataFrame:
    """Borderless tables from text pieces (doc, page, x, y, width, height, text): runs of rows with two pieces and more whose
    empty strips line up. ``confidence`` weighs alignment .3, spacing .2, filled cells .2 and equal widths .3."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        ys = snap([*(part.y + part.height / 2)])
        part = part.assign(r=[int(np.argmin([abs(y - c) for c in ys])) for y in part.y + part.height / 2])
        counts = part.groupby("r").size()
        runs, cur = [], []
        for r in range(len(ys)):
            if counts.get(r, 0) >= 2:
                cur.append(r)
            else:
                runs.append(cur)
                cur = []
        runs.append(cur)
        out = []
        for rows in (x for x in runs if len(x) >= least_rows):
            sub = part[part.r.isin(rows)]
            cuts = column_cuts([*zip(sub.x, sub.x + sub.width)], gap)
            if not cuts:
                continue
            grid = [["" for _ in range(len(cuts) + 1)] for _ in rows]
            for r, x, w, t in sorted(zip(sub.r, sub.x, sub.width, sub.text)):
                j = int(np.searchsorted(cuts, x + w / 2))
                grid[rows.index(r)][j] = f"{grid[rows.index(r)][j]} {t}".strip()
            starts = [sub.x[(sub.x + sub.width / 2 >= a) & (sub.x + sub.width / 2 < b)] for a, b in zip([-1e9, *cuts], [*cuts, 1e9])]
            align = float(np.mean([1 / (1 + np.var(s) / 25) for s in starts if len(s)]))
            steps = np.diff([ys[r] for r in rows])
            spacing = 1 / (1 + float(np.var(steps)) / 25) if len(steps) else 0.0
            density = float(np.mean([[bool(c) for c in r] for r in grid]))
            width = float(np.mean([sum(bool(c) for c in r) == len(cuts) + 1 for r in grid]))
            confidence = 0.3 * align + 0.2 * spacing + 0.2 * density + 0.3 * width
            if confidence > least:
                x, y = sub.x.min(), sub.y.min()
                out.append((key[0], int(key[1]), f"{key[0]}-{key[1]}-s{len(out)}", "stream", x, y, (sub.x + sub.width).max() - x, (sub.y + sub.height).max() - y, grid[0], grid[1:], confidence))
        return pd.DataFrame(out, columns=_NAMES)

    return lines.where("text is not null").groupBy("doc", "page").applyInPandas(run, TABLE)


def page_tables(lines: DataFrame, chars: DataFrame, pieces: DataFrame) -> DataFrame:
    """Ruled tables where a page has them, else borderless ones."""
    ruled = ruled_tables(lines, chars)
    return ruled.unionByName(stream_tables(pieces).join(ruled.select("doc", "page").distinct(), ["doc", "page"], "left_anti"))


def dedup_tables(tables: DataFrame, most: float = 0.5) -> DataFrame:
    """Of tables that overlap by more IoU the one with more cells stays, per page."""
    from folioframe.operators.pages import _iou

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.assign(n=[sum(len(r) for r in t) for t in part["rows"]]).sort_values(["n", "table_id"], ascending=[False, True], kind="stable").to_dict("records")
        kept: list[dict] = []
        for r in rows:
            if all(_iou(r, k) <= most for k in kept):
                kept.append(r)
        return pd.DataFrame(kept)[list(part.columns)]

    return tables.groupBy("doc", "page").applyInPandas(run, tables.schema)


def column_types(tables: DataFrame) -> DataFrame:
    """The type most cells of a column have, blanks left out (ties: the first in the alphabet): doc, table_id, column, type."""
    cells = tables.select("doc", "table_id", F.explode("rows").alias("r")).select("doc", "table_id", F.posexplode("r").alias("column", "c"))
    kinds = cells.withColumn("type", T.cell_type(F.col("c"))).where("type != 'Unknown'").groupBy("doc", "table_id", "column", "type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("doc", "table_id", "column").agg(F.min(F.struct(-F.col("n"), "type")).alias("m")).select("doc", "table_id", "column", F.col("m.type").alias("type"))


def merged_cells(rows: Column) -> Column:
    """Column spans of each row: a filled cell followed by blanks up to the next filled one spans them."""
    def spans(row: Column) -> Column:
        at = F.filter(F.transform(row, lambda c, i: F.when(F.trim(c) != "", i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i, k: F.struct(i.alias("column"), (F.coalesce(F.get(at, k + 1), F.size(row)) - i).alias("span")))

    return F.transform(rows, spans)


def fallback_text(headers: Column, rows: Column, confidence: Column) -> Column:
    """A table as lines of name and value, rows from 1; tables of low confidence are flagged at the end."""
    name = lambda j: F.coalesce(F.nullif(F.get(headers, j), F.lit("")), F.concat(F.lit("col"), (j + 1).cast("string")))
    lines = F.transform(rows, lambda r, i: F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(r, lambda c, j: F.concat(name(j), F.lit("="), c)), "; ")))
    return F.concat(F.array_join(lines, "\n"), F.when(confidence < 0.3, F.lit("\n[low confidence]")).otherwise(""))


def figure_regions(paths: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Regions dense with drawing paths (doc, page, x, y): a grid of 30 by 20 cells, cells with two paths and more, their
    8-neighbour components of three cells, 5 per cent of the page and ten paths at least."""
    schema = "doc string, page int, x double, y double, width double, height double, paths int"

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        gx, gy = np.clip((part.x / page_width * 30).astype(int), 0, 29), np.clip((part.y / page_height * 20).astype(int), 0, 19)
        grid = np.zeros((20, 30), int)
        np.add.at(grid, (gy, gx), 1)
        seen, out = np.zeros_like(grid, bool), []
        for start in zip(*np.nonzero(grid >= 2)):
            if seen[start]:
                continue
            seen[start] = True
            todo, cells = [start], []
            while todo:
                i, j = todo.pop()
                cells.append((i, j))
                for a in range(max(0, i - 1), min(20, i + 2)):
                    for b in range(max(0, j - 1), min(30, j + 2)):
                        if grid[a, b] >= 2 and not seen[a, b]:
                            seen[a, b] = True
                            todo.append((a, b))
            ii, jj = [c[0] for c in cells], [c[1] for c in cells]
            w, h, n = (max(jj) - min(jj) + 1) / 30, (max(ii) - min(ii) + 1) / 20, sum(int(grid[c]) for c in cells)
            if len(cells) >= 3 and w * h >= 0.05 and n >= 10:
                out.append((key[0], int(key[1]), min(jj) / 30 * page_width, min(ii) / 20 * page_height, w * page_width, h * page_height, n))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return paths.groupBy("doc", "page").applyInPandas(run, schema)


def formula_score(text: Column, math_font_share: Column, script_share: Column) -> Column:
    """.35 for mathematical characters, .40 for a mathematical font, .25 for raised and lowered characters; above .3 a block
    is a formula."""
    signs = F.length(F.regexp_replace(text, r"[^\p{Sm}∑∏∫√∞≤≥≠±×÷∂∇α-ωΑ-Ω^_=+/]", ""))
    return 0.35 * F.least(F.lit(1.0), 3 * signs / F.greatest(F.length(text), F.lit(1))) + 0.4 * math_font_share + 0.25 * script_share


def equation_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"[(（](\d+(?:[.-]\d+)*)[)）]\s*$", 1), F.lit(""))


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.cell, self.span = [], None, (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            a = dict(attrs)
            number = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and int(a[k]) else 1
            self.cell, self.span = "", (min(number("rowspan"), 1000), min(number("colspan"), 1000))
            if not self.rows:
                self.rows.append([])
        elif tag == "br" and self.cell is not None:
            self.cell += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append((" ".join(self.cell.split()), *self.span))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data


def html_rows(html: str | None) -> list[list[str]]:
    """The cells of an HTML table; a cell that spans rows or columns is repeated in all of them."""
    parser = _Cells()
    parser.feed(html or "")
    grid: dict[tuple[int, int], str] = {}
    for i, row in enumerate(parser.rows):
        j = 0
        for text, down, right in row:
            while (i, j) in grid:
                j += 1
            for a in range(down):
                for b in range(right):
                    grid[i + a, j + b] = text
            j += right
    if not grid:
        return []
    height, width = min(max(i for i, _ in grid) + 1, len(parser.rows)), max(j for _, j in grid) + 1
    return [[grid.get((i, j), "") for j in range(width)] for i in range(height)]


def html_tables(html: Column) -> Column:
    """``html_rows`` as a Column."""
    return _html_udf()(html)


def _html_udf():
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def parse(html: pd.Series) -> pd.Series:
        return html.map(html_rows)

    return parse


def markdown_rows(text: Column) -> Column:
    """The cells of the pipe tables of a text, the rule between head and body left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def text_table(text: str | None) -> list[list[str]]:
    """A table from OCR text whose lines have fields apart by tabs or two blanks: four fields and three rows at least, the
    number of fields within one of the first row's; empty otherwise."""
    import re

    rows = [re.split(r"\t+| {2,}", x.strip()) for x in (text or "").split("\n") if x.strip()]
    ok = len(rows) >= 3 and len(rows[0]) >= 4 and all(abs(len(r) - len(rows[0])) <= 1 for r in rows)
    return rows if ok else []
