"""Tables from raw spreadsheet cells: blocks, headers, types, clean-up, profiles.

Cells come as (file, sheet, row, col, kind, raw), from which a sheet's grid is rebuilt; a sheet bounds what one task
holds. Types and statistics are plain aggregations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from folioframe.functions import values as V

# Words of footers and of titles, limits of header search and of blank runs.
FOOTER = ("备注", "注：", "注:", "说明", "数据来源", "制表人", "审核人", "合计", "总计", "小计", "※", "*注")
TITLE = ("编制单位", "单位：", "单位:", "报表名称", "会计期间", "审计", "填报", "制表日期", "币种")
MOST_HEADER_ROWS, MOST_BLANK_ROWS, KEYWORD_BYTES = 5, 3, 32 * 1024
_NUMBER = re.compile(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
_DATE = re.compile(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}")


def is_number(cell: str) -> bool:
    return bool(_NUMBER.match(cell.strip().replace(",", "")))


def filled(row: list[str]) -> int:
    return sum(bool(c.strip()) for c in row)


def numbers(row: list[str]) -> int:
    return sum(is_number(c) for c in row if c.strip())


def trim_blank(grid: list[list[str]]) -> list[list[str]]:
    while grid and not filled(grid[-1]):
        grid = grid[:-1]
    return grid


def block_ranges(grid: list[list[str]]) -> list[tuple[int, int]]:
    """Row ranges of the tables of a sheet. A new one begins at a row after blank rows that has text cells only (two or
    more) if the table before it had numbers in at least two columns, two full rows were seen, and one of the next three
    rows has numbers or as many cells. Blank rows alone don't split."""
    ranges, start, run, blank, numeric = [], None, 0, 0, False
    inside = False
    for i, row in enumerate(grid):
        n = filled(row)
        if not n:
            blank += 1
            run = 0
            continue
        if start is None:
            start = i
        elif inside and numeric and blank and not numbers(row) and n >= 2 and any(numbers(r) or filled(r) == n for r in grid[i + 1 : i + 4]):
            ranges.append((start, i))
            start, run, inside, numeric = i, 0, False, False
        run += 1
        inside = inside or run >= 2
        numeric = numeric or numbers(row) >= 2
        blank = 0
    if start is not None:
        ranges.append((start, len(grid)))
    return [(a, a + len(trim_blank(grid[a:b]))) for a, b in ranges]


def header_start(rows: list[list[str]], search: int = 15, columns: int = 20) -> int:
    """The row where the header begins: the best score of the first rows, the first of equals, judged by the first columns.

    Rows less than 40 per cent full are passed over. A full row scores 40; numbers in one of the next three rows 30, and 10
    more if the row itself has none; a title word costs 50, a cell over 20 characters 20, one over 30 another 10.
    """
    width = min(max(map(len, rows), default=0), columns)
    scores: dict[int, int] = {}
    for i, row in enumerate(rows[:search]):
        cells = [c.strip() for c in row[:width] if c.strip()]
        if not width or len(cells) * 100 // width < 40:
            continue
        longest = max(map(len, cells), default=0)
        data_below = any(numbers(r[:width]) for r in rows[i + 1 : i + 4])
        titled = any(w in c for c in cells for w in TITLE)
        scores[i] = len(cells) * 40 // width + 30 * data_below + 10 * (data_below and not numbers(row[:width])) - 50 * titled - 20 * (longest > 20) - 10 * (longest > 30)
    best = max(scores.values(), default=-1)
    return next((i for i, s in scores.items() if s == best), 0) if best >= 0 else 0


def header_depth(rows: list[list[str]]) -> int:
    """Header rows: up to the first row with two numbers and more than the row before; one if there is none."""
    for i in range(1, min(MOST_HEADER_ROWS + 1, len(rows))):
        if numbers(rows[i]) >= 2 and numbers(rows[i]) > numbers(rows[i - 1]):
            return i
    return 1


def column_names(header: list[list[str]], width: int) -> list[str]:
    """Names from the header's rows, top down; blanks filled from the left in all but the last row; repeats numbered."""
    filled_rows = []
    for level, row in enumerate(header):
        row = [*row, *[""] * (width - len(row))]
        if level < len(header) - 1:
            last = ""
            row = [last := c.strip() or last for c in row]
        filled_rows.append(row)
    names, seen = [], {}
    for j in range(width):
        parts: list[str] = []
        for row in filled_rows:
            c = row[j].strip()
            if c and (not parts or parts[-1] != c):
                parts.append(c)
        name = "_".join(parts) or f"Column_{j + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


def is_dirty(row: list[str], width: int) -> bool:
    """A note or total below a wide table: one cell at most, with a footer word."""
    cells = [c.strip() for c in row if c.strip()]
    return not cells or (len(cells) <= 1 and width >= 5 and any(w in cells[0] for w in FOOTER))


def column_type(values: list[str]) -> str:
    """String, DateTime, Bool, Float, Int or Empty: any text makes a String, dates and booleans only when pure."""
    kinds = set()
    for v in (x.strip() for x in values):
        if not v:
            continue
        kinds.add("Bool" if v.lower() in ("true", "false") else "Int" if re.fullmatch(r"[+-]?\d+", v) else "Float" if is_number(v) else "DateTime" if _DATE.match(v) else "String")
    if not kinds:
        return "Empty"
    if "String" in kinds or ("DateTime" in kinds and len(kinds) > 1):
        return "String"
    return next(k for k in ("DateTime", "Float", "Int", "Bool") if k in kinds)


def fill_down(rows: list[list[str]], width: int) -> list[list[str]]:
    """Blanks of the first columns (30 per cent of them, one to three) take the value above; leading blanks stay."""
    for j in range(min(max(int(width * 0.3), 1), 3)):
        last = ""
        for row in rows:
            if row[j].strip():
                last = row[j]
            else:
                row[j] = last
    return rows


def sheet_blocks(grid: list[list[str]]) -> list[tuple[int, list[str], list[str], list[list[str]]]]:
    """(index, names, types, rows) of every table of a sheet; a table ends at three blank rows; generated columns that are
    empty throughout are dropped."""
    out = []
    for a, b in block_ranges(grid):
        rows = grid[a:b]
        at = header_start(rows)
        rows = rows[at:]
        depth = header_depth(rows)
        width = max(map(len, rows), default=0)
        names = column_names(rows[:depth], width)
        data, blank = [], 0
        for row in rows[depth:]:
            blank = 0 if filled(row) else blank + 1
            if blank >= MOST_BLANK_ROWS:
                break
            row = [*row, *[""] * (width - len(row))]
            if not is_dirty(row, width):
                data.append(row)
        data = fill_down(data, width)
        keep = [j for j in range(width) if not re.fullmatch(r"Column_\d+", names[j]) or any(r[j].strip() for r in data)]
        data = [[r[j] for j in keep] for r in data]
        out.append((len(out), [names[j] for j in keep], [column_type([r[k] for r in data]) for k in range(len(keep))], data))
    return out


BLOCK = "file string, sheet string, block int, source_id string, names array<string>, types array<string>, rows array<array<string>>, row_count int"


def _closed(places: pd.Series, most: int) -> dict[int, int]:
    """New places for row or column numbers, in order, with gaps of at most ``most`` blanks."""
    out, at, last = {}, -1, -1
    for p in sorted({int(x) for x in places}):
        at += min(p - last, most + 1)
        out[p], last = at, p
    return out


def data_blocks(cells: DataFrame) -> DataFrame:
    """The tables of every sheet of ``cells`` (file, sheet, row, col, raw); a sheet without text gives none."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        # only filled cells count, and long blank stretches are shortened: a stray cell far out makes no large grid
        part = part[part["raw"].fillna("").str.strip() != ""]
        if not len(part):
            return pd.DataFrame(columns=[c.split()[0] for c in re.sub(r"<[^ ]*>", "", BLOCK).split(", ")])
        at_row, at_col = _closed(part["row"], MOST_BLANK_ROWS + 1), _closed(part["col"], MOST_BLANK_ROWS + 1)
        grid = [[""] * (max(at_col.values()) + 1) for _ in range(max(at_row.values()) + 1)]
        for r, c, v in zip(part["row"], part["col"], part["raw"]):
            grid[at_row[int(r)]][at_col[int(c)]] = v
        out = [(key[0], key[1], i, f"{key[0]}_{key[1]}_{i}", n, t, d, len(d)) for i, n, t, d in sheet_blocks(trim_blank(grid))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in re.sub(r"<[^ ]*>", "", BLOCK).split(", ")])

    return cells.where("row is not null and col is not null").groupBy("file", "sheet").applyInPandas(run, BLOCK)


_SPARK = {"String": StringType(), "Int": LongType(), "Float": DoubleType(), "Bool": BooleanType(), "DateTime": StringType(), "Empty": StringType()}


def typed_table(block: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    """The rows of one block as a typed table; blanks and what doesn't parse are null. Only ``true``, ``TRUE`` and ``1`` are
    true."""
    rows = block.select(F.explode("rows").alias("r"))
    out = []
    for i, (name, kind) in enumerate(zip(names, types)):
        c = F.nullif(F.trim(F.get("r", i)), F.lit(""))
        if kind == "Bool":
            c = F.when(c.isin("true", "TRUE", "1"), True).when(c.isNotNull(), False)
        elif kind in ("Int", "Float"):
            c = F.replace(c, F.lit(","), F.lit("")).try_cast(_SPARK[kind])
        out.append(c.alias(name))
    return rows.select(*out)


def register(spark: SparkSession, blocks: DataFrame, most: int = 1000) -> dict[str, list[tuple[str, str]]]:
    """Temporary views of all blocks of a workbook: their names and columns. More than ``most`` blocks are refused, as each is a view."""
    from folioframe.plans.sqltools import safe_table_name

    made = {}
    heads = blocks.select("source_id", "sheet", "block", "names", "types").limit(most + 1).collect()
    if len(heads) > most:
        raise ValueError(f"more than {most} tables; register one workbook at a time")
    for r in heads:
        name = safe_table_name(r["sheet"], r["block"])
        typed_table(blocks.where(F.col("source_id") == r["source_id"]), r["names"], r["types"]).createOrReplaceTempView(name)
        made[name] = list(zip(r["names"], r["types"]))
    return made


def profiles(blocks: DataFrame, sample: int = 5) -> DataFrame:
    """What a model is told of a table: source_id, and a text with its columns, types, size and first rows."""
    columns = F.array_join(F.zip_with("names", "types", lambda n, t: F.concat(n, F.lit(" ("), t, F.lit(")"))), ", ")
    rows = F.array_join(F.transform(F.slice("rows", 1, sample), lambda r: F.array_join(r, " | ")), "\n")
    return blocks.select("source_id", F.concat_ws("\n", F.concat(F.lit("Table: "), F.col("sheet")), F.concat(F.lit("Columns: "), columns), F.format_string("Rows: %d", "row_count"), F.array_join("names", " | "), rows).alias("text"))


def infer_types(df: DataFrame) -> DataFrame:
    """The type of every column of a table of texts, by aggregation: ``column``, ``type``; the same rule as ``column_type``."""
    agg = []
    for i, c in enumerate(df.columns):
        v = F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        boolean, whole, date = F.lower(v).isin("true", "false"), v.rlike(r"^[+-]?\d+$"), V.looks_like_date(v)
        number = F.replace(v, F.lit(","), F.lit("")).rlike(_NUMBER.pattern) & ~whole
        kind = F.when(boolean, "Bool").when(whole, "Int").when(number, "Float").when(date, "DateTime").when(v.isNotNull(), "String")
        agg.append(F.collect_set(kind).alias(f"k{i}"))  # at most five kinds
    one = df.agg(*agg)
    rows = []
    for i, c in enumerate(df.columns):
        k = F.col(f"k{i}")
        has = lambda x, k=k: F.array_contains(k, x)
        kind = F.when(F.size(k) == 0, "Empty").when(has("String") | (has("DateTime") & (F.size(k) > 1)), "String").when(has("DateTime"), "DateTime").when(has("Float"), "Float").when(has("Int"), "Int").otherwise("Bool")
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("type")))
    return one.select(F.inline(F.array(*rows)))


def forward_fill(df: DataFrame, columns: list[str], group: list[str], order: list[Column]) -> DataFrame:
    """Blanks and nulls of the columns take the value above within the group; leading ones stay."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(F.nullif(F.trim(c), F.lit("")), ignorenulls=True).over(w), F.col(c)) for c in columns})


def keyword_index(df: DataFrame, columns: list[str], most_bytes: int = KEYWORD_BYTES) -> DataFrame:
    """The distinct cell values that aren't numbers, sorted, as far as they fit ``most_bytes``: value."""
    cells = df.select(F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in columns])).alias("value")).where("value != ''")
    words = cells.where(~F.col("value").rlike(_NUMBER.pattern)).groupBy("value").count().select("value")
    head = words.orderBy("value").limit(most_bytes)  # a value takes a byte at least
    used = F.sum(F.octet_length("value") + 1).over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("used", used).where(F.col("used") <= most_bytes).select("value")


def row_features(cells: DataFrame) -> DataFrame:
    """Per row of a sheet: cells that are filled, numeric, and text."""
    v = F.nullif(F.trim("raw"), F.lit(""))
    number = F.replace(v, F.lit(","), F.lit("")).rlike(_NUMBER.pattern)
    return cells.groupBy("file", "sheet", "row").agg(F.count(v).alias("filled"), F.count_if(number).alias("numeric"), F.count_if(~number & v.isNotNull()).alias("texts"))


def sheet_chunks(blocks: DataFrame) -> DataFrame:
    """Two chunks per workbook: ``-tables`` describes its tables and columns, ``-keywords`` lists its distinct words, sorted, as
    far as they fit ``KEYWORD_BYTES``."""
    line = F.concat(F.col("sheet"), F.format_string(" (%d rows): ", F.col("row_count")), F.array_join(F.zip_with("names", "types", lambda n, t: F.concat(n, F.lit(" "), t)), ", "))
    tables = blocks.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "block", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    cells = blocks.select("file", F.explode(F.flatten("rows")).alias("v")).select("file", F.trim("v").alias("v")).where("v != ''").where(~F.col("v").rlike(_NUMBER.pattern)).distinct()
    used = F.sum(F.octet_length("v") + 1).over(Window.partitionBy("file").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    words = cells.withColumn("u", used).where(F.col("u") <= KEYWORD_BYTES).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("v")), " ").alias("text"))
    both = tables.withColumn("k", F.lit("-tables")).unionByName(words.withColumn("k", F.lit("-keywords")))
    none = F.lit(None).cast("string")
    return both.select(F.concat("file", "k").alias("id"), "text", F.lit(None).cast("array<float>").alias("vector"), F.col("file").alias("file_path"), none.alias("parent_id"), none.alias("breadcrumbs"), F.lit("tabular").alias("doc_type"))
