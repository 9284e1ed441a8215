"""SQL over registered tables: single statements, scripts, pages, summaries, and rule-made queries for listing questions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from folioframe.session import table

# Display limits of results, and what a page may hold.
FULL_ROWS, SAMPLE_ROWS, SHOWN_COLUMNS, PAGE_SIZE, MOST_PAGE = 100, 10, 8, 20, 200
#: Rows shown in place of an empty result (fixed value).
EMPTY = "（空结果）"
_ALLOWED = ("select", "with", "values", "from", "(")


def statements(script: str) -> list[str]:
    """The statements of a script, split at semicolons outside of quotes and comments."""
    parts, current, quote, i = [], [], "", 0
    while i < len(script):
        c = script[i]
        if quote:
            current.append(c)
            if c == quote:
                quote = ""
        elif script.startswith("--", i):
            end = script.find("\n", i)
            i = len(script) if end < 0 else end
            continue
        elif c in "'\"`":
            quote = c
            current.append(c)
        elif c == ";":
            parts.append("".join(current).strip())
            current = []
        else:
            current.append(c)
        i += 1
    parts.append("".join(current).strip())
    return [p for p in parts if p]


def checked(statement: str) -> str:
    """The statement if it only reads; ``ValueError`` otherwise, so generated SQL can't change anything."""
    if not statement.lower().lstrip().startswith(_ALLOWED):
        raise ValueError("only SELECT, WITH and VALUES are allowed")
    return statement


def run(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """One statement; tables in braces are Parquet tables of the folder."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(checked(text), **{n: table(spark, folder, n) for n in names})


def run_script(spark: SparkSession, script: str) -> tuple[DataFrame, int]:
    """A script of several steps: each but the last is a temporary view ``step_i``; the last one's result, and the number
    of steps before it. Views are lazy, so Catalyst plans the script as one query."""
    *before, last = statements(script)
    for i, statement in enumerate(before):
        spark.sql(checked(statement)).createOrReplaceTempView(f"step_{i}")
    return spark.sql(checked(last)), len(before)


def count_of(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """How many rows a statement gives, without its columns being made: one row, ``n``."""
    return run(spark, folder, f"SELECT count(*) AS n FROM ({checked(text)}) AS counted")


def page(df: DataFrame, order: list[Column | str], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of an ordered result; the size is at least 1 and at most ``MOST_PAGE``."""
    size = min(max(size, 1), MOST_PAGE)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def pages(rows: int, size: int = PAGE_SIZE) -> int:
    return -(-rows // min(max(size, 1), MOST_PAGE))


def safe_table_name(sheet: str, block: int = 0) -> str:
    """A view name: everything but ASCII letters, digits and underscores becomes an underscore; ``_blockN`` beyond the first."""
    name = re.sub(r"[^A-Za-z0-9_]", "_", sheet)
    return f"{name}_block{block}" if block else name


def fnv1a32(data: bytes) -> int:
    """The public FNV-1a hash of 32 bits."""
    h = 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def cache_table_name(path: str, sheet: str, block: int = 0) -> str:
    """A name that is unique per file: six hex digits of the path's hash, the sheet with its Unicode letters kept, the block."""
    prefix = f"f{fnv1a32(path.encode()) & 0xFFFFFF:06x}"
    name = re.sub(r"\W", "_", sheet).lower()  # catalogs fold case
    return f"{prefix}_{name}_b{block}" if block else f"{prefix}_{name}"


@F.pandas_udf(StringType())
def cache_name(path: pd.Series, sheet: pd.Series) -> pd.Series:
    """``cache_table_name`` as a Column."""
    return pd.Series([cache_table_name(p, s) for p, s in zip(path, sheet)])


def number_text(x: Column, digits: int = 2) -> Column:
    """A number as shown: whole numbers without a point, others with at most ``digits`` decimals, null as ``NULL``."""
    whole = x == F.floor(x)
    fixed = F.rtrim(F.format_string(f"%.{digits}f", x.cast("double")), F.lit("0"))
    return F.when(x.isNull(), "NULL").when(whole, F.format_string("%d", F.floor(x).cast("bigint"))).otherwise(F.rtrim(fixed, F.lit(".")))


def as_text(df: DataFrame) -> DataFrame:
    """Every column as shown in a rendered result."""
    shown = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        shown.append((number_text(c) if kind in ("double", "float") else F.coalesce(c.cast("string"), F.lit("NULL"))).alias(f.name))
    return df.select(*shown)


def markdown(df: DataFrame, most: int = FULL_ROWS, columns: int = SHOWN_COLUMNS) -> str:
    """A result of at most ``most`` rows as a Markdown table; for rendering on the driver, so the rows are limited."""
    shown = as_text(df.select(*[f"`{c}`" for c in df.columns[:columns]])).limit(most).collect()
    if not shown:
        return EMPTY
    head = df.columns[:columns]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in shown)])


def column_stats(df: DataFrame, numeric_share: float = 0.8) -> DataFrame:
    """One row per column in one pass: ``nulls``, and for numeric columns (more than ``numeric_share`` of the values that
    are not null parse) min, max and avg, otherwise the number of distinct values. All values are read as text."""
    # a struct per column, aggregated together, then turned into rows
    cols = df.columns
    text = {c: F.col(f"`{c}`").cast("string") for c in cols}
    num = {c: F.expr(f"try_cast(`{c}` AS double)") if dict(df.dtypes)[c] in ("string",) else text[c].try_cast("double") for c in cols}
    agg = []
    for i, c in enumerate(cols):
        agg += [
            F.count_if(text[c].isNull()).alias(f"nulls{i}"), F.count(text[c]).alias(f"n{i}"), F.count(num[c]).alias(f"num{i}"),
            F.min(num[c]).alias(f"min{i}"), F.max(num[c]).alias(f"max{i}"), F.avg(num[c]).alias(f"avg{i}"), F.count_distinct(text[c]).alias(f"dist{i}"),
        ]
    one = df.agg(*agg)
    rows = []
    for i, c in enumerate(cols):
        numeric = F.col(f"num{i}") > numeric_share * F.col(f"n{i}")
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"nulls{i}").alias("nulls"), numeric.alias("numeric"), F.when(numeric, F.col(f"min{i}")).alias("min"),
                F.when(numeric, F.col(f"max{i}")).alias("max"), F.when(numeric, F.round(f"avg{i}", 6)).alias("avg"), F.when(~numeric, F.col(f"dist{i}")).alias("distinct"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def summary(df: DataFrame) -> tuple[str, str, int]:
    """(kind, text, rows): the whole result up to ``FULL_ROWS`` rows, else statistics and the first ``SAMPLE_ROWS``."""
    rows = df.count()
    if rows <= FULL_ROWS:
        return "full", markdown(df), rows
    stats = column_stats(df.select(*[f"`{c}`" for c in df.columns[:SHOWN_COLUMNS]]))
    return "summary", f"{rows} rows\n{markdown(stats)}\n{markdown(df, SAMPLE_ROWS)}", rows


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


# Words that ask for a list, and words of a question that name no column.
_LISTING = ("list", "which", "all", "what", "列出", "显示", "所有", "全部", "哪些", "查看")
_ASKING = "列出 显示 查看 查询 所有 全部 的 了 吗 把 给 我 一下 下 有 哪些 什么 多少 是 在 请 帮 看看 找 搜索 出来".split()


def listing_sql(question: str, schemas: dict[str, list[str]], rows: dict[str, int] | None = None) -> str | None:
    """SQL for questions that ask to list the values of a column; None if no rule fits.

    Words of the question (split at blanks and Chinese commas and question marks) are matched with column names, either containing the
    other; tables that ``rows`` says are empty are passed over. One table with matches gives a SELECT DISTINCT of them in
    the order of their names; several give the union of the first table's first match over all tables that matched it.
    """
    lowered = question.lower()
    if not any(w in lowered for w in _LISTING):
        return None
    keys = [k for k in re.split(r"[\s，、？?,]+", lowered) if k and k not in _ASKING and k not in _LISTING]
    picked = {}
    for name in sorted(schemas):
        hit = sorted(c for c in schemas[name] if any(k in c.lower() or c.lower() in k for k in keys))
        if hit and (rows is None or rows.get(name, 0) > 0):
            picked[name] = hit
    if not picked:
        return None
    first, columns = next(iter(picked.items()))
    if len(picked) == 1:
        return f"SELECT DISTINCT {', '.join(f'`{c}`' for c in columns)} FROM `{first}`"
    return " UNION ALL ".join(f"SELECT DISTINCT `{columns[0]}` FROM `{n}`" for n, hit in picked.items() if columns[0] in hit)


def answer_table(spark: SparkSession, question: str, schemas: dict[str, list[str]], provider, repairs: int = 2) -> DataFrame:
    """The rule-made query if one fits, else SQL from ``provider(prompt)``, repaired at most ``repairs`` times from its error."""
    sql = listing_sql(question, schemas)
    prompt = "Tables:\n" + "\n".join(f"{n}({', '.join(c)})" for n, c in schemas.items()) + f"\nQuestion: {question}\nSQL:"
    for attempt in range(repairs + 1):
        text = sql or re.sub(r"^```\w*\n?|```$", "", re.sub(r"(?s)<think>.*?</think>", "", provider(prompt)).strip()).strip()
        try:
            return run_script(spark, text)[0]
        except Exception as error:
            if attempt == repairs:
                raise
            prompt += f"\n{text}\nError: {str(error)[:500]}\nCorrected SQL:"
            sql = None
    raise AssertionError


# -- tables in a model's context --------------------------------------------------------------------------------------
def table_chars(df: DataFrame, sample: int = 100) -> int:
    """About how many characters a table takes as Markdown: the mean of the first rows times the number of rows."""
    row = F.length(F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in df.columns])) + 4
    mean = df.limit(sample).agg(F.avg(row)).first()[0] or 0.0
    return int(mean * df.count()) + sum(len(c) + 3 for c in df.columns)


def needs_sql(df: DataFrame, budget: int) -> bool:
    """Whether a table is too large for the context and has to be asked by SQL."""
    return table_chars(df) > 0.9 * budget


def injected(df: DataFrame, budget: int, least: int = 3, most: int = 30) -> str:
    """The first rows of a table as Markdown, as many as about fit the budget, ``least`` to ``most``."""
    rows = df.count()
    per_row = max(1, table_chars(df) // max(1, rows))
    return markdown(df, min(max(budget // per_row, least), most), len(df.columns))


def largest_first(tables: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """Names of a workbook's tables with their rows, the largest first."""
    return sorted(((n, df.count()) for n, df in tables.items()), key=lambda x: (-x[1], x[0]))


def chart_of(df: DataFrame, most: int = 50) -> dict | None:
    """How to chart a small result: the first column that isn't numeric labels it, numeric columns (more than 60 per cent of
    the values parse) are series; a line for dates or more than five rows, else bars; None without either."""
    rows = as_text(df).limit(most).collect()
    if not rows:
        return None

    def numeric(c: str) -> bool:
        values = [r[c] for r in rows if r[c] != "NULL"]
        return bool(values) and sum(bool(re.fullmatch(r"[+-]?[\d,]*\.?\d+%?", v)) for v in values) > 0.6 * len(values)

    series = [c for c in df.columns if numeric(c)]
    label = next((c for c in df.columns if c not in series), None)
    if not series or label is None:
        return None
    dated = all(re.match(r"\d{4}[-/]\d{1,2}", r[label]) for r in rows)
    return {"type": "line" if dated or len(rows) > 5 else "bar", "label": label, "series": series}


# -- cached tables of workbooks ---------------------------------------------------------------------------------------
def cache_tables(spark: SparkSession, path: str, tables: dict[tuple[str, int], DataFrame]) -> list[str]:
    """Save the tables of a file, keyed by sheet and block; tables the file had before and has no more are dropped."""
    names = {cache_table_name(path, sheet, block): df for (sheet, block), df in tables.items()}
    for old in cached_tables(spark, path):
        if old not in names:
            spark.sql(f"DROP TABLE IF EXISTS `{old}`")
    for name, df in names.items():
        df.write.mode("overwrite").format("parquet").saveAsTable(f"`{name}`")
    return sorted(names)


def cached_tables(spark: SparkSession, path: str) -> list[str]:
    prefix = cache_table_name(path, "")
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary and t.name.startswith(prefix))


def drop_cached(spark: SparkSession, path: str) -> None:
    for name in cached_tables(spark, path):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
