"""Folders of files as DataFrames: walk, dispatch by format, Markdown and HTML text, page ranges."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from folioframe.operators import store as S

#: Which reader takes which extension (fixed values).
READERS = {"markdown": ("md", "markdown"), "text": ("txt",), "html": ("html", "htm"), "docx": ("docx",), "pptx": ("pptx",), "sheet": ("xlsx", "xlsm"), "page_ir": ("json",)}


def walk(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """All files below a folder that are indexed: file_path, last_modified (epoch seconds), size_bytes, content, content_hash.

    Without ``content`` only the metadata is read. Hidden folders are skipped by Spark itself.
    """
    return _files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), content)


def _files(files: DataFrame, content: bool) -> DataFrame:
    path = F.regexp_replace("path", "^file:/*", "/")
    cols = [path.alias("file_path"), F.unix_timestamp("modificationTime").alias("last_modified"), F.col("length").alias("size_bytes")]
    if content:
        cols += [F.col("content"), F.sha2("content", 256).alias("content_hash")]
    return files.select(*cols).where(S.should_index(F.col("file_path")))


def read_files(spark: SparkSession, folder: str, wanted: DataFrame, few: int = 10_000) -> DataFrame:
    """The files of ``wanted`` (file_path) below a folder, with content, as ``walk`` gives them.

    Up to ``few`` files are opened by name; more are picked from a scan of the folder. Either way the same rows come out.
    """
    paths = [r["file_path"] for r in wanted.select("file_path").distinct().limit(few + 1).collect()]
    if len(paths) > few:
        return walk(spark, folder).join(wanted.select("file_path").distinct(), "file_path", "left_semi")
    if not paths:
        return walk(spark, folder).limit(0)
    return _files(spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?,])", r"\\\1", p) for p in paths]), True)


def reader_of(path: Column) -> Column:
    """The reader of a file by lower-case extension, null if none takes it."""
    ext = S.extension(path)
    out = F.lit(None).cast("string")
    for name, exts in READERS.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


class _Text(HTMLParser):
    # Elements without text, and elements that end a line.
    SKIP, BREAK = {"script", "style", "nav", "noscript", "template"}, {"p", "div", "br", "li", "tr", "section", "article", "ul", "ol", "table", "pre", "blockquote"}

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_markdown(html: str | None) -> str | None:
    """The text of a page with its headings and list items as Markdown; scripts, styles and navigation left out."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))).strip()


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(html_markdown)


def text_documents(files: DataFrame) -> DataFrame:
    """file_path and Markdown text of the Markdown, text and HTML files of ``walk``; bytes that aren't UTF-8 are replaced."""
    reader = reader_of(F.col("file_path"))
    text = F.decode("content", "UTF-8")
    rows = files.withColumn("reader", reader)
    plain = rows.where("reader in ('markdown', 'text')").select("file_path", text.alias("text"))
    pages = rows.where("reader = 'html'").select("file_path", html_text(text).alias("text"))
    return plain.unionByName(pages)


def unsupported(files: DataFrame) -> DataFrame:
    """Files no reader takes, for the report of errors."""
    return files.where(reader_of(F.col("file_path")).isNull()).select("file_path", F.lit("unsupported format").alias("error"))


def page_range(text: str, pages: int) -> list[int]:
    """``1-3,5,8-`` to sorted page indexes from 0; pages beyond the end are skipped; ``ValueError`` for anything else."""
    out: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        hit = re.fullmatch(r"(\d+)(?:\s*(-)\s*(\d*))?", part)
        if not hit or int(hit[1]) < 1:
            raise ValueError(f"not a page range: {part!r}")
        first = int(hit[1])
        last = first if not hit[2] else int(hit[3] or pages)
        if last < first and hit[3]:
            raise ValueError(f"not a page range: {part!r}")
        out |= set(range(first - 1, min(last, pages)))
    return sorted(out)


def page_indexes(text: Column, pages: Column) -> Column:
    """``page_range`` as a Column; null where the text is not a page range."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(texts, counts):
            try:
                out.append(None if t is None else page_range(t, int(n)))
            except ValueError:
                out.append(None)
        return pd.Series(out)

    return run(text, pages)


def select_pages(rows: DataFrame, pages: list[int], column: str = "page") -> DataFrame:
    return rows.where(F.col(column).isin(pages))


def page_ir(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Blocks of page documents stored as JSON, one per file or with ``lines`` one per line (doc_id, pages of blocks with boxes, roles and
    text): doc, page, block_id, box, role, text."""
    schema = (
        "doc_id string, pages array<struct<page_index:int, blocks:array<struct<block_id:string, role:string, normalized_text:string, "
        "bbox:struct<x:double,y:double,width:double,height:double>>>>>"
    )
    docs = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    pages = docs.select(F.col("doc_id").alias("doc"), F.explode("pages").alias("p"))
    return pages.select("doc", F.col("p.page_index").alias("page"), F.explode("p.blocks").alias("b")).select("doc", "page", "b.block_id", "b.bbox.*", "b.role", F.col("b.normalized_text").alias("text"))


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as JSON lines, CSV or text (one string column)."""
    writer = rows.write.mode("overwrite")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "text": writer.text, "parquet": writer.parquet}[kind](path)
