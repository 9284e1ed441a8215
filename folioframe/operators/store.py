"""The chunk store as tables: writes, deletions, upserts, state of files, and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioframe.functions import text as T
from folioframe.operators.graph import keep_latest

# What is indexed, what a listing calls unsupported, and names that are never indexed.
INDEXED = "md txt pdf docx pptx xlsx xls xlsm xlsb html".split()
WALKED = "md txt pdf xlsx xls xlsm xlsb".split()
TEMPORARY = "tmp temp swp swo bak part crdownload download lock".split()
CLASSES = {
    "markdown": "md markdown", "text": "txt log", "pdf": "pdf", "word": "doc docx", "excel": "xls xlsx xlsm xlsb csv", "powerpoint": "ppt pptx", "html": "html htm",
    "image": "png jpg jpeg gif bmp webp svg", "code": "rs py js ts java c cpp h go rb sh json toml yaml yml xml css sql",
}


def extension(path: Column) -> Column:
    name = T.file_name(path)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def should_index(path: Column) -> Column:
    """Names that are indexed: a known extension, and not hidden, temporary, an office lock or a system file."""
    name = T.file_name(path)
    bad = name.startswith(".") | name.startswith("~") | name.endswith("~") | F.lower(name).isin("thumbs.db", "desktop.ini") | extension(path).isin(*TEMPORARY)
    return ~bad & extension(path).isin(*INDEXED)


def file_class(path: Column) -> Column:
    """One of ten classes by extension; ``other`` if none fits."""
    ext = extension(path)
    out = F.lit("other")
    for name, exts in CLASSES.items():
        out = F.when(ext.isin(*exts.split()), name).otherwise(out)
    return out


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append, partitioned by kind of document, so that the route by kind prunes partitions."""
    chunks.write.mode("append").partitionBy("doc_type").parquet(path)


def without_file(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(~F.col("file_path").eqNullSafe(F.lit(path)))


def without_folder(rows: DataFrame, folder: str) -> DataFrame:
    """Without the files below a folder; a sibling that only begins with the same letters stays."""
    prefix = folder.rstrip("/") + "/"
    return rows.where(F.col("file_path").isNull() | ~F.col("file_path").startswith(prefix))


def without_sources(rows: DataFrame, gone: DataFrame, column: str = "source_file") -> DataFrame:
    """Entities or relations without those of the files in ``gone`` (file_path)."""
    return rows.join(gone.select(F.col("file_path").alias(column)).distinct(), column, "left_anti")


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Re-indexed files: everything of their paths is replaced, so no stale chunk stays."""
    return old.join(new.select("file_path").distinct(), "file_path", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Last writer wins on all columns."""
    both = old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    values = [F.hash(*[F.col(c) for c in old.columns])]
    return keep_latest(both, key, [F.col("__o"), *values]).drop("__o")


def file_states(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Listing of files with their state: Unsupported, Ignored, Unindexed, Outdated or Indexed, ordered by lower-case name.

    ``files``: file_path, content_hash. ``registry``: file_path, content_hash, indexed_at.
    """
    known = registry.select("file_path", F.col("content_hash").alias("old"), "indexed_at")
    j = files.join(known, "file_path", "left")
    state = (
        F.when(~extension(F.col("file_path")).isin(*INDEXED), "Unsupported").when(~should_index(F.col("file_path")), "Ignored").when(F.col("indexed_at").isNull(), "Unindexed")
        .when(~F.lower("content_hash").eqNullSafe(F.lower("old")), "Outdated").otherwise("Indexed")
    )
    return j.select("file_path", file_class(F.col("file_path")).alias("file_class"), state.alias("state")).orderBy(F.lower(T.file_name(F.col("file_path"))), "file_path")


def deleted_files(registry: DataFrame, seen: DataFrame, folder: str | None = None) -> DataFrame:
    """Registered files (below a folder) that the scan didn't see."""
    rows = registry if folder is None else registry.where(F.col("file_path").startswith(folder))
    return rows.join(seen.select("file_path").distinct(), "file_path", "left_anti").select("file_path").distinct()


def file_chunks(chunks: DataFrame, path: str, preview: int = 200) -> DataFrame:
    """The chunks of a file: each id once, a preview of the text, by id."""
    rows = chunks.where(F.col("file_path") == path)
    return rows.groupBy("id").agg(F.min("text").alias("text")).select("id", F.substring("text", 1, preview).alias("preview")).orderBy("id")


def all_texts(chunks: DataFrame) -> DataFrame:
    return chunks.where(~F.col("id").endswith("-doc-summary")).select("id", "text", "file_path")


def valid_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Paths whose cached tables are still those of the file: same modification time and size. Columns file_path, mtime, size."""
    return files.join(cache, ["file_path", "mtime", "size"], "left_semi").select("file_path")
