"""The indexing job: a folder of files to chunks, entities and relations, only what changed, and the tables it keeps.

Tables are Parquet folders under one root. A run reads the ledger, processes new and changed files, writes the new
version of each table beside the old one, and moves the pointer last, so a run that fails leaves everything as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioframe.operators import graph as G, sheets as SH, store as S, trees as TR
from folioframe.operators.incremental import changed_records
from folioframe.sources import files as FI, office as O
from folioframe.stash import Stash, scope

# The tables of an index and their columns.
TABLES = {
    "chunks": "id string, text string, vector array<float>, file_path string, parent_id string, breadcrumbs string, doc_type string",
    "entities": "entity_id string, name string, entity_type string, source_file string, chunk_id string",
    "relations": "from_entity string, to_entity string, relation_type string, source_file string, confidence double",
    "registry": "file_path string, content_hash string, last_modified bigint, index_version string, indexed_at bigint, size_bytes bigint",
    "errors": "file_path string, error string",
}
VERSION = "1"


class Index:
    """The tables of one index. ``current`` says which version of them counts; it is one small file, replaced at the end."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/current")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        path, fs = self._pointer()
        return self.spark.read.text(str(path)).first()[0] if fs.exists(path) else None

    def read(self, name: str) -> DataFrame:
        now = self.version()
        if now is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{now}/{name}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables as a new version, then make it the current one."""
        made = uuid.uuid4().hex
        for name, df in tables.items():
            df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.parquet(f"{self.root}/{made}/{name}")
        path, fs = self._pointer()
        out = fs.create(path, True)
        out.write(bytearray(made.encode()))
        out.close()

    def reset(self) -> None:
        path, fs = self._pointer()
        fs.delete(path.getParent(), True)


def parse_files(files: DataFrame, embed=None, threshold: int = 0) -> tuple[DataFrame, DataFrame]:
    """Chunks and errors of the files of ``walk``: heading trees of texts and office documents, each with an outline chunk,
    and two chunks per workbook (its tables, its words)."""
    office = O.office_texts(files)
    texts = FI.text_documents(files).unionByName(office.where("text is not null").select("file_path", "text"))
    nodes = TR.markdown_tree(texts, threshold=threshold)
    chunks = TR.chunks_of_trees(nodes, "text", embed)
    summaries = TR.outlines(nodes).select("id", "text", F.lit(None).cast("array<float>").alias("vector"), "file_path", F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("breadcrumbs"), F.lit("text").alias("doc_type"))
    cells = O.sheet_cells(files)
    tables = SH.sheet_chunks(SH.data_blocks(cells.where("kind != 'error'")))
    errors = office.where("error is not null").select("file_path", "error").unionByName(cells.where("kind = 'error'").select(F.col("file").alias("file_path"), F.col("raw").alias("error"))).unionByName(FI.unsupported(files))
    return chunks.unionByName(summaries).unionByName(tables), errors


def run(spark: SparkSession, folder: str, root: str, now: int, embed=None) -> dict[str, int]:
    """One run over ``folder``: new, changed and deleted files; returns how many of each. ``now`` in epoch seconds.

    Files whose time and size are those of the ledger are not opened, unless they were written within two seconds of the
    run that indexed them. The others are hashed, and only those whose hash the ledger hasn't finished are read again and parsed.
    """
    with scope():
        index, stash = Index(spark, root), Stash(spark)
        ledger = index.read("registry")
        listed = stash.put(FI.walk(spark, folder, content=False))
        same_parser = ledger.where(F.col("index_version") == VERSION)
        alike = listed.join(same_parser.select("file_path", "last_modified", "size_bytes", "indexed_at"), ["file_path", "last_modified", "size_bytes"])
        suspect = listed.join(alike.where("last_modified < indexed_at - 2").select("file_path"), "file_path", "left_anti")
        hashed = stash.put(FI.read_files(spark, folder, suspect).drop("content"))
        seen = hashed.select("file_path", "content_hash", F.timestamp_seconds("last_modified").cast("timestamp_ntz").alias("seen_at"), F.timestamp_seconds(F.lit(now)).cast("timestamp_ntz").alias("arrived_at"))
        todo = stash.put(changed_records(seen, same_parser))
        gone = stash.put(S.deleted_files(ledger, listed))
        counts = {"changed": todo.count(), "deleted": gone.count()}
        if not any(counts.values()):
            return counts
        work = FI.read_files(spark, folder, todo)
        chunks, errors = (stash.put(df) for df in parse_files(work, embed))
        replaced = todo.select("file_path").unionByName(gone)
        keep = lambda df, c: S.without_sources(df, replaced, c)
        mentions = stash.put(G.extract_entities(chunks))
        done = hashed.join(todo.select("file_path"), "file_path", "left_semi").select("file_path", F.lower("content_hash").alias("content_hash"), "last_modified", F.lit(VERSION).alias("index_version"), F.lit(now).cast("bigint").alias("indexed_at"), "size_bytes")
        index.commit({
            "chunks": keep(index.read("chunks"), "file_path").unionByName(chunks), "errors": keep(index.read("errors"), "file_path").unionByName(errors),
            "entities": keep(index.read("entities"), "source_file").unionByName(mentions),
            "relations": keep(index.read("relations"), "source_file").unionByName(G.cooccurrence_relations(mentions)),
            "registry": keep(ledger, "file_path").unionByName(done),
        })
        return counts


def unfinished_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages (doc, page) a job still has to do: those without a finished row in the page store (doc, page, status)."""
    return pages.join(done.where("status = 'Done'").select("doc", "page").distinct(), ["doc", "page"], "left_anti")


def search_all(searches: list[DataFrame], k: int = 10) -> DataFrame:
    """The best ``k`` hits over several indexes; ``index`` says which one a hit is from."""
    out = None
    for i, s in enumerate(searches):
        part = s.withColumn("index", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(F.desc("score"), "index", "id").limit(k)
