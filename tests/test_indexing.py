"""The indexing job end to end, and tables in a context."""

from pyspark.sql import functions as F

from folioframe.plans import indexing as I, sqltools as Q
from tests.test_documents import docx, xlsx


def test_index_runs(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "index")
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("# Alpha\nThe Rust Compiler uses LLVM.\n\n## Beta\nmore")
    (src / "sub/b.docx").write_bytes(docx())
    (src / "c.xlsx").write_bytes(xlsx())
    (src / "d.docx").write_bytes(b"PK\x03\x04broken")
    vector = lambda t: F.array(F.length(t).cast("float"))
    assert I.run(spark, str(src), root, 1_000, vector) == {"changed": 4, "deleted": 0}
    index = I.Index(spark, root)
    chunks = index.read("chunks")
    kinds = {r["id"].rsplit("/", 1)[-1] for r in chunks.collect()}
    assert {"a.md-1", "a.md-2", "a.md-doc-summary", "b.docx-1", "c.xlsx-tables", "c.xlsx-keywords"} <= kinds
    assert chunks.where("vector is not null and id like '%a.md-1'").count() == 1
    assert index.read("entities").where("entity_id = 'llvm'").count() == 1 and index.read("relations").count() > 0
    assert I.run(spark, str(src), root, 2_000) == {"changed": 0, "deleted": 0}
    (src / "a.md").write_text("# Gamma\nonly this")
    (src / "sub/b.docx").unlink()
    assert I.run(spark, str(src), root, 3_000) == {"changed": 1, "deleted": 1}
    assert {r["id"].rsplit("/", 1)[-1] for r in index.read("chunks").where("file_path like '%.md' or file_path like '%b.docx'").collect()} == {"a.md-1", "a.md-doc-summary"}
    assert index.read("entities").where("entity_id = 'llvm'").count() == 0 and index.read("registry").count() == 3
    index.reset()
    assert index.read("chunks").count() == 0


def test_pages_left_and_search_over_indexes(spark):
    pages = spark.createDataFrame([("d", 0), ("d", 1)], "doc string, page int")
    done = spark.createDataFrame([("d", 0, "Done"), ("d", 1, "Failed")], "doc string, page int, status string")
    assert [r["page"] for r in I.unfinished_pages(pages, done).collect()] == [1]
    a = spark.createDataFrame([("x", 1.0)], "id string, score double")
    assert [(r["id"], r["index"]) for r in I.search_all([a, a.withColumn("score", F.lit(2.0))]).collect()] == [("x", 1), ("x", 0)]


def test_tables_in_a_context(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("name"), F.col("id").alias("n"))
    assert Q.needs_sql(df, 100) and not Q.needs_sql(df, 10_000)
    assert len(Q.injected(df, 10).split("\n")) == 5 and len(Q.injected(df, 10_000).split("\n")) == 32
    assert Q.largest_first({"a": df.limit(2), "b": df}) == [("b", 40), ("a", 2)]
    bars = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert Q.chart_of(bars) == {"type": "bar", "label": "k", "series": ["v"]} and Q.chart_of(df.select("name")) is None and Q.chart_of(bars.limit(0)) is None


def test_cached_tables(spark):
    df = spark.range(3)
    try:
        assert len(Q.cache_tables(spark, "/x/a.xlsx", {("S", 0): df, ("S", 1): df})) == 2
        assert Q.cache_tables(spark, "/x/a.xlsx", {("S", 0): df.limit(1)}) == Q.cached_tables(spark, "/x/a.xlsx")
        assert spark.table(f"`{Q.cached_tables(spark, '/x/a.xlsx')[0]}`").count() == 1
    finally:
        Q.drop_cached(spark, "/x/a.xlsx")
    assert Q.cached_tables(spark, "/x/a.xlsx") == []
