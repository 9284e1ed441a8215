"""The page pipeline, the written text index, debouncing, joins by chunks and the scope of intermediates."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioframe.operators import retrieval as R, sheets as SH
from folioframe.operators.skew import meetings
from folioframe.plans import pages as PP
from folioframe.sources import files as FI
from folioframe.stash import Stash, exists, scope
from folioframe.streaming import changes as CH


def glyphs(doc, page, x, y, text, size=10.0, bold=False):
    return [(doc, page, c, x + i * size * 0.5, float(y), size * 0.5, size, size, bold) for i, c in enumerate(text) if c != " "]


def test_process_pages(spark):
    chars, rules = [], []
    for page in range(3):
        chars += glyphs("d", page, 60, 20, f"Annual report page {page + 1}") + glyphs("d", page, 60, 120, "Heading here", 20.0)
        chars += glyphs("d", page, 60, 200, "The text of this page begins here and goes") + glyphs("d", page, 60, 214, "on to the next line of the paragraph.")
    for r, row in enumerate((("name", "count"), ("alpha", "1"), ("beta", "2"))):
        for c, cell in enumerate(row):
            chars += glyphs("d", 0, 100 + 150 * c, 405 + 20 * r, cell)
    rules += [("d", 0, 90.0, y, 390.0, y) for y in (400.0, 420.0, 440.0, 460.0)] + [("d", 0, x, 400.0, x, 460.0) for x in (90.0, 240.0, 390.0)]
    chars += [(None, 0, "x", 1.0, 1.0, 1.0, 1.0, 1.0, False), ("d", None, "x", 1.0, 1.0, 1.0, 1.0, 1.0, False)]
    got = PP.process_pages(spark.createDataFrame(chars, PP.CHARS), spark.createDataFrame(rules, PP.LINES))
    tables = got.tables.collect()
    assert [(t["kind"], t["headers"], t["rows"]) for t in tables] == [("ruled", ["name", "count"], [["alpha", "1"], ["beta", "2"]])]
    blocks = {(r["page"], r["role"]): r["text"] for r in got.blocks.collect()}
    assert blocks[1, "Header"].startswith("Annual report") and blocks[1, "Title"] == "Heading here" and "alpha" not in "".join(blocks.values())
    pages = {r["page"]: r for r in got.pages.collect()}
    assert set(pages) == {0, 1, 2} and pages[2]["markdown"] == "# Heading here\n\nThe text of this page begins here and goes\non to the next line of the paragraph."
    lines = {r["text"] for r in got.lines.where("page = 0").collect()}
    assert any(t.endswith("name=alpha | count=1") for t in lines)


def test_process_pages_reads_ocr_where_there_is_no_text(spark):
    chars = spark.createDataFrame(glyphs("d", 0, 60, 120, "Enough text stands on the first page of this document to be read") * 2, PP.CHARS)
    ocr = spark.createDataFrame([("d", 0, 1, 60.0, 300.0, 100.0, 10.0, "Body", 10.0, "unused"), ("d", 1, 1, 60.0, 300.0, 300.0, 12.0, "Body", 10.0, "Read by a scanner.")], "doc string, page int, block_id bigint, x double, y double, width double, height double, role string, font double, text string")
    got = PP.process_pages(chars, ocr=ocr)
    assert {(r["page"], r["source"]) for r in got.pages.collect()} == {(0, "BornDigital"), (1, "Ocr")}
    assert [r["text"] for r in got.blocks.where("page = 1").collect()] == ["Read by a scanner."]
    assert PP.process_pages(chars.limit(0)).pages.count() == 0


def test_written_index_equals_the_search_without(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"c{i}", " ".join(rng.choice("file files filing search searches engine of 机器学习 stop".split()) for _ in range(rng.randint(0, 12))) or None, f"/a/files{i % 3}.md", [1.0]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "id string, text string, file_path string, vector array<double>")
    index = R.TextIndex.build(chunks, str(tmp_path / "index"))
    for fields in (R.FIELDS, R.WORDS):
        a = R.keyword_leg(chunks, "files search 机器学习", fields=fields).select("id", F.round("score", 6), "rank_k").collect()
        b = R.keyword_leg(index.chunks, "files search 机器学习", fields=fields, index=index).select("id", F.round("score", 6), "rank_k").collect()
        assert a and a == b
    one = spark.createDataFrame([("x", "the file alone", "/p/q.md", None), ("y", "nothing", "/p/r.md", None)], chunks.schema)
    assert [r["id"] for r in R.keyword_leg(one, "files", fields={"text_std": R.FIELDS["text_std"]}).collect()] == ["x"]
    assert R.keyword_leg(index.chunks, "the", fields=R.WORDS, index=index).count() == 0


def test_quiet_batches(spark):
    rng = random.Random(5)
    at = datetime(2025, 1, 1, 23, 58)
    times = []
    for _ in range(300):
        at += timedelta(seconds=rng.choice([1, 20, 59, 60, 61, 400, 7000]))
        times.append(at)
    rows = [(t, i) for i, t in enumerate(times)] + [(times[7], 999), (None, 1000)]
    got = CH.quiet_batches(spark.createDataFrame(rows, "ts timestamp_ntz, batch_in int"), 60)
    seen = sorted((r["ts"], r["batch"]) for r in got.collect())
    assert len(seen) == 301
    for (a, x), (b, y) in zip(seen, seen[1:]):
        assert (x == y) == (b - a <= timedelta(seconds=60)) and y in (x, x + 1)
    assert CH.quiet_batches(spark.createDataFrame([], "ts timestamp_ntz"), 60).count() == 0


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_meetings(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i) for i in range(60)]
    df = Stash(spark).put(spark.createDataFrame(rows, "g string, i int"))
    got = []
    for x, y, on in meetings(df, "g", "i", block):
        got += [tuple(r) for r in x.alias("x").join(y.alias("y"), on).select("x.i", "y.i").collect()]
    assert sorted(got) == sorted((i, j) for g, i in rows for h, j in rows if g is not None and g == h)


def test_intermediates_go_with_their_scope(spark):
    with scope():
        df = Stash(spark).put(spark.range(3))
        assert df.count() == 3 and exists(spark, df._stash_path)
    assert not exists(spark, df._stash_path)
    kept = Stash(spark).put(spark.range(3))
    assert kept.count() == 3


def test_a_stray_cell_makes_no_large_grid(spark):
    rows = [("f", "s", r, c, "str", v) for r, row in enumerate((("name", "n"), ("a", "1"), ("b", "2"))) for c, v in enumerate(row)] + [("f", "s", 1_048_575, 16_383, "str", "stray"), ("g", "s", 5, 5, "str", " ")]
    got = SH.data_blocks(spark.createDataFrame(rows, "file string, sheet string, row int, col int, kind string, raw string")).collect()
    assert [r["file"] for r in got] == ["f"] and got[0]["names"][:2] == ["name", "n"] and [r[:2] for r in got[0]["rows"]] == [["a", "1"], ["b", "2"]]


def test_page_indexes(spark):
    df = spark.createDataFrame([("1-3,5,8-",), ("x",), (None,)], "t string").select(FI.page_indexes(F.col("t"), F.lit(9)).alias("p"))
    assert [r["p"] for r in df.collect()] == [[0, 1, 2, 4, 7, 8], None, None]
