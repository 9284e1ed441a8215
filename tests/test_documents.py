"""Sheets, trees, pages, files, office formats, streams, SQL tools and retrieval on small fixtures."""

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioframe.operators import graph as G, page_tables as PT, pages as P, retrieval as R, sheets as SH, store as S, trees as TR
from folioframe.plans import sqltools as Q
from folioframe.sources import files as FI, office as O
from folioframe.streaming import changes as C

SALES = [["产品", "销量", "金额"], ["A", "100", "15000.5"], ["B", "200", "30000.0"], ["A", "150", "22500.0"], ["C", "80", "12000.0"]]


def cells(spark, grid, file="f.xlsx", sheet="Sheet1"):
    rows = [(file, sheet, i, j, "str", v) for i, r in enumerate(grid) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "file string, sheet string, row int, col int, kind string, raw string")


# -- sheets -----------------------------------------------------------------------------------------------------------
def test_sales_block(spark):
    blocks = SH.data_blocks(cells(spark, SALES))
    row = blocks.first()
    assert row["names"] == SALES[0] and row["types"] == ["String", "Int", "Float"] and row["row_count"] == 4
    views = SH.register(spark, blocks)
    assert list(views) == ["Sheet1"]
    assert spark.sql("SELECT * FROM Sheet1").count() == 4
    out, steps = Q.run_script(spark, "SELECT `产品` AS p, sum(`销量`) AS s FROM Sheet1 GROUP BY 1; SELECT * FROM step_0 WHERE s > 100 -- ; not a split")
    assert steps == 1 and {tuple(r) for r in out.collect()} == {("A", 250), ("B", 200)}
    assert "产品 (String)" in SH.profiles(blocks).first()["text"]


def test_block_rules():
    assert SH.column_names([["Name", "Value", "Name", "Value", "Name"]], 5) == ["Name", "Value", "Name_2", "Value_2", "Name_3"]
    assert SH.column_names([["2024", "", "x"], ["Q1", "Q2", "x"]], 3) == ["2024_Q1", "2024_Q2", "x"]
    rows = [["Alice", "25", "3.14", "true", "2024-01-15"], ["Bob", "30", "2.71", "false", "2024-02-20"]]
    assert [SH.column_type([r[i] for r in rows]) for i in range(5)] == ["String", "Int", "Float", "Bool", "DateTime"]
    assert SH.column_type(["", " "]) == "Empty" and SH.column_type(["1", "x"]) == "String" and SH.column_type(["true", "1"]) == "Int"
    two = [["a", "b"], ["1", "2"], ["3", "4"], ["", ""], ["c", "d"], ["5", "6"], ["7", "8"]]
    assert SH.block_ranges(two) == [(0, 3), (4, 7)]
    assert SH.block_ranges([["a", "b"], ["1", "2"], ["", ""], ["3", "4"]]) == [(0, 4)]
    report = [["Dep", "A", "B", "C", "D"], ["x", "1", "2", "3", "4"], ["", "5", "6", "7", "8"], ["备注：none", "", "", "", ""]]
    (_, names, _, data), = SH.sheet_blocks(report)
    assert names[0] == "Dep" and [r[0] for r in data] == ["x", "x"]


def test_empty_sheet(spark):
    assert SH.data_blocks(cells(spark, [["", ""], ["", ""]])).count() == 0
    assert SH.data_blocks(cells(spark, SALES).limit(0)).count() == 0


# -- SQL tools --------------------------------------------------------------------------------------------------------
def test_sql_tools(spark):
    assert Q.statements("a; b ';' ; -- c;\n d") == ["a", "b ';'", "d"]
    with pytest.raises(ValueError):
        Q.checked("DROP TABLE x")
    df = spark.createDataFrame([(1, 2.5, None), (2, 3.0, "x")], "a int, b double, c string")
    assert Q.markdown(df.orderBy("a")).split("\n")[2:] == ["| 1 | 2.5 | NULL |", "| 2 | 3 | x |"]
    assert Q.markdown(df.limit(0)) == Q.EMPTY
    big = spark.range(150).select(F.col("id").cast("string").alias("v"))
    assert Q.summary(big)[0] == "summary" and Q.summary(big)[2] == 150 and Q.summary(df)[0] == "full"
    assert Q.safe_table_name("a b", 2) == "a_b_block2" and Q.cache_table_name("x", "表 1").startswith("f") and Q.pages(41) == 3
    assert Q.fnv1a32(b"") == 0x811C9DC5 and Q.fnv1a32(b"a") == 0xE40C292C
    assert Q.listing_sql("how many?", {"t": ["name"]}) is None
    answers = iter(["SELECT nope FROM values_t", "```sql\nSELECT 1 AS x\n```"])
    assert Q.answer_table(spark, "sum", {"t": ["a"]}, lambda _: next(answers)).first()["x"] == 1


# -- trees ------------------------------------------------------------------------------------------------------------
MD = "intro\n\n# One\ntext a\n\n```\n# not a heading\n```\n\n## One.One\nb\n\n### Deep\nc\n\n## One.Two\nd\n\n# Two\ne"


def test_tree(spark):
    nodes = TR.markdown_tree(spark.createDataFrame([("/x/a.md", MD), ("/x/b.md", None), ("/x/c.md", "### only\nx\n### more"), (None, "# x")], "file_path string, text string"))
    a = {r["title"]: r for r in nodes.where("file_path = '/x/a.md'").collect()}
    assert set(a) == {"a.md", "One", "One.One", "Deep", "One.Two", "Two"}
    assert a["Deep"]["breadcrumbs"] == ["a.md", "One", "One.One"] and a["One"]["content"].startswith("# One\ntext a") and a["One.Two"]["parent_id"] == a["One"]["id"]
    assert nodes.where("file_path = '/x/b.md'").count() == 1
    assert [r["parent_id"] for r in nodes.where("file_path = '/x/c.md' and ordinal > 0").collect()] == ["/x/c.md-0"] * 2
    chunks = TR.chunks_of_trees(nodes).where("file_path = '/x/a.md'")
    assert chunks.count() == 6 and chunks.where("breadcrumbs = 'a.md > One'").count() == 2
    text = TR.outlines(nodes).where("file_path = '/x/a.md'").first()["text"]
    assert text.startswith("# a.md\nintro\n- One: text a\n  - One.One: b\n    - Deep: c")
    assert nodes.select(TR.enriched_text().alias("e")).where("e like '%Section: a.md > One > One.One%'").count() >= 1


def test_thin():
    def node(level, parent, n):
        return {"level": level, "title": "", "parent": parent, "content": "w " * n, "page": None}

    assert [TR.count_tokens(n["content"]) for n in TR.thin([node(0, None, 10), node(1, 0, 30), node(1, 0, 30)], 50)] == [10, 30, 30]
    nested = TR.thin([node(0, None, 100), node(1, 0, 10), node(2, 1, 20)], 50)
    assert [TR.count_tokens(n["content"]) for n in nested] == [100, 30] and nested[1]["parent"] == 0


def test_page_tree(spark):
    pages = spark.createDataFrame([("d", 2, "goes on\n\n## Section 1.1\nx"), ("d", 1, "# Introduction\nstart")], "file_path string, page int, content string")
    rows = {r["title"]: r for r in TR.page_tree(pages).collect()}
    assert "goes on" in rows["Introduction"]["content"] and rows["Section 1.1"]["page"] == 2 and rows["Section 1.1"]["parent_id"] == rows["Introduction"]["id"]


# -- pages ------------------------------------------------------------------------------------------------------------
B = "doc string, page int, block_id string, x double, y double, width double, height double, role string, text string"


def blocks(spark, rows):
    return spark.createDataFrame([(*r[:3], *(None if v is None else float(v) for v in r[3:7]), *r[7:]) for r in rows], B)


def test_glyphs_to_blocks(spark):
    def line(text, x, y, size=10.0):
        return [("d", 0, c, float(x + 6 * i), float(y), 6.0, size, size, False) for i, c in enumerate(text) if c != " "]

    chars = line("Big", 72, 30, 20.0) + line("hello world", 72, 100) + line("second line", 72, 112) + line("apart", 72, 200)
    df = spark.createDataFrame(chars, "doc string, page int, ch string, x double, y double, width double, height double, font_size double, bold boolean")
    got = [(r["role"], r["text"]) for r in P.blocks_from_chars(df).orderBy("block").collect()]
    assert got == [("Title", "Big"), ("Body", "hello world\nsecond line"), ("Body", "apart")]
    assert P.blocks_from_chars(df.limit(0)).count() == 0


def test_reading_order(spark):
    rows = [("d", 0, "a", 50, 50, 200, 300, "Body", "left"), ("d", 0, "b", 320, 40, 200, 300, "Body", "right"), ("d", 0, "c", 50, 10, 470, 20, "Title", "top")]
    got = {r["block_id"]: r["position"] for r in P.reading_order(blocks(spark, rows)).collect()}
    assert got == {"c": 0, "a": 1, "b": 2}


def test_filters(spark):
    rows = [
        ("d", 0, "n", 72, 100, 100, 10, "Body", "....\n---"), ("d", 0, "p", 300, 760, 20, 9, "PageNumber", "- 3 -"), ("d", 0, "w", 100, 300, 400, 100, "Body", "CONFIDENTIAL"),
        ("d", 0, "t", 72, 120, 400, 40, "Body", "plain text\n***"), ("d", 0, None, None, None, None, None, None, None),
        *[("d", 0, f"l{i}", 100 + 20 * i, 500, 15, 8, "Body", f"{i}0%") for i in range(4)],
    ]
    got = {r["block_id"]: r["text"] for r in P.postprocess(blocks(spark, rows)).collect()}
    assert got == {"p": "- 3 -", "t": "plain text"}


def test_headers(spark):
    rows = []
    for page in range(3):
        rows += [("d", page, f"h{page}", 72, 20, 300, 10, "Body", f"Annual report - {page + 1}"), ("d", page, f"b{page}", 72, 100, 300, 50, "Body", f"text {page}"), ("d", page, f"f{page}", 290, 770, 20, 9, "Body", str(page + 1))]
    got = {r["block_id"]: r["role"] for r in P.mark_headers_footers(blocks(spark, rows)).collect()}
    assert all(got[f"h{i}"] == "Header" and got[f"f{i}"] == "Footer" and got[f"b{i}"] == "Body" for i in range(3))


def test_orphans_and_urls(spark):
    rows = [("d", 0, "a", 72, 100, 300, 20, "Body", "this goes on and"), ("d", 0, "b", 72, 125, 40, 10, "Body", "ends."), ("d", 0, "c", 72, 300, 40, 10, "Body", "Next.")]
    assert {(r["block_id"], r["text"]) for r in P.merge_orphans(blocks(spark, rows)).collect()} == {("a", "this goes on andends."), ("c", "Next.")}
    spans = F.array(F.lit("see"), F.lit("https://a.b/"), F.lit("c/d.html"), F.lit("now"))
    assert spark.range(1).select(P.merge_url_spans(spans).alias("x")).first()["x"] == ["see", "https://a.b/c/d.html", "now"]


def test_boxes(spark):
    b = blocks(spark, [("d", 0, "in", 10, 10, 10, 10, "Body", "x"), ("d", 0, "out", 200, 200, 10, 10, "Body", "y")])
    t = spark.createDataFrame([("d", 0, "t", 0.0, 0.0, 100.0, 100.0, "ruled", 2)], "doc string, page int, table_id string, x double, y double, width double, height double, kind string, rows int")
    assert [r["block_id"] for r in P.outside_tables(b, t).collect()] == ["out"]
    assert P.unobscured_tables(t, b).count() == 1
    r = spark.createDataFrame([("d", 0, "Table", 0.9, 9.0, 9.0, 12.0, 12.0), ("d", 0, "Table", 0.5, 10.0, 10.0, 12.0, 12.0), ("d", 0, "Text", 0.4, 10.0, 10.0, 12.0, 12.0)], "doc string, page int, label string, confidence double, x double, y double, width double, height double")
    assert P.suppress_overlaps(r).count() == 2
    assert P.label_blocks(b, r.where("confidence < 0.45")).orderBy("block_id").select("label").first()["label"] == "Text"
    n = spark.createDataFrame([("d", 0, 1, 50.0)], "doc string, page int, noise_id int, y double")
    rows = spark.createDataFrame([("d", 0, 1, 40.0), ("d", 0, 2, 60.0), ("d", 0, 3, 90.0)], "doc string, page int, row_id int, y double")
    assert P.nearest_rows(n, rows).first()["row_id"] == 1


def test_page_scores(spark):
    rows = [("d", 0, "a", 72, 72, 468, 600, "Body", "A long readable text. " * 40), ("d", 1, "b", 72, 72, 10, 10, "Body", "�" * 30)]
    got = {r["page"]: r for r in P.page_scores(blocks(spark, rows)).collect()}
    assert got[0]["score"] > 0.7 and got[0]["flags"] == [] and got[1]["score"] < 0.4 and "garbled" in got[1]["flags"]


def test_tables(spark):
    lines = [("d", 0, 0.0, y, 200.0, y) for y in (0.0, 20.0, 40.0)] + [("d", 0, x, 0.0, x, 40.0) for x in (0.0, 100.0, 200.0)]
    ldf = spark.createDataFrame(lines, "doc string, page int, x1 double, y1 double, x2 double, y2 double")
    chars = [("d", 0, c, x, y, 6.0, 10.0) for c, x, y in (("a", 10.0, 5.0), ("b", 110.0, 5.0), ("1", 10.0, 25.0), ("2", 110.0, 25.0))]
    cdf = spark.createDataFrame(chars, "doc string, page int, ch string, x double, y double, width double, height double")
    t = PT.ruled_tables(ldf, cdf).first()
    assert t["kind"] == "ruled" and t["headers"] == ["a", "b"] and t["rows"] == [["1", "2"]] and t["confidence"] is None
    pieces = [("e", 0, 100.0 * j, 15.0 * i, 40.0, 10.0, f"r{i}c{j}") for i in range(4) for j in range(3)]
    s = PT.stream_tables(spark.createDataFrame(pieces, "doc string, page int, x double, y double, width double, height double, text string")).first()
    assert s["headers"] == ["r0c0", "r0c1", "r0c2"] and len(s["rows"]) == 3 and s["confidence"] > 0.9
    assert PT.html_rows("<table><tr><th colspan=2>A</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table>") == [["A", "A"], ["1", "2"], ["1", "3"]]
    assert PT.html_rows(None) == [] and PT.text_table("a  b  c  d\n1  2  3  4\n5  6  7  8")[1] == ["1", "2", "3", "4"]
    text = spark.range(1).select(PT.markdown_rows(F.lit("x\n| a | b |\n|---|---|\n| 1 | 2 |")).alias("r"), PT.fallback_text(F.array(F.lit("h")), F.array(F.array(F.lit("v"))), F.lit(0.1)).alias("f")).first()
    assert text["r"] == [["a", "b"], ["1", "2"]] and text["f"] == "row 1: h=v\n[low confidence]"
    paths = spark.createDataFrame([("d", 0, 100.0 + 10 * (i % 12), 100.0 + 10 * (i // 12)) for i in range(240)], "doc string, page int, x double, y double")
    assert PT.figure_regions(paths).count() == 1 and PT.figure_regions(paths.limit(5)).count() == 0


# -- files and office formats -----------------------------------------------------------------------------------------
def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


NS_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
NS_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def docx():
    p = lambda text, style="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    bold = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bo</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>ld</w:t></w:r><w:r><w:t xml:space=\"preserve\"> end</w:t></w:r></w:p>"
    return archive({
        "[Content_Types].xml": "wordprocessingml.document", "word/document.xml": f"<w:document {NS_W}><w:body>{p('Title', 'H1')}{p('text')}{bold}{table}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {NS_W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    })


def xlsx():
    return archive({
        "[Content_Types].xml": "spreadsheetml.sheet", "xl/workbook.xml": f'<workbook {NS_S}><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="r1" Target="worksheets/sheet1.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {NS_S}><si><t>name</t></si><si><r><t>da</t></r><r><t>te</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {NS_S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {NS_S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c><c r="B3" s="1"><v>45292</v></c><c r="C3" t="b"><v>1</v></c><c r="D3"><v>2.50</v></c></row></sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells></worksheet>',
    })


def test_office(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "sub/b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.md").write_text("# Hi\nthere")
    (tmp_path / "d.html").write_text("<h2>T</h2><script>x</script><p>body</p><ul><li>i</li></ul>")
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04nonsense")
    (tmp_path / "~lock.md").write_text("x")
    files = FI.walk(spark, str(tmp_path))
    assert files.count() == 5
    texts = {r["file_path"].rsplit("/", 1)[-1]: r["text"] for r in O.office_texts(files).collect()}
    assert texts == {"a.docx": "# Title\n\ntext\n\n**bold** end\n\n| a | b |\n|---|---|\n| 1 |  |"}
    cells_ = {(r["row"], r["col"]): (r["kind"], r["raw"]) for r in O.sheet_cells(files).collect()}
    assert cells_ == {(0, 0): ("s", "name"), (0, 1): ("s", "date"), (2, 0): ("inlineStr", "x"), (2, 1): ("d", "2024-01-01"), (2, 2): ("b", "true"), (2, 3): ("n", "2.5"), (3, 0): ("inlineStr", "x")}
    md = {r["file_path"].rsplit("/", 1)[-1]: r["text"] for r in FI.text_documents(files).collect()}
    assert md == {"c.md": "# Hi\nthere", "d.html": "## T\n\nbody\n\n- i"}
    assert O.sniff(b"nope") is None


def test_pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr>{f"""<p:ph type="{kind}"/>""" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    data = archive({
        "[Content_Types].xml": "presentationml.presentation", "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="r1" Target="slides/slide1.xml"/>'), "ppt/slides/slide1.xml": f"<p:sld {ns}>{shape('title', 'Head')}{shape('', 'body')}</p:sld>",
    })
    assert O.read_pptx(data) == "## Head\n\nbody"


@pytest.mark.parametrize("text, want", [("3", [2]), ("1-5", [0, 1, 2, 3, 4]), ("1,3,5", [0, 2, 4]), ("1-3,5,8-10", [0, 1, 2, 4, 7, 8, 9]), ("8-", [7, 8, 9]), ("9-15", [8, 9])])
def test_page_range(text, want):
    assert FI.page_range(text, 10) == want


def test_page_range_errors():
    for bad in ("0", "a", "5-3", ""):
        with pytest.raises(ValueError):
            FI.page_range(bad, 10)


def test_page_ir(spark, tmp_path):
    doc = {"doc_id": "d", "pages": [{"page_index": 0, "blocks": [{"block_id": "b", "role": "Body", "normalized_text": "t", "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert tuple(FI.page_ir(spark, str(tmp_path)).first()) == ("d", 0, "b", 1.0, 2.0, 3.0, 4.0, "Body", "t")


# -- streams ----------------------------------------------------------------------------------------------------------
def test_pending(spark):
    t = lambda s: datetime(2025, 1, 1, 0, 0, s)
    ev = [(t(1), "a", "modify"), (t(2), "a", "remove"), (t(1), "b", "remove"), (t(2), "b", "create"), (t(1), "c", "modify"), (t(2), "c", "modify")]
    got = {r["path"]: (r["remove"], r["update"]) for r in C.pending(spark.createDataFrame(ev, C.EVENTS)).collect()}
    assert got == {"a": (True, False), "b": (True, True), "c": (False, True)}
    batches = C.debounced(spark.createDataFrame([(t(1), "a", "modify"), (t(9), "b", "modify")], C.EVENTS))
    assert batches.count() == 2


def test_stream_applies_in_order_and_once(spark, tmp_path):
    src, ckpt = tmp_path / "in", tmp_path / "ckpt"
    src.mkdir()
    (src / "1.json").write_text('{"ts":"2025-01-01T00:00:01","path":"a","kind":"create"}\n{"ts":"2025-01-01T00:00:02","path":"b","kind":"remove"}\n')
    log = []

    def go():
        q = C.apply_changes(
            C.event_stream(spark, str(src)), str(ckpt), lambda d: log.append(("remove", sorted(r[0] for r in d.collect()))), lambda d: log.append(("update", sorted(r[0] for r in d.collect()))), lambda d, n: log.append(("confirm", n))
        )
        q.awaitTermination(60)

    go()
    assert log == [("remove", ["b"]), ("update", ["a"]), ("confirm", 0)]
    go()
    assert len(log) == 3  # nothing new, nothing repeated
    (src / "2.json").write_text('{"ts":"2025-01-01T00:00:03","path":"c","kind":"modify"}\n')
    go()
    assert log[3:] == [("remove", []), ("update", ["c"]), ("confirm", 1)]


def test_event_windows_drop_late_rows(spark, tmp_path):
    src = tmp_path / "ev"
    schema = "ts timestamp, event_type string, user_id bigint, value double"
    rows = lambda *m: spark.createDataFrame([(datetime(2025, 1, 1, h, i), "click", 1, 1.0) for h, i in m], schema)
    rows((0, 5), (0, 30)).coalesce(1).write.json(str(src / "1"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(src))
    q = C.windowed_counts(stream, "1 hour").writeStream.format("memory").queryName("win_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        rows((3, 0)).coalesce(1).write.json(str(src / "2"))
        q.processAllAvailable()
        rows((0, 10), (6, 0)).coalesce(1).write.json(str(src / "3"))  # the first is too late
        q.processAllAvailable()
        got = {(r["start"].hour, r["n"]) for r in spark.table("win_out").collect()}
    finally:
        q.stop()
    assert got == {(0, 2), (3, 1)}


# -- retrieval and graph ----------------------------------------------------------------------------------------------
CH = "id string, text string, vector array<double>, file_path string, parent_id string, breadcrumbs string, doc_type string"


def test_hybrid_golden(spark):
    """Four chunks whose ranks are known by hand."""
    rows = [
        ("a", "rust engine", [1.0, 0.0], "/f/x.md", None, None, "text"), ("b", "rust", [0.8, 0.6], "/f/x.md", None, None, "text"),
        ("c", "other words", [0.6, 0.8], "/f/y.md", None, None, "text"), ("d", "nothing", [-1.0, 0.0], "/f/y.md", None, None, "text"), ("e", None, None, "/f/y.md", None, None, "text"),
    ]
    chunks = spark.createDataFrame(rows, CH)
    one = {"text_std": R.FIELDS["text_std"]}
    got = {r["id"]: (r["source"], r["rank_v"], r["rank_k"], round(r["score"], 4)) for r in R.hybrid_search(chunks, [1.0, 0.0], "rust", threshold=0.9, fields=one).collect()}
    assert got["a"] == ("Hybrid", 1, 2, round(6100 * (0.6 / 61 + 0.4 / 62), 4))
    assert got["b"][0] == "Keyword" and got["b"][2] == 1  # cut from the vector leg, whose nearest lies at 0
    assert set(got) == {"a", "b"}
    assert R.keyword_leg(chunks, "", fields=one).count() == 0
    assert R.hybrid_search(chunks.limit(0), [1.0, 0.0], "rust", fields=one).count() == 0


def test_merge_results(spark):
    s = "id string, score double, source string"
    a = spark.createDataFrame([("a", 90.0, "Vector"), ("b", 80.0, "Keyword")], s)
    b = spark.createDataFrame([("b", 85.0, "Vector"), ("c", 70.0, "Vector")], s)
    assert {tuple(r) for r in R.merge_results(a, b).collect()} == {("a", 90.0, "Vector"), ("b", 85.0, "Hybrid"), ("c", 70.0, "Vector")}


def test_sibling_order(spark):
    rows = [(f"f-{i}", f"t{i}", None, "f", "p", "A > B", "text") for i in (1, 2, 10)]
    got = {r["id"]: r["context"] for r in R.sibling_context(spark.createDataFrame(rows, CH)).collect()}
    assert got["f-2"] == "[上级] B\n[前文] t1\n[后文] t10" and got["f-10"] == "[上级] B\n[前文] t2"


def test_budget_and_choice(spark):
    rows = spark.createDataFrame([("a", 9.0, "xxxx", "text"), ("b", 8.0, "xxxxxxxxxx", "text"), ("c", 7.0, "xx", "tabular"), *[(f"t{i}", 1.0, "x", "text") for i in range(5)]], "id string, score double, text string, doc_type string")
    assert [r["id"] for r in R.within_budget(rows.where("score > 5"), 7).orderBy("id").collect()] == ["a", "c"]
    assert {r["doc_type"] for r in R.display_choice(rows).collect()} == {"text", "tabular"} and R.display_choice(rows).count() == 5


def test_entities(spark):
    text = 'The Rust compiler uses LLVM. 「知识图谱」 and “vector search” and "a b c d e f"'
    names = spark.range(1).select(G.entity_names(F.lit(text)).alias("n")).first()["n"]
    assert set(names) == {"Rust", "LLVM", "知识图谱", "vector search"}
    m = spark.createDataFrame([(1, "x", "X", "concept"), (2, "x", "Y", "person"), (3, None, "Z", "person"), (4, "y", None, None)], "mention_id int, entity_id string, name string, entity_type string")
    assert {tuple(r) for r in G.distinct_entities(m, F.col("mention_id")).collect()} == {("x", "X", "Person", 2), ("y", None, "Concept", 1)}
    chunks = spark.createDataFrame([("c", "word " * 60, "f"), ("d", "Short Text", "f")], "id string, text string, file_path string")
    said = G.extract_with_model(chunks, lambda t: F.lit('{"entities":[{"name":"Spark","type":"tool"}],"relations":[]}'))
    assert {(r["entity_id"], r["chunk_id"]) for r in said.collect()} == {("spark", "c"), ("short", "d"), ("text", "d")}


def test_store(spark):
    rows = spark.createDataFrame([("a", "/x/1.md"), ("b", "/x/1.md"), ("c", "/xy/2.md"), ("d", None)], "id string, file_path string")
    assert S.without_file(rows, "/x/1.md").count() == 2 and S.without_folder(rows, "/x").count() == 2
    new = spark.createDataFrame([("z", "/x/1.md")], "id string, file_path string")
    assert {r["id"] for r in S.replace_files(rows, new).collect()} == {"z", "c", "d"}
    assert {tuple(r) for r in S.upsert(rows.limit(1), spark.createDataFrame([("a", "/new")], rows.schema), ["id"]).collect()} == {("a", "/new")}
    names = {".x.md": False, "~$a.docx": False, "a.tmp": False, "a.MD": True, "a.docx": True, "Thumbs.db": False, "a": False}
    df = spark.createDataFrame([(k,) for k in names], "p string")
    assert {r["p"]: r["ok"] for r in df.select("p", S.should_index(F.col("p")).alias("ok")).collect()} == names
