"""Text and value functions against the expectations of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as T, values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "query, want",
    [("rust语言  教程", "rust 语言 教程"), ("a b a", "a b"), ("机器learning", "机器 learning"), ("", ""), ("the the", "the the"), ("ok ok ok", "ok")],
)
def test_preprocess_query(spark, query, want):
    assert one(spark, T.preprocess_query(F.lit(query))) == want


def test_query_terms(spark):
    # every word over two characters also gives its pairs, as the reference has it
    pairs = [w[i : i + 2] for w in ("does", "index", "work", "机器学习") for i in range(len(w) - 1)]
    assert one(spark, T.query_terms(F.lit("How does (the) 2024 index+ work? 机器学习"))) == ["does", "index", "work", "机器学习", *pairs]
    assert one(spark, T.query_terms(F.lit(""))) == []


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("hopping", "hop"), ("agreed", "agre"), ("relational", "relat"), ("at", "at"), ("über", "über")])
def test_stem(word, stem):
    assert T.stem(word) == stem


def test_analyzers(spark):
    assert one(spark, T.unicode_tokens(F.lit("Hello 世界 v2"))) == ["hello", "世", "界", "v2"]
    assert one(spark, T.segmented_tokens(F.lit("机器学习 ok 学"))) == ["机器", "器学", "学习", "ok", "学"]
    assert one(spark, T.stemmed_tokens(F.lit("The indexes are running"))) == ["index", "run"]
    assert one(spark, T.stemmed_tokens(F.lit(None).cast("string"))) is None


def test_paths(spark):
    p = F.lit("/Users/me/Work/garden/src/plan.md")
    assert one(spark, T.path_tags(p)) == "me Work garden src" and one(spark, T.file_name(p)) == "plan.md"
    assert one(spark, T.path_tags(F.lit("x.md"))) == ""


def test_truncation(spark):
    assert one(spark, T.truncate_text(F.lit("Chinese 中文字"), 9)) == "Chinese 中..."
    assert one(spark, T.truncate_text(F.lit("short"), 9)) == "short"
    assert one(spark, T.truncate_bytes(F.lit("a中文"), F.lit(5))) == "a中"
    assert one(spark, T.token_count(F.lit(" a  b\nc "))) == 3 and one(spark, T.token_count(F.lit(None).cast("string"))) == 0


def test_clean(spark):
    text = F.lit("• one two​\n\n\n\nPage 3 of 9\nIntro ........ 12\n*\n“end”")
    assert one(spark, T.clean(text)) == '- one two\n\n*\n"end"'
    assert one(spark, T.clean(text, "aggressive")) == '- one two\n\n"end"'
    assert one(spark, T.mojibake_lines(F.lit("ok\nschÃ¶n"))) == [2]


@pytest.mark.parametrize("a, b, s", [("abcd", "abcd", 1.0), ("abcd", "abce", 2 * 2 / 6), ("a", "b", 0.0), ("", "x", 0.0)])
def test_bigram_similarity(spark, a, b, s):
    assert one(spark, T.bigram_similarity(F.lit(a), F.lit(b))) == pytest.approx(s)


def test_predicates(spark):
    assert one(spark, T.ends_incomplete(F.lit("and the"))) and not one(spark, T.ends_incomplete(F.lit("done.")))
    assert one(spark, T.is_list_item(F.lit("1. x"))) == "ordered" and one(spark, T.is_list_item(F.lit("- x"))) == "unordered" and one(spark, T.is_list_item(F.lit("x"))) is None
    assert one(spark, T.is_url_start(F.lit("https://a.b"))) and one(spark, T.is_email(F.lit("a@b.cd"))) and not one(spark, T.is_email(F.lit("a@b")))
    assert one(spark, T.numbered_heading_level(F.lit("2.1 Method"))) == 2 and one(spark, T.numbered_heading_level(F.lit("21"))) is None
    assert one(spark, T.key_value(F.lit("Name: Alice"))) == ("Name", "Alice")
    assert one(spark, T.strip_fences(F.lit("<think>a</think>\n```sql\nSELECT 1\n```"))) == "SELECT 1"
    assert one(spark, T.strip_page_number(F.lit("Report - 12"))) == "report" and one(spark, T.strip_page_number(F.lit("12"))) == ""


@pytest.mark.parametrize(
    "cell, kind",
    [("97.0%", "Percent"), ("$1,200", "Currency"), ("300元", "Currency"), ("2024-01-15", "Date"), ("1,747", "Number"), ("(12)", "Number"), ("abc", "Text"), (" ", "Unknown"), (None, "Unknown")],
)
def test_cell_type(spark, cell, kind):
    assert one(spark, T.cell_type(F.lit(cell).cast("string"))) == kind


@pytest.mark.parametrize("serial, want", [(45292.0, "2024-01-01"), (45292.5, "2024-01-01 12:00:00"), (0.5, None), (59.0, "1900-02-28"), (61.0, "1900-03-01")])
def test_excel_date(spark, serial, want):
    assert one(spark, V.excel_date(F.lit(serial))) == want


@pytest.mark.parametrize("x, want", [(42.0, "42"), (3.14, "3.14"), (2024.0, "2024"), (0.1234567, "0.123457"), (None, None)])
def test_cell_number(spark, x, want):
    assert one(spark, V.cell_number(F.lit(x).cast("double"))) == want


def test_scores(spark):
    assert one(spark, V.rrf_score(F.lit(1), F.lit(1))) == pytest.approx(100.0)
    assert one(spark, V.rrf_score(F.lit(1), F.lit(None).cast("int"))) == pytest.approx(60.0)
    assert one(spark, V.similarity(F.lit(3.0))) == 0.0 and one(spark, V.squared_l2(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 25.0


def test_json(spark):
    answer = 'Sure! ```json\n{"entities": [{"name": "Rust", "type": "tool"}], "relations": []}\n``` done'
    got = one(spark, V.parse_graph_answer(F.lit(answer)))
    assert got["entities"][0]["name"] == "Rust" and one(spark, V.entity_type(F.lit("tool"))) == "Technology"
    assert one(spark, V.parse_graph_answer(F.lit("no json"))) is None
    assert V.first_json_object('x {bad} {"a": {"b": 1}} y') == '{"a": {"b": 1}}'


def test_merge_headers(spark):
    assert one(spark, V.merge_headers(F.array(F.lit("2024"), F.lit(" "), F.lit("Q1"), F.lit("Q1")))) == "2024_Q1"


def test_rendering(spark):
    head, rows = F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("1|2"), F.lit("<x>")))
    assert one(spark, T.markdown_table(head, rows)) == "| a | b |\n|---|---|\n| 1\\|2 | <x> |"
    assert one(spark, T.html_table(head, rows)) == "<table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td><td>&lt;x&gt;</td></tr></table>"
    assert one(spark, T.csv_line(F.array(F.lit('a"b'), F.lit("c,d"), F.lit("e")))) == '"a""b","c,d",e'
