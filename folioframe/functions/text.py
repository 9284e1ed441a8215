"""Text functions as Columns: queries, analyzers, clean-up, predicates of layout text, cell types.

All are null-safe: a null text gives null (predicates: null, which filters treat as false) unless stated otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# Scripts that are written without blanks, as regular-expression ranges.
CJK = r"一-鿿㐀-䶿぀-ゟ゠-ヿ가-힯"
# Characters a full-text query parser would read as operators or punctuation.
QUERY_MARKS = "+-&|!(){}[]^\"~*?:\\/<>=@#$%,;'"
# The stop words removed from queries and key terms.
STOP_WORDS = (
    "a an and are as at be but by for from had has have how i if in into is it its no not of on or such that the their then there these they this to was were what when where which who why will with you your "
    "的 了 和 是 在 我 有 他 这 中 大 来 上 个 到 说 们 为 子 与 也 你 对 就 那 要 吗 呢 吧 啊 哪些 什么 怎么 如何 请问"
).split()
# Characters with a plain counterpart, for clean-up.
_SWAPS = (("•●▪■◦‣∙·", "-"), ("–—―−", "-"), ("“”„‟«»", '"'), ("‘’‚‛", "'"), ("              　", " "))
_ZERO_WIDTH = "​‌‍⁠﻿"
# What UTF-8 looks like when it was read as Latin-1.
MOJIBAKE = ("Ã¤", "Ã¶", "Ã¼", "Ã©", "Ã¨", "â€", "Â°", "Ã±", "ï»¿")


def preprocess_query(q: Column) -> Column:
    """Blanks where Latin letters or digits meet CJK, white space collapsed, repeated words of up to two bytes dropped."""
    out = F.regexp_replace(q, f"([A-Za-z0-9])([{CJK}])", "$1 $2")
    out = F.regexp_replace(out, f"([{CJK}])([A-Za-z0-9])", "$1 $2")
    words = F.split(F.trim(F.regexp_replace(out, r"\s+", " ")), " ")
    short = lambda w: F.octet_length(w) <= 2
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(short(w) & F.array_contains(acc, w), acc).otherwise(F.array_append(acc, w)))
    return F.array_join(kept, " ")


def sanitize_query(q: Column) -> Column:
    """Operators and punctuation of query languages become blanks; white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(q, QUERY_MARKS, " " * len(QUERY_MARKS)), r"\s+", " "))


def word_tokens(text: Column) -> Column:
    """Runs of letters or digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def unicode_tokens(text: Column) -> Column:
    """Like ``word_tokens``, but every Han character is a token of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), 1)


def segmented_tokens(text: Column) -> Column:
    """Words, and for runs of Han characters all pairs of neighbours (a run of one character is itself).

    The default for Chinese, as no dictionary is at hand; another segmenter can be passed wherever an analyzer is taken.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), 1)
    pairs = lambda w: F.when(
        w.rlike(r"^\p{IsHan}{2,}"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2))
    ).otherwise(F.array(w))
    return F.flatten(F.transform(words, pairs))


def stemmed_tokens(text: Column) -> Column:
    """``word_tokens`` of up to 40 bytes without stop words, stemmed, for English; stop words go first, so none survives as a stem."""
    kept = F.filter(word_tokens(text), lambda t: (F.octet_length(t) <= 40) & ~t.isin(*STOP_WORDS))
    return stem_all(kept)


def query_terms(q: Column, *, stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct terms of a query: words without stop words and plain numbers, and the character pairs of words over two characters,
    which meet words that the index cut otherwise."""
    words = F.filter(word_tokens(sanitize_query(preprocess_query(q))), lambda t: ~t.isin(*stop_words) & ~t.rlike(r"^\d+$"))
    grams = F.flatten(
        F.transform(words, lambda w: F.when(F.length(w) > 2, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2))).otherwise(F.array().cast("array<string>")))
    )
    return F.array_distinct(F.concat(words, grams))


_VOWELS = "aeiouy"


def _region(word: str, start: int = 0) -> int:
    """Where the part after the first vowel-consonant pair begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def stem(word: str) -> str:
    """A suffix stripper for English in the manner of the public Porter2 description: plurals, -ed, -ing, -ly, and common
    derivational endings that lie in the word's second half. Words of up to two letters, and words with other letters
    than a to z, stay as they are."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    r1 = _region(word)
    r2 = _region(word, r1) if r1 < len(word) else len(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    for end in ("ingly", "edly", "ing", "ed"):
        if word.endswith(end):
            head = word[: -len(end)]
            if any(c in _VOWELS for c in head):
                if head.endswith(("at", "bl", "iz")):
                    head += "e"
                elif len(head) > 2 and head[-1] == head[-2] and head[-1] in "bdfgmnprt":
                    head = head[:-1]
                elif len(head) <= 3 and r1 >= len(head) and head[-1] not in _VOWELS + "wx" and head[-2:-1] in tuple(_VOWELS):
                    head += "e"
                word = head
            break
    if len(word) > 2 and word[-1] == "y" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # fixed values: derivational endings and what they become, the longest match only
    for end, to, region in (
        ("ational", "ate", r1), ("ization", "ize", r1), ("fulness", "ful", r1), ("ousness", "ous", r1), ("iveness", "ive", r1), ("tional", "tion", r1), ("biliti", "ble", r1), ("lessli", "less", r1),
        ("entli", "ent", r1), ("ation", "ate", r1), ("alism", "al", r1), ("aliti", "al", r1), ("ousli", "ous", r1), ("iviti", "ive", r1), ("fulli", "ful", r1), ("enci", "ence", r1), ("anci", "ance", r1),
        ("abli", "able", r1), ("izer", "ize", r1), ("ator", "ate", r1), ("alli", "al", r1), ("alize", "al", r1), ("icate", "ic", r1), ("iciti", "ic", r1), ("ical", "ic", r1), ("ness", "", r1), ("ful", "", r1),
        ("ement", "", r2), ("ment", "", r2), ("ance", "", r2), ("ence", "", r2), ("able", "", r2), ("ible", "", r2), ("ant", "", r2), ("ent", "", r2), ("ism", "", r2), ("ate", "", r2), ("iti", "", r2),
        ("ous", "", r2), ("ive", "", r2), ("ize", "", r2), ("al", "", r2), ("er", "", r2), ("ic", "", r2),
    ):
        if word.endswith(end):
            if len(word) - len(end) >= region:
                word = word[: -len(end)] + to
            break
    if word.endswith("e") and (len(word) - 1 >= r2):
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stem_all(tokens: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    return pd.Series([None if ts is None else [seen[t] if t in seen else seen.setdefault(t, stem(t)) for t in ts] for ts in tokens])


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def path_tags(path: Column) -> Column:
    """The directory names of a path, without separators, dots, ``Users`` and ``home``, joined by blanks."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.isin("", ".", "..", "Users", "home", "/")), " ")


def truncate_text(text: Column, n: int) -> Column:
    """At most n code points, then three dots if something was cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


@F.pandas_udf(StringType())
def truncate_bytes(text: pd.Series, most: pd.Series) -> pd.Series:
    """At most so many UTF-8 bytes, never half a character."""
    return pd.Series([None if t is None else t.encode()[: int(m)].decode(errors="ignore") for t, m in zip(text, most)])


def token_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)), F.lit(0))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    import unicodedata

    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in text])


def clean_unicode(text: Column, *, compose: bool = False) -> Column:
    """Bullets, dashes, quotes and blanks made plain, zero-width characters dropped; ``compose`` also applies NFC."""
    out = _nfc(text) if compose else text
    for chars, plain in _SWAPS:
        out = F.translate(out, chars, plain * len(chars))
    return F.translate(out, _ZERO_WIDTH, "")


def drop_private_use(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Co}", "")


def normalize_space(text: Column) -> Column:
    """Blanks at line ends dropped, runs of blanks one blank, at most one empty line in a row, ends trimmed."""
    out = F.regexp_replace(text, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def noise_line(line: Column) -> Column:
    """Page numbers, header and footer phrases, and leader dots of tables of contents."""
    low = F.lower(F.trim(line))
    return low.rlike(r"^(page|seite|p\.?)?\s*[-–—]?\s*\d+\s*[-–—]?(\s*(of|von|/)\s*\d+)?$") | low.rlike(r"^(confidential|internal copy|draft|all rights reserved|copyright)\b.{0,60}$") | low.rlike(r"\.{4,}\s*\d+$")


def clean_lines(text: Column) -> Column:
    """Without noise lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~noise_line(x)), "\n")


def filter_structure(text: Column) -> Column:
    """Lines of a single symbol dropped, empty lines collapsed."""
    return F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(r"^[^\p{L}\p{N}]$")), "\n"), r"\n{3,}", "\n\n")


def clean(text: Column, preset: str = "default") -> Column:
    """``minimal``: characters and white space; ``default``: also private-use characters and noise lines; ``aggressive``:
    also the structure filter."""
    out = clean_unicode(text)
    if preset != "minimal":
        out = clean_lines(drop_private_use(out))
    if preset == "aggressive":
        out = filter_structure(out)
    return normalize_space(out)


def mojibake_lines(text: Column) -> Column:
    """Numbers (from 1) of the lines that hold a sign of wrongly decoded UTF-8."""
    bad = lambda x: F.greatest(*[x.contains(m) for m in MOJIBAKE])
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(bad(x), i + 1)), lambda i: i.isNotNull())


def strip_page_number(text: Column) -> Column:
    """Text for comparing headers: page numbers in words, digits at either end, and dashes around them removed."""
    out = F.regexp_replace(F.lower(F.trim(text)), r"(page|p\.|seite|第)\s*\d+\s*(页)?(\s*(of|/|von)\s*\d+)?", "")
    out = F.regexp_replace(out, r"^[-–—\s]*\d+[-–—\s]*(of\s*\d+)?", "")
    return F.trim(F.regexp_replace(out, r"[-–—\s]*\d+[-–—\s]*$", ""))


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, 2)))


def bigram_similarity(a: Column, b: Column) -> Column:
    """2 * (bigrams of a that b has) / (bigrams of a + bigrams of b); 1 for equal texts, 0 if either is shorter than two."""
    x = bigrams(a)
    # y is a variable of its own, so it isn't built anew for each bigram of a
    share = F.get(F.transform(F.array(bigrams(b)), lambda y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.filter(x, lambda g: F.array_contains(y, g))) / (F.size(x) + F.size(y)))), 0)
    return F.when(a == b, 1.0).otherwise(share)


def ends_incomplete(text: Column) -> Column:
    """Not ended by sentence punctuation, closing quote or bracket."""
    return ~F.rtrim(text).rlike(r"[.!?:;。！？：；…\"”’)\]）】]$")


def starts_paragraph(text: Column) -> Column:
    """Starts like a heading, list item or sentence."""
    return F.ltrim(text).rlike(r"^(#{1,6}\s|[-*•●]\s|\d+[.)、]\s|[（(]\d+[)）]|第[一二三四五六七八九十\d]+[章节条]|[A-Z一-鿿\"“])")


def is_list_item(text: Column) -> Column:
    """``ordered``, ``unordered`` or null."""
    t = F.ltrim(text)
    return F.when(t.rlike(r"^[-*+•●▪■◦‣]\s+\S"), "unordered").when(t.rlike(r"^(\d{1,3}[.)、]|[(（]\d{1,3}[)）]|[a-zA-Z][.)]|[ivxIVX]{1,5}[.)])\s*\S"), "ordered")


def is_footnote_marker(text: Column) -> Column:
    return F.ltrim(text).rlike(r"^([¹²³⁰-⁹]+|\[\d{1,3}\]|\d{1,2}\s+\S|[*†‡§]\s*\S|注\d*[:：])")


def is_url_start(text: Column) -> Column:
    return F.trim(text).rlike(r"^(https?://|ftp://|www\.)\S")


def is_url_continuation(text: Column) -> Column:
    return F.trim(text).rlike(r"^[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+$") & F.trim(text).rlike(r"[/._?=&%-]")


def is_email(text: Column) -> Column:
    return F.trim(text).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def numbered_heading_level(line: Column) -> Column:
    """Level of a numbered heading such as ``2.1 Method`` (2), null for other lines."""
    mark = F.regexp_extract(F.trim(line), r"^(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+\p{L}", 1)
    return F.when(mark != "", F.size(F.split(mark, r"\.")))


def key_value(line: Column) -> Column:
    """``key`` and ``value`` of a ``Key: value`` line with a short key, null for other lines."""
    hit = line.rlike(r"^[^:：\n]{1,30}[:：]\s*\S")
    return F.when(hit, F.struct(F.trim(F.regexp_extract(line, r"^([^:：\n]{1,30})[:：]", 1)).alias("key"), F.trim(F.regexp_extract(line, r"^[^:：\n]{1,30}[:：]\s*(.*)$", 1)).alias("value")))


def strip_fences(text: Column) -> Column:
    """Model output without thoughts and without the fence around it."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(F.regexp_replace(strip(out), r"^```\w*\s*\n?", ""), r"\n?```\s*$", ""))


def garbled_characters(text: Column) -> Column:
    """How many characters are U+FFFD, private use, or control characters other than tab and line ends."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[\x{FFFD}\p{Co}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))


def uncommon_cjk_ratio(text: Column, common: str) -> Column:
    """Share of the Han characters that are not in ``common``; null below ten characters or five Han characters."""
    han = F.length(F.regexp_replace(text, r"[^\p{IsHan}]", ""))
    usual = F.length(F.regexp_replace(text, f"[^{common}]", ""))
    return F.when((F.length(text) >= 10) & (han >= 5), (han - usual) / han)


def cell_type(cell: Column) -> Column:
    """Percent, Currency, Date, Number, Text or Unknown (blank or null)."""
    c = F.trim(cell)
    number = r"[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?"
    return (
        F.when(cell.isNull() | (c == ""), "Unknown")
        .when(c.rlike(f"^{number}\\s*[%％‰]$"), "Percent")
        .when(c.rlike(f"^[-(]?\\s*[$€£¥￥]\\s*{number}\\)?$") | c.rlike(f"^{number}\\s*([$€£¥￥元]|万元|亿元|USD|EUR|CNY|RMB)$"), "Currency")
        .when(c.rlike(r"^\d{4}[-/.年]\d{1,2}([-/.月]\d{1,2}日?)?$") | c.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"), "Date")
        .when(c.rlike(f"^{number}([eE][+-]?\\d+)?$") | c.rlike(f"^\\({number}\\)$"), "Number")
        .otherwise("Text")
    )


def markdown_table(header: Column, rows: Column) -> Column:
    """A table (array of names, array of arrays) as Markdown; bars in cells are escaped."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(header)))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def csv_line(cells: Column) -> Column:
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.array_join(F.transform(cells, quoted), ",")


def escape_html(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def html_table(header: Column, rows: Column) -> Column:
    line = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), line(header, "th"), F.array_join(F.transform(rows, lambda r: line(r, "td")), ""), F.lit("</table>"))
