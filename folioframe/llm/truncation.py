"""Text cut off by field limits or broken transfers.

Hidden limits: the length of every text is recomputed as characters, UTF-8 bytes, UTF-16 units, HTML-escaped,
JSON-escaped and with CR LF line ends; lengths are counted per source, and a source has a limit where many of its texts
pile up on one length that almost none exceeds. Endings: the last block of every text is inspected for open code
blocks, short table rows, list items and sentences. Whether a sentence without full stop is whole is decided by a
logistic model of sentence shapes, trained here on the corpus' own sentences (whole, and cut at random), and by the
corpus' vocabulary, which tells a cut word from a whole one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioframe.operators.skew import broadcast_if
from folioframe.stash import Stash

#: Bounds of the training sample: documents, and sentences taken from them.
SAMPLE_DOCS, SAMPLE_SENTENCES = 4000, 15_000
_BITS = 18
#: Words in brackets that stores leave where they cut, the default of ``marks``.
MARKS = ("more", "cut", "truncated", "continued")
_END = re.compile(r"[.!?。！？][\"'”’»)\]]*$")
#: Phrases that end a text in dots of their own, the default of ``own_dots``.
AND_SO_ON = ("and so on", "and so forth", "et cetera", "etc", "und so weiter", "usw", "et ainsi de suite", "y así sucesivamente", "e così via", "等等", "以此类推")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:[-'’][^\W\d_]+)*|\w+|[^\w\s]")
_SPLIT = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[。！？])")


def _bracketed(marks: tuple[str, ...]) -> str:
    return r"\[(?:" + "|".join(map(re.escape, marks)) + r")\]" if marks else r"(?!)"


def _length_mark(marks: tuple[str, ...]) -> str:
    """Signs left by a cut that are not part of the text; a blank before dots is the text's own last character."""
    return r"(?:\.\.\.|…{1,2}|\s?" + _bracketed(marks) + r"|\x{FFFD}+|,)$"


class Signs:
    """Signs of a cut for the inspection of endings: ``any`` of them, and those that are ``sure``."""

    def __init__(self, marks: tuple[str, ...] = MARKS, own_dots: tuple[str, ...] = AND_SO_ON):
        self.any = re.compile(r"(?:\s?\.\.\.|\s?…{1,2}|\s*" + _bracketed(marks) + "|\ufffd+|,)$")
        self.sure = re.compile(r"(?:\s*" + _bracketed(marks) + "|\ufffd+)$")
        self.own_dots = frozenset(own_dots)


def _count(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece)))) / F.lit(len(piece))


def _body(text: Column, marks: tuple[str, ...]) -> Column:
    """The text without a trailing sign of a cut; only its last characters are searched for one."""
    tail = F.right(text, F.lit(40))
    return F.left(text, F.length(text) - F.length(tail) + F.length(F.regexp_replace(tail, _length_mark(marks), "")))


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text under the encodings a store may have limited."""
    n, amp, quote = F.length(text), _count(text, "&"), _count(text, '"')
    angle, line, back = _count(text, "<") + _count(text, ">"), _count(text, "\n"), _count(text, "\\")
    plain = F.octet_length(text) == n  # ASCII only: nothing to count
    wide = F.when(plain, 0).otherwise(n - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "")))
    other = F.when(plain, 0).otherwise(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")))
    out = {
        "characters": n, "bytes": F.octet_length(text), "utf16": n + wide, "html": n + 4 * amp + 3 * angle + 5 * quote, "html_bytes": F.octet_length(text) + 4 * amp + 3 * angle,
        "crlf": n + line, "crlf_bytes": F.octet_length(text) + line, "json": n + quote + back + line + 5 * other,
    }
    return {k: v.cast("bigint") for k, v in out.items()}


def field_limits(docs: DataFrame, *, source: str, text: str, least: int = 4, share: float = 0.01, beyond: float = 0.02, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """Sources whose texts pile up on a length limit: source, ``measure``, ``limit``, ``piled``, ``texts``.

    A length is a limit if at least ``least`` texts and ``share`` of the source have it (after a trailing sign of a cut is
    taken off), five times as many as the twenty lengths below have on average, and at most ``beyond`` of the source is
    longer. Of several measures the one with the highest pile counts. Null sources and texts are left out.
    """
    body = _body(F.col("t"), marks)
    rows = docs.select(F.col(source).alias("s"), F.col(text).alias("t")).where("s is not null and t is not null").select("s", body.alias("t"))
    measures = lengths(F.col("t"))
    sized = rows.select("s", *[v.alias(k) for k, v in measures.items()])
    sizes = sized.select("s", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.lit(k).alias("measure"), F.col(k).alias("n")) for i, k in enumerate(measures)])).alias("x"))
    counts = sizes.groupBy("s", "x.m", "x.measure", "x.n").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("s", "m")
    line = whole.orderBy("n")
    told = counts.select(
        "*", F.sum("c").over(whole).alias("texts"), F.sum("c").over(line.rangeBetween(1, Window.unboundedFollowing)).alias("longer"),
        F.sum("c").over(line.rangeBetween(-20, -1)).alias("below"),
    )
    limit = told.where(
        (F.col("c") >= least) & (F.col("c") >= share * F.col("texts")) & (F.coalesce("longer", F.lit(0)) <= beyond * F.col("texts"))
        & (F.col("c") >= 5 * (F.coalesce("below", F.lit(0)) / 20.0 + 0.2))
    )
    best = limit.groupBy("s").agg(F.max(F.struct(F.col("c"), (-F.col("m")).alias("o"), F.col("measure"), F.col("n"), F.col("texts"))).alias("b"))
    return best.select(F.col("s").alias(source), F.col("b.measure").alias("measure"), F.col("b.n").alias("limit"), F.col("b.c").alias("piled"), F.col("b.texts").alias("texts"))


def tokens(sentence: str) -> list[str]:
    """Words, Han characters and marks; numbers are one token ``9``, words with digits ``a9``."""
    return ["9" if t.isdigit() else "a9" if any(c.isdigit() for c in t) else t.lower() for t in _TOKEN.findall(sentence)]


def features(ts: list[str]) -> list[int]:
    """Hashed shape of a sentence: how it begins, how long it is, how it ends."""
    import xxhash

    n = len(ts)
    a, b, c = (ts + ["", "", ""])[:3]
    z, y, x = (ts[::-1] + ["", "", ""])[:3]
    commas = [i for i, t in enumerate(ts) if t in ",，、"]
    since = n - (commas[-1] + 1 if commas else 0)
    quotes = sum(t in "\"“”«»" for t in ts) % 2
    named = (
        "1", f"n{n}", f"a{a}|{n}", f"ab{a}|{b}|{n}", f"abc{a}|{b}|{c}|{n}", f"z{z}", f"yz{y}|{z}", f"xyz{x}|{y}|{z}", f"az{a}|{z}", f"ae{a}|{z[-2:]}", f"ay{a}|{y}", f"ax{a}|{x}",
        f"s{a}|{since}|{len(commas)}", f"abs{a}|{b}|{since}", f"e{z[-3:]}|{y[-3:]}", f"aye{a}|{y}|{z[-2:]}", f"q{quotes}", f"ane{a}|{n}|{z[-2:]}",
    )
    return [xxhash.xxh32_intdigest(f) & ((1 << _BITS) - 1) for f in named]


def last_sentence(line: str) -> str:
    return [p for p in _SPLIT.split(line) if p.strip()][-1].strip() if line.strip() else ""


def train(texts: list[str], sentences: int = SAMPLE_SENTENCES, seed: int = 5, rounds: int = 4) -> np.ndarray:
    """Weights of the logistic model: whole sentences of the texts against the same sentences cut at random."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for text in texts:
        lines = text.split("\n")
        for line in lines[:-1] if len(lines) > 1 else lines:
            line = line.strip()
            if not line or line[0] in "|`#" or line.startswith("- ") or not _END.search(line):
                continue
            for s in _SPLIT.split(line):
                s = s.strip()
                if not _END.search(s) or s.endswith(("...", "…")):
                    continue
                ts = tokens(s.rstrip(".!?。！？\"'”’»)]"))
                if len(ts) < 3:
                    continue
                rows.append(features(ts))
                labels.append(1.0)
                for _ in range(2):
                    rows.append(features(ts[: rng.integers(1, len(ts))]))
                    labels.append(0.0)
        if len(rows) >= 3 * sentences:
            break
    weights = np.zeros(1 << _BITS, np.float64)
    if not rows:
        return weights
    x, y = np.array(rows), np.array(labels)
    grad2 = np.full(1 << _BITS, 1e-6)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // 64)):
            p = 1 / (1 + np.exp(-np.clip(weights[x[at]].sum(axis=1), -30, 30)))
            flat, err = x[at].ravel(), np.repeat((p - y[at]) / len(at), x.shape[1])
            uniq, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, err)
            grad2[uniq] += g * g
            weights[uniq] -= 0.3 * g / np.sqrt(grad2[uniq])
    return weights


def whole_probability(weights: np.ndarray, sentence: str) -> float:
    ts = tokens(sentence)
    return float(1 / (1 + np.exp(-np.clip(weights[features(ts)].sum(), -30, 30)))) if ts else 0.0


def inspect(block: str, weights: np.ndarray, items: dict[int, float], signs: Signs) -> tuple[str, str | None]:
    """What the last block of a text ends with: ``whole``, the kind of cut, or ``word`` with a word to look up.

    ``items``: share of list items by number of words. A word to look up means: whole if the vocabulary knows it.
    """
    if signs.sure.search(block):
        return "mark", None
    bare = signs.any.sub("", block)
    marked = bare != block
    line = bare.rsplit("\n", 1)[-1]
    rows = [r for r in bare.split("\n") if r.startswith("|")]
    if line.startswith("|"):
        cells = line.count("|")
        short = not line.rstrip().endswith("|") or cells != rows[0].count("|") or len(rows) < 3 or line[-1] == " "
        return ("table row" if short else "whole"), None
    words = re.findall(r"[^\W\d_]+", line)
    last = words[-1].lower() if words and re.search(r"[^\W\d_]$", line) and not re.search(r"[㐀-鿿]$", line) else None
    item = re.match(r"\s*(?:[-*+•]|\d+[.)])\s+(.*)$", line)
    if item:
        few = items.get(len(item[1].split()), 0.0) < 0.01
        if few and not _END.search(item[1]):
            return "list item", None
        return ("word", last) if last and not marked else ("list item" if marked and not _END.search(line) else "whole", None)
    if re.match(r"\s*#+\s", line):
        return ("word", last) if last else ("whole", None)
    if re.search(r"(?:^|[\s(])[\w./-]*/[\w.-]+\.\w{2,5}$", line):
        return "whole", None
    if line.startswith("-- ") or line.startswith("— "):
        ok = whole_probability(weights, line) >= 0.5 or len(words) >= 3
        return ("word", last) if ok and last else ("signature", None)
    if _END.search(line) or re.match(r"\s*(?:```|~~~)\s*$", line):
        return "whole", None
    if marked and last_sentence(line).lower() in signs.own_dots:
        return "whole", None
    if re.search(r"[。！？.!?]\s*[(（][^()（）\n]{1,40}[)）]$", line):
        return "whole", None
    if line != line.rstrip():
        return "sentence", None
    sentence = last_sentence(line)
    if whole_probability(weights, sentence.rstrip("\"'”’»)]")) < 0.5:
        return "sentence", None
    return ("word", last) if last else ("whole", None)


def truncated(docs: DataFrame, *, doc: str, text: str, source: str, sample_docs: int = SAMPLE_DOCS, least_known: int = 3, marks: tuple[str, ...] = MARKS, own_dots: tuple[str, ...] = AND_SO_ON) -> DataFrame:
    """The cut texts: doc, source, ``how`` (field limit, code block, table row, list item, sentence, word, mark, signature).

    A text is cut if it has the limit length of its source, or if its end is missing. Whole texts may end without a
    full stop, in a list, a table, a signature, a path, or in dots of their own (``And so on...``). Null and empty texts
    aren't cut; a null source has no limit. Statistics (lengths, vocabulary, list items) cover all texts; only the
    sentence model is trained on at most ``sample_docs`` texts, distinct ones with the smallest hashes. ``marks`` are words that
    stand in brackets where a store cut, ``own_dots`` phrases after which dots are the text's own; signs in neither list are
    judged like any other ending.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    rows = docs.select(F.col(doc).alias("d"), F.col(text).alias("t"), F.col(source).alias("s")).where("t is not null and t != ''")
    # copies count once; only texts up to the last hash wanted are moved
    hashed = rows.select("t", F.xxhash64("t").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last)).distinct().orderBy("h", "t").limit(sample_docs).toPandas()
    weights = spark.sparkContext.broadcast(train(sample["t"].tolist()).astype(np.float32))

    listed = rows.select(F.explode(F.regexp_extract_all("t", F.lit(r"\n[-*+] ([^\n]+)\n"), 1)).alias("i"))
    sizes = listed.groupBy(F.least(F.size(F.split(F.trim("i"), r"\s+")), F.lit(40)).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 40 rows
    total = sum(r["n"] for r in sizes) or 1
    items = {r["w"]: r["n"] / total for r in sizes}

    limits = field_limits(docs, source=source, text=text, marks=marks).select(F.col(source).alias("s"), "measure", "limit")
    body = _body(F.col("t"), marks)
    told = rows.join(stash.put(limits), "s", "left")
    length = F.coalesce(*[F.when(F.col("measure") == k, v) for k, v in lengths(body).items()])
    told = told.select(
        "d", "s", F.substring_index("t", "\n\n", -1).alias("block"), (_count(F.col("t"), "```").cast("bigint") % 2 == 1).alias("open"),
        F.coalesce(F.col("measure").isNotNull() & (length == F.col("limit")), F.lit(False)).alias("at_limit"),
    )

    signs = Signs(marks, own_dots)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for part in parts:
            hows, words = [], []
            for block, opened, at in zip(part["block"], part["open"], part["at_limit"]):
                how, word = ("field limit", None) if at else ("code block", None) if opened else inspect(block, w, items, signs)
                hows.append(how)
                words.append(word)
            yield pd.DataFrame({"d": part["d"], "s": part["s"], "how": hows, "word": words})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    judged = stash.put(told.mapInPandas(judge, f"d {kinds['d']}, s string, how string, word string").where("how != 'whole'"))
    # a word is known if it stands somewhere within a text, followed by another word or a mark and a blank
    inner = rows.select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)(?=[ -][\p{L}\p{N}]|[,;:.!?] |\n\n)"), 1)).alias("word"))
    asked = stash.put(judged.where("word is not null").select("word").distinct())
    # only words that are asked for are counted, and each is dropped or kept before the shuffle
    known = inner.join(broadcast_if(asked, 200_000), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = known.where(F.col("n") >= least_known).select("word", F.lit(True).alias("known"))
    checked = judged.join(known, "word", "left").where("word is null or known is null")
    return checked.select(F.col("d").alias(doc), F.col("s").alias(source), "how")


def source_rates(docs: DataFrame, cut: DataFrame, *, source: str, text: str) -> DataFrame:
    """How often each source truncates, and at which limit: source (null included), texts, truncated, rate, measure, limit."""
    texts = docs.groupBy(source).agg(F.count(F.lit(1)).alias("texts"))
    found = cut.groupBy(F.col(source).alias("__s")).agg(F.count(F.lit(1)).alias("truncated"), F.sum((F.col("how") == "field limit").cast("bigint")).alias("by_limit"))
    limits = field_limits(docs, source=source, text=text).select(F.col(source).alias("__l"), "measure", "limit")
    joined = texts.join(found, texts[source].eqNullSafe(F.col("__s")), "left").join(limits, texts[source] == F.col("__l"), "left")
    n = F.coalesce("truncated", F.lit(0))
    return joined.select(source, "texts", n.alias("truncated"), F.coalesce("by_limit", F.lit(0)).alias("by_limit"), F.round(n / F.col("texts"), 6).alias("rate"), "measure", "limit")
