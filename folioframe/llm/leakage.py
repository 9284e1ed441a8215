"""Evaluation texts leaking into training text: a broadcast hash set of test n-grams, scanned over token windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioframe.functions.values import let
from folioframe.operators.skew import broadcast_if
from folioframe.stash import Stash

#: Grams per pass. The hash set of a pass is broadcast: 8 bytes each, 32 MB at most. More grams take more passes.
GRAMS_PER_PASS = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """Maximal runs of letters or digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _rolling(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n word hashes: a polynomial modulo 2 ** 64."""
    out = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _STEP + flat[j : len(flat) - n + 1 + j]
    return out


def _windows(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and hash of each window that lies within one row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - starts[row]
    grams = _rolling(flat, n)
    inside = (at[: len(grams)] + n <= sizes[row[: len(grams)]]) if len(grams) else np.zeros(0, bool)
    return row[: len(grams)][inside], at[: len(grams)][inside], grams[inside]


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, gram = _windows(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64))], names=["item", "at", "gram"])

    return run


def _scan(n: int, wanted):
    """Documents with hits only: doc, text, and place and gram of each hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = wanted.value
        for batch in batches:
            row, at, gram = _windows(batch.column(2), n)
            spot = np.searchsorted(grams, gram)
            hit = grams[np.minimum(spot, len(grams) - 1)] == gram
            row, at, gram = row[hit], at[hit], gram[hit]
            docs, starts = np.unique(row, return_index=True)  # rows come in order
            offsets = pa.array(np.r_[starts, len(row)].astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64))], names=["at", "gram"])
            held = batch.take(pa.array(docs))
            yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.ListArray.from_arrays(offsets, pairs)], names=["doc", "text", "hits"])

    return run


def leaked_windows(
    corpus: DataFrame, items: DataFrame, *, doc: str, text: str, item: str, passages: list[str], n: int = 12, grams_per_pass: int = GRAMS_PER_PASS
) -> DataFrame:
    """Each window of ``n`` consecutive words of a document that stands in a passage of an item: doc, item, ``at`` (word position from 0).

    Words are maximal runs of letters or digits in lower case, so case, punctuation, markup and line breaks play no
    part. Passages shorter than n words can't leak. The n-grams of the items are hashed, put into one sorted hash set
    and broadcast (``grams_per_pass`` bounds it; beyond it the corpus is scanned once per block of grams); the corpus
    is scanned once, window by window. Only what hit windows say is moved, to be verified on the words themselves, so hash
    collisions report nothing. Null texts, null ids and null passages give no row; repeated rows count once.
    """
    spark = corpus.sparkSession
    stash = Stash(spark)
    wide = [items.select(F.col(item).cast("bigint").alias("item"), words(F.col(p)).alias("w")) for p in passages]
    asked = wide[0]
    for other in wide[1:]:
        asked = asked.unionByName(other)
    asked = asked.where(F.col("item").isNotNull() & (F.size("w") >= n)).withColumn("passage", F.monotonically_increasing_id())
    asked = stash.put(asked)
    hashed = asked.select("passage", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    grams = stash.put(hashed.mapInArrow(_grams(n), "item bigint, at int, gram bigint").select(F.col("item").alias("passage"), "at", "gram"))
    distinct = stash.put(grams.select("gram").distinct())
    passes = max(1, -(-distinct.count() // grams_per_pass))

    docs = corpus.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    hashes = docs.select("doc", "text", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    hits, held = None, []
    for block in range(passes):
        part = distinct.where(F.pmod(F.xxhash64("gram"), F.lit(passes)) == block).toPandas()["gram"].to_numpy(dtype=np.int64)
        if not len(part):
            continue
        held.append(spark.sparkContext.broadcast(np.sort(part.view(np.uint64))))
        found = hashes.mapInArrow(_scan(n, held[-1]), "doc bigint, text string, hits array<struct<at: int, gram: bigint>>")
        said = lambda w: F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["gram"].alias("gram"), F.array_join(F.slice(w, h["at"] + 1, n), " ").alias("said")))
        found = found.select("doc", F.inline(let(words(F.col("text")), said)))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], f"{doc} bigint, {item} bigint, at int")
    hits = stash.put(hits.distinct())
    for wanted in held:
        wanted.destroy()
    wanted_text = grams.join(asked, "passage").select("item", "gram", F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("said")).distinct()
    checked = hits.join(wanted_text, ["gram", "said"])
    return checked.select(F.col("doc").alias(doc), F.col("item").alias(item), "at").distinct()


def leaks(windows: DataFrame, doc: str, item: str, n: int = 12) -> DataFrame:
    """One row per document and leaked item: how many windows, the first word and one past the last word."""
    return windows.groupBy(doc, item).agg(F.count(F.lit(1)).alias("windows"), F.min("at").alias("first_word"), (F.max("at") + n).alias("end_word"))


def remove_leaks(corpus: DataFrame, windows: DataFrame, *, doc: str, text: str, n: int = 12, drop_above: float = 0.5) -> DataFrame:
    """The corpus without leaked passages: all its rows and columns, with the leaked words cut out of ``text``.

    Documents of which more than ``drop_above`` of the words leaked are dropped. Text between the cut spans keeps its
    characters. Documents without leaks, and null texts, stay as they are.
    """
    # windows that touch or overlap are one span [s, e) of words; spans are few and short, however many windows they have
    none = F.array().cast("array<struct<s: int, e: int>>")
    grown = F.aggregate(
        F.array_sort(F.collect_set("at")), none,
        lambda acc, a: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= a),
            F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(F.element_at(acc, -1)["s"].alias("s"), (a + n).alias("e"))),
        ).otherwise(F.array_append(acc, F.struct(a.alias("s"), (a + n).alias("e")))),
    )
    marks = Stash(corpus.sparkSession).put(windows.groupBy(F.col(doc).alias("__doc")).agg(grown.alias("__spans")))
    parts = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+[^\p{L}\p{N}]*)"), 1)
    head = F.regexp_extract(F.col(text), r"^([^\p{L}\p{N}]*)", 1)
    joined = corpus.join(broadcast_if(marks, 100_000), corpus[doc] == F.col("__doc"), "left")
    joined = joined.withColumn("__parts", F.when(F.col("__spans").isNotNull(), parts))
    whole = F.size("__parts")
    # what stands before each span, and after the last
    between = lambda ps: F.transform("__spans", lambda x, i: F.array_join(F.slice(ps, F.coalesce(F.get("__spans", i - 1)["e"], F.lit(0)) + 1, x["s"] - F.coalesce(F.get("__spans", i - 1)["e"], F.lit(0))), ""))
    end = F.element_at("__spans", -1)["e"]
    rest = lambda ps: F.array_join(F.slice(ps, end + 1, F.greatest(whole - end, F.lit(0))), "")
    kept = let(F.col("__parts"), lambda ps: F.concat(head, F.array_join(between(ps), ""), rest(ps)))
    share = F.aggregate("__spans", F.lit(0), lambda acc, x: acc + x["e"] - x["s"]) / whole
    joined = joined.where(F.col("__spans").isNull() | (share <= drop_above))
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept)).select(*corpus.columns)
