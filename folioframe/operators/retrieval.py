"""Hybrid retrieval: exact nearest vectors, multi-field BM25, their fusion, context expansion and second hops."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioframe.functions import text as T, values as V
from folioframe.stash import exists

# Hits per leg and in the end, cut-offs of either leg, BM25 parameters.
LEG, FINAL, RELATIVE, FLOOR, K1, B = 20, 10, 1.5, 0.3, 1.2, 0.75
#: Fields of the text index, how they are analysed, and how much they count (fixed values). The standard fields are stemmed.
FIELDS: dict[str, tuple[Callable[[Column, Column], Column], float]] = {
    "file_name": (lambda text, path: T.segmented_tokens(T.file_name(path)), 8.0),
    "text_zh": (lambda text, path: T.segmented_tokens(text), 5.0),
    "file_name_std": (lambda text, path: T.stemmed_tokens(T.file_name(path)), 5.0),
    "text_std": (lambda text, path: T.stemmed_tokens(text), 3.0),
    "path_tags": (lambda text, path: T.stemmed_tokens(T.path_tags(path)), 2.0),
    "text_icu": (lambda text, path: T.unicode_tokens(text), 1.0),
}
#: The same without stemming and without segmentation.
WORDS = {
    "file_name_words": (lambda text, path: T.word_tokens(T.file_name(path)), 5.0), "text_words": (lambda text, path: T.word_tokens(text), 3.0),
    "path_words": (lambda text, path: T.word_tokens(T.path_tags(path)), 2.0),
}
STEMMED = ("file_name_std", "text_std", "path_tags")
#: Parts an index is cut into by hash of the term; a query reads those of its terms.
BUCKETS = 64
#: Changes with what is written, so that an index of another make isn't read.
FORMAT = 2


class TextIndex:
    """A written index: ``chunks``, ``postings`` by bucket of the term, ``terms`` with their document counts, ``stats`` of the fields.

    Built once and read by every search. Searches read the term buckets they need and, of those, the row groups of their
    terms, as a bucket is sorted by term.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.chunks = spark.read.parquet(f"{root}/chunks")
        self.stats = {r["field"]: (r["docs"], r["avg_length"]) for r in spark.read.parquet(f"{root}/stats").collect()}  # a row per field

    @classmethod
    def build(cls, chunks: DataFrame, root: str, fields: dict | None = None) -> TextIndex:
        """Write the index of ``chunks`` (id, text, file_path and others) and open it. ``stats`` is written last."""
        spark, fields = chunks.sparkSession, fields or FIELDS | WORDS
        chunks.write.mode("overwrite").parquet(f"{root}/chunks")
        kept = spark.read.parquet(f"{root}/chunks")
        bucket = (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")
        rows = postings(kept, fields).withColumn("bucket", bucket)
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "field").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
        seen = spark.read.parquet(f"{root}/postings").groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df"))
        seen.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/terms")
        field_stats(kept, fields).coalesce(1).write.mode("overwrite").parquet(f"{root}/stats")
        return cls(spark, root)

    def _of(self, name: str, terms: dict[str, list[str]]) -> DataFrame:
        every = sorted({t for ts in terms.values() for t in ts})
        # the buckets' folders are named, so no other is listed
        folders = [f"{self.root}/{name}/bucket={b}" for b in sorted({zlib.crc32(t.encode()) % BUCKETS for t in every})]
        folders = [f for f in folders if exists(self.spark, f)]
        schema = "field string, term string, id string, tf bigint, length int" if name == "postings" else "field string, term string, df bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).where(F.col("term").isin(every) & F.col("field").isin(list(terms)))

    def scored(self, terms: dict[str, list[str]], boosts: dict[str, float]) -> DataFrame:
        """Boosted BM25 of each chunk that has any of the terms of a field: id, ``score``."""
        weights = {}
        for r in self._of("terms", terms).collect():  # at most fields x terms rows
            if r["term"] in terms[r["field"]]:
                docs = self.stats[r["field"]][0]
                weights[r["field"], r["term"]] = boosts[r["field"]] * math.log1p((docs - r["df"] + 0.5) / (r["df"] + 0.5))
        if not weights:
            return self.spark.createDataFrame([], "id string, score double")
        weight = F.create_map(*[F.lit(x) for (f, t), w in weights.items() for x in (f"{f}\t{t}", w)])[F.concat("field", F.lit("\t"), "term")]
        mean = F.create_map(*[F.lit(x) for f in terms for x in (f, self.stats[f][1])])[F.col("field")]
        hits = self._of("postings", terms).withColumn("weight", weight).where("weight is not null")
        return hits.groupBy("id").agg(F.sum(F.col("weight") * _saturated(mean)).alias("score"))


def _saturated(mean: Column) -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))


def vector_leg(chunks: DataFrame, query: list[float], *, threshold: float = 0.9, k: int = LEG, file: str | None = None, exclude: str | None = None) -> DataFrame:
    """The ``k`` nearest chunks by squared L2 distance, cut at ``threshold`` and, with three or more left, at 1.5 times the
    nearest: id, distance, similarity, ``rank_v``. Chunks without a vector of the query's length are left out."""
    rows = chunks.where(F.col("vector").isNotNull() & (F.size("vector") == len(query)))
    if file is not None:
        rows = rows.where(F.col("file_path") == file)
    if exclude is not None:
        rows = rows.where(F.col("id") != exclude)
    if len(query) <= 256:  # one compiled expression
        distance = F.expr(" + ".join(f"(vector[{i}] - {float(x)!r}D) * (vector[{i}] - {float(x)!r}D)" for i, x in enumerate(query)) or "0D")
    else:
        distance = V.squared_l2(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    near = rows.select("id", distance.alias("distance")).orderBy("distance", "id").limit(k)
    kept = near.where(F.col("distance") <= threshold)
    whole = Window.partitionBy(F.lit(0))  # at most k rows
    cut = F.when(F.count(F.lit(1)).over(whole) >= 3, F.least(F.min("distance").over(whole) * RELATIVE, F.lit(threshold))).otherwise(threshold)
    kept = kept.withColumn("cut", cut).where("distance <= cut").drop("cut")
    ranked = kept.withColumn("rank_v", F.row_number().over(whole.orderBy("distance", "id")))
    return ranked.withColumn("similarity", V.similarity(F.col("distance")))


def postings(chunks: DataFrame, fields: dict[str, tuple[Callable[[Column, Column], Column], float]] | None = None, terms: list[str] | None = None) -> DataFrame:
    """The text index: field, term, id, ``tf``, ``length`` (tokens of the field). With ``terms`` only their postings, which
    are cut before the shuffle. One row per term and chunk, however often it occurs."""
    parts = []
    for name, (analyze, _) in (fields or FIELDS).items():
        tokens = chunks.select("id", analyze(F.col("text"), F.col("file_path")).alias("tokens"))
        sized = tokens.select("id", F.size("tokens").alias("length"), "tokens")
        if terms is not None:
            wanted = F.array(*[F.lit(t) for t in terms])
            sized = sized.withColumn("tokens", F.filter("tokens", lambda t: F.array_contains(wanted, t)))
        parts.append(sized.select(F.lit(name).alias("field"), "id", "length", F.explode("tokens").alias("term")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("field", "term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def field_stats(chunks: DataFrame, fields: dict[str, tuple[Callable[[Column, Column], Column], float]] | None = None) -> DataFrame:
    """Per field: ``docs`` and ``avg_length``; one pass over the chunks."""
    names = list(fields or FIELDS)
    sizes = chunks.select(*[F.size(analyze(F.col("text"), F.col("file_path"))).alias(n) for n, (analyze, _) in (fields or FIELDS).items()])
    one = sizes.agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("docs"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col("docs"), F.col(n).alias("avg_length")) for n in names])))


def bm25(index: DataFrame, stats: DataFrame, terms: dict[str, list[str]], boosts: dict[str, float]) -> DataFrame:
    """Boosted BM25 of each chunk that has any of the terms of a field: id, ``score``. Exact field lengths are used."""
    hits = index.where(reduce(lambda x, y: x | y, [(F.col("field") == f) & F.col("term").isin(terms[f]) for f in boosts]))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))  # at most fields x terms rows
    weight = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])[F.col("field")]
    joined = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return joined.groupBy("id").agg(F.sum(weight * idf * _saturated(F.col("avg_length"))).alias("score"))


def terms_of(spark: SparkSession, query: str) -> list[str]:
    """The terms of a query text, on the driver: a query is a few words."""
    return [*spark.range(1).select(T.query_terms(F.lit(query)).alias("t")).first()["t"]]


def field_terms(terms: list[str], fields: dict) -> dict[str, list[str]]:
    """The terms as each field's analyzer has them: stemmed, without stop words, for the standard fields."""
    stemmed = list(dict.fromkeys(T.stem(t) for t in terms if t not in T.STOP_WORDS))
    return {f: stemmed if f in STEMMED else terms for f in fields}


def keyword_leg(chunks: DataFrame, query: str, *, k: int = LEG, file: str | None = None, fields: dict | None = None, exclude: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """The ``k`` best chunks by multi-field BM25, any term counting; with three or more hits those below 30 per cent of the
    best are dropped: id, score, ``score100`` (min-max to 0..100), ``rank_k``. Queries without terms have no hits. Without a
    written ``index`` the chunks are analysed for this query."""
    fields = fields or FIELDS
    terms, boosts = field_terms(terms_of(chunks.sparkSession, query), fields), {n: b for n, (_, b) in fields.items()}
    if index is not None:
        scored = index.scored(terms, boosts)
    else:
        scored = bm25(postings(chunks, fields, sorted({t for ts in terms.values() for t in ts})), field_stats(chunks, fields), terms, boosts)
    if exclude is not None:
        scored = scored.where(F.col("id") != exclude)
    if file is not None:
        scored = scored.join(chunks.where(F.col("file_path") == file).select("id"), "id", "left_semi")
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    whole = Window.partitionBy(F.lit(0))  # at most k rows
    best, hits = F.max("score").over(whole), F.count(F.lit(1)).over(whole)
    kept = top.withColumn("keep", (hits < 3) | (best <= 0) | (F.col("score") >= FLOOR * best)).where("keep").drop("keep")
    low = F.min("score").over(whole)
    span = F.greatest(F.max("score").over(whole) - low, F.lit(0.001))
    return kept.withColumn("score100", (F.col("score") - low) / span * 100).withColumn("rank_k", F.row_number().over(whole.orderBy(F.desc("score"), "id")))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = FINAL) -> DataFrame:
    """Full outer merge of both legs by id and weighted reciprocal rank fusion: id, ``score``, ``source``, the legs' columns."""
    merged = vector.join(keyword, "id", "full_outer")
    source = F.when(F.col("rank_v").isNotNull() & F.col("rank_k").isNotNull(), "Hybrid").when(F.col("rank_v").isNotNull(), "Vector").otherwise("Keyword")
    fused = merged.withColumn("fused", V.rrf_score(F.col("rank_v"), F.col("rank_k"))).withColumn("source", source)
    return fused.orderBy(F.desc("fused"), "id").limit(k).select("id", F.col("fused").alias("score"), "source", "rank_v", "rank_k", "distance", F.col("score").alias("bm25"))


def hybrid_search(chunks: DataFrame, query_vector: list[float], query: str, *, threshold: float = 0.9, file: str | None = None, exclude: str | None = None, fields: dict | None = None, index: TextIndex | None = None) -> DataFrame:
    """Both legs and their fusion, at most ``FINAL`` chunks; an empty text gives the vector leg alone, nearest first."""
    vector = vector_leg(chunks, query_vector, threshold=threshold, file=file, exclude=exclude)
    return fuse(vector, keyword_leg(chunks, query, file=file, fields=fields, exclude=exclude, index=index))


def hits_of_queries(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best ids for each of many queries (qid, ``terms``) by BM25 over one field's postings: qid, id, ``score``, ``rank``.

    All queries are answered in one pass: their terms are joined with the postings, and counts of terms are taken once.
    """
    asked = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    told = index.join(asked, "term").join(df, "term").withColumn("docs", stats.select("docs").scalar()).withColumn("avg_length", stats.select("avg_length").scalar())
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = told.groupBy("qid", "id").agg(F.sum(idf * _saturated(F.col("avg_length"))).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= k)


def merge_results(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two result lists (id, score, source) by id: the higher score, and ``Hybrid`` for what both hold."""
    both = first.select("id", "score", "source").unionByName(second.select("id", "score", "source"))
    merged = both.groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"), F.max_by("source", "score").alias("source"))
    return merged.select("id", "score", F.when(F.col("n") > 1, "Hybrid").otherwise(F.col("source")).alias("source"))


def key_terms(texts: DataFrame, query: str, *, k: int = 5, text: str = "text") -> DataFrame:
    """The most frequent terms of a few texts beside the query's own words and stop words: term, ``n``."""
    own = terms_of(texts.sparkSession, query)
    tokens = texts.select(F.explode(T.segmented_tokens(F.col(text))).alias("term"))
    kept = tokens.where((F.length("term") >= 2) & ~F.col("term").isin(*T.STOP_WORDS) & ~F.col("term").isin(own) & ~F.col("term").rlike(r"^\d+$"))
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def two_hops(chunks: DataFrame, query_vector: list[float], query: str, **options) -> DataFrame:
    """A search, a second one with the key terms of the first three hits added, and both merged."""
    first = hybrid_search(chunks, query_vector, query, **options)
    best = chunks.join(F.broadcast(first.orderBy(F.desc("score"), "id").limit(3).select("id")), "id", "left_semi")
    more = [r["term"] for r in key_terms(best, query).collect()]  # at most five
    if not more:
        return merge_results(first, first.limit(0))
    return merge_results(first, hybrid_search(chunks, query_vector, f"{query} {' '.join(more)}", **options))


def sibling_context(chunks: DataFrame, *, each: int = 200, whole: int = 500) -> DataFrame:
    """For every chunk the parent's title and the texts before and after it, at most ``each`` characters a part and about
    ``whole`` together: id, ``context`` (null if there is none). Siblings share file and parent and stand in the order of
    the number at the end of their id, so ``x-10`` comes after ``x-2``. One window answers for all chunks at once."""
    number = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint"), F.lit(0))
    line = Window.partitionBy("file_path", "parent_id").orderBy(number, "id")
    has = F.col("parent_id").isNotNull() & (F.col("parent_id") != "")
    seen = chunks.withColumn("before", F.when(has, F.lag("text").over(line))).withColumn("after", F.when(has, F.lead("text").over(line)))
    part = lambda mark, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(mark), F.left(c, F.lit(each))))
    up = part("[上级] ", V.last_breadcrumb(F.col("breadcrumbs")))
    before, after = part("[前文] ", F.col("before")), part("[后文] ", F.col("after"))
    used = F.coalesce(F.length(up), F.lit(0))
    before = F.when(used + F.length(before) <= whole, before)
    used = used + F.coalesce(F.length(before), F.lit(0))
    after = F.when(used + F.length(after) <= whole, after)
    return seen.select("id", F.nullif(F.concat_ws("\n", up, before, after), F.lit("")).alias("context"))


def context_budget(context_tokens: int, answer_tokens: int) -> int:
    """Characters the context may have: two for each token left after the answer and the prompt's 300."""
    return max(0, (context_tokens - answer_tokens - 300) * 2)


def within_budget(results: DataFrame, budget: int) -> DataFrame:
    """The results whose texts fit the budget, best first; one that doesn't fit is skipped and smaller ones may follow.
    For the few rows of a result list."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", F.length("text").alias("n"))))
    none = F.array().cast("array<string>")
    taken = F.aggregate(
        rows, F.struct(F.lit(0).alias("used"), none.alias("ids")),
        lambda s, x: F.when(s["used"] + x["n"] <= budget, F.struct((s["used"] + x["n"]).alias("used"), F.array_append(s["ids"], x["id"]).alias("ids"))).otherwise(s),
    )
    kept = results.agg(taken["ids"].alias("ids")).select(F.explode("ids").alias("id"))
    return results.join(kept, "id", "left_semi")


def display_choice(results: DataFrame) -> DataFrame:
    """Five results to show: four texts and one table if there are both, else the five best."""
    kind = F.when(F.col("doc_type") == "tabular", "table").otherwise("text")
    rows = results.withColumn("kind", kind)
    both = Window.partitionBy(F.lit(0))  # a result list of a few rows
    mixed = F.size(F.collect_set("kind").over(both)) == 2
    n = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "id"))
    all_n = F.row_number().over(both.orderBy(F.desc("score"), "id"))
    most = F.when(F.col("kind") == "table", 1).otherwise(4)
    told = rows.withColumn("mixed", mixed).withColumn("n", n).withColumn("all_n", all_n).withColumn("most", most)
    return told.where(F.when(F.col("mixed"), F.col("n") <= F.col("most")).otherwise(F.col("all_n") <= 5)).drop("mixed", "n", "all_n", "most", "kind")


def route(results: DataFrame, file_filter: bool = False) -> DataFrame:
    """Where a question goes: one row with ``route`` (text, table, pending_table_selection) and the candidate files."""
    files = F.array_sort(F.collect_set(F.when(F.col("doc_type") == "tabular", F.col("file_path"))))
    one = results.agg(files.alias("files"))
    return one.select(F.when(F.size("files") == 0, "text").when((F.size("files") > 1) & F.lit(not file_filter), "pending_table_selection").otherwise("table").alias("route"), "files")


def answer_context(results: DataFrame) -> DataFrame:
    """One row: the context text, best first, each part with its number, file and score."""
    part = F.format_string("[%d] %s (%.1f%%)\n%s", F.col("n"), F.col("file_path"), F.col("score"), F.col("text"))
    ranked = results.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))  # a result list
    return ranked.select("n", part.alias("p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]), "\n\n").alias("context"))
