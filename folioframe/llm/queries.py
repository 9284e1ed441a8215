"""Queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioframe.llm import cooccur, fusion, leakage, mixing, names, neighbours, ocr_repair, truncation
from folioframe.session import table
from folioframe.stash import Stash


def _stars(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(table(spark, d, "entities"), id_col="entity_id", kind_col="entity_type")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(_stars(spark, d)).select(F.col("id_a").alias("entity_id_a"), F.col("id_b").alias("entity_id_b"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a person or organisation with the spelling its cluster is named by."""
    return _stars(spark, d).select(F.col("id").alias("entity_id"), "kind", "star")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.pair_counts(table(spark, d, "entities"), basket="chunk_id", item="entity_id", min_count=5, min_lift=5.0)
    found = cooccur.related_pairs(pairs, table(spark, d, "relations"), "from_entity", "to_entity")
    return found.select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


def p2_association(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that share a chunk, with their association scores."""
    pairs = cooccur.pair_counts(table(spark, d, "entities"), basket="chunk_id", item="entity_id")
    scored = cooccur.association(pairs)
    return scored.select("item_a", "item_b", "together", "n_a", "n_b", *[F.round(c, 6).alias(c) for c in ("lift", "pmi", "npmi", "jaccard", "g2")])


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that stand together in three files or more: a file mentions more entities than a chunk, so its basket is split."""
    pairs = cooccur.pair_counts(table(spark, d, "entities"), basket="source_file", item="entity_id", min_count=3, block=64)
    return pairs.select("item_a", "item_b", "together", "n_a", "n_b", "baskets")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_neighbours(table(spark, d, "chunks"), k=5, min_cosine=0.85)
    return neighbours.similar_pairs(near)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every twentieth id (by a hash of it) among all vectors, whatever their similarity.

    What the orderings don't bring near is found in tiles, so this is as good as brute force, and costs it for vectors without near ones.
    """
    asked = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 20 == 0
    near = neighbours.nearest_neighbours(table(spark, d, "chunks"), k=5, queries=asked, exact_below=0.8)
    return near.select("id", "other", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.page_noise(table(spark, d, "page_blocks"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous readable paragraphs of every file."""
    return ocr_repair.repaired_paragraphs(table(spark, d, "page_blocks"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    order = F.when(F.col("source") == "Vector", F.col("distance")).otherwise(-F.col("score"))
    return fusion.reciprocal_rank_fusion(table(spark, d, "search_results"), query="query_id", item="id", source="source", order=order)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_in_all_sources(_fused(spark, d)).select("query_id", "id")


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The one ranking of every query."""
    return _fused(spark, d).select("query_id", "id", "rrf", "sources", "position")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_windows(
        table(spark, d, "documents"), table(spark, d, "eval_items"), doc="doc_id", text="text", item="item_id", passages=["quote", "question"]
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where each item leaked into each document."""
    return leakage.leaks(_leaks(spark, d), "doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without the leaked passages."""
    return leakage.remove_leaks(table(spark, d, "documents"), _leaks(spark, d), doc="doc_id", text="text").select("doc_id", "text")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null")
    return Stash(spark).put(docs.select(F.col("doc_id").alias("id"), "source", mixing.token_counts(F.col("text")).alias("tokens")))


def _shares(spark: SparkSession, sizes: DataFrame, d: str) -> tuple[DataFrame, DataFrame]:
    plan = mixing.mixing_plan(sizes, table(spark, d, "mix_targets"))
    mixed = mixing.mix(sizes, plan, shard_tokens=1_000_000)
    return mixed, mixing.shares(mixed, plan)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the mix gives less than their target although it repeats them as often as it may."""
    _, shares = _shares(spark, _sizes(spark, d), d)
    return shares.where("reached < wanted and most_copies >= least(max_repeats, documents)").where("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus: which document goes to which place of which shard, how often."""
    return _shares(spark, _sizes(spark, d), d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares the mix reached."""
    return _shares(spark, _sizes(spark, d), d)[1]


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """A mix by characters instead of tokens, held against its targets: every source's plan, whether it was reached to within
    one document, how many of its documents stand in it more often than allowed, or twice in a copy."""
    sizes = table(spark, d, "documents").where("source is not null").select(F.col("doc_id").alias("id"), "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"))
    mixed, shares = _shares(spark, Stash(spark).put(sizes), d)
    mixed = Stash(spark).put(mixed)
    longest = sizes.groupBy("source").agg(F.max("tokens").alias("longest"))
    times = mixed.groupBy("source", "id").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("copy").alias("copies")).groupBy("source").agg(
        F.max("times").alias("times"), F.sum(F.col("times") - F.col("copies")).alias("twice")
    )
    told = shares.join(longest, "source", "left").join(times, "source", "left")
    close = (F.col("reached") <= F.col("planned")) & (F.col("planned") - F.col("reached") < F.coalesce("longest", F.lit(0)) + 1)
    over = F.greatest(F.coalesce("times", F.lit(0)) - F.col("max_repeats"), F.lit(0)).cast("bigint")
    return told.select("source", "own", F.round("planned", 2).alias("planned"), "short", close.alias("close"), over.alias("over"), F.coalesce("twice", F.lit(0)).alias("twice"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"), doc="doc_id", text="text", source="source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates, and at which limit."""
    return truncation.source_rates(table(spark, d, "documents"), _cut(spark, d), source="source", text="text")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_clusters, p2_found, p2_association, p2_files, p3_found, p3_neighbours, p5_found, p5_paragraphs, p7_found, p7_ranking, p8_found, p8_spans, p8_clean, p9_found, p9_mix, p9_shares, p9_limits, p10_found,
        p10_rates,
    )
}
