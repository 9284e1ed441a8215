"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioframe.operators.skew import grouped_rank, lookup
from folioframe.stash import Stash


def reciprocal_rank_fusion(hits: DataFrame, *, query: str, item: str, source: str, order: Column, k: float = 60.0) -> DataFrame:
    """One ranking per query: ranks per source, ``rrf`` = sum over sources of 1 / (k + rank), ``position`` by rrf.

    ``order`` says how good a hit is within its source, smaller is better. Hits whose order is null or NaN, and rows
    with a null query, item or source, are left out; a repeated hit counts once, with its best value. Equal values
    share a rank (1, 1, 3), so no arbitrary order decides. Only ranks enter, so no source outweighs another by its
    range. Result: query, item, ``rrf``, ``sources`` (that return the item), ``worst_rank``, ``query_sources`` (that
    return anything for the query), ``position``. Queries of any size are ranked in buckets, see ``grouped_rank``.
    """
    stash = Stash(hits.sparkSession)
    value = order.cast("double")
    plain = hits.select(F.col(query).alias("q"), F.col(item).alias("i"), F.col(source).alias("s"), value.alias("v"))
    plain = plain.where("q is not null and i is not null and s is not null and v is not null and not isnan(v)")
    best = stash.put(plain.groupBy("q", "s", "i").agg(F.min("v").alias("v")))
    ranked = grouped_rank(best, ["q", "s"], F.col("v"), "rank")
    fused = ranked.groupBy("q", "i").agg(
        F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("rrf"), F.count(F.lit(1)).alias("sources"), F.max("rank").alias("worst_rank")
    )
    fused = stash.put(fused.withColumn("rrf", F.round("rrf", 12)))
    placed = grouped_rank(fused, ["q"], -F.col("rrf"), "position")
    of_query = best.groupBy("q").agg(F.count_distinct("s").alias("query_sources"), F.count(F.lit(1)).alias("hits"))
    return lookup(placed, of_query, "q", "hits", best.count()).select(
        F.col("q").alias(query), F.col("i").alias(item), "rrf", "sources", "worst_rank", "query_sources", "position"
    )


def first_in_all_sources(fused: DataFrame, first: int = 2, least_sources: int = 2, k: float = 60.0) -> DataFrame:
    """Items among the ``first`` of every source their query has, of queries with at least ``least_sources`` sources.

    Such an item's fused score is at least sources / (k + first), which few others reach; those that do are told apart by
    their worst rank.
    """
    top = fused.where((F.col("query_sources") >= least_sources) & (F.col("rrf") >= F.col("query_sources") / (k + first) - 1e-9))
    return top.where((F.col("sources") == F.col("query_sources")) & (F.col("worst_rank") <= first))
