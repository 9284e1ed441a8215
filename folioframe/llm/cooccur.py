"""Items that appear together: pair counts by large-basket blocking, and association scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioframe.operators.skew import lookup
from folioframe.stash import Stash


def pair_counts(
    rows: DataFrame, *, basket: str, item: str, min_count: int = 1, min_lift: float = 0.0, block: int = 256
) -> DataFrame:
    """Unordered pairs of items and in how many baskets both occur.

    Result: ``item_a`` < ``item_b``, ``together``, ``n_a``, ``n_b`` (baskets of each), ``baskets`` (number of distinct
    non-null baskets). An item counts once per basket, null items and null baskets make no pair, a basket that has
    only null items still counts among ``baskets``. Empty input gives no row.

    ``min_count`` and ``min_lift`` (together * baskets / (n_a * n_b)) are applied exactly, and used early: an item in
    fewer than ``min_count`` baskets, or in more than baskets / ``min_lift``, can't be in any pair that passes, as
    together <= min(n_a, n_b).

    Baskets of up to ``block`` items are paired where they are. A larger one is split by item hash into chunks of
    about ``block`` items; each pair of chunks is a task of its own, so one huge basket spreads over as many tasks
    as it has chunk pairs. Pairs are counted map-side before the shuffle.
    """
    stash = Stash(rows.sparkSession)
    raw = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null")
    seen = stash.put(raw.distinct())
    baskets = seen.select("basket").distinct().count()
    seen = seen.where("item is not null")
    counts = seen.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    useful = counts.where(F.col("n") >= min_count)
    if min_lift > 0:
        useful = useful.where(F.col("n") * F.lit(float(min_lift)) <= F.lit(float(baskets)))
    useful = stash.put(useful)
    kept = stash.put(lookup(seen, useful, "item", "n", max(1, baskets)))
    sizes = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    large = stash.put(sizes.where(F.col("size") > block).withColumn("chunks", F.ceil(F.col("size") / block).cast("int")))
    split = not large.isEmpty()
    whole = kept.count() if split else 0

    one = F.struct("item", "n")
    small = (
        (lookup(kept, large, "basket", "size", whole, "left_anti") if split else kept).groupBy("basket").agg(F.array_sort(F.collect_list(one)).alias("items")).where(F.size("items") > 1)
    )
    near = small.select(
        F.explode(
            F.flatten(
                F.transform(
                    "items",
                    lambda x, i: F.transform(
                        F.slice("items", i + 2, F.size("items")),
                        lambda y: F.struct(x["item"].alias("item_a"), y["item"].alias("item_b"), x["n"].alias("n_a"), y["n"].alias("n_b")),
                    ),
                )
            )
        ).alias("p")
    ).select("p.*")
    parts = near
    if split:
        cut = lookup(kept, large, "basket", "size", whole).withColumn("c", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
        spread = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
            "basket", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), F.struct("item", "n", "c").alias("x")
        )
        cells = spread.groupBy("basket", "c1", "c2").agg(F.collect_list("x").alias("xs"))
        far = cells.select(
            F.explode(
                F.flatten(
                    F.transform(
                        "xs",
                        lambda x: F.transform(
                            F.filter("xs", lambda y: (x["item"] < y["item"]) & ((F.col("c1") == F.col("c2")) | (x["c"] != y["c"]))),
                            lambda y: F.struct(x["item"].alias("item_a"), y["item"].alias("item_b"), x["n"].alias("n_a"), y["n"].alias("n_b")),
                        ),
                    )
                )
            ).alias("p")
        ).select("p.*")
        parts = near.unionByName(far)
    total = parts.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("together"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    total = total.where(F.col("together") >= min_count).withColumn("baskets", F.lit(baskets).cast("bigint"))
    if min_lift > 0:
        total = total.where(F.col("together") * F.col("baskets") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    return total


def association(pairs: DataFrame) -> DataFrame:
    """``pair_counts`` with ``lift``, ``pmi`` (log2), ``npmi``, ``jaccard`` and ``g2`` (log-likelihood ratio).

    ``npmi`` is 1 where a pair is in every basket; terms of ``g2`` with an empty cell count as 0.
    """
    n, a, b, ab = (F.col(c).cast("double") for c in ("baskets", "n_a", "n_b", "together"))
    pmi = F.log2(ab * n / (a * b))

    def term(o, e):
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    g2 = 2 * (
        term(ab, a * b / n) + term(a - ab, a * (n - b) / n) + term(b - ab, (n - a) * b / n) + term(n - a - b + ab, (n - a) * (n - b) / n)
    )
    return (
        pairs.withColumn("lift", ab * n / (a * b))
        .withColumn("pmi", pmi)
        .withColumn("npmi", F.when(ab >= n, 1.0).otherwise(pmi / -F.log2(ab / n)))
        .withColumn("jaccard", ab / (a + b - ab))
        .withColumn("g2", g2)
    )


def related_pairs(pairs: DataFrame, relations: DataFrame, one: str, other: str) -> DataFrame:
    """The pairs that stand together, in either order, in at least one row of ``relations``; ends that are null or equal match nothing."""
    edges = relations.select(F.least(one, other).alias("item_a"), F.greatest(one, other).alias("item_b")).where(
        F.col(one).isNotNull() & F.col(other).isNotNull()
    )
    return pairs.join(edges.distinct(), ["item_a", "item_b"], "left_semi")
