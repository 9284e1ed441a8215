"""Joins and ranks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: A key counts as hot from this share of all rows on, so at most 1 / HOT_SHARE keys are hot. Fixed bound
#: of what ``lookup`` broadcasts.
HOT_SHARE = 0.001


def lookup(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: float, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``facts`` (unique on ``key``, ``weight`` = rows per key) without a hot partition.

    Keys that hold more than ``HOT_SHARE`` of ``total`` rows, at most 1 / HOT_SHARE of them, are joined by
    broadcast; all others hold few rows each and are joined by a shuffle. Rows with a null key match nothing.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = facts.where(F.col(weight) > limit)
    cold = facts.where(F.col(weight) <= limit)
    flagged = rows.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot"))), key, "left")
    first = flagged.where("__hot").drop("__hot").join(F.broadcast(hot), key, how) if how != "left_anti" else None
    rest = flagged.where("__hot is null").drop("__hot").join(cold, key, how)
    return rest if first is None else first.unionByName(rest)


def meetings(rows: DataFrame, group: str, item: str, block: int) -> list[tuple[DataFrame, DataFrame, list[str]]]:
    """How to join a written table with itself on ``group``: (left, right, columns to join on), the results to be united.

    Groups of up to ``block`` rows are joined as they are. Larger ones are cut by hash of ``item`` into chunks of about
    ``block`` rows, and every pair of chunks is a key of its own, so no task holds more than two chunks of a group. Every
    pair of rows of a group meets once in either order. Null groups meet nothing.
    """
    large = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > block)
    if large.isEmpty():
        return [(rows, rows, [group])]
    total = rows.count()
    small = lookup(rows, large, group, "__size", total, "left_anti")
    chunks = F.ceil(F.col("__size") / block).cast("int")
    cut = lookup(rows, large, group, "__size", total).withColumn("__n", chunks).drop("__size").withColumn("__own", F.pmod(F.xxhash64(item), F.col("__n")).cast("int"))
    tiles = lambda mine, other: cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumnRenamed("__own", mine).drop("__n")
    return [(small, small, [group]), (tiles("__a", "__b"), tiles("__b", "__a"), [group, "__a", "__b"])]


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns of the same name in which null equals null; they are kept once."""
    named = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    return left.join(named, condition, how).drop(*[f"__r_{c}" for c in on])


def grouped_rank(rows: DataFrame, group: list[str], order: Column, name: str = "rank", per_bucket: int = 200_000) -> DataFrame:
    """Competition rank (1, 1, 3, ...) of ``order`` ascending within ``group``, whatever the size of a group.

    Rows are first counted per (group, value), so repeats of a value shrink before the shuffle. A group with
    more than ``per_bucket`` distinct values is cut at approximate quantiles into buckets; each bucket is a
    window of its own and starts at the number of rows in the buckets before it. The rank is exact whatever
    the cuts are. Null values of ``order`` get a null rank.
    """
    from folioframe.stash import Stash

    stash = Stash(rows.sparkSession)
    data = rows.withColumn("__v", order)
    values = stash.put(data.where("__v is not null").groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__n")))
    sizes = values.groupBy(*group).agg(F.count(F.lit(1)).alias("__d"))
    big = sizes.where(F.col("__d") > per_bucket)
    most = big.agg(F.max("__d")).first()[0]
    if most:
        buckets = max(64, 2 * -(-most // per_bucket))  # as many as the largest group needs
        cuts = stash.put(
            values.join(big, group, "left_semi").groupBy(*group).agg(
                F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 16 * buckets).alias("__cuts")
            )
        )
        values = _null_safe(values, cuts, group, "left").withColumn(
            "__b", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__v"))), F.lit(0))
        ).drop("__cuts")
    else:
        values = values.withColumn("__b", F.lit(0))
    starts = values.groupBy(*group, "__b").agg(F.sum("__n").alias("__s"))
    starts = starts.withColumn(
        "__start",
        F.coalesce(F.sum("__s").over(Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("__s")
    inside = Window.partitionBy(*group, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    counted = values.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    ranked = _null_safe(counted, starts, [*group, "__b"], "inner").select(*group, "__v", (F.col("__before") + F.col("__start") + 1).alias(name))
    on = [data[g].eqNullSafe(ranked[g]) for g in group] + [data["__v"] == ranked["__v"]]
    return data.join(ranked, on, "left").select(*[data[c] for c in rows.columns], ranked[name])


def broadcast_if(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows (counted first), else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
