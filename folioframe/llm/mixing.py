"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are hashed into blocks of about ``block_tokens``. The mix takes whole permuted blocks (a permutation
per copy) up to the source's planned tokens and cuts the last block at document level. A tree over the output shards splits
the block quotas of all sources without replacement: a node draws how many blocks of each source go to its left half from
the multivariate hypergeometric distribution, so every shard is a fair sample of the mix and the quotas add up exactly.
Shards walk from the root to their own leaves; nodes are seeded, so all tasks see the same draws and no state is
shared. A shard takes its disjoint range of the source's permuted blocks and shuffles its documents locally.

Blocks, shards and sources may be any number: sums along permuted blocks are taken in runs of ``RUN`` blocks, and a tree
holds ``TREE`` sources, more sources having more trees, each of which splits its own quotas evenly.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioframe.operators.skew import lookup
from folioframe.stash import Stash

#: Where the public vocabulary lies; a parameter of ``token_counts``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Blocks per run of a permutation, sources per splitting tree, shards that one task walks to.
RUN, TREE, WALK = 100_000, 5_000, 512


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of subword tokens of a text; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for part in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in part], dtype="int64")

    return count(text)


def mixing_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: what it has, what it should and what it can give.

    ``sizes``: id, source, tokens of each document. ``targets``: source, weight, max_repeats. The whole is the tokens
    of all documents with a non-null source, T. Result: source, weight, max_repeats, own (0 for a source without
    documents), total (T), wanted (weight * T), planned (wanted, or max_repeats * own if that is less), ``short``
    (wanted > max_repeats * own). Null weights and repeats count as 0; sources with no row in targets add to T only.
    """
    own = sizes.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("own"))
    total = own.agg(F.coalesce(F.sum("own"), F.lit(0)).cast("bigint")).scalar()
    plan = targets.where("source is not null").select(
        "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).cast("bigint").alias("max_repeats")
    )
    plan = plan.join(own, "source", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("bigint")).withColumn("total", total)
    wanted, most = F.col("weight") * F.col("total"), F.col("max_repeats") * F.col("own")
    return plan.withColumn("wanted", wanted).withColumn("planned", F.least(wanted, most.cast("double"))).withColumn("short", wanted > most)


def _quotas(shards: int, seed: int):
    """For a tree's sources (source, n) and a stretch of shards, the blocks of each source a shard gets."""

    def run(key: tuple[int, int], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("source")
        sources, start = part["source"].tolist(), part["n"].to_numpy(np.int64)
        tree, stretch = int(key[0]), int(key[1])
        whole = int(start.sum())
        capacity = lambda a, b: whole * b // shards - whole * a // shards
        out = []
        nodes = [(0, shards, start)]
        while nodes:
            lo, hi, have = nodes.pop()
            if hi <= stretch * WALK or lo >= (stretch + 1) * WALK:
                continue
            if hi - lo == 1:
                out += [(lo, s, int(n)) for s, n in zip(sources, have) if n]
                continue
            mid = (lo + hi) // 2
            left = np.random.default_rng([seed, tree, lo, hi]).multivariate_hypergeometric(have, capacity(lo, mid), method="marginals")
            nodes += [(mid, hi, have - left), (lo, mid, left)]
        return pd.DataFrame(out, columns=["shard", "source", "blocks"])

    return run


def _before(rows: DataFrame, group: list[str], order: list[str], run: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before it in the order of ``run``, then ``order``, within ``group``: a window per run and one over their sums."""
    sums = rows.groupBy(*group, run).agg(F.sum(value).alias("__all"))
    sums = sums.withColumn("__off", F.coalesce(F.sum("__all").over(Window.partitionBy(*group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__all")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*group, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__in", inside).join(sums, [*group, run]).withColumn(name, F.col("__in") + F.col("__off")).drop("__in", "__off")


def mix(sizes: DataFrame, plan: DataFrame, *, shard_tokens: int = 50_000_000, block_tokens: int = 20_000, seed: int = 11, run: int = RUN, tree: int = TREE) -> DataFrame:
    """The mix: id, source, tokens, ``copy`` (from 0), ``shard``, ``position`` in the shard.

    A document appears at most max_repeats times, never twice in the same copy. Each source gives its planned tokens
    to within one document (the last block is cut in hash order). Repeated ids are documents of their own. Empty
    documents, plans or sources give no rows. Deterministic for a given seed.
    """
    spark = sizes.sparkSession
    stash = Stash(spark)
    facts = stash.put(
        plan.where("planned > 0 and own > 0").select(
            "source", "own", "planned", F.ceil(F.col("own") / block_tokens).alias("nb"), F.floor(F.col("planned") / F.col("own")).cast("int").alias("full")
        )
    )
    whole = facts.agg(F.coalesce(F.sum("own"), F.lit(0)), F.coalesce(F.sum("planned"), F.lit(0.0)), F.coalesce(F.sum("nb"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-int(whole[1]) // shard_tokens))
    tagged = lookup(sizes.where("tokens > 0"), facts.select("source", "nb", "own"), "source", "own", whole[0]).drop("own")
    tagged = stash.put(tagged.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("nb"))).drop("nb"))
    blocks = tagged.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    copies = lookup(blocks, facts, "source", "nb", whole[2]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("full"))))
    copies = copies.withColumn("order", F.xxhash64("source", "block", "copy", F.lit(seed + 1)))
    # the permutation goes run by run, a run being a hash of the block and copy as well
    copies = stash.put(copies.withColumn("run", F.pmod(F.xxhash64("order", F.lit(seed + 4)), F.ceil(F.col("nb") / run))))
    drawn = _before(copies, ["source", "copy"], ["order", "block"], "run", F.col("tokens"), "sofar")
    room = F.col("planned") - F.col("copy").cast("double") * F.col("own") - F.col("sofar")
    drawn = stash.put(
        drawn.withColumn("room", room).where("room > 0").select("source", "block", "copy", "order", "run", F.when(F.col("room") < F.col("tokens"), F.col("room")).alias("room"))
    )
    # numbers of a source's blocks, through all its copies
    line = F.col("copy").cast("bigint") * F.lit(1 << 40) + F.col("run")
    drawn = stash.put(_before(drawn.withColumn("line", line), ["source"], ["order", "block"], "line", F.lit(1), "n").drop("line", "run", "order"))
    trees = max(1, -(-whole[3] // tree))
    quota = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("tree", F.pmod(F.xxhash64("source"), F.lit(trees)))
    stretches = quota.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // WALK))))
    split = stash.put(stretches.groupBy("tree", "stretch").applyInPandas(_quotas(shards, seed), "shard bigint, source string, blocks bigint"))
    until = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    ranges = split.withColumn("from", F.coalesce(F.sum("blocks").over(until), F.lit(0)))
    seats = ranges.select("source", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1)).alias("n"))
    placed = stash.put(drawn.join(seats, ["source", "n"]).select("source", "block", "copy", "shard", "room"))
    rows = tagged.join(placed, ["source", "block"])
    complete = rows.where("room is null")
    cut = Window.partitionBy("source", "block", "copy").orderBy(F.xxhash64("id", F.lit(seed + 2)), "id")
    last = rows.where("room is not null").withColumn("sofar", F.sum("tokens").over(cut.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where("sofar <= room").drop("sofar")
    mixed = complete.unionByName(last)
    local = Window.partitionBy("shard").orderBy(F.xxhash64("id", "copy", F.lit(seed + 3)), "id", "copy", "source")
    return mixed.select("id", "source", "tokens", "copy", "shard", F.row_number().over(local).alias("position"))


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per source of the plan: what was wanted, planned and reached, in tokens and as a share of the mix."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("reached"), (F.max("copy") + 1).alias("most_copies"), F.count(F.lit(1)).alias("documents"))
    whole = got.agg(F.sum("reached")).scalar()
    joined = plan.join(got, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    return joined.select(
        "source", "weight", "max_repeats", "own", "wanted", "planned", "short", "reached", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.try_divide("reached", whole), F.lit(0.0)).alias("share"),
    )
