"""Co-occurrence, nearest vectors and rank fusion against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import cooccur as C, fusion as R, neighbours as V
from folioframe.llm.queries import p2_association


def brute_pairs(rows, min_count=1, min_lift=0.0):
    baskets, items = {}, {}
    for b, i in rows:
        if b is not None:
            baskets.setdefault(b, set())
            if i is not None:
                baskets[b].add(i)
                items.setdefault(i, set()).add(b)
    out = {}
    for a in items:
        for b in items:
            n = len(items[a] & items[b])
            if a < b and n >= max(1, min_count) and n * len(baskets) >= min_lift * len(items[a]) * len(items[b]):
                out[a, b] = (n, len(items[a]), len(items[b]), len(baskets))
    return out


@pytest.mark.parametrize("block, min_count, min_lift", [(256, 1, 0), (3, 1, 0), (3, 3, 0), (4, 2, 1.5)])
def test_pair_counts(spark, block, min_count, min_lift):
    rng = random.Random(block)
    rows = [(rng.choice(["big", *map(str, range(20)), None]), rng.choice([*"abcdefghijklmn", None])) for _ in range(400)]
    rows += [("big", f"i{k}") for k in range(12)] + rows[:30] + [("only null", None)]
    df = spark.createDataFrame([(b, i, "x", 0) for b, i in rows], "chunk string, ent string, item string, n int")
    got = C.pair_counts(df, basket="chunk", item="ent", block=block, min_count=min_count, min_lift=min_lift)
    assert {(r["item_a"], r["item_b"]): (r["together"], r["n_a"], r["n_b"], r["baskets"]) for r in got.collect()} == brute_pairs(rows, min_count, min_lift)


def test_pair_counts_edges(spark):
    df = spark.createDataFrame([], "chunk string, ent string")
    assert C.pair_counts(df, basket="chunk", item="ent").count() == 0
    one = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a"), ("d", "b")], "chunk string, ent string")
    r = C.association(C.pair_counts(one, basket="chunk", item="ent")).first()
    assert r["lift"] == 1.0 and r["npmi"] == 1.0 and r["jaccard"] == 1.0 and abs(r["g2"]) < 1e-9
    rel = spark.createDataFrame([("b", "a"), (None, "a"), ("x", "x")], "f string, t string")
    assert C.related_pairs(C.pair_counts(one, basket="chunk", item="ent"), rel, "f", "t").count() == 1


def test_association_has_every_pair(spark, tmp_path):
    rows = [(f"c{i}", e) for i in range(6) for e in "ab"] + [("c0", "x"), (None, "a")]
    spark.createDataFrame(rows, "chunk_id string, entity_id string").write.parquet(f"{tmp_path}/entities.parquet")
    got = p2_association(spark, str(tmp_path)).collect()
    assert {(r["item_a"], r["item_b"]): r["together"] for r in got} == {("a", "b"): 6, ("a", "x"): 1, ("b", "x"): 1}


def vectors(spark, pairs):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "t", 1.0) for i, v in pairs], "id string, vector array<float>, other string, cosine double")


def brute_nearest(data, k, least=-1.0):
    ids = sorted(data)
    m = np.array([data[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    return {(ids[a], ids[b]) for a in range(len(ids)) for b in sorted((x for x in range(len(ids)) if x != a), key=lambda x: (-round(s[a, x], 6), ids[x]))[:k] if s[a, b] >= least}


def test_hilbert_is_a_bijection_with_unit_steps():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = V.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = {}
    for g in range(400):
        centre = rng.standard_normal(64)
        for j in range(int(rng.integers(1, 6))):
            data[f"g{g}-{j}"] = (centre + rng.standard_normal(64) * rng.uniform(0.05, 0.45)) * rng.uniform(0.2, 4)
    want = brute_nearest(data, 5, 0.8)
    got = V.nearest_neighbours(vectors(spark, data.items()), k=5, min_cosine=0.8, window=16, partition_rows=2000)
    found = {(r["id"], r["other"]) for r in got.collect()}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want)


@pytest.mark.parametrize("spread", [0.1, 0.02])
def test_recall_with_a_dense_third(spark, spread):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    data = {f"d{i}": centre / np.linalg.norm(centre) + rng.standard_normal(64) * spread / 8 for i in range(1500)}
    data |= {f"r{i}": rng.standard_normal(64) for i in range(3000)}
    data = {i: v.astype(np.float32) for i, v in data.items()}
    ids, m = list(data), np.array(list(data.values()), float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = m[:1500] @ m.T - 9 * np.eye(1500, len(m))
    want = {(ids[i], ids[j]) for i, row in enumerate(np.argsort(-cos, axis=1)[:, :5]) for j in row}
    got = V.nearest_neighbours(vectors(spark, data.items()), k=5, window=32, partition_rows=20_000)
    found = {(r["id"], r["other"]) for r in got.collect() if r["id"].startswith("d")}
    assert len(found) == len(want) and len(found & want) >= 0.98 * len(want)


@pytest.mark.parametrize("partition_rows", [80, 3000])
def test_windows_reach_over_cuts(spark, partition_rows):
    """However the orderings are cut into partitions, the same neighbours come out."""
    rng = np.random.default_rng(11)
    data = {f"v{i:03}": (c + rng.standard_normal(64) * 0.3).astype(np.float32) for i, c in enumerate(np.repeat(rng.standard_normal((60, 64)), 5, axis=0))}
    got = V.nearest_neighbours(vectors(spark, data.items()), k=4, min_cosine=0.7, orderings=2, window=20, partition_rows=partition_rows)
    want = V.nearest_neighbours(vectors(spark, data.items()), k=4, min_cosine=0.7, orderings=2, window=20, partition_rows=10**6)
    pairs = lambda df: {(r["id"], r["other"], r["rank"], round(r["cosine"], 6)) for r in df.collect()}
    assert pairs(got) == pairs(want) and len(pairs(want)) > 500


def test_far_neighbours_of_a_query_set(spark):
    """Noise without near neighbours: what the windows miss is compared exactly, for the ids asked."""
    rng = np.random.default_rng(12)
    data = {f"v{i}": rng.standard_normal(64).astype(np.float32) for i in range(2000)}
    asked = F.col("id").endswith("7")
    got = {(r["id"], r["other"]) for r in V.nearest_neighbours(vectors(spark, data.items()), k=5, queries=asked, exact_below=0.8, window=16).collect()}
    want = {(a, b) for a, b in brute_nearest(data, 5) if a.endswith("7")}
    assert len(got) == len(want) and len(got & want) >= 0.999 * len(want)


def test_exact_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    data = {f"v{i}": rng.standard_normal(16).astype(np.float32) for i in range(300)}
    unit = spark.createDataFrame([(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in data.items()], "cls string, unit array<float>")
    got = {}
    for r in V.exact_neighbours(unit.where("cls < 'v2'"), unit, 3, -1.0, tile_rows=70).collect():
        got.setdefault(r["cls"], []).append((-r["cosine"], r["other"]))
    assert {(a, o) for a, bs in got.items() for _, o in sorted(bs)[:3]} == {(a, b) for a, b in brute_nearest(data, 3) if a < "v2"}


def test_unusable_repeated_and_equal_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(f"s{i}", [x * (i + 1) for x in same]) for i in range(8)] + [("n", None), ("z", [0, 0, 0]), ("e", []), ("nan", [1, float("nan"), 0]), ("inf", [1, float("inf"), 0]), ("hole", [1, None, 0]), ("d", [3, 2, 1]), ("d", [3, 2, 1]), ("two", [1, 1]), (None, same)]
    got = V.nearest_neighbours(vectors(spark, rows), k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r["other"]))
    assert set(by) == {*[f"s{i}" for i in range(8)], "d"}
    assert [o for _, o in sorted(by["s0"])] == ["s1", "s2", "s3"] and [o for _, o in sorted(by["s5"])] == ["s0", "s1", "s2"] and [o for _, o in sorted(by["d"])] == ["s0", "s1", "s2"]
    assert V.nearest_neighbours(vectors(spark, []), k=3).count() == 0


def test_rank_fusion(spark):
    rng = random.Random(2)
    rows = [(q, f"i{rng.randint(0, 12)}", s, None) for q in (1, 2) for s in ("V", "K", "H") for _ in range(9)]
    rows = [(q, i, s, float(rng.choice([1, 2, 3, 4, 1e9, -5]))) for q, i, s, _ in rows]
    rows += rows[:5] + [(1, "nul", "V", None), (1, "nan", "V", float("nan")), (None, "x", "V", 1.0), (3, "a", "V", None), (4, "a", "V", 1.0)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "q long, i string, s string, o double, rank int, rrf string")
    got = {(r["q"], r["i"]): r for r in R.reciprocal_rank_fusion(df, query="q", item="i", source="s", order=F.col("o")).collect()}
    best = {}
    for q, i, s, o in rows:
        if q is not None and o is not None and not math.isnan(o):
            best[q, s, i] = min(o, best.get((q, s, i), math.inf))
    want = {}
    for (q, s, i), o in best.items():
        rank = 1 + sum(1 for (a, b, _), x in best.items() if (a, b) == (q, s) and x < o)
        want.setdefault((q, i), []).append(rank)
    assert set(got) == set(want)
    for k, ranks in want.items():
        assert got[k]["rrf"] == pytest.approx(sum(1 / (60 + r) for r in ranks)) and got[k]["worst_rank"] == max(ranks) and got[k]["sources"] == len(ranks)
        assert got[k]["position"] == 1 + sum(1 for o, rs in want.items() if o[0] == k[0] and round(sum(1 / (60 + r) for r in rs), 12) > got[k]["rrf"])
    assert got[4, "a"]["query_sources"] == 1
    assert R.reciprocal_rank_fusion(df.limit(0), query="q", item="i", source="s", order=F.col("o")).count() == 0


def test_no_source_outweighs_by_range(spark):
    rows = [(1, i, s, v) for s, scale in (("A", 1.0), ("B", 1e12)) for i, v in (("x", 1 * scale), ("y", 2 * scale), ("z", 3 * scale))]
    df = spark.createDataFrame(rows, "q int, i string, s string, o double")
    order = [r["i"] for r in R.reciprocal_rank_fusion(df, query="q", item="i", source="s", order=F.col("o")).orderBy("position").collect()]
    assert order == ["x", "y", "z"]
