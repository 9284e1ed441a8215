"""Incremental processing, hierarchies, ranks and lookups against brute force, with nulls, ties, repeats and empty tables."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from folioframe.operators import hierarchy as H
from folioframe.operators.incremental import changed_records, confirm, reread_from
from folioframe.operators.skew import grouped_rank, lookup

NOW = "file_path string, content_hash string, seen_at timestamp_ntz, arrived_at timestamp_ntz, indexed_at string"
REG = "file_path string, content_hash string, indexed_at bigint, seen_at string"


def at(day, hour=0):
    return datetime(2025, 2, day, hour)


def changed(spark, now, reg):
    return {tuple(r) for r in changed_records(spark.createDataFrame(now, NOW), spark.createDataFrame(reg, REG)).collect()}


def test_changed_records(spark):
    epoch = int(datetime(2025, 2, 1).timestamp())
    reg = [("a", "AA", epoch, "x"), ("a", "00", epoch - 9, None), ("b", "bb", epoch, None), ("c", None, epoch, None), ("d", "dd", None, None), (None, "zz", epoch, None), ("late", "l1", epoch - 5, None)]
    now = [
        ("a", "aa", at(3), at(3), None),  # same but for letter case
        ("b", "bb", at(2), at(2), None), ("b", "b2", at(3), at(2), None), ("b", "b2", at(3), at(2), None),  # newer, repeated
        ("c", "cc", at(3), at(3), None),  # only an unreadable registry row
        ("d", "dd", at(3), at(3), None),  # run not finished
        ("e", "ee", at(2), at(2), None), ("e", None, at(3), at(3), None),  # latest look unreadable
        ("f", "ff", None, None, None), (None, "nn", at(3), at(3), None),
        ("late", "l2", datetime(2025, 1, 31, 20), at(2), None),  # seen before the last run ended, arrived after
    ]
    assert changed(spark, now, reg) == {("b", "b2"), ("c", "cc"), ("d", "dd"), ("f", "ff"), ("late", "l2")}
    assert changed(spark, now, []) == {("a", "aa"), ("b", "b2"), ("c", "cc"), ("d", "dd"), ("f", "ff"), ("late", "l2")}
    assert changed(spark, [], reg) == set()


def test_change_seen_before_the_failed_run_ended(spark):
    """The scan of 9:00 saw both files changed; the run finished ``a`` at 10:00 and failed at ``b``."""
    ended = int(datetime(2025, 2, 2, 10, tzinfo=timezone.utc).timestamp())
    reg = [("a", "a1", ended - 90_000, None), ("b", "b1", ended - 90_000, None), ("a", "a2", ended, None), ("b", "b2", None, None)]
    now = [("a", "a2", at(2, 9), at(2, 9), None), ("b", "b2", at(2, 9), at(2, 9), None), ("c", "c1", at(1), at(1), None)]
    assert changed(spark, now, reg) == {("b", "b2"), ("c", "c1")}


def test_confirmed_records_are_not_processed_again(spark):
    now = spark.createDataFrame([("a", "a1", at(3), at(3), None), ("b", "b1", at(3), at(3), None)], NOW)
    ledger = spark.createDataFrame([("a", "a0", 5, None)], REG)
    todo = changed_records(now, ledger)
    assert todo.count() == 2
    done = confirm(ledger, todo, key="file_path", version="content_hash", done="indexed_at", at=F.lit(2_000_000_000).cast("bigint"))
    assert changed_records(now, done).count() == 0


def test_reread_from_the_oldest_open_record(spark):
    rows = [("a", "a1", at(1), at(1), None), ("b", "b1", at(2), at(2), None), ("b", "b2", at(3), at(3), None), ("c", "c1", at(4), at(4), None), ("d", None, at(1), at(1), None)]
    scan = spark.createDataFrame(rows, NOW)
    book = lambda *done: spark.createDataFrame([(k, v, 5, None) for k, v in done], REG)
    since = lambda df, ledger: reread_from(df, ledger).first()["since"]
    assert since(scan, book(("a", "a1"), ("b", "b1"))) == at(2)  # b2 and c1 are open; b's first row counts
    assert since(scan, book(("a", "A1"), ("b", "b2"), ("c", "c1"))) == at(4) and since(scan.limit(0), book()) is None
    assert since(scan.unionByName(spark.createDataFrame([("e", "e1", None, None, None)], NOW)), book()) is None


@pytest.mark.parametrize("seed", range(2))
def test_runs_that_fail_skip_and_repeat_nothing(spark, seed):
    """Random arrivals, late looks and failures: with the mark of the last run the same records come out as without."""
    rng = random.Random(seed)
    rows = []
    for n in range(40):
        day = rng.randint(1, 9)
        rows.append((f"f{rng.randint(0, 9)}", rng.choice(["x", "y", "z", None]), at(day, rng.randint(0, 23)), at(min(10, day + rng.choice([0, 0, 1])), 23) if n else None, None))
    ledger, since = spark.createDataFrame([], REG), None
    for run, day in enumerate((3, 6, 8, 12)):
        seen = spark.createDataFrame([r for r in rows if r[3] is None or r[3] < at(day)], NOW)
        todo = {tuple(r) for r in changed_records(seen, ledger, since=since).collect()}
        assert todo == {tuple(r) for r in changed_records(seen, ledger).collect()}
        done = [(k, v, 100 + run, None) for k, v in sorted(todo) if run % 2 or rng.random() < 0.5]
        ledger = spark.createDataFrame([tuple(r) for r in ledger.collect()] + done, REG)
        since = F.lit(reread_from(seen, ledger).first()["since"])
    assert changed_records(seen, ledger).count() == 0


def brute(links):
    out = {}
    for node in links:
        path, x = [node], links[node]
        while x is not None and x in links and x not in path:
            path.append(x)
            x = links[x]
        if x is None:
            out[node] = ("tree", len(path) - 1, path[-1])
        elif x not in links:
            out[node] = ("orphan", len(path) - 1, path[-1])
        else:
            out[node] = ("cycle" if x == node else "below_cycle", None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_random(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(60)]
    links = {i: rng.choice([None, "", "gone", *ids, *ids]) for i in ids}
    rows = [(i, p, "x", i) for i, p in links.items()] * 2 + [(None, "n1", "x", "q")]
    df = spark.createDataFrame(rows, "id string, parent_id string, state string, root string")
    got = {r["id"]: (r["state"], r["depth"], r["root"]) for r in H.hierarchy(df).collect()}
    links = {i: p or None for i, p in links.items()}
    assert got == brute(links)
    pairs = {(r["ancestor"], r["id"]) for r in H.descendants(H.hierarchy(df)).collect()}
    want = set()
    for i, (state, depth, _) in brute(links).items():
        x = i
        for _ in range(depth or 0):
            x = links[x]
            want.add((x, i))
    assert pairs == want


def test_hierarchy_edges(spark):
    schema = "id string, parent_id string, breadcrumbs string"
    empty = H.hierarchy(spark.createDataFrame([], schema), extra=["breadcrumbs"])
    assert empty.count() == 0 and H.faults(empty).count() == 0
    rows = [("r", None, None), ("a", "r", "R"), ("b", "a", "R"), ("c", "r", ""), ("s", "s", "R"), ("t", "s", None), ("o", "missing", "R")]
    tree = H.hierarchy(spark.createDataFrame(rows, schema), extra=["breadcrumbs"])
    assert {tuple(r) for r in H.faults(tree).collect()} == {("b", "depth"), ("c", "depth"), ("s", "cycle"), ("t", "below_cycle"), ("o", "orphan")}
    counts = {r["id"]: r["descendants"] for r in H.with_descendant_counts(tree).collect()}
    assert counts == {"r": 3, "a": 1, "b": 0, "c": 0, "s": None, "t": None, "o": 0}


@pytest.mark.parametrize("per_bucket", [200_000, 5])
def test_grouped_rank(spark, per_bucket):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 40) if g != "t" else 7, i) for i in range(300) for g in ("h", "t", None)] + [("h", None, -1)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(r["g"], r["i"]): r["rank"] for r in grouped_rank(df, ["g"], F.col("v"), per_bucket=per_bucket).collect()}
    for g, v, i in rows:
        assert got[g, i] == (None if v is None else 1 + sum(1 for a, b, _ in rows if a == g and b is not None and b < v))
    assert grouped_rank(df.limit(0), ["g"], F.col("v")).count() == 0


def test_lookup(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("c", 1), (None, 2), ("x", 3)], "k string, v int")
    facts = spark.createDataFrame([("hot", 500, "H"), ("c", 1, "C")], "k string, n bigint, f string")
    got = lookup(rows, facts, "k", "n", 500)
    assert got.count() == 501 and got.where("f = 'C'").count() == 1
