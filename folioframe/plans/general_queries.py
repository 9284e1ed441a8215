"""Queries of the general training-data operators (incremental processing, hierarchies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioframe.operators import hierarchy as H
from folioframe.operators.incremental import changed_records, confirm, reread_from
from folioframe.session import table
from folioframe.stash import Stash


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The registry has runs that did not finish and no time they began at, so the oldest open record is unknown and all is reread."""
    return changed_records(table(spark, d, "files_now"), table(spark, d, "file_registry")).select("file_path")


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """The records to process with their version."""
    return changed_records(table(spark, d, "files_now"), table(spark, d, "file_registry"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs one after the other, with the log that says where to reread from: run, file_path, content_hash.

    The first sees what had arrived 27 hours after the first day began and fails when it has finished the paths of even length; the second sees
    what had arrived two hours later, the third everything. No run skips what the one before it left, none repeats what was finished.
    """
    stash = Stash(spark)
    scan, ledger = table(spark, d, "files_now"), table(spark, d, "file_registry")
    day = F.date_trunc("day", scan.agg(F.min("arrived_at")).scalar())
    since, runs = None, []
    for number, hours in ((1, 27), (2, 29), (3, None)):
        seen = scan if hours is None else scan.where(F.col("arrived_at") < day + F.expr(f"interval {hours} hours"))
        todo = stash.put(changed_records(seen, ledger, since=since))
        finished = todo.where("length(file_path) % 2 = 0") if number == 1 else todo
        ledger = stash.put(confirm(ledger, finished, key="file_path", version="content_hash", done="indexed_at", at=F.lit(4_000_000_000 + number).cast("bigint")))
        log = stash.put(reread_from(seen, ledger))
        since = log.scalar()
        runs.append(todo.select(F.lit(number).alias("run"), "file_path", "content_hash"))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def _tree(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", "parent_id", "breadcrumbs", "added_at")
    return H.hierarchy(chunks, order=[F.col("added_at")], extra=["breadcrumbs"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return H.faults(_tree(spark, d))


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = H.with_descendant_counts(_tree(spark, d))
    return tree.select("id", "state", "root", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", "/").alias("path"), "descendants")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = H.descendants(_tree(spark, d))
    return pairs.select("ancestor", "id", F.col("distance").cast("bigint").alias("distance"))


_NODES = """nodes AS (
  SELECT id, nullif(max_by(coalesce(parent_id, ''), added_at), '') AS parent_id, max_by(breadcrumbs, added_at) AS breadcrumbs
  FROM chunks WHERE id IS NOT NULL GROUP BY id)"""

_WALK = f"""WITH RECURSIVE {_NODES},
walk AS (
  SELECT n.id, CASE WHEN n.parent_id IS NULL THEN 'tree' ELSE 'orphan' END AS state, n.id AS root, CAST(0 AS BIGINT) AS depth, n.id AS path
  FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id WHERE n.parent_id IS NULL OR p.id IS NULL
  UNION ALL
  SELECT c.id, w.state, w.root, w.depth + 1, w.path || '/' || c.id FROM walk w JOIN nodes c ON c.parent_id = w.id),
lost AS (SELECT id, parent_id FROM nodes WHERE id NOT IN (SELECT id FROM walk)),
climb AS (
  SELECT id AS start, parent_id AS here FROM lost
  UNION
  SELECT c.start, l.parent_id FROM climb c JOIN lost l ON c.here = l.id),
loops AS (SELECT DISTINCT start AS id FROM climb WHERE start = here)"""

_P4 = """WITH now AS (
  SELECT file_path, lower(content_hash) AS content_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seen_at DESC, arrived_at DESC, content_hash DESC NULLS LAST) AS rn
    FROM files_now WHERE file_path IS NOT NULL) WHERE rn = 1 AND content_hash IS NOT NULL),
reg AS (
  SELECT file_path, lower(content_hash) AS content_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC, lower(content_hash) DESC) AS rn
    FROM file_registry WHERE indexed_at IS NOT NULL AND content_hash IS NOT NULL) WHERE rn = 1)
SELECT {cols} FROM now LEFT JOIN reg USING (file_path) WHERE reg.content_hash IS NULL OR reg.content_hash <> now.content_hash"""

def _run(number: int, until: str, ledger: str) -> str:
    return f"""n{number} AS (SELECT file_path, h FROM (SELECT file_path, lower(content_hash) AS h, row_number() OVER (PARTITION BY file_path ORDER BY seen_at DESC, arrived_at DESC, content_hash DESC NULLS LAST) AS rn
  FROM files_now WHERE file_path IS NOT NULL {until}) WHERE rn = 1 AND h IS NOT NULL),
r{number} AS (SELECT n.file_path, n.h FROM n{number} n LEFT JOIN {ledger} l USING (file_path) WHERE l.h IS NULL OR l.h <> n.h)"""


def _after(number: int, before: str, finished: str) -> str:
    return f"l{number} AS (SELECT * FROM {before} WHERE file_path NOT IN (SELECT file_path FROM {finished}) UNION ALL SELECT * FROM {finished})"


_RUNS = f"""WITH t AS (SELECT date_trunc('day', min(arrived_at)) AS day FROM files_now),
l0 AS (SELECT file_path, h FROM (SELECT file_path, lower(content_hash) AS h, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC, lower(content_hash) DESC) AS rn
  FROM file_registry WHERE indexed_at IS NOT NULL AND content_hash IS NOT NULL AND file_path IS NOT NULL) WHERE rn = 1),
{_run(1, "AND arrived_at < (SELECT day + INTERVAL 27 HOUR FROM t)", "l0")}, f1 AS (SELECT * FROM r1 WHERE length(file_path) % 2 = 0), {_after(1, "l0", "f1")},
{_run(2, "AND arrived_at < (SELECT day + INTERVAL 29 HOUR FROM t)", "l1")}, {_after(2, "l1", "r2")}, {_run(3, "", "l2")}
SELECT 1 AS run, file_path, h AS content_hash FROM r1 UNION ALL SELECT 2, file_path, h FROM r2 UNION ALL SELECT 3, file_path, h FROM r3"""

QUERIES = {"p4_found": p4_found, "p4_changes": p4_changes, "p4_runs": p4_runs, "p6_found": p6_found, "p6_hierarchy": p6_hierarchy, "p6_descendants": p6_descendants}

SQL = {
    "p4_runs": _RUNS,
    "p4_found": _P4.format(cols="file_path"),
    "p4_changes": _P4.format(cols="file_path, now.content_hash AS content_hash"),
    "p6_found": _WALK + """
SELECT id, state AS fault FROM walk WHERE state = 'orphan'
UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM loops) THEN 'cycle' ELSE 'below_cycle' END FROM lost
UNION ALL SELECT w.id, 'depth' FROM walk w JOIN nodes n USING (id)
WHERE w.state = 'tree' AND n.breadcrumbs IS NOT NULL AND len(string_split(n.breadcrumbs, ' > ')) <> w.depth""",
    "p6_hierarchy": _WALK + """,
up AS (
  SELECT w.id AS id, n.parent_id AS ancestor FROM walk w JOIN nodes n USING (id) WHERE w.depth > 0
  UNION ALL SELECT u.id, n.parent_id FROM up u JOIN nodes n ON u.ancestor = n.id JOIN walk w ON w.id = n.id WHERE w.depth > 0),
below AS (SELECT ancestor, count(*) AS n FROM up GROUP BY ancestor)
SELECT w.id, w.state, w.root, w.depth, w.path, coalesce(b.n, 0) AS descendants FROM walk w LEFT JOIN below b ON b.ancestor = w.id
UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM loops) THEN 'cycle' ELSE 'below_cycle' END, NULL, NULL, NULL, NULL FROM lost""",
    "p6_descendants": _WALK + """,
up AS (
  SELECT w.id AS id, n.parent_id AS ancestor, CAST(1 AS BIGINT) AS distance FROM walk w JOIN nodes n USING (id) WHERE w.depth > 0
  UNION ALL SELECT u.id, n.parent_id, u.distance + 1 FROM up u JOIN nodes n ON u.ancestor = n.id JOIN walk w ON w.id = n.id WHERE w.depth > 0)
SELECT ancestor, id, distance FROM up""",
}
