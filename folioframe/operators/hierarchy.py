"""Parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioframe.operators.incremental import latest
from folioframe.stash import Stash


def _nodes(rows: DataFrame, id_col: str, parent_col: str, order: list[Column], extra: list[str]) -> DataFrame:
    keep = ["__parent", *[f"__x{i}" for i in range(len(extra))]]
    data = rows.select(
        F.col(id_col).alias("id"),
        F.when(F.col(parent_col) == "", None).otherwise(F.col(parent_col)).alias("__parent"),
        *[F.col(c).alias(f"__x{i}") for i, c in enumerate(extra)],
        *[o.alias(f"__o{i}") for i, o in enumerate(order)],
    )
    return latest(data, "id", [F.col(f"__o{i}") for i in range(len(order))], keep).withColumnRenamed("__parent", "parent")


#: Up to this many rows a frontier is taken ``STRIDE`` levels down per job.
SMALL_FRONTIER, STRIDE = 100_000, 5


def _below(frontier: DataFrame, children: DataFrame) -> DataFrame:
    """The next level: the children of the frontier, with their depth and path."""
    return frontier.alias("f").join(children.alias("c"), F.col("f.id") == F.col("c.parent")).select(
        "c.id", "f.state", "f.root", (F.col("f.depth") + 1).alias("depth"), F.array_append("f.path", F.col("c.id")).alias("path")
    )


def on_cycles(links: DataFrame, stash: Stash) -> DataFrame:
    """Ids that lie on a cycle, of ``links`` (id, parent) in which every parent is an id itself.

    The image of the parent map under 2, 4, 8, ... steps shrinks to the nodes on cycles and then stays as it is;
    so a number of joins logarithmic in the longest tail is enough.
    """
    jump = stash.put(links.select("id", F.col("parent").alias("to")))
    size = jump.count()
    while size:
        image = stash.put(jump.select(F.col("to").alias("id")).distinct())
        now = image.count()
        if now == size:
            return image
        size = now
        # nodes that are no longer images stay in the map: they may still jump, but only images have to be kept
        kept = jump.join(image, "id", "left_semi")
        old, jump = jump, stash.put(kept.alias("a").join(kept.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", F.col("b.to").alias("to")))
        stash.drop(old)
        stash.drop(image)
    return links.select("id").limit(0)


def hierarchy(
    rows: DataFrame,
    *,
    id_col: str = "id",
    parent_col: str = "parent_id",
    order: list[Column] | None = None,
    extra: list[str] | None = None,
) -> DataFrame:
    """For each id: ``parent``, ``state``, ``root``, ``depth``, ``path`` (ids from the root down) and the ``extra`` columns.

    Level by level the frontier is joined with the links below it, starting at the roots (null or empty parent) and
    at the heads of broken trees (parent that is no id). A node is reached at most once, since it has one parent;
    what no frontier reaches hangs on a cycle. ``state`` is ``tree``, ``orphan`` (under a missing parent; ``root`` is
    the topmost existing node, depth and path count from it), ``cycle`` (on one) or ``below_cycle``; for the last two
    root, depth and path are null.

    An id written several times counts once (greatest ``order``, then values). Null ids are ignored. Levels are
    written to the shared folder; their number is the depth of the deepest tree.
    """
    extra = extra or []
    stash = Stash(rows.sparkSession)
    nodes = stash.put(_nodes(rows, id_col, parent_col, order or [F.lit(0)], extra))
    links = nodes.select("id", "parent")
    children = stash.put(links.where("parent is not null").join(links.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent"))
    inner = children.select(F.col("parent").alias("id")).distinct()  # only these can have a next level
    heads = (
        links.where("parent is not null")
        .join(children.select("id"), "id", "left_anti")
        .select("id", F.lit("orphan").alias("state"))
        .unionByName(links.where("parent is null").select("id", F.lit("tree").alias("state")))
    )
    level = stash.put(heads.select("id", "state", F.col("id").alias("root"), F.lit(0).alias("depth"), F.array("id").alias("path")))
    levels = [level]
    frontier, depth, size = level.join(inner, "id", "left_semi"), 0, SMALL_FRONTIER + 1
    while True:
        # a thin frontier goes several levels down in one job; a wide one is written after each, so no join is done twice
        stride = STRIDE if size <= SMALL_FRONTIER else 1
        steps = [frontier]
        for _ in range(stride):
            steps.append(_below(steps[-1], children))
        batch = steps[1]
        for step in steps[2:]:
            batch = batch.unionByName(step)
        batch, size = stash.put_counted(batch)
        if not size:
            break
        levels.append(batch)
        depth += stride
        frontier = batch.where(F.col("depth") == depth)
    paths = [p._stash_path for p in levels]
    reached = rows.sparkSession.read.schema(levels[0].schema).parquet(*paths)
    lost = stash.put(links.join(reached.select("id"), "id", "left_anti"))
    loops = on_cycles(lost, stash)
    rest = (
        lost.select("id")
        .join(loops.withColumn("__c", F.lit("cycle")), "id", "left")
        .select(
            "id", F.coalesce("__c", F.lit("below_cycle")).alias("state"), F.lit(None).cast("string").alias("root"),
            F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"),
        )
    )
    full = nodes.join(reached.unionByName(rest), "id")
    return full.select("id", "parent", "state", "root", "depth", "path", *[F.col(f"__x{i}").alias(c) for i, c in enumerate(extra)])


def descendants(tree: DataFrame) -> DataFrame:
    """Pairs (``ancestor``, ``id``, ``distance``) of a ``hierarchy`` result, distance 1 and more; no pair for nodes on or below a cycle.

    One row per pair and no list per ancestor, so a root with a third of all nodes below it is no large group.
    """
    pairs = tree.where("path is not null").select("id", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return pairs.where("pos < depth").select("ancestor", "id", (F.col("depth") - F.col("pos")).alias("distance"))


def with_descendant_counts(tree: DataFrame) -> DataFrame:
    """``hierarchy`` plus ``descendants``: how many nodes lie below each (0 for leaves, null on and below cycles)."""
    counts = descendants(tree).groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"))
    joined = tree.join(counts, tree["id"] == counts["ancestor"], "left").drop("ancestor")
    return joined.withColumn("descendants", F.when(F.col("path").isNotNull(), F.coalesce("descendants", F.lit(0))))


def faults(tree: DataFrame, breadcrumbs: str = "breadcrumbs", separator: str = " > ") -> DataFrame:
    """(``id``, ``fault``) where links or breadcrumbs fail: ``cycle``, ``below_cycle``, ``orphan``, or ``depth`` when a
    node of a whole tree has breadcrumbs whose number of titles differs from its depth (null breadcrumbs: no fault;
    empty breadcrumbs: no title)."""
    titles = F.when(F.col(breadcrumbs) == "", 0).otherwise(F.size(F.split(breadcrumbs, separator)))
    fault = F.when(F.col("state") != "tree", F.col("state")).when(
        F.col(breadcrumbs).isNotNull() & (titles != F.col("depth")), F.lit("depth")
    )
    return tree.select("id", fault.alias("fault")).where("fault is not null")
