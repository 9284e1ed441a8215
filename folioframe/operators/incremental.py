"""Processing only new or changed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest(rows: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each ``key`` that is greatest by ``order``; one map-side combined aggregation, no window.

    Nulls in ``order`` are the oldest. Rows equal in all of ``order`` are decided by the kept values, so the
    result does not depend on the order of the input. Rows with a null key are dropped.
    """
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    best = rows.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(packed).alias("__m"))
    return best.select(F.col(key), *[F.col(f"__m.k{i}").alias(c) for i, c in enumerate(keep)])


def changed_records(
    source: DataFrame,
    ledger: DataFrame,
    *,
    key: str = "file_path",
    version: str = "content_hash",
    seen: str = "seen_at",
    arrived: str = "arrived_at",
    done: str = "indexed_at",
    since: Column | None = None,
) -> DataFrame:
    """Records of ``source`` that a run has to process: new keys, and keys whose version differs from the ledger's.

    ``since`` is what ``reread_from`` found for the last run: the arrival of the oldest record that was open then. Only
    keys with a row that arrived at that time or later are reread, a filter that reaches the scan, and of these every
    row, so a late look at an old state does not stand for the newest. What the reread has in common with finished runs is
    removed by an anti-join of (key, version) against the ledger's finished rows: nothing is processed twice, and a run
    that is repeated after a failure returns the same records until the ledger has them. Without ``since``, or where it
    is null (no run was recorded, or an open record has no time), everything is reread. Rows without a time of arrival
    are always reread.

    Versions are compared without letter case. A key's row is its latest by ``seen`` (then ``arrived``, then
    version); if its version is null (unreadable) the key is left out. In the ledger a key's row is the latest by
    ``done`` of those with neither ``done`` nor version null. Null keys are ignored. An empty ledger returns every
    readable key, an empty source no row. Other columns play no part. Result: ``key``, ``version`` (lower case).
    """
    now = source.select(F.col(key).alias("__key"), F.lower(version).alias("__version"), F.col(seen).alias("__seen"), F.col(arrived).alias("__arrived"))
    if since is not None:
        fresh = now.where(F.col("__arrived").isNull() | since.isNull() | (F.col("__arrived") >= since)).select("__key").distinct()
        now = now.join(fresh, "__key", "left_semi")
    return _open(now, ledger, key, version, done).select(F.col("__key").alias(key), F.col("__version").alias(version))


def _open(now: DataFrame, ledger: DataFrame, key: str, version: str, done: str) -> DataFrame:
    """Keys of ``now`` whose latest version the ledger has not finished: __key, __version."""
    book = ledger.select(F.col(key).alias("__key"), F.lower(version).alias("__version"), F.col(done).alias("__done"))
    finished = latest(book.where("__done is not null and __version is not null"), "__key", [F.col("__done")], ["__version"])
    recent = latest(now, "__key", [F.col("__seen"), F.col("__arrived")], ["__version"])
    return recent.where("__version is not null").join(finished, ["__key", "__version"], "left_anti")


def reread_from(
    source: DataFrame, ledger: DataFrame, *, key: str = "file_path", version: str = "content_hash", seen: str = "seen_at", arrived: str = "arrived_at", done: str = "indexed_at"
) -> DataFrame:
    """Where the next run has to start: one row with ``since``, the arrival of the oldest record that is open.

    Called at the end of a run, finished or failed, with what the run saw and the ledger it left, and kept in a log of
    runs. A record is open if the ledger has not finished the latest version of its key; the run may have failed, or
    finished other keys after it saw this one. Everything that arrived before the first row of any open key is
    finished. With nothing open it is the newest arrival, whose time more rows may still come in for; it is null if an open key has
    a row without a time, and for an empty source.
    """
    now = source.select(F.col(key).alias("__key"), F.lower(version).alias("__version"), F.col(seen).alias("__seen"), F.col(arrived).alias("__arrived"))
    left = now.join(_open(now, ledger, key, version, done).select("__key", F.lit(True).alias("__left")), "__key", "left")
    timeless = F.coalesce(F.bool_or(F.col("__left") & F.col("__arrived").isNull()), F.lit(False))
    return left.agg(F.when(~timeless, F.coalesce(F.min(F.when(F.col("__left"), F.col("__arrived"))), F.max("__arrived"))).alias("since"))


def confirm(ledger: DataFrame, processed: DataFrame, *, key: str, version: str, done: str, at: Column) -> DataFrame:
    """The ledger after a run: its rows and one finished row per processed record.

    Write this after the run's output is committed, never before: a run that fails in between is repeated, and
    its output has to be written by key. Columns of the ledger the run does not know are null.
    """
    made = processed.select(F.col(key), F.col(version), at.alias(done))
    return ledger.unionByName(made, allowMissingColumns=True)
