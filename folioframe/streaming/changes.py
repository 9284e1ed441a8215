"""Streams of file events and of records: debouncing, pending changes, idempotent batches, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

EVENTS = "ts timestamp, path string, kind string"


def pending(events: DataFrame) -> DataFrame:
    """What a batch of file events (ts, path, kind of create, modify, remove) leaves to do: path, ``remove``, ``update``.

    A removal cancels the updates before it; an update after a removal doesn't cancel it, so the path is removed first and
    then read again. Events at the same time count in the order create, modify, remove.
    """
    order = F.create_map(F.lit("create"), F.lit(0), F.lit("modify"), F.lit(1), F.lit("remove"), F.lit(2))[F.col("kind")]
    at = F.struct("ts", order.alias("o"))
    gone = F.max(F.when(F.col("kind") == "remove", at))
    changed = F.max(F.when(F.col("kind") != "remove", at))
    seen = events.groupBy("path").agg(gone.alias("g"), changed.alias("c"))
    return seen.select("path", F.col("g").isNotNull().alias("remove"), (F.col("c").isNotNull() & (F.col("g").isNull() | (F.col("c") > F.col("g")))).alias("update"))


def debounced(events: DataFrame, quiet: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Batches of events: any event within ``quiet`` of the last prolongs the batch, over all paths; start, end, events.

    One global timer is one session, so this is for the trickle of events of a watched folder, not for data.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    told = rows.groupBy(F.session_window("ts", quiet).alias("w")).agg(F.collect_list(F.struct("ts", "path", "kind")).alias("events"))
    return told.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def quiet_batches(events: DataFrame, quiet: float, span: int = 3600) -> DataFrame:
    """A table of events with ``batch``: as ``debounced``, for any number of events. A batch goes on while neighbours are at most
    ``quiet`` seconds apart, over all paths.

    Events are ordered within spans of time; what a span needs of those before it, the last time and the number of
    batches, is one row per span. Rows with a null ``ts`` are left out.
    """
    rows = events.where("ts is not null").withColumn("__span", F.floor(F.col("ts").cast("timestamp").cast("double") / span))
    inside = Window.partitionBy("__span").orderBy("ts")
    before = F.lag("ts").over(inside)
    far = lambda a, b: (b.cast("timestamp").cast("double") - a.cast("timestamp").cast("double")) > quiet
    told = rows.withColumn("__new", F.when(before.isNotNull() & far(before, F.col("ts")), 1).otherwise(0))
    spans = told.groupBy("__span").agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"), F.sum("__new").alias("__news"))
    line = Window.orderBy("__span")  # a row per span
    prior = F.lag("__last").over(line)
    spans = spans.withColumn("__starts", F.when(prior.isNull() | far(prior, F.col("__first")), 1).otherwise(0))
    spans = spans.withColumn("__off", F.sum("__starts").over(line) + F.coalesce(F.sum("__news").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = told.join(spans.select("__span", "__off"), "__span")
    return joined.withColumn("batch", F.col("__off") + F.sum("__new").over(inside.rangeBetween(Window.unboundedPreceding, 0))).drop("__span", "__new", "__off")


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """Events from JSON files dropped into a folder."""
    return spark.readStream.schema(schema).json(folder)


def apply_changes(
    stream: DataFrame, checkpoint: str, remove: Callable[[DataFrame], None], update: Callable[[DataFrame], None], confirm: Callable[[DataFrame, int], None], once: bool = True
) -> StreamingQuery:
    """Applies file events batch by batch: removals, then updates, then the registry, so a batch that fails is done again.

    The callbacks get the paths and have to write by key; ``confirm`` comes last and gets the batch number. Batches and
    what was done of them are kept in ``checkpoint``.
    """

    def run(batch: DataFrame, number: int) -> None:
        todo = pending(batch).persist()
        try:
            remove(todo.where("remove").select("path"))
            update(todo.where("update").select("path"))
            confirm(todo, number)
        finally:
            todo.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums of ``value`` per event-time window and ``by``; rows later than ``late`` are dropped by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark; for a batch, once."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)
