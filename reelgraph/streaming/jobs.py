"""The incremental jobs as Structured Streaming. Late rows are accepted; the last arrival wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.community import first_per_key
from ..sources.tables import upsert
from ..sources.versions import VersionedTable


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hands all that has landed to `each` in micro-batches, then stops; a restart goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def stream_upsert(stream: DataFrame, table: VersionedTable, checkpoint: str, place: list[str] | None = None) -> None:
    """Upserts all that has landed into a table, each batch once: one that comes again after a failure is known by its
    number, and the table tells where it stands. `place` names the columns by which the last row of a key in a batch
    wins. Only the buckets of a batch's keys are read and written."""
    run_available(stream, lambda batch, number: table.merge(number, batch, lambda old, new: upsert(old, new, table.keys, place=place)), checkpoint)


def stream_dedupe(activities: DataFrame, delay: str | None = None) -> DataFrame:
    """Rows whose dedupe key was not seen before; empty keys pass. The state grows with the keys; give `delay`, on a
    stream with the timestamp created_at, to forget keys older than that."""
    empty, keyed = activities.where("dedupe_key = ''"), activities.where("dedupe_key <> ''")
    if delay:
        keyed = keyed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["dedupe_key"])
    else:
        keyed = keyed.dropDuplicates(["dedupe_key"])
    return empty.unionByName(keyed)


def stream_errors(outcomes: DataFrame) -> DataFrame:
    """Running retry count per (task, entity); for the modes update and complete."""
    return outcomes.where("outcome = 'failed'").groupBy("task", "entity").agg(F.count("*").alias("retry_count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


TARGET = ["target_type", "target_id"]


def floored_steps(changes: DataFrame, span: str = "1 minute") -> DataFrame:
    """(target_type, target_id, total, least): what steps (ts, id, delta) in the order of (ts, id) do to a count that never
    falls below 0 at any step: from n they lead to greatest(n + total, least).

    Steps of that kind are closed under composition, so each target's steps are summed up by spans of time (total of the
    span, and what it leads to from 0 or less), and the spans' sums in order: no task holds more of a hot target than a
    span's steps, or a row for each span."""
    running = Window.partitionBy(*TARGET, "span").orderBy("ts", "id")
    steps = changes.select(*TARGET, "ts", "id", "delta", F.window("ts", span)["start"].alias("span")).withColumn("so_far", F.sum("delta").over(running))
    spans = steps.groupBy(*TARGET, "span").agg(F.sum("delta").alias("total"), (F.sum("delta") - F.min("so_far")).alias("least"))
    spans = spans.withColumn("before", F.sum("total").over(Window.partitionBy(*TARGET).orderBy("span")))
    return spans.groupBy(*TARGET).agg(F.sum("total").alias("total"), (F.max(F.col("least") - F.col("before")) + F.sum("total")).alias("least"))


def counted(old: DataFrame, steps: DataFrame) -> DataFrame:
    """Counts (target_type, target_id, n) after floored_steps; targets without one start at 0."""
    both = old.select(*TARGET, "n").join(steps, TARGET, "full")
    n = F.coalesce("n", F.lit(0))
    return both.select(*TARGET, F.coalesce(F.greatest(n + F.col("total"), "least"), n).cast("long").alias("n"))


def stream_counters(stream: DataFrame, table: VersionedTable, checkpoint: str, span: str = "1 minute") -> None:
    """Running counts per target of (target_type, target_id, ts, id, delta), never below 0 at any step: within a batch in
    the order of (ts, id), batch after batch. The counts are a table (target_type, target_id, n); batches count once."""
    run_available(stream, lambda batch, number: table.merge(number, floored_steps(batch, span), counted), checkpoint)


def batch_counters(changes: DataFrame, span: str = "1 minute") -> DataFrame:
    """The batch twin of stream_counters, for all changes at once."""
    return floored_steps(changes, span).select(*TARGET, F.greatest("total", "least").cast("long").alias("n"))


def batch_dedupe(activities: DataFrame) -> DataFrame:
    """The batch twin of stream_dedupe."""
    return activities.where("dedupe_key = ''").unionByName(first_per_key(activities.where("dedupe_key <> ''"), ["dedupe_key"]))
