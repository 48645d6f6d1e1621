"""Logs of file changes, attempts and sync activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import ROWS_PER_SLICE, carried_value, previous_row, running_sum, with_slices

# How long a mark counts, and the pauses between attempts, in seconds.
MARK_TTL = 30.0
FIRST_DELAY = 5.0
DELAY_FACTOR = 2.0
LONGEST_DELAY = 60.0


def seconds(ts) -> F.Column:
    """Time stamp as seconds with fractions."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def relevant_events(events: DataFrame) -> DataFrame:
    """Changes of Markdown files outside hidden folders."""
    path = F.col("path")
    return events.filter(path.endswith(".md") & ~path.rlike(r"(^|/)\."))


def dedupe_mtime(events: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Drop a Modified whose mtime equals the one remembered for its path.

    Each Modified with an mtime is remembered; one without leaves what is remembered, as any
    other kind does, but Deleted forgets it.
    """
    sliced = with_slices(events, ["path"], "seq", rows_per_slice)
    modified = (F.col("kind") == "Modified") & F.col("mtime").isNotNull()
    kept = F.when(modified, F.struct("mtime")).when(
        F.col("kind") == "Deleted", F.struct(F.lit(None).cast(events.schema["mtime"].dataType).alias("mtime"))
    )
    seen = carried_value(sliced, ["path"], "seq", kept, "known", before=True)
    repeated = modified & (F.col("known.mtime") == F.col("mtime"))
    return seen.filter(~F.coalesce(repeated, F.lit(False))).select(*events.columns)


def rename_marks(renames: DataFrame) -> DataFrame:
    """Marks (seq, ts, path) of applied renames: both the old and the new path are marked."""
    return renames.select("seq", "ts", F.explode(F.array("src", "dst")).alias("path"))


def suppress_echo(
    marks: DataFrame, events: DataFrame, ttl: float = MARK_TTL, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Add ``is_echo``: the row before an event, marks and events together, is a fresh mark.

    A mark is used up by the next event of its path and replaced by the next mark, so
    only the previous row matters.
    """
    rows = events.select("path", "seq", "ts", F.lit(False).alias("is_mark")).unionByName(
        marks.select("path", "seq", "ts", F.lit(True).alias("is_mark"))
    )
    sliced = with_slices(rows, ["path"], "seq", rows_per_slice)
    seen = previous_row(sliced, ["path"], "seq", ["is_mark", "ts"])
    age = seconds("ts") - seconds("prev.ts")
    echo = F.coalesce(F.col("prev.is_mark") & (age < ttl), F.lit(False))
    return seen.filter(~F.col("is_mark")).select("path", "seq", "ts", echo.alias("is_echo"))


def retry_schedule(
    attempts: DataFrame, now, max_attempts: int | None = None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Failed attempts (peer, seq, ts) with their number since the last success.

    Adds attempt, delay (seconds), next_due, due_now and exceeded.  ``attempts`` has peer,
    seq, ts and success.
    """
    sliced = with_slices(attempts, ["peer"], "seq", rows_per_slice)
    failed = F.when(F.col("success"), 0).otherwise(1)
    counted = running_sum(sliced, ["peer"], "seq", failed, "failures")
    based = carried_value(counted, ["peer"], "seq", F.when(F.col("success"), F.col("failures")), "before")
    attempt = F.col("failures") - F.coalesce("before", F.lit(0))
    delay = F.least(F.lit(FIRST_DELAY) * F.pow(F.lit(DELAY_FACTOR), F.col("attempt") - 1), F.lit(LONGEST_DELAY))
    exceeded = F.lit(False) if max_attempts is None else F.col("attempt") >= max_attempts
    return (
        based.filter(~F.col("success"))
        .withColumn("attempt", attempt.cast("long"))
        .withColumn("delay", delay)
        .withColumn("next_due", F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) + F.col("delay") * 1e6).cast("long")))
        .withColumn("due_now", F.lit(now).cast("timestamp") >= F.col("next_due"))
        .select("peer", "seq", "ts", "attempt", "delay", "next_due", "due_now", exceeded.alias("exceeded"))
    )


def event_counts(events: DataFrame, window: str = "1 minute") -> DataFrame:
    """Per time window and event type: events and bytes.  Works on a stream with a watermark."""
    return (
        events.groupBy(F.window("ts", window), "type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        .select(F.col("window.start").alias("start"), "type", "n", "bytes")
    )
