"""Keeping the link table and the vector cache up to date from a stream of file changes.

Every micro-batch writes one segment: the new links and content hash of each path it touched, in
folders by a hash of the path (``bucket``).  Segments are merged like digits: ``FAN`` segments of a tier
make one of the next, so a row is rewritten once per tier and a reader meets at most ``FAN`` segments
of each.  A segment's name says which batches it holds, so a batch that is run again replaces its own
files, and no list of segments has to be kept in step.  Whoever asks for some buckets reads only these.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.links import linked_note_names
from ..scale import cut_lineage, drop_steps

CHANGE_SCHEMA = "path string, name string, deleted boolean, tgt_names array<string>, content_hash string, batch long, bucket int"
BUCKETS = 64
FAN = 8


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def index_changes(events: DataFrame, notes: DataFrame) -> DataFrame:
    """What one batch of changes does to the index: one row per path, its last event counts."""
    last = events.groupBy("path").agg(F.max_by("kind", "seq").alias("kind"))
    touched = last.join(notes.select("path", "name", "content"), "path", "left")
    gone = (F.col("kind") == "Deleted") | F.col("content").isNull()
    return touched.select(
        "path",
        "name",
        gone.alias("deleted"),
        F.when(~gone, linked_note_names(F.col("content"))).alias("tgt_names"),
        F.when(~gone, F.sha2("content", 256)).alias("content_hash"),
    )


def _segment(location: str, tier: int, upto: int) -> str:
    return f"{location}/tier-{tier}-upto-{upto}"


def live_segments(names: list[str]) -> list[str]:
    """Of the segment folders there are, those that together hold every batch once."""
    found = {tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"tier-(\d+)-upto-(\d+)", n))}
    end, out = max((upto for _, upto in found), default=-1), []
    while end >= 0:
        tier = max((t for t, upto in found if upto == end), default=None)
        if tier is None:
            raise ValueError(f"the segment of batch {end} is missing")
        out.append(f"tier-{tier}-upto-{end}")
        end -= FAN**tier
    return out


def _folder(spark: SparkSession, location: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _segments(spark: SparkSession, location: str) -> list[str]:
    """Names of the complete segments; one that a writer did not finish has no mark."""
    fs, path = _folder(spark, location)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    jvm = spark.sparkContext._jvm
    return [n for n in names if n.startswith("tier-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{location}/{n}/_SUCCESS"))]


def read_changes(spark: SparkSession, location: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of the live segments, of all buckets or of some; other buckets' folders are not read."""
    paths = [f"{location}/{n}" for n in live_segments(_segments(spark, location))]
    out = spark.createDataFrame([], CHANGE_SCHEMA)
    if paths:
        read = [spark.read.schema(CHANGE_SCHEMA).option("basePath", p).parquet(p) for p in paths]  # at most FAN a tier
        out = read[0]
        for other in read[1:]:
            out = out.unionByName(other)
    return out if buckets is None else out.filter(F.col("bucket").isin(buckets))


def _latest(changes: DataFrame) -> DataFrame:
    fields = F.struct("name", "deleted", "tgt_names", "content_hash", "batch")
    return changes.groupBy("path", "bucket").agg(F.max_by(fields, "batch").alias("c")).select("path", "c.*", "bucket")


def write_batch(events: DataFrame, batch_id: int, read_notes: Callable[[list[int]], DataFrame], location: str) -> None:
    """Write the segment of one micro-batch and merge what is full.

    ``read_notes`` gives the notes of some buckets; only those that the batch touches are asked for.
    """
    spark = events.sparkSession
    batch = cut_lineage(events.select("path", "kind", "seq").withColumn("bucket", bucket_of(F.col("path"))), "batch")
    touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())  # at most BUCKETS
    changes = index_changes(batch, read_notes(touched)).withColumns(
        {"batch": F.lit(batch_id).cast("long"), "bucket": bucket_of(F.col("path"))}
    )
    changes.write.mode("overwrite").partitionBy("bucket").parquet(_segment(location, 0, batch_id))
    drop_steps(batch)
    fs, _ = _folder(spark, location)
    tier = 1
    while (batch_id + 1) % FAN**tier == 0:
        step = FAN ** (tier - 1)
        parts = [_segment(location, tier - 1, batch_id - step * i) for i in range(FAN)]
        read = spark.read.schema(CHANGE_SCHEMA).option("basePath", parts[0]).parquet(parts[0])
        for p in parts[1:]:
            read = read.unionByName(spark.read.schema(CHANGE_SCHEMA).option("basePath", p).parquet(p))
        _latest(read).write.mode("overwrite").partitionBy("bucket").parquet(_segment(location, tier, batch_id))
        # The parts of this merge stay for readers that have listed them; those of the one before go.
        for i in range(FAN, 2 * FAN):
            old = _segment(location, tier - 1, batch_id - step * i)
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old), True)
        tier += 1


def index_stream(
    events: DataFrame, read_notes: Callable[[list[int]], DataFrame], location: str, checkpoint: str
) -> StreamingQuery:
    """Start the stream; ``read_notes`` gives the notes of some buckets as they are when a batch runs."""
    write = lambda batch, batch_id: write_batch(batch, batch_id, read_notes, location)
    return (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_links(base_links: DataFrame, changes: DataFrame) -> DataFrame:
    """(src, src_name, tgt_name) after the changes, the latest batch of a path counting."""
    latest = _latest(changes)
    fresh = latest.filter(~F.col("deleted")).select(
        F.col("path").alias("src"), F.col("name").alias("src_name"), F.explode("tgt_names").alias("tgt_name")
    )
    kept = base_links.join(latest.select(F.col("path").alias("src")), "src", "left_anti")
    return kept.select("src", "src_name", "tgt_name").unionByName(fresh)


def valid_vectors(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """Cached vectors still of use: those of paths not touched, or with unchanged content."""
    void = _latest(changes).select("path", F.col("content_hash").alias("_now"), F.lit(True).alias("_touched"))
    return cache.join(void, "path", "left").filter(
        F.col("_touched").isNull() | F.coalesce(F.col("_now") == F.col("content_hash"), F.lit(False))
    ).drop("_now", "_touched")
