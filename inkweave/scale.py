"""Helpers that keep jobs safe when one key holds a large part of the rows.

An ordered computation per key (previous row, value carried forward, running
total) normally puts every row of a key in one task.  Here all rows are dealt out
by ranges of (key, order), so a key with very many rows spans several ranges, and
every range is cut into slices of at most ``rows_per_slice`` rows by rank.  Each
slice is computed on its own, and what a slice needs from the rows before it is
taken from one summary row per earlier slice.  There is one way for all keys, and
the result is the same for any slice size, data size and spacing of the order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 1_000_000
# Folder of the step tables in the shared folder.
STEPS = "inkweave"
# Slices of a range are numbered from the range's number times this.
RANGE_STEP = 1 << 32


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors can reach: the checkpoint folder, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    one_machine = not warehouse or warehouse.startswith(("file:", "/"))
    if one_machine and not spark.sparkContext.master.startswith("local"):
        # Without a setting the warehouse is a folder below the driver's working directory.
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_steps"


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{STEPS}/{label}-{uuid.uuid4().hex}"


@contextmanager
def session_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Run eager work under another session setting and put the old one back."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    One job, unlike ``checkpoint()`` which computes the last stage twice, and the
    files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Buckets(NamedTuple):
    """A table in buckets, and its name in the session's catalog."""

    rows: DataFrame
    name: str


def cut_into_buckets(df: DataFrame, column: str, label: str = "buckets") -> Buckets:
    """Like :func:`cut_lineage`, with the rows in as many buckets by ``column`` as a shuffle has partitions.

    A join by ``column`` reads the buckets as they lie, so only its other side is exchanged.
    """
    spark = df.sparkSession
    name = f"{STEPS}_{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out as the buckets are, so that a task writes one file.
    writer = df.repartition(n, column).write.bucketBy(n, column).sortBy(column)
    writer.option("path", new_table_path(spark, label)).saveAsTable(name)
    return Buckets(spark.table(name), name)


def drop_buckets(*tables: Buckets) -> None:
    """Delete tables of :func:`cut_into_buckets`, once nothing reads them any more."""
    for table in tables:
        drop_steps(table.rows)
        table.rows.sparkSession.sql(f"drop table {table.name}")


def drop_steps(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut_lineage` has written, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() != STEPS:
                raise ValueError(f"{folder} is no step table")
            path.getFileSystem(conf).delete(path, True)


def with_slices(
    df: DataFrame,
    keys: list[str],
    seq: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``_slice``: numbers that ascend with ``seq`` within a key.

    A slice holds at most ``rows_per_slice`` rows of a key, whatever the values of ``seq``.
    The ranges are written down first: their bounds are sampled, and a plan that used them
    twice could draw them twice.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*keys, seq).withColumn("_range", F.spark_partition_id().cast("long")), "ranges"
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(seq)).cast("long") - 1
    number = F.col("_range") * RANGE_STEP + F.floor(rank / F.lit(rows_per_slice))
    return ranged.withColumn("_slice", number.cast("long")).drop("_range")


def _with_summary(df: DataFrame, keys: list[str], summary: DataFrame) -> DataFrame:
    """Join what holds before a slice; only slices behind others of their key have any."""
    known = summary.filter("_before is not null").select(
        *(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_key_slice"), "_before"
    )
    match = F.col("_slice") == F.col("_key_slice")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return df.join(known, match, "left").drop("_key_slice", *(f"_key_{i}" for i in range(len(keys))))


def previous_row(
    df: DataFrame,
    keys: list[str],
    seq: str,
    fields: list[str],
    out: str = "prev",
    descending: bool = False,
) -> DataFrame:
    """Add struct ``out`` with ``fields`` of the row before (or after) in ``seq`` order.

    ``df`` must carry ``_slice`` from :func:`with_slices`.
    """
    packed = F.struct(*fields)
    seq_order = F.desc(seq) if descending else F.asc(seq)
    slice_order = F.desc("_slice") if descending else F.asc("_slice")
    edge = F.min_by if descending else F.max_by
    inside = Window.partitionBy(*keys, "_slice").orderBy(seq_order)
    across = Window.partitionBy(*keys).orderBy(slice_order)
    summary = (
        df.groupBy(*keys, "_slice")
        .agg(edge(packed, F.col(seq)).alias("_edge"))
        .select(*keys, "_slice", F.lag("_edge").over(across).alias("_before"))
    )
    return (
        _with_summary(df.withColumn(out, F.lag(packed).over(inside)), keys, summary)
        .withColumn(out, F.coalesce(out, "_before"))
        .drop("_before")
    )


def carried_value(
    df: DataFrame, keys: list[str], seq: str, value: Column, out: str, before: bool = False
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before the row in ``seq`` order.

    With ``before`` the row's own value does not count.
    """
    df = df.withColumn("_value", value)
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    )
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        df.groupBy(*keys, "_slice")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(seq))).alias("_edge"))
        .select(*keys, "_slice", F.last("_edge", ignorenulls=True).over(across).alias("_before"))
    )
    return (
        _with_summary(
            df.withColumn(out, F.last("_value", ignorenulls=True).over(inside)), keys, summary
        )
        .withColumn(out, F.coalesce(out, "_before"))
        .drop("_before", "_value")
    )


def running_sum(
    df: DataFrame, keys: list[str], seq: str, value: Column, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and with the row in ``seq`` order."""
    df = df.withColumn("_value", value)
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    )
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        df.groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, "_slice", F.sum("_total").over(across).alias("_before"))
    )
    return (
        _with_summary(df.withColumn(out, F.sum("_value").over(inside)), keys, summary)
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_before", "_value")
    )


def rank_in_group(
    df: DataFrame,
    keys: list[str],
    order: str,
    out: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Number the rows of each key 1, 2, ... in ``order``, without one task per key."""
    sliced = with_slices(df, keys, order, rows_per_slice)
    return running_sum(sliced, keys, order, F.lit(1).cast("long"), out).drop("_slice")
