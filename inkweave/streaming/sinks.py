"""Running a stream over what is there and reading the result as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..scale import new_table_path


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available, append it to a table in the shared folder, read it back."""
    target = new_table_path(stream.sparkSession, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", target + "-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def run_in_batches(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Feed ``parts`` to a stream one after another, as micro-batches of one query that keeps its state.

    ``make`` turns the stream of their rows into the stream whose rows are returned.
    """
    spark = parts[0].sparkSession
    source, target = new_table_path(spark, f"{label}-in"), new_table_path(spark, label)
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(part.schema).parquet(source))
        (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("path", target)
            .option("checkpointLocation", target + "-state")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.schema(stream.schema).parquet(target)
