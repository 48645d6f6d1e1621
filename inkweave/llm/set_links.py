"""Exact Jaccard checks of chosen pairs of n-gram sets, without a set sent once per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage

from .ngram_join import class_ids, shingle_sets
from .words import bytes_of, cut, slices

MEMBERS_PER_TASK = 256
FILTER_BITS = 1 << 23


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """One bit per value of the one column of ``hashes`` (64-bit numbers), as ``FILTER_BITS / 8`` bytes.

    The size does not depend on the number of values; with very many of them more bits are set by
    chance, so it is only good for leaving rows out before a join that is exact.
    """
    name = hashes.columns[0]
    bit = F.pmod(F.col(name), F.lit(FILTER_BITS))
    found = (
        hashes.filter(F.col(name).isNotNull())
        .select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
        .toArrow()  # one row of 4 KB for each 32,768 bits of the filter
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in zip(found["bucket"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def maybe_in(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``hashes`` may be values that the filter was made of."""
    bit = hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (filter_bytes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``cls, grams``: the n-gram sets of the classes in ``pairs`` (columns ``a, b``).

    ``classes`` names each class's text by ``text_key``; ``docs`` has ``_text``.  Texts are read where
    they lie: a task keeps those whose hash may be asked for, and sends each set once.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    need = cut_lineage(classes.join(ends, "cls", "left_semi").select("cls", "text_key"), "need")
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bit_filter(need.select("text_key")))  # FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(maybe_in(wanted.value, np.ascontiguousarray(keys)))
            keep = keep[np.unique(keys[keep], return_index=True)[1]]
            texts, keys = batch.column(0).take(pa.array(keep)), pa.array(keys[keep])
            for part in slices(texts):
                sets, first = shingle_sets(part, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(class_ids(sets, first).view(np.int64)),
                        keys.slice(part.first, part.n_texts),
                        pa.array([s.tobytes() for s in cut(sets, first)], pa.binary()),
                    ],
                    ["cls", "text_key", "grams"],
                )

    read = docs.select("_text", F.xxhash64("_text")).mapInArrow(run, "cls long, text_key long, grams binary")
    return cut_lineage(read.join(need, ["cls", "text_key"], "left_semi").dropDuplicates(["cls"]).select("cls", "grams"), "sets")


def linked_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows ``a, b`` of ``pairs`` whose sets have a Jaccard similarity of ``num``/``den`` or more.

    The members of ``a`` come sorted behind its set; an ``a`` with many members goes to several tasks,
    each of which gets its set once.
    """
    spread = cut_lineage(
        pairs.groupBy("a").agg(F.floor(F.count("*") / F.lit(MEMBERS_PER_TASK)).cast("int").alias("more")), "spread"
    )
    first = (
        spread.join(sets.withColumnRenamed("cls", "a"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"), "grams")
        .select("a", "salt", F.lit(None).cast("long").alias("b"), "grams")
    )
    rest = (
        pairs.join(spread, "a")
        .join(sets.withColumnRenamed("cls", "b"), "b")
        .select("a", F.pmod(F.xxhash64("b"), F.col("more") + 1).cast("int").alias("salt"), "b", "grams")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a = batch.column(0).to_numpy()
            is_hub = np.asarray(batch.column(2).is_null())
            data, bounds = bytes_of(batch.column(3))
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                values = np.frombuffer(data[bounds[i] : bounds[i + 1]].tobytes(), np.uint64)
                if is_hub[i]:
                    hub, own = a[i], values
                elif a[i] == hub and len(own):
                    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    common = int((own[at] == values).sum())
                    ok[i] = den * common >= num * (len(own) + len(values) - common)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 2)], ["a", "b"])

    return (
        first.union(rest)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(run, "a long, b long")
    )
