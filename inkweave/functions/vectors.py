"""Vector arithmetic on ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: smallest mask weight used as a divisor in mean pooling.
MIN_MASK_WEIGHT = 1e-9


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, zero or differently long vectors."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    length = norm(a) * norm(b)
    return F.when(usable & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(_doubles(a), lambda x: x / length)).otherwise(_doubles(a))


def mean_pool(chunks: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Masked mean of the chunk vectors of each key.

    Sums per position combine on the map side, so a key with very many chunks sends
    one partial row per task and position, never its chunks.
    """
    return (
        chunks.select(key, F.col(mask).cast("double").alias("_m"), F.posexplode(_doubles(F.col(vector))))
        .groupBy(key, "pos")
        .agg(
            (
                F.sum(F.col("col") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(MIN_MASK_WEIGHT))
            ).alias("x")
        )
        .groupBy(key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vector"))
    )
