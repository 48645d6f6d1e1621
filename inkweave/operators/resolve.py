"""From a note reference or name to a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def _rank(path: Column, include_private: bool) -> Column:
    hidden = F.lit(False) if include_private else paths.is_private(path)
    return F.struct(hidden.alias("hidden"), paths.folder_priority(path).alias("priority"), path.alias("path"))


def pick_path(candidates: DataFrame, key: str, path: str = "path", include_private: bool = False) -> DataFrame:
    """Best path per key: not private unless nothing else, then folder order, then path.

    ``min`` of a struct combines on the map side; no window over a hot key.
    """
    return candidates.groupBy(key).agg(F.min(_rank(F.col(path), include_private))["path"].alias("best_path"))


def best_paths(notes: DataFrame, include_private: bool = False) -> DataFrame:
    """(name, best_path) for every note name."""
    return pick_path(notes.select("name", "path"), "name", "path", include_private)


def resolve_refs(refs: DataFrame, notes: DataFrame, order: str = "uri") -> DataFrame:
    """Add ``uri_path``, ``ref_name``, ``found_by`` and ``found`` to a table with column ``ref``.

    ``uri``: exact path when the reference has a folder, then name, then plain path.
    ``info``: name first, then exact path, then the lookup folders.
    """
    wanted = refs.withColumn("_n", paths.normalize_ref(F.col("ref"))).withColumns(
        {"ref_path": F.col("_n.path"), "ref_name": F.col("_n.name")}
    )
    by_path = notes.select(paths.strip_md(F.col("path")).alias("ref_path"), F.lit(True).alias("_exact"))
    by_name = best_paths(notes).select(
        F.col("name").alias("ref_name"), paths.strip_md(F.col("best_path")).alias("_named")
    )
    has_folder = F.instr("ref_path", "/") > 0
    joined = wanted.drop("_n").join(by_path, "ref_path", "left").join(by_name, "ref_name", "left")
    exact, named = F.col("_exact").isNotNull(), F.col("_named").isNotNull()
    steps = {
        "uri": [("path", has_folder & exact), ("name", named), ("path", exact)],
        # Every note in a lookup folder is also found by name, so that step never adds one.
        "info": [("name", named), ("path", has_folder & exact)],
    }[order]
    found_by = F.coalesce(*[F.when(test, F.lit(kind)) for kind, test in steps])
    return (
        joined.withColumn("found_by", found_by)
        .withColumn("found", F.col("found_by").isNotNull())
        .withColumn("uri_path", F.when(F.col("found_by") == "name", F.col("_named")).otherwise(F.col("ref_path")))
        .drop("_exact", "_named")
    )
