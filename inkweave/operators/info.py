"""What is known about requested notes: place, URIs, links, backlinks, front-matter keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.frontmatter import frontmatter_table
from ..scale import cut_lineage
from .links import link_uris
from .resolve import resolve_refs


def note_info(requests: DataFrame, notes: DataFrame, links: DataFrame, order: str = "info") -> DataFrame:
    """(ref, section, value) rows for a table with column ``ref``.

    Sections are status, path, link, backlink and frontmatter.  A note that a third of all
    notes link to has that many backlink rows, so they are not packed into one value.
    """
    found = resolve_refs(requests.select("ref").distinct(), notes, order).select(
        "ref", "ref_name", "found", F.col("uri_path"), paths.ensure_md(F.col("uri_path")).alias("path")
    )
    found = cut_lineage(found, "found")  # read once for each section
    status = F.when(F.col("found"), "found").otherwise("not found")
    general = found.select(
        "ref",
        F.explode(
            F.array(
                F.struct(F.lit("status").alias("section"), status.alias("value")),
                F.struct(F.lit("path").alias("section"), F.col("uri_path").alias("value")),
            )
        ).alias("row"),
    ).select("ref", "row.*")
    known = found.filter("found")
    forward = known.join(link_uris(links, notes).withColumnRenamed("src", "path"), "path").select(
        "ref", F.lit("link").alias("section"), F.col("uri").alias("value")
    )
    uri = F.concat(F.lit(paths.URI_PREFIX), paths.strip_md(F.col("src")))
    back = known.join(links.select(F.col("tgt_name").alias("ref_name"), "src"), "ref_name").select(
        "ref", F.lit("backlink").alias("section"), uri.alias("value")
    )
    keys = (
        known.join(frontmatter_table(notes.join(known.select("path").distinct(), "path", "left_semi")).select("path", "fm"), "path")
        .select("ref", F.lit("frontmatter").alias("section"), F.explode(F.map_keys("fm")).alias("value"))
    )
    return general.unionByName(forward).unionByName(back).unionByName(keys)


def weekly_note_info(days: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """``note_info`` of the weekly journal note of each ``ts``, whether it exists or not."""
    from ..functions.dates import week_key

    refs = days.select(F.concat(F.lit("journal/"), week_key(F.col("ts"))).alias("ref")).distinct()
    return note_info(refs, notes, links, "uri")
