"""The link table of a set of notes and what can be read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.links import linked_note_names, parse_link, raw_links


def extract_links(notes: DataFrame) -> DataFrame:
    """One row per link of a note, in text order: src, pos and the parts of the link."""
    return (
        notes.select(F.col("path").alias("src"), F.posexplode(raw_links(F.col("content"))).alias("pos", "raw"))
        .select("src", "pos", parse_link(F.col("raw")).alias("link"))
        .select("src", "pos", "link.*")
    )


def note_links(notes: DataFrame) -> DataFrame:
    """Distinct (src, src_name, tgt_name) straight from the notes.

    A path is one row of ``notes``, so duplicates are dropped inside the row and no
    shuffle is needed.
    """
    return notes.select(
        F.col("path").alias("src"),
        F.col("name").alias("src_name"),
        F.explode(linked_note_names(F.col("content"))).alias("tgt_name"),
    )


def linked_names(links: DataFrame) -> DataFrame:
    """Distinct linked names per note from a table of links."""
    return links.select("src", F.col("name").alias("tgt_name")).distinct()


def link_labels(links: DataFrame) -> DataFrame:
    """Add file_name, path and display_name of each link."""
    file_name = F.concat_ws(".", "name", "extension")
    return links.withColumns(
        {
            "file_name": file_name,
            "path": F.concat_ws("/", "parent", file_name),
            "display_name": F.coalesce("alias", "name"),
        }
    )


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Every note path a link can mean (same name, any folder); dangling links keep a null."""
    targets = notes.select(F.col("path").alias("tgt"), F.col("name").alias("tgt_name"))
    return links.select("src", "tgt_name").join(targets, "tgt_name", "left").select("src", "tgt_name", "tgt")


def link_uris(links: DataFrame, notes: DataFrame) -> DataFrame:
    """One URI per link: the best note of that name, or the bare name when dangling."""
    from .resolve import best_paths

    uri = F.concat(F.lit(paths.URI_PREFIX), F.coalesce(paths.strip_md(F.col("best_path")), F.col("tgt_name")))
    best = best_paths(notes).withColumnRenamed("name", "tgt_name")
    return links.select("src", "tgt_name").join(best, "tgt_name", "left").select("src", "tgt_name", uri.alias("uri"))


def backlinks(links: DataFrame) -> DataFrame:
    """(tgt_name, src): the paths that link to a name.

    Rows, not one array per name: a name that a third of all notes link to stays
    spread over many tasks.
    """
    return links.select("tgt_name", "src").distinct()


def backlink_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("tgt_name").agg(F.count(F.lit(1)).alias("n_backlinks"))


def neighborhood(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct (a, b): b is a note a links to by name, or one that links to a's name."""
    forward = resolve_links(links, notes).filter(F.col("tgt").isNotNull())
    both = F.explode(
        F.array(
            F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")),
            F.struct(F.col("tgt").alias("a"), F.col("src").alias("b")),
        )
    )
    return forward.select(both.alias("e")).select("e.a", "e.b").distinct()


def neighborhood_names(edges: DataFrame) -> DataFrame:
    """Distinct (a, b_name) of a neighbourhood."""
    return edges.select("a", paths.stem(F.col("b")).alias("b_name")).distinct()


def graph_stats(notes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: notes, and links counted once per note and name.

    ``links`` holds each pair once, so plain counts do.
    """
    counted = notes.select(F.lit(1).alias("n"), F.lit(0).alias("l")).unionAll(
        links.select(F.lit(0).alias("n"), F.lit(1).alias("l"))
    )
    return counted.agg(F.sum("n").alias("n_notes"), F.sum("l").alias("n_links"))


def update_links(links: DataFrame, changed_notes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Replace the links of changed notes and drop those of deleted ones."""
    gone = changed_notes.select(F.col("path").alias("src")).unionAll(deleted.select(F.col("path").alias("src")))
    return links.join(gone, "src", "left_anti").unionByName(note_links(changed_notes))
