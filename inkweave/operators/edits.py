"""Guarded batch edits of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.frontmatter import build_content, frontmatter_table
from ..scale import carried_value, cut_lineage, with_slices

# Fixed value: characters of a text shown in a change list.
SNIPPET = 60


def occurrences(text: Column, part: Column) -> Column:
    """Number of times ``part`` occurs; the empty text occurs around every character."""
    without = F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) == 0, F.length(text) + 1).otherwise(
        ((F.length(text) - without) / F.greatest(F.length(part), F.lit(1))).cast("int")
    )


def edited(content: Column, edits: Column) -> Column:
    """STRUCT<text, error> after ARRAY<STRUCT<old, new>> edits, each on the result of the last.

    An old text must occur exactly once; the first that does not stops the edit.
    """
    start = F.struct(content.alias("text"), F.lit(None).cast("string").alias("error"))

    def step(state: Column, edit: Column) -> Column:
        n = occurrences(state["text"], edit["old"])
        problem = F.when(n == 0, F.lit("text not found")).when(
            n > 1, F.concat(F.lit("text appears "), n.cast("string"), F.lit(" times"))
        )
        new_text = F.when(F.length(edit["old"]) == 0, edit["new"]).otherwise(
            F.replace(state["text"], edit["old"], edit["new"])
        )
        failed = state["error"].isNotNull() | problem.isNotNull()
        return F.struct(
            F.when(failed, state["text"]).otherwise(new_text).alias("text"),
            F.coalesce(state["error"], problem).alias("error"),
        )

    return F.aggregate(edits, start, step)


def _requested(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests next to the note they are about, with the reason they cannot run, if any."""
    current = notes.select("path", "content", F.sha2("content", 256).alias("_hash"))
    guard = F.when(F.col("_hash").isNull(), "note not found").when(
        F.col("content_hash") != F.col("_hash"), "note modified since last read"
    )
    return requests.join(current, "path", "left").withColumn("guard_error", guard)


def apply_edits(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """(path, content, error) for requests (path, content_hash, edits).

    A request carries its own ordered edits, so no grouping is needed.
    """
    return (
        _requested(notes, requests)
        .withColumn("_e", edited(F.col("content"), F.col("edits")))
        .select("path", F.coalesce("guard_error", "_e.error").alias("error"), F.col("_e.text").alias("_text"), "content")
        .select("path", F.when(F.col("error").isNull(), F.col("_text")).otherwise(F.col("content")).alias("content"), "error")
    )


def _snippet(text: Column) -> Column:
    trimmed = paths.trim_space(text)
    short = F.replace(F.substring(trimmed, 1, SNIPPET), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(trimmed) > SNIPPET, F.concat(short, F.lit("..."))).otherwise(short)


def preview_edits(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """(path, would_produce_hash, edits_count, changes, error) without changing anything."""
    change = lambda e: F.concat(
        F.lit("- Replaced:\n  "), _snippet(e["old"]), F.lit("\n  With:\n  "), _snippet(e["new"])
    )
    changes = F.when(F.size("edits") == 0, "No changes made.").otherwise(
        F.array_join(F.transform("edits", change), "\n\n")
    )
    done = apply_edits(notes, requests).withColumn("would_produce_hash", F.sha2("content", 256))
    return done.join(requests.select("path", "edits"), "path").select(
        "path",
        F.when(F.col("error").isNull(), F.col("would_produce_hash")).alias("would_produce_hash"),
        F.size("edits").alias("edits_count"),
        F.when(F.col("error").isNull(), changes).alias("changes"),
        "error",
    )


def _first_wins(checked: DataFrame, key: str, lost: str) -> DataFrame:
    """Of several accepted requests for one key the one with the lowest ``seq`` stays."""
    checked = cut_lineage(checked, "checked")  # read twice here, and this is done twice for moves
    winners = checked.filter("error is null").groupBy(key).agg(F.min("seq").alias("_first"))
    late = F.col("error").isNull() & (F.col("seq") > F.col("_first"))
    return (
        checked.join(winners, key, "left")
        .withColumn("error", F.when(late, F.lit(lost)).otherwise(F.col("error")))
        .drop("_first")
    )


def guard_writes(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """Add ``action`` (create, update) or ``error`` to writes (seq, path, content, content_hash)."""
    current = notes.select("path", F.sha2("content", 256).alias("_hash"))
    exists, given = F.col("_hash").isNotNull(), F.col("content_hash").isNotNull()
    error = (
        F.when(exists & ~given, "note already exists")
        .when(exists & (F.col("_hash") != F.col("content_hash")), "note modified since last read")
        .when(~exists & given, "note does not exist")
    )
    checked = writes.join(current, "path", "left").withColumn("error", error)
    checked = _first_wins(checked.withColumn("action", F.when(exists, "update").otherwise("create")), "path", "note modified since last read")
    return checked.withColumn("action", F.when(F.col("error").isNull(), F.col("action"))).drop("_hash")


def apply_writes(notes: DataFrame, guarded: DataFrame) -> DataFrame:
    """(path, content) of the notes after the accepted writes."""
    accepted = guarded.filter("error is null").select("path", "content")
    return notes.select("path", "content").join(accepted.select("path"), "path", "left_anti").unionByName(accepted)


def guard_deletes(notes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Add ``error`` to deletes (seq, path); a note can be deleted once."""
    known = notes.select("path", F.lit(True).alias("_known"))
    error = F.when(F.col("_known").isNull(), "note not found")
    return _first_wins(deletes.join(known, "path", "left").withColumn("error", error), "path", "note not found").drop("_known")


def guard_moves(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Add ``error`` to moves (seq, src, dst): the source must exist, the destination must not."""
    known = notes.select("path", F.lit(True).alias("_known"))
    sources = known.select(F.col("path").alias("src"), F.col("_known").alias("_src"))
    targets = known.select(F.col("path").alias("dst"), F.col("_known").alias("_dst"))
    error = F.when(F.col("_src").isNull(), "source not found").when(F.col("_dst").isNotNull(), "destination exists")
    checked = moves.join(sources, "src", "left").join(targets, "dst", "left").withColumn("error", error)
    checked = _first_wins(checked.drop("_src", "_dst"), "src", "source not found")
    return _first_wins(checked, "dst", "destination exists")


def final_names(renames: DataFrame) -> DataFrame:
    """Add ``last_name`` to renames (seq, old_name, new_name): what the name is called in the end.

    A rename is followed by the next one of its new name.  The chains are resolved by pointer jumping: in
    every round each rename looks where its follower points, so the distance doubles and a chain of n
    renames takes log n joins; no list of renames is held anywhere.
    """
    renames = cut_lineage(renames, "renames")
    rows = renames.select(F.col("old_name").alias("name"), (-F.col("seq")).alias("at"), F.col("seq").alias("is_rename")).unionByName(
        renames.select(F.col("new_name").alias("name"), (-F.col("seq")).alias("at")), allowMissingColumns=True
    )
    carried = carried_value(with_slices(rows, ["name"], "at"), ["name"], "at", F.col("is_rename"), "next", before=True)
    follows = carried.filter("is_rename is null").select((-F.col("at")).alias("seq"), F.coalesce("next", -F.col("at")).alias("to"))
    follows = cut_lineage(follows, "follows")
    while True:
        there = follows.select(F.col("seq").alias("to"), F.col("to").alias("_far"))
        jumped = cut_lineage(follows.join(there, "to").select("seq", F.col("_far").alias("to"), (F.col("_far") != F.col("to")).alias("_moved")), "follows")
        moved = jumped.filter("_moved").limit(1).count()
        follows = jumped.select("seq", "to")
        if not moved:
            break
    ends = renames.select(F.col("seq").alias("to"), F.col("new_name").alias("last_name"))
    return renames.join(follows, "seq").join(ends, "to").drop("to")


def rewrite_links(notes: DataFrame, links: DataFrame, moves: DataFrame) -> DataFrame:
    """(path, content) of the notes whose plain ``[[Old]]`` links the moves change.

    A link follows its name through all later renames (:func:`final_names`).  Only notes that link to a
    renamed name and hold the literal text count, and a note's own move does not start a chain in it.  A
    note meets one new name for each of its own links, and all are put in at once.
    """
    renames = moves.select(
        "seq",
        F.col("src").alias("moved"),
        paths.file_name(paths.strip_md(F.col("src"))).alias("old_name"),
        paths.file_name(paths.strip_md(F.col("dst"))).alias("new_name"),
    ).filter("old_name <> new_name")
    renames = cut_lineage(final_names(renames), "renames")
    # A note is moved once, so of the first two renames of a name one is not its own.
    pick = F.struct("seq", "moved", "last_name")
    first = cut_lineage(renames.groupBy("old_name").agg(F.min(pick).alias("one")), "first")
    second = renames.join(first, "old_name").filter("seq > one.seq").groupBy("old_name").agg(F.min(pick).alias("two"))
    starts = first.join(second, "old_name", "left").withColumnRenamed("old_name", "tgt_name")
    own = F.when(F.col("one.moved") != F.col("src"), F.col("one")).otherwise(F.col("two"))
    bracket = lambda c: F.concat(F.lit("[["), c, F.lit("]]"))
    touched = (
        links.select("src", "tgt_name").distinct()
        .join(starts, "tgt_name")
        .select(F.col("src").alias("path"), "tgt_name", own["last_name"].alias("new_name"))
        .filter("new_name is not null")
        .groupBy("path")
        .agg(F.collect_list(F.struct(bracket(F.col("tgt_name")).alias("old"), bracket(F.col("new_name")).alias("new"))).alias("renames"))
    )
    # Old names become numbers first, so that a new name is never taken for an old one.
    mark = lambda i: F.concat(F.lit("[[\0"), i.cast("string"), F.lit("]]"))
    numbers = F.sequence(F.lit(0), F.size("renames") - 1)
    marked = F.aggregate(numbers, F.col("content"), lambda text, i: F.replace(text, F.col("renames")[i]["old"], mark(i)))
    changed = F.aggregate(numbers, F.col("_marked"), lambda text, i: F.replace(text, mark(i), F.col("renames")[i]["new"]))
    return (
        notes.select("path", "content")
        .join(touched, "path")
        .withColumn("_marked", marked)
        .select("path", "content", changed.alias("_new"))
        .filter("content <> _new")
        .select("path", F.col("_new").alias("content"))
    )


def update_frontmatter(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """(path, content, content_hash, error) for updates (path, content_hash, fm_updates).

    ``fm_updates`` is a MAP of key to JSON text; an updated key replaces the old one.
    """
    wanted = _requested(notes, updates)
    old = F.coalesce("fm", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key("fm_updates", k))
    merged = F.map_concat(kept, F.col("fm_updates"))
    built = frontmatter_table(wanted).withColumn("_new", build_content(merged, F.col("body")))
    ok = F.col("guard_error").isNull()
    return built.select(
        "path",
        F.when(ok, F.col("_new")).otherwise(F.col("content")).alias("content"),
        F.when(ok, F.sha2("_new", 256)).alias("content_hash"),
        F.col("guard_error").alias("error"),
    )
