"""Comparing two snapshots of the notes, and planning what to exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import frontmatter_table
from ..functions.versions import includes
from ..scale import ROWS_PER_SLICE, cut_lineage, rank_in_group


def fingerprints(notes: DataFrame) -> DataFrame:
    """(path, fingerprint): equal when front matter and body agree, whatever the key order.

    Computed before any join, so joins move hashes and not texts.
    """
    lf = notes.select("path", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("content"))
    parsed = frontmatter_table(lf, "sync")
    entries = F.to_json(F.array_sort(F.map_entries(F.coalesce("fm", F.create_map().cast("map<string,string>")))))
    return parsed.select("path", F.sha2(F.concat_ws("\n", entries, "body"), 256).alias("fingerprint"))


def reconcile(files: DataFrame, index: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(path, action, moved_from): indexed, reindexed, unchanged, orphaned or moved per path.

    An orphan and a new file with equal content are a move, each used once.  Copies of one
    content are paired by their number in path order.
    """
    have = fingerprints(files).select("path", F.col("fingerprint").alias("file_print"))
    known = fingerprints(index).select("path", F.col("fingerprint").alias("index_print"))
    compared = cut_lineage(have.join(known, "path", "full_outer"), "compared")
    both = compared.filter("file_print is not null and index_print is not null").select(
        "path",
        F.when(F.col("file_print") == F.col("index_print"), "unchanged").otherwise("reindexed").alias("action"),
        F.lit(None).cast("string").alias("moved_from"),
    )
    new = rank_in_group(
        compared.filter("index_print is null").select("path", F.col("file_print").alias("print")), ["print"], "path", "n", rows_per_slice
    )
    orphans = rank_in_group(
        compared.filter("file_print is null").select("path", F.col("index_print").alias("print")), ["print"], "path", "n", rows_per_slice
    )
    paired = new.select("print", "n", F.col("path").alias("to_path")).join(
        orphans.select("print", "n", F.col("path").alias("from_path")), ["print", "n"], "full_outer"
    )
    action = (
        F.when(F.col("from_path").isNull(), "indexed").when(F.col("to_path").isNull(), "orphaned").otherwise("moved")
    )
    return both.unionByName(
        paired.select(
            F.coalesce("to_path", "from_path").alias("path"),
            action.alias("action"),
            F.when(F.col("to_path").isNotNull(), F.col("from_path")).alias("moved_from"),
        )
    )


def reconcile_summary(report: DataFrame) -> DataFrame:
    """One row of totals; orphans alone are no change."""
    kinds = ("indexed", "reindexed", "moved", "orphaned", "unchanged")
    counts = report.agg(*[F.count_if(F.col("action") == k).alias(k) for k in kinds])
    return counts.withColumn("has_changes", F.col("indexed") + F.col("reindexed") + F.col("moved") > 0)


def plan_delta(ours: DataFrame, theirs: DataFrame, exclude: DataFrame) -> DataFrame:
    """(path, send): ``full`` for paths the peer lacks, ``update`` where it misses changes.

    Paths just received from the peer are left out.
    """
    known = theirs.select("path", F.col("version").alias("_theirs"))
    send = F.when(F.col("_theirs").isNull(), "full").when(~includes(F.col("_theirs"), F.col("version")), "update")
    return (
        ours.select("path", "version")
        .join(exclude.select("path"), "path", "left_anti")
        .join(known, "path", "left")
        .select("path", send.alias("send"))
        .filter("send is not null")
    )


def resolve_updates(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, action, modified) for each incoming document.

    Both sides have path, doc_id, version, mtime and content_hash.  Different document ids
    mean separate histories: the later side wins as a whole, the remote one on a tie or
    where a time is unknown.
    """
    side = lambda df, p: df.select("path", *[F.col(c).alias(p + c) for c in ("doc_id", "version", "mtime", "content_hash")])
    joined = side(remote, "r_").join(side(local, "l_"), "path", "left")
    absent = F.col("l_version").isNull()
    divergent = F.coalesce(F.col("l_doc_id") != F.col("r_doc_id"), F.lit(False))
    remote_wins = F.coalesce(F.col("r_mtime") >= F.col("l_mtime"), F.lit(True))
    action = (
        F.when(absent, "create")
        .when(divergent & remote_wins, "take remote")
        .when(divergent, "keep local")
        .when(includes(F.col("l_version"), F.col("r_version")), "already included")
        .otherwise("merge")
    )
    same_content = F.coalesce(F.col("l_content_hash") == F.col("r_content_hash"), F.lit(False))
    modified = F.col("action").isin("create", "merge") | ((F.col("action") == "take remote") & ~same_content)
    return joined.withColumn("action", action).select("path", "action", modified.alias("modified"))


def diff_frontmatter(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, key, change, old_value, new_value) of removed, inserted and changed keys."""
    entries = lambda df, v: frontmatter_table(df).select("path", F.explode("fm").alias("key", v))
    change = F.when(F.col("new_value").isNull(), "removed").when(F.col("old_value").isNull(), "inserted").otherwise("changed")
    return (
        entries(old, "old_value")
        .join(entries(new, "new_value"), ["path", "key"], "full_outer")
        .filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
        .select("path", "key", change.alias("change"), "old_value", "new_value")
    )


def diff_body_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, line, removed, added): lines whose number of occurrences changed.

    Signed counts combine on the map side; no list of lines is built.
    """
    lines = lambda df, n: frontmatter_table(df).select(
        "path", F.explode(F.split(F.col("body"), "\n")).alias("line"), F.lit(n).cast("long").alias("n")
    )
    return (
        lines(old, -1)
        .unionByName(lines(new, 1))
        .groupBy("path", "line")
        .agg(F.sum("n").alias("n"))
        .filter("n <> 0")
        .select("path", "line", F.greatest(-F.col("n"), F.lit(0)).alias("removed"), F.greatest("n", F.lit(0)).alias("added"))
    )


def document_stats(changes: DataFrame) -> DataFrame:
    """Per path: changes, operations, first and last time, and the highest counter per peer.

    ``changes`` has path, peer, counter, ops and ts.  The peers are grouped first, so the
    map of a document is built from one row per peer.
    """
    per_peer = changes.groupBy("path", "peer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ops").alias("ops"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.max("counter").alias("counter"),
    )
    return per_peer.groupBy("path").agg(
        F.sum("n").alias("change_count"),
        F.sum("ops").alias("op_count"),
        F.min("first").alias("start_ts"),
        F.max("last").alias("end_ts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("peer", "counter")))).alias("version"),
    )


def registry_stats(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count(F.lit(1)).alias("change_count"), F.sum("ops").alias("op_count"))


def document_info(notes: DataFrame) -> DataFrame:
    """(path, body_length in characters, has_frontmatter)."""
    parsed = frontmatter_table(notes, "sync")
    return parsed.select("path", F.length("body").alias("body_length"), F.col("fm").isNotNull().alias("has_frontmatter"))


def version_text(version: Column) -> Column:
    """A version vector as ``peer:counter`` pairs in order."""
    pairs = F.array_sort(F.map_entries(version))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
