"""The day-organised log and the notes of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.dates import day_abbrev, format_12h, iso_week_date, parse_12h, valid_iso_week, week_key
from ..scale import ROWS_PER_SLICE, carried_value, cut_lineage, rank_in_group, with_slices

# Notes every session starts with.
LOG_NOTE = "Log.md"
MEMORY_NOTE = "Working Memory.md"
PRIVATE_MEMORY = "Working Memory"
DASH = " – "
AT_END = 2**62


def session_context(notes: DataFrame, matches: DataFrame, as_of) -> DataFrame:
    """(session, ord, depth, path, content) of the notes to load, in order.

    Rows with a null session (log, working memory, this week's note) hold for every
    session; strictly matched project notes follow, closest directory first.
    """
    week = F.concat(F.lit("journal/"), week_key(F.lit(as_of).cast("timestamp")), F.lit(".md"))
    ord_ = F.when(F.col("path") == LOG_NOTE, 0).when(F.col("path") == MEMORY_NOTE, 1).when(F.col("path") == week, 2)
    shared = notes.withColumn("ord", ord_).filter("ord is not null")
    strict = matches.filter("match_type = 'strict'").select("session", "depth", "path")
    return shared.select("ord", "path", "content").unionByName(
        strict.join(notes.select("path", "content"), "path").withColumn("ord", F.lit(3)), allowMissingColumns=True
    ).select("session", "ord", "depth", "path", "content")


def private_inventory(notes: DataFrame, reason: str) -> DataFrame:
    """Names of the notes directly in ``private/``, in order; needs a stated reason."""
    if not reason.strip():
        raise ValueError("a reason for reading private notes is required")
    return (
        notes.filter(F.col("path").rlike(r"^private/[^/]+\.md$"))
        .select(paths.stem(F.col("path")).alias("name"))
        .filter(F.col("name") != PRIVATE_MEMORY)
        .withColumn("link", F.concat(F.lit("[[private/"), "name", F.lit("]]")))
        .orderBy("name")
    )


def entry_line(ts, text):
    """``- 9:30 AM – text``; a leading dash of the text is dropped."""
    body = F.when(text.startswith("-"), paths.trim_space(F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
    return F.concat(F.lit("- "), format_12h(ts), F.lit(DASH), body)


def parse_log(lines: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Entries of log text given as (log_id, line_no, line): adds day, minute and text.

    A day header holds for the lines after it up to any other header line.  The lines of
    one log are read in slices, so a single huge log is not one task.
    """
    header = F.when(
        F.col("line").startswith("##"), F.regexp_extract("line", r"^## (\S+) \(.{3}\)$", 1)
    )
    sliced = with_slices(lines, ["log_id"], "line_no", rows_per_slice)
    dated = carried_value(sliced, ["log_id"], "line_no", header, "day").drop("_slice")
    cut = F.instr("line", DASH)
    timed = F.col("line").startswith("- ") & (cut > 0)
    return dated.filter(F.col("line").startswith("-") & (F.col("day") != "")).select(
        "log_id",
        "line_no",
        "day",
        F.when(timed, parse_12h(F.substring("line", F.lit(3), cut - 3), strict=False)).alias("minute"),
        F.when(timed, F.substring("line", cut + len(DASH), F.length("line")))
        .otherwise(F.regexp_replace("line", r"^-\s*", ""))
        .alias("text"),
        "line",
    )


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Put new entries (ts, seq, text) into a log (day, minute, line_no, line).

    An entry goes before the first entry of its day with a later time, else to the end
    of the day.  Returns day, at_line, is_old, minute, seq, line; that order is file order.

    The place is looked up in one row per day and minute, at most a day's minutes, not in
    the entries themselves.
    """
    added = new.select(
        iso_week_date(F.col("ts")).alias("day"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("minute"),
        "seq",
        entry_line(F.col("ts"), F.col("text")).alias("line"),
    )
    firsts = (
        log.filter("minute is not null").select("day", "minute", "line_no")
        .unionByName(added.select("day", "minute"), allowMissingColumns=True)
        .groupBy("day", "minute")
        .agg(F.min("line_no").alias("line_no"))
    )
    later = Window.partitionBy("day").orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    slots = firsts.select("day", "minute", F.min("line_no").over(later).alias("slot"))
    return (
        added.join(slots, ["day", "minute"])
        .select("day", F.coalesce("slot", F.lit(AT_END)).alias("at_line"), F.lit(0).alias("is_old"), "minute", "seq", "line")
        .unionByName(
            log.select(
                "day", F.col("line_no").cast("long").alias("at_line"), F.lit(1).alias("is_old"), "minute",
                F.lit(0).cast("long").alias("seq"), "line",
            )
        )
    )


def insert_into_log(lines: DataFrame, new: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(log_id, line_no, line): all lines of the logs, numbered from 1, after new entries are put in.

    ``lines`` has log_id, line_no and line, in file order; ``new`` has log_id, ts, seq and text.  An entry goes
    into the section of its day, the lines from the first one that is exactly its header to the next that
    begins with ``##``: before the first timed entry that is later, else behind the last line with a dash,
    else behind the header and the blank lines under it.  Entries of one place are in order of time, then
    ``seq``.  A day without a section gets one at the end of the file, new days in order of their first
    ``seq``: a blank line (not in an empty file), the header, a blank line, the entries, a blank line.  Entries
    of days that are there are placed before new days are added.

    Places are looked up in one row per section and minute; lines are numbered by ranges of their order, so
    that one huge log is not one task.
    """
    is_head = F.col("line").startswith("##")
    sliced = with_slices(lines.select("log_id", F.col("line_no").cast("long").alias("line_no"), "line"), ["log_id"], "line_no", rows_per_slice)
    in_section = cut_lineage(
        carried_value(sliced, ["log_id"], "line_no", F.when(is_head, F.col("line_no")), "section").drop("_slice"), "lines"
    )
    day = iso_week_date(F.col("ts"))
    added = cut_lineage(
        new.select(
            "log_id",
            F.concat(F.lit("## "), day, F.lit(" ("), day_abbrev(day), F.lit(")")).alias("header"),
            (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("minute"),
            F.col("seq").cast("long").alias("seq"),
            entry_line(F.col("ts"), F.col("text")).alias("line"),
        ),
        "added",
    )
    wanted = added.select("log_id", F.col("header").alias("line")).distinct()
    heads = (
        in_section.filter(is_head).join(wanted, ["log_id", "line"], "left_semi")
        .groupBy("log_id", F.col("line").alias("header")).agg(F.min("line_no").alias("section"))
    )
    ours = in_section.join(heads, ["log_id", "section"])
    dash = F.col("line").startswith("-")
    under = F.col("line_no") > F.col("section")
    blank = paths.trim_space(F.col("line")) == ""
    last = in_section.groupBy("log_id").agg(F.max("line_no").alias("last_line"))
    # Where the next line that is not blank stands behind a header whose section has nothing but blank lines.
    ends = ours.groupBy("log_id", "header", "section").agg(
        F.max(F.when(dash & under, F.col("line_no"))).alias("last_dash"),
        F.min(F.when(under & ~blank, F.col("line_no"))).alias("first_text"),
        F.max("line_no").alias("section_end"),
    )
    behind = ends.join(last, "log_id").select(
        "log_id", "header",
        # (line, side): side 0 is before the line, 2 behind it.
        F.when(F.col("last_dash").isNotNull(), F.struct(F.col("last_dash").alias("at"), F.lit(2).alias("side")))
        .when(F.col("first_text").isNotNull(), F.struct(F.col("first_text").alias("at"), F.lit(0).alias("side")))
        .otherwise(F.struct(F.col("section_end").alias("at"), F.lit(2).alias("side"))).alias("end"),
    )
    cut = F.instr("line", DASH)
    timed = F.col("line").startswith("- ") & (cut > 0)
    minute = F.when(timed, parse_12h(F.substring("line", F.lit(3), cut - 3), strict=False)).cast("long")
    firsts = (
        ours.filter(dash & under).select("log_id", "header", minute.alias("minute"), "line_no").filter("minute is not null")
        .unionByName(added.select("log_id", "header", "minute"), allowMissingColumns=True)
        .groupBy("log_id", "header", "minute").agg(F.min("line_no").alias("line_no"))
    )
    later = Window.partitionBy("log_id", "header").orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    slots = firsts.select("log_id", "header", "minute", F.min("line_no").over(later).alias("slot"))
    place = lambda at, side, *rest: F.struct(
        at.cast("long").alias("at"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"),
        *[F.lit(x).cast("long").alias(n) if isinstance(x, int) else x.cast("long").alias(n) for n, x in zip(("day", "part", "minute", "seq"), rest, strict=True)],
    ).alias("place")
    known = added.join(behind, ["log_id", "header"]).join(slots, ["log_id", "header", "minute"]).select(
        "log_id",
        place(
            F.coalesce("slot", "end.at"), F.when(F.col("slot").isNotNull(), 0).otherwise(F.col("end.side")), 0, 0, F.col("minute"), F.col("seq")
        ),
        "line",
    )
    fresh = added.join(heads, ["log_id", "header"], "left_anti").join(last, "log_id", "left")
    days = fresh.groupBy("log_id", "header").agg(F.min("seq").alias("first"), F.max("last_line").alias("last_line"))
    start = days.groupBy("log_id").agg(F.min("first").alias("first_day"))
    frame = days.join(start, "log_id").select(
        "log_id", "header", "first", "last_line",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit(0).alias("part"), F.when(F.col("last_line").isNotNull() | (F.col("first") != F.col("first_day")), "").alias("line")),
                    F.struct(F.lit(1).alias("part"), F.col("header").alias("line")),
                    F.struct(F.lit(2).alias("part"), F.lit("").alias("line")),
                    F.struct(F.lit(4).alias("part"), F.lit("").alias("line")),
                ),
                lambda x: x["line"].isNotNull(),
            )
        ).alias("f"),
    )
    at_end = F.coalesce("last_line", F.lit(0))
    appended = frame.select("log_id", place(at_end, 3, F.col("first"), F.col("f.part"), 0, 0), "f.line").unionByName(
        fresh.join(days.select("log_id", "header", "first"), ["log_id", "header"]).select(
            "log_id", place(at_end, 3, F.col("first"), 3, F.col("minute"), F.col("seq")), "line"
        )
    )
    old = in_section.select("log_id", place(F.col("line_no"), 1, 0, 0, 0, 0), "line")
    placed = old.unionByName(known).unionByName(appended)
    return rank_in_group(placed, ["log_id"], "place", "line_number", rows_per_slice).select(
        "log_id", F.col("line_number").alias("line_no"), "line"
    )


def check_day_requests(requests: DataFrame) -> DataFrame:
    """(day, n_entries, error) of requests to replace days; one bad time rejects the day.

    ``requests`` has day, time and text; a row without time asks for an empty day.
    """
    bad_time = F.col("time").isNotNull() & parse_12h(F.col("time"), strict=True).isNull()
    return requests.groupBy("day").agg(F.count("time").alias("n_entries"), F.max(bad_time).alias("bad_time")).select(
        "day",
        "n_entries",
        F.when(~valid_iso_week(F.col("day")), "invalid day").when(F.col("bad_time"), "invalid time").alias("error"),
    )


def replace_days(log: DataFrame, requests: DataFrame) -> DataFrame:
    """(day, minute, line) after whole days are replaced; an empty request deletes its day."""
    accepted = check_day_requests(requests).filter("error is null").select("day")
    fresh = requests.join(accepted, "day", "left_semi").filter("time is not null").select(
        "day",
        parse_12h(F.col("time"), strict=True).alias("minute"),
        F.concat(F.lit("- "), "time", F.lit(DASH), "text").alias("line"),
    )
    return log.join(accepted, "day", "left_anti").select("day", "minute", "line").unionByName(fresh)


def render_log(entries: DataFrame) -> DataFrame:
    """(day, part, minute, seq, line): the lines of a log, to be sorted by those columns.

    Header, blank line, entries in time order, blank line per day.  Rows, so that a day
    with very many entries is sorted by the cluster and not held in one value.
    """
    days = entries.select("day").distinct()
    frame = days.select(
        "day",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.concat(F.lit("## "), "day", F.lit(" ("), day_abbrev(F.col("day")), F.lit(")")).alias("line")),
                F.struct(F.lit(1).alias("part"), F.lit("").alias("line")),
                F.struct(F.lit(3).alias("part"), F.lit("").alias("line")),
            )
        ).alias("f"),
    ).select("day", "f.part", "f.line")
    return (
        entries.select("day", F.lit(2).alias("part"), "minute", "seq", "line")
        .unionByName(frame, allowMissingColumns=True)
        .orderBy("day", "part", "minute", "seq")
    )


def squeeze_blank_lines(content):
    """Leave at most two blank lines in a row; white space alone is a blank line."""
    blank = r"[^\S\n]*"
    return F.regexp_replace(content, rf"(?U)((?:\A|\n){blank}\n{blank})(?:\n{blank})+(?=\n|\z)", "$1")
