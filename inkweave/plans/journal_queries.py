"""The log, session notes and date functions, over ``events`` as a journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import journal as J
from . import views as V
from .registry import query

WEEKDAY = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
ISO_SQL = "isoyear(ts) || '-W' || lpad(week(ts)::varchar, 2, '0') || '-' || isodow(ts)"
ABBREV_SQL = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"
H12_SQL = "(case when hour(ts) % 12 = 0 then 12 else hour(ts) % 12 end) || ':' || lpad(minute(ts)::varchar, 2, '0') || case when hour(ts) < 12 then ' AM' else ' PM' end"
# Times spread over years, so that week numbers around New Year occur.
FAR_SPARK = "timestampadd(DAY, cast(seq % 3000 as int), ts) as ts"
FAR_SQL = "ts + to_days((seq % 3000)::int) as ts"
ODD_DAY = """case cast(seq % 8 as int) when 0 then '2025-W48-' || (seq % 9) when 1 then '2025-W5' || (seq % 7) || '-1' when 2 then '25-W01-1'
  when 3 then '2025-w01-1' when 4 then '2025-W1-1' when 5 then 'x' when 6 then '2025-W0' || (seq % 10) || '-3' else '2025-W10-2-1' end"""
ODD_TIME = """case cast(seq % 8 as int) when 0 then (seq % 14) || ':' || lpad(cast(seq % 70 as {S}), 2, '0') || ' AM'
  when 1 then (seq % 14) || ':05 PM' when 2 then '9:30 am' when 3 then ' 9:30  PM ' when 4 then '9:30' when 5 then '9 AM'
  when 6 then '12:' || (seq % 60) || ' AM' else '9:3O AM' end"""


@query("dtm1_iso_week_date", V.with_views(f"""
select seq, {ISO_SQL} as iso_date, {ABBREV_SQL}[isodow(ts)] as abbrev from (select seq, {FAR_SQL} from ev)""", V.EVENTS))
def iso_week_date(spark, sf):
    far = V.events(spark, sf).selectExpr("seq", FAR_SPARK)
    iso = D.iso_week_date(F.col("ts"))
    return far.select("seq", iso.alias("iso_date"), D.day_abbrev(iso).alias("abbrev"))


@query("dtm1_valid_iso_week", V.with_views(f"""
select seq, d, regexp_full_match(d, '\\d{{4}}-W(0[1-9]|[1-4]\\d|5[0-3])-[1-7]') as valid,
  case when regexp_full_match(d, '[^-]*-[^-]*-[1-7]') then {ABBREV_SQL}[right(d, 1)::int] else '???' end as abbrev
from (select seq, {ODD_DAY} as d from ev)""", V.EVENTS))
def valid_iso_week(spark, sf):
    odd = V.events(spark, sf).selectExpr("seq", f"{ODD_DAY} as d")
    return odd.select("seq", "d", D.valid_iso_week(F.col("d")).alias("valid"), D.day_abbrev(F.col("d")).alias("abbrev"))


@query("dtm2_week_rollup", V.with_views(f"""
select week, day, count(*) as n, min(stamp) as first_stamp from (
  select isoyear(ts) || '-w' || lpad(week(ts)::varchar, 2, '0') as week, {WEEKDAY}[isodow(ts)] as day,
    strftime(ts, '%Y-%m-%dT%H:%M') as stamp from (select seq, {FAR_SQL} from ev)) group by week, day""", V.EVENTS))
def week_rollup(spark, sf):
    far = V.events(spark, sf).selectExpr(FAR_SPARK)
    c = F.col("ts")
    return far.groupBy(D.week_key(c).alias("week"), D.day_name(c).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(D.minute_stamp(c)).alias("first_stamp")
    )


@query("dtm4_format_12h", V.with_views(f"select seq, {H12_SQL} as clock from ev", V.EVENTS))
def format_12h(spark, sf):
    return V.events(spark, sf).select("seq", D.format_12h(F.col("ts")).alias("clock"))


@query("dtm5_parse_12h", V.with_views(f"""
select seq, t, case when ok and upper(half) = half then h24 end as entry_minute,
  case when ok and h between 1 and 12 and m <= 59 then h24 end as bulk_minute
from (select *, (case when upper(half) = 'AM' then case when h = 12 then 0 else h end else case when h = 12 then 12 else h + 12 end end) * 60 + m as h24
  from (select seq, t, regexp_full_match(t, '\\s*\\d+:\\d+\\s+(?i:am|pm)\\s*') as ok,
    try_cast(regexp_extract(t, '(\\d+):(\\d+)', 1) as bigint) as h, try_cast(regexp_extract(t, '(\\d+):(\\d+)', 2) as bigint) as m,
    regexp_extract(t, '(?i:am|pm)') as half from (select seq, {ODD_TIME.format(S='varchar')} as t from ev)))""", V.EVENTS))
def parse_12h(spark, sf):
    odd = V.events(spark, sf).selectExpr("seq", f"{ODD_TIME.format(S='string')} as t")
    return odd.select(
        "seq", "t", D.parse_12h(F.col("t"), strict=False).alias("entry_minute"), D.parse_12h(F.col("t"), strict=True).alias("bulk_minute")
    )


# The log as text lines, one log per user.
LINES_SPARK = """case cast(seq % 6 as int) when 0 then '## 2024-W01-' || (seq % 7 + 1) || ' (Mon)' when 1 then ''
  when 2 then '### part' when 3 then '- odd entry ' || seq else '- ' || (seq % 12 + 1) || ':' || lpad(cast(seq % 60 as {S}), 2, '0') || if(seq % 2 = 0, ' AM', ' PM') || ' – ' || event_type end"""
LINES_SQL = LINES_SPARK.replace("{S}", "varchar").replace("if(seq % 2 = 0, ' AM', ' PM')", "case when seq % 2 = 0 then ' AM' else ' PM' end")


@query("win6_parse_log", V.with_views(f"""
select log_id, line_no, day, case when timed then ((case when h = 12 then 0 else h end) + case when contains(line, ' PM – ') then 12 else 0 end) * 60 + m end as minute,
  case when timed then split_part(line, ' – ', 2) else regexp_replace(line, '^-\\s*', '') end as text
from (select *, contains(line, ' – ') as timed, try_cast(regexp_extract(line, '^- (\\d+):(\\d+)', 1) as bigint) as h,
        try_cast(regexp_extract(line, '^- (\\d+):(\\d+)', 2) as bigint) as m,
        last_value(head ignore nulls) over (partition by log_id order by line_no) as day
      from (select user_id as log_id, seq as line_no, line, case when starts_with(line, '##') then regexp_extract(line, '^## (\\S+) \\(', 1) end as head
            from (select user_id, seq, {LINES_SQL} as line from ev)))
where starts_with(line, '-') and day <> ''""", V.EVENTS))
def parse_log(spark, sf):
    lines = V.events(spark, sf).selectExpr("user_id as log_id", "seq as line_no", LINES_SPARK.format(S="string") + " as line")
    return J.parse_log(lines).select("log_id", "line_no", "day", "minute", "text")


def old_log(ev):
    """Entries of the journal so far: day, minute, line_no, line."""
    return ev.filter("event_type <> 'purchase'").select(
        D.iso_week_date(F.col("ts")).alias("day"), (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("minute"),
        F.col("seq").alias("line_no"), J.entry_line(F.col("ts"), F.col("event_type")).alias("line"),
    )


OLD_LOG = f"""oldlog as (select {ISO_SQL} as day, (hour(ts) * 60 + minute(ts))::bigint as minute, seq as line_no,
  '- ' || {H12_SQL} || ' – ' || event_type as line from ev where event_type <> 'purchase')"""


@query("win7_append_log", V.with_views(f"""
, added as (select {ISO_SQL} as day, (hour(ts) * 60 + minute(ts))::bigint as minute, seq, '- ' || {H12_SQL} || ' – bought' as line
  from ev where event_type = 'purchase')
select day, coalesce((select min(line_no) from oldlog o where o.day = a.day and o.minute > a.minute), 4611686018427387904) as at_line,
  0::bigint as is_old, minute, seq, line from added a
union all select day, line_no, 1, minute, 0, line from oldlog""".replace("\n, added", "added"), V.EVENTS, OLD_LOG).replace("\nadded", ",\nadded"))
def append_log(spark, sf):
    ev = V.events(spark, sf)
    new = ev.filter("event_type = 'purchase'").select("ts", "seq", F.lit("- bought").alias("text"))
    return J.append_log(old_log(ev), new).withColumn("is_old", F.col("is_old").cast("long"))


# Log files, one per user: days come in any order and a day may have several sections.
FILE_LINES_SPARK = """case cast((seq + user_id) % 7 as int) when 0 then {header} when 1 then '' when 2 then '### part' when 3 then '- odd entry ' || seq
  when 4 then 'text' else '- ' || ((seq * 5) % 12 + 1) || ':' || lpad(cast(seq % 60 as {S}), 2, '0') || {half} || ' – ' || event_type end"""
HEADER_SQL = f"'## ' || {ISO_SQL} || ' (' || {ABBREV_SQL}[isodow(ts)::int] || ')'"
FILE_LINES_SQL = FILE_LINES_SPARK.format(header=HEADER_SQL, S="varchar", half="case when seq % 2 = 0 then ' AM' else ' PM' end")


@query("win7_insert_into_log", V.with_views(f"""
lines as (select user_id as log_id, seq as line_no, {FILE_LINES_SQL} as line from ev where event_type <> 'purchase'),
cutup as (select *, last_value(case when starts_with(line, '##') then line_no end ignore nulls) over (partition by log_id order by line_no) as section from lines),
added as (select user_id as log_id, {HEADER_SQL} as header, (hour(ts) * 60 + minute(ts))::bigint as minute, seq, '- ' || {H12_SQL} || ' – bought' as line
  from ev where event_type = 'purchase'),
heads as (select log_id, line as header, min(line_no) as section from lines semi join (select distinct log_id, header as line from added) using (log_id, line) group by all),
ours as (select header, c.*, case when regexp_matches(line, '^- \\d+:\\d+ (AM|PM) – ') then
    ((regexp_extract(line, '^- (\\d+)', 1)::int % 12) + case when contains(line, ' PM – ') then 12 else 0 end) * 60 + regexp_extract(line, ':(\\d+)', 1)::int end as minute
  from cutup c join heads using (log_id, section)),
behind as (select log_id, header, max(case when starts_with(line, '-') then line_no end) as last_dash,
  min(case when line_no > section and trim(line) <> '' then line_no end) as first_text, max(line_no) as section_end from ours group by log_id, header),
lasts as (select log_id, max(line_no) as last_line from lines group by log_id),
slots as (select a.log_id, a.seq, min(o.line_no) as slot from added a join ours o on o.log_id = a.log_id and o.header = a.header and o.minute > a.minute group by all),
fresh as (select * from added anti join heads using (log_id, header)),
days as (select log_id, header, min(seq) as first from fresh group by log_id, header),
placed as (
  select log_id, line_no as pos, 1 as side, 0 as day, 0 as part, 0 as minute, 0 as seq, line from lines
  union all select log_id, coalesce(slot, last_dash, first_text, section_end), case when slot is not null then 0 when last_dash is not null then 2 when first_text is not null then 0 else 2 end,
    0, 0, minute, seq, line from added join behind using (log_id, header) left join slots using (log_id, seq)
  union all select log_id, coalesce(last_line, 0), 3, first, part, 0, 0, text from (
    select d.*, last_line, unnest([0, 1, 2, 4]) as part, unnest(['', d.header, '', '']) as text, min(first) over (partition by d.log_id) as first_day
    from days d left join lasts using (log_id)) where part > 0 or last_line is not null or first <> first_day
  union all select log_id, coalesce(last_line, 0), 3, first, 3, minute, seq, line from fresh join days using (log_id, header) left join lasts using (log_id))
select log_id, row_number() over (partition by log_id order by pos, side, day, part, minute, seq) as line_no, line from placed""".lstrip(), V.EVENTS + ","))
def insert_into_log(spark, sf):
    ev = V.events(spark, sf)
    header = "concat('## ', day, ' (', abbrev, ')')"
    lines = ev.filter("event_type <> 'purchase'").withColumn("day", D.iso_week_date(F.col("ts"))).withColumn("abbrev", D.day_abbrev(F.col("day"))).selectExpr(
        "user_id as log_id", "seq as line_no", FILE_LINES_SPARK.format(header=header, S="string", half="if(seq % 2 = 0, ' AM', ' PM')") + " as line"
    )
    new = ev.filter("event_type = 'purchase'").select(F.col("user_id").alias("log_id"), "ts", "seq", F.lit("- bought").alias("text"))
    return J.insert_into_log(lines, new)


# Requests to replace days: some empty, some with a bad time, some with a bad day.
REQUESTS_SQL = f"""requests as (select case when k = 9 then 'bad' else {ISO_SQL} end as day,
  case when k < 8 then {H12_SQL} when k = 8 and seq % 5 = 0 then '13:00 PM' end as time, event_type as text from ev where k < 10),
accepted as (select day from requests group by day having day <> 'bad' and not coalesce(bool_or(time = '13:00 PM'), false))"""


@query("set1_replace_days", V.with_views("""
select day, minute, line from oldlog where day not in (select day from accepted)
union all select day, ((case when split_part(time, ':', 1)::int = 12 then 0 else split_part(time, ':', 1)::int end)
   + case when ends_with(time, 'PM') then 12 else 0 end)::bigint * 60 + substr(split_part(time, ':', 2), 1, 2)::int, '- ' || time || ' – ' || text
from requests where day in (select day from accepted) and time is not null""", V.EVENTS, OLD_LOG, REQUESTS_SQL))
def replace_days(spark, sf):
    ev = V.events(spark, sf)
    requests = ev.filter("k < 10").select(
        F.when(F.col("k") == 9, "bad").otherwise(D.iso_week_date(F.col("ts"))).alias("day"),
        F.when(F.col("k") < 8, D.format_12h(F.col("ts"))).when((F.col("k") == 8) & (F.col("seq") % 5 == 0), "13:00 PM").alias("time"),
        F.col("event_type").alias("text"),
    )
    return J.replace_days(old_log(ev), requests)


@query("snk3_render_log", V.with_views(f"""
select day, part::bigint as part, minute, seq, line from (
  select day, 2 as part, minute, line_no as seq, line from oldlog
  union all select day, unnest([0, 1, 3]), null, null, unnest(['## ' || day || ' (' || {ABBREV_SQL}[right(day, 1)::int] || ')', '', ''])
  from (select distinct day from oldlog))""", V.EVENTS, OLD_LOG))
def render_log(spark, sf):
    entries = old_log(V.events(spark, sf)).withColumnRenamed("line_no", "seq")
    return J.render_log(entries).withColumn("part", F.col("part").cast("long"))


@query("set4_squeeze_blank_lines", """
with t as (select doc_id, string_split(replace(text, '. ', '.' || chr(10) || repeat('  ' || chr(10), (doc_id % 5)::int)), chr(10)) as l from documents),
u as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as line from t),
v as (select *, trim(line, ' ') = '' as blank, sum(case when trim(line, ' ') = '' then 0 else 1 end) over (partition by doc_id order by i) as run from u),
w as (select *, sum(case when blank then 1 else 0 end) over (partition by doc_id, run order by i) as nth from v)
select doc_id, md5(string_agg(line, chr(10) order by i)) as squeezed from w where not blank or nth <= 2 group by doc_id""")
def squeeze_blank_lines(spark, sf):
    spaced = V.table(spark, sf, "documents").selectExpr(
        "doc_id", r"replace(text, '. ', '.\n' || repeat('  \n', cast(doc_id % 5 as int))) as text"
    )
    return spaced.select("doc_id", F.md5(J.squeeze_blank_lines(F.col("text"))).alias("squeezed"))


CONTEXT_PATH = """case doc_id when 1 then 'Log.md' when 2 then 'Working Memory.md' when 3 then 'journal/2024-w02.md'
  when 4 then 'private/Working Memory.md' else path end"""


@query("src3_session_context", V.with_views(f"""
select null::bigint as session, (case path when 'Log.md' then 0 when 'Working Memory.md' then 1 else 2 end)::bigint as ord,
  null::bigint as depth, path, sha256(content) as hash from (select {CONTEXT_PATH} as path, content from notes)
where path in ('Log.md', 'Working Memory.md', 'journal/2024-w02.md')
union all select conv_id, 3, turn, 'projects/N' || (((conv_id * 6 + 3) / 2)::double).floor()::bigint || '.md', sha256(content)
from conversations join notes on path = 'projects/N' || (((conv_id * 6 + 3) / 2)::double).floor()::bigint || '.md'
where conv_id * 6 + 3 <> 3""", V.NOTES))
def session_context(spark, sf):
    notes = V.notes(spark, sf).selectExpr(f"{CONTEXT_PATH} as path", "content")
    matches = V.table(spark, sf, "conversations").selectExpr(
        "conv_id as session", "turn as depth", "'projects/N' || cast(floor((conv_id * 6 + 3) / 2) as bigint) || '.md' as path", "'strict' as match_type"
    )
    return J.session_context(notes, matches, "2024-01-10 12:00:00").select(
        "session", F.col("ord").cast("long").alias("ord"), "depth", "path", F.sha2("content", 256).alias("hash")
    )


@query("src4_private_inventory", V.with_views(f"""
select regexp_replace(substr(path, 9), '\\.md$', '') as name, '[[private/' || regexp_replace(substr(path, 9), '\\.md$', '') || ']]' as link
from (select {CONTEXT_PATH} as path from notes) where starts_with(path, 'private/') and path <> 'private/Working Memory.md' order by name""", V.NOTES))
def private_inventory(spark, sf):
    return J.private_inventory(V.notes(spark, sf).selectExpr(f"{CONTEXT_PATH} as path"), "check")
