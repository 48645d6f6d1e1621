"""Batch edits, reconcile, delta and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions as W
from ..operators import edits as E
from ..operators import reconcile as R
from ..scale import new_table_path
from ..sources.notes import publish, read_version, sweep_attempts
from . import views as V
from .registry import query

HASH_SPARK = "if(doc_id % 13 = 0, 'stale', sha2(content, 256)) as content_hash"
REQUEST_PATH = "if(doc_id % 17 = 0, 'no/' || path, path) as path"
# The second edit works on the result of the first; the third kind is ambiguous or absent.
EDITS_SPARK = """case cast(doc_id % 5 as int) when 0 then array(struct('title: T' as old, 'title: U' as new), struct('title: U' as old, 'name: V' as new))
  when 1 then array(struct('See [[' as old, 'Look at [[' as new)) when 2 then array(struct('[[' as old, '((' as new))
  when 3 then array(struct('absent text' as old, '' as new)) else array(struct('slug: s' as old, '' as new), struct('slug: s' as old, 'x' as new)) end as edits"""
EDITED = """edited as (select doc_id, case when doc_id % 17 = 0 then 'no/' || path else path end as path, content,
  case when doc_id % 17 = 0 then 'note not found' when doc_id % 13 = 0 then 'note modified since last read'
    when doc_id % 5 = 2 then 'text appears ' || ((length(content) - length(replace(content, '[[', ''))) // 2) || ' times'
    when doc_id % 5 = 0 and (length(content) - length(replace(content, 'title: T', ''))) // 8 > 1 then 'text appears '
      || ((length(content) - length(replace(content, 'title: T', ''))) // 8) || ' times'
    when doc_id % 5 in (3, 4) then 'text not found' end as error,
  case cast(doc_id % 5 as int) when 0 then replace(content, 'title: T', 'name: V') else replace(content, 'See [[', 'Look at [[') end as edited from notes)"""


def requests(spark, sf):
    return V.notes(spark, sf).selectExpr(REQUEST_PATH, HASH_SPARK, EDITS_SPARK)


@query("txt11_apply_edits", V.with_views("""
select path, error, case when doc_id % 17 = 0 then null when error is null then sha256(edited) else sha256(content) end as hash from edited""", V.NOTES, EDITED))
def apply_edits(spark, sf):
    return E.apply_edits(V.notes(spark, sf), requests(spark, sf)).select("path", "error", F.sha2("content", 256).alias("hash"))


@query("txt12_preview_edits", V.with_views("""
select path, case when error is null then sha256(edited) end as would_produce_hash,
  (case when doc_id % 5 in (0, 4) then 2 else 1 end)::bigint as edits_count,
  case when error is null then case when doc_id % 5 = 0 then
     '- Replaced:' || chr(10) || '  title: T' || chr(10) || '  With:' || chr(10) || '  title: U' || chr(10) || chr(10)
     || '- Replaced:' || chr(10) || '  title: U' || chr(10) || '  With:' || chr(10) || '  name: V'
   else '- Replaced:' || chr(10) || '  See [[' || chr(10) || '  With:' || chr(10) || '  Look at [[' end end as changes, error from edited""", V.NOTES, EDITED))
def preview_edits(spark, sf):
    return E.preview_edits(V.notes(spark, sf), requests(spark, sf)).withColumn("edits_count", F.col("edits_count").cast("long"))


@query("txt8_update_frontmatter", V.with_views("""
select path, case when doc_id % 13 = 0 then null else sha256('---' || chr(10) || 'slug: s' || doc_id % 20 || chr(10) || 'tags:' || chr(10)
    || '- a' || chr(10) || '- b' || chr(10) || 'title: New' || chr(10) || '---' || chr(10)
    || substr(content, instr(content, chr(10) || 'See [[') + 1)) end as content_hash,
  case when doc_id % 13 = 0 then 'note modified since last read' end as error from notes""", V.NOTES))
def update_frontmatter(spark, sf):
    notes = V.notes(spark, sf)
    updates = notes.selectExpr("path", HASH_SPARK, """map('title', '"New"', 'tags', '["a", "b"]') as fm_updates""")
    return E.update_frontmatter(notes, updates).select("path", "content_hash", "error")


@query("jn10_guard_writes", V.with_views("""
, w as (select doc_id as seq, case when doc_id % 4 = 0 then 'new/' || name || '.md' else path end as path,
    case when doc_id % 5 = 0 then null when doc_id % 13 = 0 then 'stale' else sha256(content) end as h,
    doc_id % 4 <> 0 as known, sha256(content) as cur from notes),
c as (select *, case when known and h is null then 'note already exists' when known and h <> cur then 'note modified since last read'
  when not known and h is not null then 'note does not exist' end as e from w),
d as (select *, min(case when e is null then seq end) over (partition by path) as first from c)
select seq, path, case when e is null and seq > first then 'note modified since last read' else e end as error,
  case when e is null and not (seq > first) then case when known then 'update' else 'create' end end as action from d
""".replace("\n, w as", "w as"), V.NOTES).replace("\nw as", ",\nw as"))
def guard_writes(spark, sf):
    notes = V.notes(spark, sf)
    writes = notes.selectExpr(
        "doc_id as seq", "if(doc_id % 4 = 0, 'new/' || name || '.md', path) as path",
        "if(doc_id % 5 = 0, null, if(doc_id % 13 = 0, 'stale', sha2(content, 256))) as content_hash",
    )
    return E.guard_writes(notes, writes).select("seq", "path", "error", "action")


MOVES_SPARK = "doc_id as seq, {i}(doc_id % 7 = 0, 'gone/' || path, path) as src, {i}(doc_id % 3 = 0, 'knowledge/' || name || '.md', 'moved/' || name || 'x.md') as dst"
MOVES = """moves as (select doc_id as seq, case when doc_id % 7 = 0 then 'gone/' || path else path end as src,
  case when doc_id % 3 = 0 then 'knowledge/' || name || '.md' else 'moved/' || name || 'x.md' end as dst from notes),
m1 as (select m.*, case when s.path is null then 'source not found' when t.path is not null then 'destination exists' end as e
  from moves m left join notes s on s.path = src left join notes t on t.path = dst),
m2 as (select *, min(case when e is null then seq end) over (partition by dst) as first from m1),
guarded as (select seq, src, dst, case when e is null and seq > first then 'destination exists' else e end as error from m2)"""


def moves(spark, sf):
    return V.notes(spark, sf).selectExpr(
        "doc_id as seq", "if(doc_id % 7 = 0, 'gone/' || path, path) as src",
        "if(doc_id % 3 = 0, 'knowledge/' || name || '.md', 'moved/' || name || 'x.md') as dst",
    )


@query("jn11_guard_moves", V.with_views("select seq, src, dst, error from guarded", V.NOTES, MOVES))
def guard_moves(spark, sf):
    return E.guard_moves(V.notes(spark, sf), moves(spark, sf)).select("seq", "src", "dst", "error")


@query("jn11_guard_deletes", V.with_views("""
select doc_id as seq, case when doc_id % 7 = 0 then 'gone/' || path else path end as path,
  case when doc_id % 7 = 0 then 'note not found' end as error from notes""", V.NOTES))
def guard_deletes(spark, sf):
    notes = V.notes(spark, sf)
    wanted = notes.selectExpr("doc_id as seq", "if(doc_id % 7 = 0, 'gone/' || path, path) as path")
    return E.guard_deletes(notes, wanted).select("seq", "path", "error")


@query("txt13_rewrite_links", V.with_views("""
, renames as (select * from (select seq, src as moved, regexp_extract(src, '([^/]*)\\.md$', 1) as old_name, regexp_extract(dst, '([^/]*)\\.md$', 1) as new_name
  from guarded where error is null) where old_name <> new_name),
starts as (select l.path, l.name, new_name, seq, row_number() over (partition by l.path, l.name order by seq) as rn
  from (select distinct src as path, tgt_name as name from links) l join renames on old_name = l.name where moved <> l.path),
chain(path, old_name, name, seq) as (
  select path, name, new_name, seq from starts where rn = 1
  union all
  select path, old_name, new_name, seq from (
    select c.path, c.old_name, r.new_name, r.seq, row_number() over (partition by c.path, c.old_name order by r.seq) as rn
    from chain c join renames r on r.old_name = c.name and r.seq > c.seq) where rn = 1),
hits as (select path, list({'o': '[[' || old_name || ']]', 'n': '[[' || name || ']]'}) as r
  from (select path, old_name, arg_max(name, seq) as name from chain group by all) group by path),
done as (select path, content, list_reduce(list_transform(r, lambda x: [x.o, x.n]), lambda acc, x: [replace(acc[1], x[1], '[[' || chr(1) || md5(x[1]) || ']]'), ''], [content, ''])[1] as marked, r
  from hits join notes using (path)),
put as (select path, content, list_reduce(list_transform(r, lambda x: [x.o, x.n]), lambda acc, x: [replace(acc[1], '[[' || chr(1) || md5(x[1]) || ']]', x[2]), ''], [marked, ''])[1] as new_content from done)
select path, sha256(new_content) as hash from put where new_content <> content""".replace("\n, renames", "renames"), V.NOTES, V.LINKS, MOVES).replace("\nrenames", ",\nrenames"))
def rewrite_links(spark, sf):
    notes = V.notes(spark, sf)
    accepted = E.guard_moves(notes, moves(spark, sf)).filter("error is null")
    return E.rewrite_links(notes, V.links(spark, sf), accepted).select("path", F.sha2("content", 256).alias("hash"))


@query("snk1_publish", V.with_views("""
, w as (select doc_id as seq, case when doc_id % 4 = 0 then 'new/' || name || '.md' else path end as path,
    case when doc_id % 5 = 0 then null when doc_id % 13 = 0 then 'stale' else sha256(content) end as h,
    doc_id % 4 <> 0 as known, sha256(content) as cur, content || ' edited' as content from notes),
ok as (select * from w where case when known then h = cur else h is null end qualify row_number() over (partition by path order by seq) = 1)
select path, sha256(content) as hash, 2::bigint as version from (
  select path, content from notes where path not in (select path from ok) union all select path, content from ok)""".replace("\n, w as", "w as"), V.NOTES).replace("\nw as", ",\nw as"))
def publish_edits(spark, sf):
    """The notes, an attempt that is never committed, and the notes after a batch of writes, read back."""
    notes, place = V.notes(spark, sf), new_table_path(spark, "published")
    publish(notes.select("path", "content"), place)
    writes = notes.selectExpr(
        "doc_id as seq", "if(doc_id % 4 = 0, 'new/' || name || '.md', path) as path", "content || ' edited' as content",
        "if(doc_id % 5 = 0, null, if(doc_id % 13 = 0, 'stale', sha2(content, 256))) as content_hash",
    )
    before = read_version(spark, place)
    writes.select("path", "content").write.parquet(f"{place}/data/attempt")
    version = publish(E.apply_writes(before, E.guard_writes(before, writes)), place)
    sweep_attempts(spark, place, 0.0)
    return read_version(spark, place).select("path", F.sha2("content", 256).alias("hash"), F.lit(version).cast("long").alias("version"))


FILES = """files as (select doc_id, case when doc_id % 11 = 0 then 'moved/' || path else path end as path,
  case when doc_id % 7 = 0 then content || ' edited' else content end as content, text,
  case when doc_id % 7 = 0 then ' edited' else '' end as mark from notes join documents using (doc_id) where doc_id % 10 <> 1),
idx as (select doc_id, path, content from notes where doc_id % 10 <> 0),
fo as (select f.path as fp, f.content as fc, i.path as ip, i.content as ic from files f full join idx i using (path)),
nw as (select fp, row_number() over (partition by fc order by fp) as n, fc from fo where ip is null),
orph as (select ip, row_number() over (partition by ic order by ip) as n, ic from fo where fp is null),
report as (select fp as path, case when fc = ic then 'unchanged' else 'reindexed' end as action, null::varchar as moved_from from fo where fp is not null and ip is not null
  union all select coalesce(fp, ip), case when ip is null then 'indexed' when fp is null then 'orphaned' else 'moved' end, case when fp is not null then ip end
  from nw full join orph on fc = ic and nw.n = orph.n)"""


def snapshots(spark, sf):
    notes = V.notes(spark, sf)
    files = notes.filter("doc_id % 10 <> 1").selectExpr(
        "doc_id", "if(doc_id % 11 = 0, 'moved/' || path, path) as path", "if(doc_id % 7 = 0, content || ' edited', content) as content"
    )
    return files, notes.filter("doc_id % 10 <> 0")


@query("jn12_reconcile", V.with_views("select path, action, moved_from from report", V.NOTES, FILES))
def reconcile(spark, sf):
    return R.reconcile(*snapshots(spark, sf))


# Only a few contents, so that many files and orphans are copies of each other.
@query("jn13_move_detection_copies", V.with_views("""
, f as (select 'a/' || name || doc_id as path, (doc_id % 3)::varchar as content from notes where doc_id % 2 = 0),
i as (select 'b/' || name || doc_id as path, (doc_id % 5)::varchar as content from notes where doc_id % 4 <> 1),
x as (select path, content, row_number() over (partition by content order by path) as n from f),
y as (select path, content, row_number() over (partition by content order by path) as n from i)
select coalesce(x.path, y.path) as path, case when y.path is null then 'indexed' when x.path is null then 'orphaned' else 'moved' end as action,
  case when x.path is not null then y.path end as moved_from from x full join y on x.content = y.content and x.n = y.n""".replace("\n, f as", "f as"), V.NOTES).replace("\nf as", ",\nf as"))
def move_detection_copies(spark, sf):
    notes = V.notes(spark, sf)
    files = notes.filter("doc_id % 2 = 0").selectExpr("'a/' || name || doc_id as path", "cast(doc_id % 3 as string) as content")
    index = notes.filter("doc_id % 4 <> 1").selectExpr("'b/' || name || doc_id as path", "cast(doc_id % 5 as string) as content")
    return R.reconcile(files, index)


@query("agg8_reconcile_summary", V.with_views("""
select count(*) filter (action = 'indexed') as indexed, count(*) filter (action = 'reindexed') as reindexed, count(*) filter (action = 'moved') as moved,
  count(*) filter (action = 'orphaned') as orphaned, count(*) filter (action = 'unchanged') as unchanged,
  count(*) filter (action in ('indexed', 'reindexed', 'moved')) > 0 as has_changes from report""", V.NOTES, FILES))
def reconcile_summary(spark, sf):
    return R.reconcile_summary(R.reconcile(*snapshots(spark, sf)))


VERSION_A = "map('p1', cast(doc_id % 5 as int), 'p2', cast(doc_id % 3 as int))"
VERSION_B = "if(doc_id % 4 = 0, map('p1', cast(doc_id % 4 as int)), map('p1', cast(doc_id % 4 as int), 'p3', cast(doc_id % 2 as int)))"
# Counters per peer of the two vectors, an absent peer as 0.
V_SQL = """vv as (select doc_id, path, content, doc_id % 5 as a1, doc_id % 3 as a2, doc_id % 4 as b1, case when doc_id % 4 = 0 then 0 else doc_id % 2 end as b3 from notes),
inc as (select *, a1 >= b1 and 0 >= b3 as a_has_b, b1 >= a1 and a2 <= 0 as b_has_a from vv)"""


@query("vv1_compare_versions", V.with_views("""
select path, case when a_has_b and b_has_a then 'equal' when a_has_b then 'includes' when b_has_a then 'dominated' else 'concurrent' end as relation from inc""", V.NOTES, V_SQL))
def compare_versions(spark, sf):
    return V.notes(spark, sf).selectExpr("path", f"{VERSION_A} as a", f"{VERSION_B} as b").select(
        "path", W.compare_versions(F.col("a"), F.col("b")).alias("relation")
    )


@query("jn14_plan_delta", V.with_views("""
select path, case when doc_id % 6 = 5 then 'full' else 'update' end as send from inc
where doc_id % 9 <> 0 and (doc_id % 6 = 5 or not b_has_a)""", V.NOTES, V_SQL))
def plan_delta(spark, sf):
    notes = V.notes(spark, sf)
    ours = notes.selectExpr("path", f"{VERSION_A} as version")
    theirs = notes.filter("doc_id % 6 <> 5").selectExpr("path", f"{VERSION_B} as version")
    return R.plan_delta(ours, theirs, notes.filter("doc_id % 9 = 0").select("path"))


@query("jn15_resolve_updates", V.with_views("""
select path, action, action in ('create', 'merge') or (action = 'take remote' and doc_id % 2 = 1) as modified
from (select doc_id, path, case when doc_id % 8 = 7 then 'create'
   when doc_id % 3 <> 0 and doc_id % 4 <> doc_id % 5 then case when doc_id % 10 = 0 or n_chars % 7 >= n_chars % 5 then 'take remote' else 'keep local' end
   when a_has_b then 'already included' else 'merge' end as action from inc join documents using (doc_id))""", V.NOTES, V_SQL))
def resolve_updates(spark, sf):
    n_chars = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    notes = V.notes(spark, sf).join(n_chars, "doc_id")
    local = notes.filter("doc_id % 8 <> 7").selectExpr(
        "path", "cast(doc_id % 4 as string) as doc_id", f"{VERSION_A} as version", "if(doc_id % 10 = 0, null, n_chars % 5) as mtime", "'h' as content_hash"
    )
    remote = notes.selectExpr(
        "path", "if(doc_id % 3 = 0, null, cast(doc_id % 5 as string)) as doc_id", f"{VERSION_B} as version", "n_chars % 7 as mtime", "if(doc_id % 2 = 1, 'g', 'h') as content_hash"
    )
    return R.resolve_updates(local, remote)


OTHER_FM = r"""'---\ntitle: T' || doc_id || if(doc_id % 3 = 0, '\nextra: 5', '') || if(doc_id % 2 = 0, '\nslug: changed', '') || '\n---\nother\nbody\nbody' as content"""


@query("txt9_diff_frontmatter", V.with_views("""
select path, 'slug' as key, case when doc_id % 2 = 0 then 'changed' else 'removed' end as change, '"s' || doc_id % 20 || '"' as old_value,
  case when doc_id % 2 = 0 then '"changed"' end as new_value from notes
union all select path, 'extra', 'inserted', null, '5' from notes where doc_id % 3 = 0""", V.NOTES))
def diff_frontmatter(spark, sf):
    notes = V.notes(spark, sf)
    return R.diff_frontmatter(notes, notes.selectExpr("path", OTHER_FM))


@query("txt10_diff_body_lines", V.with_views("""
, old as (select path, unnest(string_split(substr(content, instr(content, chr(10) || 'See [[') + 1), chr(10))) as line, 1 as o, 0 as n from notes),
new as (select path, unnest(['other', 'body', 'body']) as line, 0 as o, 1 as n from notes)
select path, md5(line) as line, greatest(sum(o) - sum(n), 0)::bigint as removed, greatest(sum(n) - sum(o), 0)::bigint as added
from (select * from old union all select * from new) group by path, line having sum(o) <> sum(n)""".replace("\n, old", "old"), V.NOTES).replace("\nold as", ",\nold as"))
def diff_body_lines(spark, sf):
    notes = V.notes(spark, sf)
    return R.diff_body_lines(notes, notes.selectExpr("path", OTHER_FM)).withColumn("line", F.md5("line"))


@query("agg9_document_stats", V.with_views("""
select path, sum(n)::bigint as change_count, sum(ops)::bigint as op_count, min(a) as start_us, max(b) as end_us,
  string_agg(peer || ':' || c, ',' order by peer) as version
from (select 'N' || user_id || '.md' as path, event_type as peer, count(*) as n, sum(k) as ops, epoch_us(min(ts)) as a, epoch_us(max(ts)) as b, max(k) as c
      from ev group by all) group by path""", V.EVENTS))
def document_stats(spark, sf):
    changes = V.events(spark, sf).selectExpr("'N' || user_id || '.md' as path", "event_type as peer", "k as counter", "k as ops", "ts")
    stats = R.document_stats(changes)
    return stats.select(
        "path", "change_count", "op_count", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end_ts").cast("timestamp")).alias("end_us"),
        R.version_text(F.col("version")).alias("version"),
    )


@query("agg9_registry_stats", V.with_views("select count(*) as change_count, sum(k)::bigint as op_count from ev", V.EVENTS))
def registry_stats(spark, sf):
    return R.registry_stats(V.events(spark, sf).withColumn("ops", F.col("k")))


@query("agg9_document_info", V.with_views("""
select path, length(substr(content, instr(content, chr(10) || 'See [[') + 1)) as body_length, true as has_frontmatter from notes""", V.NOTES))
def document_info(spark, sf):
    return R.document_info(V.notes(spark, sf)).withColumn("body_length", F.col("body_length").cast("long"))
