"""Paths, links, neighbourhood and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..operators import links as L
from ..operators import pagerank as P
from ..operators import resolve as R
from . import views as V
from .registry import query

NL = (V.NOTES, V.LINKS)

# References of several forms, derived from the notes.
REFS_SPARK = """case cast(doc_id % 5 as int) when 0 then '[[' || name || ']]' when 1 then 'memory:' || path
  when 2 then '  ' || name || ' ' when 3 then '[[memory:' || substr(path, 1, length(path) - 3) || ']]'
  else 'knowledge/' || name || 'x' end"""
PLAIN_REFS = f"""refs as (select doc_id, {REFS_SPARK} as ref from notes),
plain_refs as (select doc_id, ref,
  regexp_replace(regexp_replace(regexp_replace(trim(ref), '^\\[\\[(.*)\\]\\]$', '\\1'), '^memory:', ''), '\\.md$', '') as ref_path from refs)"""
# Paths of which some break a rule.
ODD_PATH = """case cast(doc_id % 11 as int) when 0 then '/' || path when 1 then '//' || path when 2 then 'a/../' || path
  when 3 then 'C:/' || path when 4 then replace(path, '.md', '.txt') when 5 then 'a//' || path
  when 6 then 'a' || {chr}(92) || path when 7 then 'a' || {chr}(9) || path
  when 8 then repeat('é/', 400) || path when 9 then '' else path end"""


@query("backlink_counts", V.with_views("""
select path, name, cast(count(src) as bigint) as n_backlinks
from notes left join links on links.tgt_name = notes.name group by path, name""", *NL))
def backlink_counts(spark, sf):
    notes = V.notes(spark, sf).select("path", "name")
    counts = L.backlink_counts(V.links(spark, sf)).withColumnRenamed("tgt_name", "name")
    return notes.join(counts, "name", "left").select("path", "name", F.coalesce("n_backlinks", F.lit(0)).alias("n_backlinks"))


@query("src2_list_notes", V.with_views("""
select path, regexp_replace(path, '\\.md$', '') as uri from notes where starts_with(path, 'knowledge/')""", V.NOTES))
def list_notes(spark, sf):
    from ..sources.notes import list_notes

    return list_notes(V.notes(spark, sf), "knowledge/")


@query("prj1_path_parts", V.with_views("""
select path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') as stem,
  case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as folder,
  regexp_extract(path, '[^.]*$') as extension from notes""", V.NOTES))
def path_parts(spark, sf):
    return paths.with_path_parts(V.notes(spark, sf).select("path"))


@query("prj2_normalize_ref", V.with_views("""
select doc_id, ref, ref_path, regexp_extract(ref_path, '[^/]*$') as ref_name, ref_path || '.md' as md_path from plain_refs""", V.NOTES, PLAIN_REFS))
def normalize_ref(spark, sf):
    refs = V.notes(spark, sf).selectExpr("doc_id", f"{REFS_SPARK} as ref")
    n = paths.normalize_ref(F.col("ref"))
    return refs.select(
        "doc_id", "ref", n["path"].alias("ref_path"), n["name"].alias("ref_name"), paths.ensure_md(n["path"]).alias("md_path")
    )


@query("prj3_search_paths", V.with_views("""
select doc_id, cast(u.pos as bigint) as pos, u.folder || name as candidate
from notes, (values (0, ''), (1, 'knowledge/'), (2, 'journal/'), (3, 'projects/'), (4, 'private/')) u(pos, folder)""", V.NOTES))
def search_paths(spark, sf):
    notes = V.notes(spark, sf)
    return notes.select("doc_id", F.posexplode(paths.search_paths(F.col("name"), True)).alias("pos", "candidate")).withColumn(
        "pos", F.col("pos").cast("long")
    )


@query("prj4_folder_priority", V.with_views("""
select path, cast(case when not contains(path, '/') then 0 when starts_with(path, 'knowledge/') then 1
  when starts_with(path, 'journal/') then 2 when starts_with(path, 'projects/') then 3
  when starts_with(path, 'private/') then 5 else 4 end as bigint) as priority from notes""", V.NOTES))
def folder_priority(spark, sf):
    return V.notes(spark, sf).select("path", paths.folder_priority(F.col("path")).cast("long").alias("priority"))


@query("prj5_relative_path", V.with_views(f"""
select doc_id, regexp_replace(p, '^/', '') as clean_path,
  case when contains(regexp_replace(p, '^/', ''), '..') then 'directory traversal'
       when starts_with(regexp_replace(p, '^/', ''), '/') then 'absolute path' end as path_error
from (select doc_id, {ODD_PATH.format(chr='chr')} as p from notes)""", V.NOTES))
def relative_path(spark, sf):
    odd = V.notes(spark, sf).selectExpr("doc_id", ODD_PATH.format(chr="char") + " as path")
    return paths.check_relative_path(odd).drop("path")


@query("prj6_sync_path", V.with_views(f"""
select doc_id, case when p = '' then 'empty path' when contains(p, '..') then 'path traversal'
  when contains(p, '//') then 'empty path segment' when starts_with(p, '/') then 'absolute path'
  when substr(p, 2, 1) = ':' then 'drive letter' when contains(p, chr(92)) then 'backslash'
  when not ends_with(p, '.md') then 'not a markdown file'
  when regexp_matches(p, '[[:cntrl:]]') then 'control character'
  when octet_length(encode(p)) > 1024 then 'path too long' end as path_error
from (select doc_id, {ODD_PATH.format(chr='chr')} as p from notes)""", V.NOTES))
def sync_path(spark, sf):
    odd = V.notes(spark, sf).selectExpr("doc_id", ODD_PATH.format(chr="char") + " as path")
    return paths.check_sync_path(odd).drop("path")


@query("prj8_note_uris", V.with_views("""
select path, 'memory:' || replace(path, '.md', '') as memory_uri,
  'editor://open?vault=My%20Vault%2A~&file=' || replace(replace(path, '.md', ''), '/', '%2F') as open_uri from notes""", V.NOTES))
def note_uris(spark, sf):
    return paths.note_uris(V.notes(spark, sf).select("path"), "My Vault*~", "editor")


@query("prj9_content_hash", V.with_views("select path, sha256(content) as content_hash from notes", V.NOTES))
def content_hash(spark, sf):
    return V.notes(spark, sf).select("path", hashing.content_hash(F.col("content")).alias("content_hash"))


FNV_SQL = """lower(lpad(hex(cast(list_reduce(
  list_transform(range(0, octet_length(encode({x})) ), lambda i: cast(('0x' || substr(hex(encode({x})), 2 * i + 1, 2)) as hugeint)),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::hugeint) as ubigint)), 16, '0'))"""


@query("prj10_path_key", V.with_views(f"select path, {FNV_SQL.format(x='path')} as path_key from notes", V.NOTES))
def path_key(spark, sf):
    return V.notes(spark, sf).select("path", hashing.path_key(F.col("path")).alias("path_key"))


@query("prj11_text_differs", V.with_views("""
select path, replace(content, chr(13) || chr(10), chr(10)) <> case when doc_id % 7 = 0 then content || 'x' else content end as differs
from (select path, doc_id, replace(content, chr(13) || chr(10), chr(10)) as content from notes)""", V.NOTES))
def text_differs(spark, sf):
    notes = V.notes(spark, sf)
    other = F.expr(r"replace(replace(content, '\r\n', '\n'), '\n', '\r\n') || if(doc_id % 7 = 0, 'x', '')")
    return notes.select("path", hashing.text_differs(F.col("content"), other).alias("differs"))


@query("txt1_extract_links", V.with_views(
    "select src, cast(pos as bigint) as pos, name, parent, extension, header, block_id, alias, is_embed from all_links", V.NOTES, V.RAW_LINKS))
def extract_links(spark, sf):
    return L.extract_links(V.notes(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query("txt2_linked_names", V.with_views("select src, tgt_name from links", *NL))
def linked_names(spark, sf):
    return L.linked_names(L.extract_links(V.notes(spark, sf)))


@query("txt3_link_labels", V.with_views("""
select src, cast(pos as bigint) as pos, name || coalesce('.' || extension, '') as file_name,
  coalesce(parent || '/', '') || name || coalesce('.' || extension, '') as path, coalesce(alias, name) as display_name
from all_links""", V.NOTES, V.RAW_LINKS))
def link_labels(spark, sf):
    return L.link_labels(L.extract_links(V.notes(spark, sf))).select(
        "src", F.col("pos").cast("long").alias("pos"), "file_name", "path", "display_name"
    )


@query("jn1_resolve_links", V.with_views(
    "select src, tgt_name, path as tgt from links left join notes on notes.name = tgt_name", *NL))
def resolve_links(spark, sf):
    return L.resolve_links(V.links(spark, sf), V.notes(spark, sf))


BEST = """best as (select name, path as best_path from (
  select name, path, row_number() over (partition by name order by starts_with(path, 'private/'),
    case when not contains(path, '/') then 0 when starts_with(path, 'knowledge/') then 1 when starts_with(path, 'journal/') then 2
         when starts_with(path, 'projects/') then 3 else 4 end, path) as rn from notes) where rn = 1)"""


@query("jn1_link_uris", V.with_views("""
select src, tgt_name, 'memory:' || coalesce(replace(best_path, '.md', ''), tgt_name) as uri
from links left join best on best.name = tgt_name""", *NL, BEST))
def link_uris(spark, sf):
    return L.link_uris(V.links(spark, sf), V.notes(spark, sf))


@query("jn2_backlinks", V.with_views("select distinct tgt_name, src from links", *NL))
def backlinks(spark, sf):
    return L.backlinks(V.links(spark, sf))


@query("jn3_neighborhood", V.with_views("select a, b from edges", *NL, V.EDGES))
def neighborhood(spark, sf):
    return L.neighborhood(V.links(spark, sf), V.notes(spark, sf))


@query("jn3_neighborhood_names", V.with_views("""
select distinct a, regexp_replace(regexp_extract(b, '[^/]*$'), '\\.md$', '') as b_name from edges""", *NL, V.EDGES))
def neighborhood_names(spark, sf):
    return L.neighborhood_names(L.neighborhood(V.links(spark, sf), V.notes(spark, sf)))


@query("jn5_resolve_refs", V.with_views("""
select doc_id, ref, case when by_name then replace(best_path, '.md', '') else ref_path end as uri_path,
  case when by_path then 'path' when by_name then 'name' when hit then 'path' end as found_by, hit or by_name as found
from (select r.*, best_path, p.path is not null as hit, p.path is not null and contains(ref_path, '/') as by_path,
        best_path is not null and not (p.path is not null and contains(ref_path, '/')) as by_name
      from plain_refs r
      left join best on best.name = regexp_extract(ref_path, '[^/]*$')
      left join notes p on p.path = ref_path || '.md')""", V.NOTES, PLAIN_REFS, BEST))
def resolve_refs(spark, sf):
    notes = V.notes(spark, sf)
    refs = notes.selectExpr("doc_id", f"{REFS_SPARK} as ref")
    return R.resolve_refs(refs, notes).select("doc_id", "ref", "uri_path", "found_by", "found")


@query("jn5_resolve_refs_info", V.with_views("""
select r.doc_id, ref, coalesce(replace(best_path, '.md', ''), ref_path) as uri_path,
  best_path is not null or (p.path is not null and contains(ref_path, '/')) as found
from plain_refs r
left join best on best.name = regexp_extract(ref_path, '[^/]*$')
left join notes p on p.path = ref_path || '.md'""", V.NOTES, PLAIN_REFS, BEST))
def resolve_refs_info(spark, sf):
    notes = V.notes(spark, sf)
    refs = notes.selectExpr("doc_id", f"{REFS_SPARK} as ref")
    return R.resolve_refs(refs, notes, "info").select("doc_id", "ref", "uri_path", "found")


@query("jn6_pick_path", V.with_views("select name, best_path from best", V.NOTES, BEST))
def pick_path(spark, sf):
    return R.best_paths(V.notes(spark, sf))


@query("agg1_graph_stats", V.with_views(
    "select (select count(*) from notes) as n_notes, (select count(*) from links) as n_links", *NL))
def graph_stats(spark, sf):
    return L.graph_stats(V.notes(spark, sf), V.links(spark, sf))


@query("agg2_degrees", V.with_views("""
select path, (select count(*) from links where src = path) as out_links,
  (select count(*) from links where tgt_name = name) as in_links,
  (select count(*) from edges where a = path) as degree from notes""", *NL, V.EDGES))
def degrees(spark, sf):
    return P.degrees(V.links(spark, sf), V.notes(spark, sf))


# The walks start from the names that most links lead to; their number does not grow with the notes.
N_SEEDS = 8
SEEDS_SQL = f"""seeds as (select name as seed from (select distinct name from notes)
  left join (select tgt_name, count(*) as n from links group by tgt_name) on tgt_name = name order by coalesce(n, 0) desc, name limit {N_SEEDS})"""
RANK_STEPS = 4
# The walk of each seed up to the first step that changes it by less than 1e-6 in total.
CONVERGED_SQL = """walk(step, seed, path, s, change) as (
  select 0, seed, path, s, 1e9::double from w0
  union all
  select step + 1, seed, path, next, sum(abs(next - s)) over (partition by seed) from (
    select w.step, w.seed, w.path, w.s, 0.85::double * coalesce(v, 0) + 0.15::double * coalesce(r, 0) as next
    from walk w
    left join (select seed, b as path, sum(s / d) as v from walk join edges on a = path join deg using (a) group by seed, b) g
      on g.seed = w.seed and g.path = w.path
    left join restart x on x.seed = w.seed and x.path = w.path
    where w.change >= 1e-6 and w.step < 100)),
final as (select seed, path, arg_max(s, step) as s from walk group by seed, path)"""


def popular_names(notes, links):
    linked = links.groupBy(F.col("tgt_name").alias("seed")).agg(F.count(F.lit(1)).alias("n"))
    names = notes.select(F.col("name").alias("seed")).distinct()
    return names.join(linked, "seed", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), "seed").limit(N_SEEDS).select("seed")


def _rank_steps_sql() -> str:
    """The walk unrolled for a fixed number of steps, over materialised edges."""
    steps = ["deg as (select a, count(*) as d from edges group by a)", SEEDS_SQL, """restart as (select seed, path, 1.0::double / count(*) over (partition by seed) as r from seeds join notes on name = seed),
w0 as (select seed, path, 1.0::double / (select count(*) from notes) as s from seeds, notes)"""]
    for i in range(RANK_STEPS):
        steps.append(f"""g{i} as (select seed, b as path, sum(s / d) as v from w{i} join edges on a = path join deg using (a) group by seed, b),
w{i + 1} as (select seed, path, 0.85::double * coalesce(v, 0) + 0.15::double * coalesce(r, 0) as s
  from w{i} left join g{i} using (seed, path) left join restart using (seed, path))""")
    return ",\n".join(steps)


@query("agg3_pagerank_fixed_steps", V.with_views(
    f"select seed, path, round(s, 9) as score from w{RANK_STEPS}", *NL, V.EDGES, _rank_steps_sql()))
def pagerank_fixed_steps(spark, sf):
    notes, links = V.notes(spark, sf).select("path", "name"), V.links(spark, sf)
    ranking = P.personalized_pagerank(links, notes, popular_names(notes, links), tol=0.0, max_iter=RANK_STEPS)
    return P.path_scores(ranking).withColumn("score", F.round("score", 9))


@query("agg4_pagerank_by_name", V.with_views(f"""
select seed, name, round(max(s / top), 6) as score
from (select seed, path, s, max(s) over (partition by seed) as top from w{RANK_STEPS}) join notes using (path)
group by seed, name""", *NL, V.EDGES, _rank_steps_sql()))
def pagerank_by_name(spark, sf):
    notes, links = V.notes(spark, sf).select("path", "name"), V.links(spark, sf)
    ranking = P.personalized_pagerank(links, notes, popular_names(notes, links), tol=0.0, max_iter=RANK_STEPS)
    return P.name_scores(ranking).withColumn("score", F.round("score", 6))


@query("agg3_pagerank_converged", V.with_views("""
select seed, name, round(max(s / top), 6) as score
from (select seed, path, s, max(s) over (partition by seed) as top from final) join notes using (path)
group by seed, name""", *NL, V.EDGES, _rank_steps_sql(), CONVERGED_SQL))
def pagerank_converged(spark, sf):
    notes, links = V.notes(spark, sf).select("path", "name"), V.links(spark, sf)
    ranking = P.personalized_pagerank(links, notes, popular_names(notes, links))
    return P.name_scores(ranking).withColumn("score", F.round("score", 6))


@query("set3_update_links", V.with_views("""
select src, tgt_name from links join notes on path = src where doc_id % 9 <> 0 and doc_id % 10 <> 0
union all
select path as src, unnest(['N1', 'New ' || (doc_id % 4)]) as tgt_name from notes where doc_id % 10 = 0""", *NL))
def update_links(spark, sf):
    notes = V.notes(spark, sf)
    changed = notes.filter("doc_id % 10 = 0").withColumn(
        "content", F.expr("'[[N1]] and [[a/New ' || (doc_id % 4) || '.md]] [[N1|again]]'")
    )
    deleted = notes.filter("doc_id % 9 = 0 and doc_id % 10 <> 0").select("path")
    return L.update_links(V.links(spark, sf), changed, deleted).select("src", "tgt_name")
