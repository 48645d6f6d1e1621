"""Views over the test tables: notes with links and front matter, and event streams.

The tables hold no notes, so note text, references and event kinds are derived from
``documents``, ``events`` and ``conversations`` by fixed rules, once in Spark and once
in SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import note_links


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, name, content."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """case cast(doc_id % 6 as int) when 0 then '' when 1 then 'knowledge/' when 2 then 'journal/'
             when 3 then 'projects/' when 4 then 'private/' else 'archive/' end
           || 'N' || cast(floor(doc_id / 2) as string) || '.md' as path""",
        "'N' || cast(floor(doc_id / 2) as string) as name",
        r"""'---\ntitle: T' || doc_id || '\nslug: s' || (doc_id % 20) || '\n---\nSee [[N' || ((doc_id * 7 + 3) % 100)
           || ']] and [[knowledge/N' || ((doc_id * 13) % 100) || '.md#H|alias]] ![[N' || (doc_id % 50)
           || ']] [[Missing ' || (doc_id % 10) || ']]\n' || text as content""",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_links(notes(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, vector: the notes that have a vector."""
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return notes(spark, sf_dir).select("doc_id", "path", "name").join(vec, "doc_id").select("path", "name", "vector")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, user_id, event_type, k."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value",
    )


NOTES = """notes as (
  select doc_id,
    case cast(doc_id % 6 as int) when 0 then '' when 1 then 'knowledge/' when 2 then 'journal/'
         when 3 then 'projects/' when 4 then 'private/' else 'archive/' end
    || 'N' || cast(cast(floor(doc_id / 2) as bigint) as varchar) || '.md' as path,
    'N' || cast(cast(floor(doc_id / 2) as bigint) as varchar) as name,
    '---' || chr(10) || 'title: T' || doc_id || chr(10) || 'slug: s' || (doc_id % 20) || chr(10) || '---' || chr(10)
    || 'See [[N' || ((doc_id * 7 + 3) % 100) || ']] and [[knowledge/N' || ((doc_id * 13) % 100)
    || '.md#H|alias]] ![[N' || (doc_id % 50) || ']] [[Missing ' || (doc_id % 10) || ']]' || chr(10) || text as content
  from documents)"""

RAW_LINKS = """raw_links as (
  select path as src, name as src_name, generate_subscripts(m, 1) - 1 as pos, unnest(m) as raw
  from (select path, name, regexp_extract_all(content, '(?s)!?\\[\\[.*?\\]\\]') as m from notes)),
link_parts as (
  select src, src_name, pos, starts_with(raw, '!') as is_embed,
    regexp_extract(raw, '(?s)\\[\\[(.*)\\]\\]', 1) as inner_text from raw_links),
link_targets as (
  select *, split_part(inner_text, '|', 1) as target from link_parts),
link_rows as (
  select src, src_name, pos, is_embed,
    case when contains(inner_text, '|') then substr(inner_text, instr(inner_text, '|') + 1) end as alias,
    case when contains(target, '#^') then substr(target, instr(target, '#^') + 2) end as block_id,
    case when contains(target, '#') and not contains(target, '#^') then substr(target, instr(target, '#') + 1) end as header,
    trim(case when contains(target, '#^') then substr(target, 1, instr(target, '#^') - 1)
         else split_part(target, '#', 1) end) as target_path
  from link_targets),
all_links as (
  select src, src_name, pos, is_embed, alias, block_id, header,
    case when contains(target_path, '/') then regexp_replace(target_path, '/[^/]*$', '') end as parent,
    regexp_replace(regexp_extract(target_path, '[^/]*$'), '\\.[^.]*$', '') as name,
    case when contains(regexp_extract(target_path, '[^/]*$'), '.')
         then regexp_extract(target_path, '[^./]*$') end as extension
  from link_rows)"""

LINKS = RAW_LINKS + """,
links as (select distinct src, src_name, name as tgt_name from all_links)"""

EDGES = """edges as (
  select src as a, path as b from links join notes on notes.name = tgt_name
  union
  select path as a, src as b from links join notes on notes.name = tgt_name)"""

VECTORS = """vectors as (
  select path, name, embedding as vector from notes join embeddings on doc_id = vec_id)"""

EVENTS = """ev as (
  select event_id as seq, ts, user_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k, value
  from events)"""


def with_views(sql: str, *views: str) -> str:
    return "with recursive " + ",\n".join(views) + "\n" + sql.strip()
