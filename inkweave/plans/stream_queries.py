"""The event operators run as streams over ``events``, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..scale import cut_lineage, new_table_path
from ..streaming import events as S
from ..streaming import index as X
from ..streaming.sinks import run_available, run_in_batches
from . import event_queries as E
from . import views as V
from .registry import query

# How late an event may come.
DELAY = "1 hour"


def closing(spark, sf):
    """A row of each event type long after all others, of users that do nothing else.

    It moves the watermark past everything that is still open; what it opens itself stays open.
    """
    events = spark.read.parquet(f"{sf}/events.parquet")
    number = (-10 * (1 + F.pmod(F.xxhash64("event_type"), F.lit(1_000_000)))).cast("long")
    # All at one time, so that none of them closes what another has opened.
    last = events.agg((F.max("ts") + F.expr("interval 10 years")).alias("ts")).select("ts").scalar()
    return events.select("event_type").distinct().withColumn("ts", last).select(
        number.alias("event_id"), "ts", number.alias("user_id"), "event_type", F.lit(0.0).alias("value"), F.lit('{"k": 1}').alias("props")
    )


def stream(spark, sf, closed=False):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    if closed:
        path = new_table_path(spark, "closing")
        closing(spark, sf).write.parquet(path)
        raw = raw.unionByName(spark.readStream.schema(schema).parquet(path))
    return raw.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def parts_by_time(df, n=3):
    """``df`` cut into ``n`` parts at quantiles of ``ts``."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)])).first()[0] or []
    edges = [-(2**62), *cuts, 2**62]
    return [df.filter((at > low) & (at <= high)) for low, high in zip(edges, edges[1:], strict=False)]


DEBOUNCED = """gaps as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by path order by ts) < 20000000000 then 0 else 1 end as first from fe),
sess as (select *, sum(first) over (partition by path order by ts) as s from gaps),
quiet as (select path, arg_max(kind, seq) as kind, max(seq) as seq, epoch_us(max(ts)) as last_us from sess group by path, s)"""


@query("str1_debounce", V.with_views("select * from quiet", V.EVENTS, E.FILE_EVENTS, DEBOUNCED))
def debounce(spark, sf):
    done = S.debounce(E.file_events(V.events(spark, sf)), "20000 seconds")
    return done.select("path", "kind", "seq", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"))


@query("str1_debounce_stream", V.with_views("select * from quiet", V.EVENTS, E.FILE_EVENTS, DEBOUNCED))
def debounce_stream(spark, sf):
    done = run_available(S.debounce(E.file_events(stream(spark, sf, closed=True)), "20000 seconds", DELAY), "debounce")
    return done.select("path", "kind", "seq", F.unix_micros("last_ts").alias("last_us"))


@query("str2_index_stream", V.with_views("""
, pages_now as (select 'N' || user_id || '.md' as path, 'N' || user_id as name, '[[N' || user_id % 7 || ']] [[x' || user_id || ']]' as content from (select distinct user_id from ev)),
lastk as (select path, arg_max(kind, seq) as kind from fe group by path),
kept as (select user_id from (select distinct user_id from ev) where 'N' || user_id || '.md' not in (select path from lastk))
select 'N' || user_id || '.md' as src, 'N' || user_id as src_name, 'old' as tgt_name from kept
union all select 'N' || user_id || '.md', 'N' || user_id, unnest(['N' || user_id % 7, 'x' || user_id])
from (select distinct user_id from ev) join lastk on path = 'N' || user_id || '.md' where kind <> 'Deleted'""".replace("\n, pages_now", "pages_now"), V.EVENTS, E.FILE_EVENTS).replace("\npages_now", ",\npages_now"))
def index_stream(spark, sf):
    users, changes = live_index(spark, sf)
    base = users.selectExpr("'N' || user_id || '.md' as src", "'N' || user_id as src_name", "'old' as tgt_name")
    return X.current_links(base, changes)


def live_index(spark, sf):
    """The users whose notes are indexed, and the changes after a stream of four micro-batches."""
    ev = V.events(spark, sf)
    users = ev.select("user_id").distinct()
    notes = users.selectExpr("'N' || user_id || '.md' as path", "'N' || user_id as name", "'[[N' || (user_id % 7) || ']] [[x' || user_id || ']]' as content")
    stored, target = new_table_path(spark, "notes"), new_table_path(spark, "index")
    notes.withColumn("bucket", X.bucket_of(F.col("path"))).write.partitionBy("bucket").parquet(stored)
    table = spark.read.parquet(stored)
    source = target + "-in"
    for part in parts_by_time(E.file_events(ev), 4):
        part.write.mode("append").parquet(source)
        rows = C.relevant_events(spark.readStream.schema(part.schema).parquet(source))
        X.index_stream(rows, lambda buckets: table.filter(F.col("bucket").isin(buckets)), target, target + "-state").awaitTermination()
    return users, X.read_changes(spark, target)


@query("str2_index_vectors_stream", V.with_views("""
, lastk as (select path, arg_max(kind, seq) as kind from fe group by path),
cache as (select 'N' || user_id || '.md' as path, case when user_id % 3 = 0 then 'old'
    else '[[N' || user_id % 7 || ']] [[x' || user_id || ']]' end as text, user_id from (select distinct user_id from ev))
select path, user_id from cache left join lastk using (path)
where kind is null or (kind <> 'Deleted' and text = '[[N' || user_id % 7 || ']] [[x' || user_id || ']]')""".replace("\n, lastk", "lastk"), V.EVENTS, E.FILE_EVENTS).replace("\nlastk", ",\nlastk"))
def index_vectors_stream(spark, sf):
    users, changes = live_index(spark, sf)
    text = "if(user_id % 3 = 0, 'old', '[[N' || (user_id % 7) || ']] [[x' || user_id || ']]')"
    cache = users.selectExpr("'N' || user_id || '.md' as path", f"sha2({text}, 256) as content_hash", "user_id")
    return X.valid_vectors(cache, changes).select("path", "user_id")


@query("str3_suppress_echo_stream", V.with_views(E.ECHO_SQL, V.EVENTS, E.FILE_EVENTS))
def suppress_echo_stream(spark, sf):
    rows = stream(spark, sf).selectExpr(
        "'N' || user_id || '.md' as path", "seq", "ts", "event_type = 'purchase' as is_mark"
    )
    return run_available(S.suppress_echo_stream(rows, ttl=36000.0), "echo").drop("ts")


@query("str4_membership_stream", V.with_views("select observer, peer_id, state, incarnation, address, via from members", V.EVENTS, E.GOSSIP))
def membership_stream(spark, sf):
    changes = run_available(S.membership_stream(E.gossip(stream(spark, sf))), "membership")
    last = changes.groupBy("observer", "peer_id").agg(F.max_by(F.struct("state", "incarnation", "address", "via"), "seq").alias("m"))
    return last.select("observer", "peer_id", "m.*")


@query("str7_peer_registry_stream", V.with_views("select * from registry", V.EVENTS, E.PEER_EVENTS, E.REGISTRY_SQL))
def peer_registry_stream(spark, sf):
    rows = run_available(S.peer_registry_stream(E.peer_events(stream(spark, sf)).withColumn("since", F.col("ts"))), "registry")
    last = rows.groupBy("peer").agg(F.max_by(F.struct(*S.PEER_FIELDS), "seq").alias("e"))
    return E._registry_columns(last.select("peer", "e.*"))


@query("str8_probe_stream", V.with_views("""
, p as (select seq, 'p' || user_id as target, epoch_us(ts) as sent from ev where event_type = 'signup'),
a as (select seq - 1 as seq, epoch_us(ts) as ack from ev where event_type <> 'signup')
select p.seq, target, case when a.ack is null then 'suspected' when a.ack < sent + 100000000 then 'ok' else 'late' end as outcome
from p left join a on a.seq = p.seq and a.ack < sent + 300000000
""".replace("\n, p as", "p as"), V.EVENTS).replace("\np as", ",\np as"))
def probe_stream(spark, sf):
    # The next event of the log answers a ping, whichever user it is of.
    pings = stream(spark, sf, closed=True).filter("event_type = 'signup'").selectExpr("seq", "'p' || user_id as target", "ts")
    acks = stream(spark, sf, closed=True).filter("event_type <> 'signup'").selectExpr("seq - 1 as seq", "ts")
    return run_available(S.probe_stream(pings, acks, timeout=100.0, watermark=DELAY), "probes")


def closed_parts(rows, last):
    """Parts of ``rows`` by time, and a part of its own with the closing rows ``last``."""
    return [*parts_by_time(rows), last.select(*[F.col(c).cast(t) for c, t in rows.dtypes])]


@query("str8_probe_states_stream", V.with_views("""
select seq, target, c.outcome as outcome, round(c.at, 3) as decided_at from (select pings.seq, target, list_min(list_filter([
    {'at': a.at, 'prio': 0, 'outcome': case when a.at < sent + 40000 then 'ok' else 'late' end}, {'at': alive_at, 'prio': 1, 'outcome': 'alive'},
    {'at': case when n_no >= 2 then no_at end, 'prio': 2, 'outcome': 'suspected'}, {'at': sent + 120000, 'prio': -1, 'outcome': 'suspected'}],
    lambda x: x.at is not null)) as c
  from pings left join (select ping_seq as seq, min(epoch_us(ts) / 1e6) as at from numbered join pings p on ping_seq = p.seq
      where event_type = 'view' and epoch_us(ts) / 1e6 < p.sent + 120000 group by 1) a on a.seq = pings.seq
    left join (select ping_seq as seq, min(epoch_us(ts) / 1e6) filter (k % 2 = 0) as alive_at, count(*) filter (k % 2 = 1) as n_no,
      max(epoch_us(ts) / 1e6) filter (k % 2 = 1) as no_at from numbered join pings p on ping_seq = p.seq
      where event_type = 'click' and epoch_us(ts) / 1e6 < p.sent + 120000 group by 1) r on r.seq = pings.seq)""", V.EVENTS, E.PROBES))
def probe_states_stream(spark, sf):
    pings, acks, replies = E.probe_tables(spark, sf)
    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    messages = kind(pings, "ping").unionByName(kind(acks, "ack"), True).unionByName(kind(replies, "reply"), True)
    messages = cut_lineage(messages.select("seq", "ts", "kind", "target", F.col("asked").cast("long").alias("asked"), "alive"), "messages")
    last = closing(spark, sf).selectExpr("event_id as seq", "ts", "'ping' as kind", "'none' as target", "1 as asked", "false as alive")
    run = lambda rows: S.probe_states_stream(rows, timeout=E.PING_TIMEOUT, watermark=DELAY)
    return run_in_batches(closed_parts(messages, last), run, "probe-states").withColumn("decided_at", F.round("decided_at", 3))


@query("str8_suspicion_stream", V.with_views("""
select peer, seq, case when nt - t < 50000 then nk else 'dead' end as outcome
from (select *, lead(kind) over w as nk, lead(t) over w as nt from (select 'p' || user_id as peer, seq, epoch_us(ts) / 1e6 as t,
   case event_type when 'error' then 'renewed' else 'cleared' end as kind from ev) window w as (partition by peer order by seq))
where kind = 'renewed'""", V.EVENTS))
def suspicion_stream(spark, sf):
    kinds = "if(event_type = 'error', 'renewed', 'cleared') as kind"
    rows = V.events(spark, sf).selectExpr("'p' || user_id as peer", "seq", "ts", kinds)
    last = closing(spark, sf).selectExpr("'p' || user_id as peer", "event_id as seq", "ts", kinds)
    run = lambda df: S.suspicion_stream(df, timeout=50000.0, watermark=DELAY)
    return run_in_batches(closed_parts(rows, last), run, "suspicions")


@query("str9_event_counts_stream", V.with_views("""
select * from (select epoch_us(time_bucket(interval 6 hours, ts)) as start_us, event_type as type, count(*) as n, sum(k)::bigint as bytes from ev
  group by all)""", V.EVENTS))
def event_counts_stream(spark, sf):
    ev = stream(spark, sf, closed=True).withWatermark("ts", DELAY).selectExpr("ts", "event_type as type", "k as size")
    return run_available(C.event_counts(ev, "6 hours"), "activity").select(F.unix_micros("start").alias("start_us"), "type", "n", "bytes")
