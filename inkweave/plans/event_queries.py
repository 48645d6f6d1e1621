"""File changes, peers, probes, membership, and their streams, over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import normalize_peer_id
from ..operators import changes as C
from ..operators import membership as M
from ..operators import peers as P
from ..operators import probes as B
from ..scale import carried_value, with_slices
from . import views as V
from .graph_queries import FNV_SQL
from .registry import query

NOW = "2024-02-15 00:00:00"
EPOCH_NOW = "epoch_us(timestamp '2024-02-15 00:00:00') / 1e6"


# ---- file changes

FILE_EVENTS = """fe as (select seq, ts, 'N' || user_id || '.md' as path, case event_type when 'error' then 'Deleted' when 'signup' then 'Created' else 'Modified' end as kind,
  case when event_type in ('click', 'view') and k % 4 <> 0 then k % 3 end as mtime from ev where event_type <> 'purchase'),
marks as (select seq, ts, 'N' || user_id || '.md' as path from ev where event_type = 'purchase')"""


def file_events(ev):
    return ev.filter("event_type <> 'purchase'").selectExpr(
        "seq", "ts", "'N' || user_id || '.md' as path", "case event_type when 'error' then 'Deleted' when 'signup' then 'Created' else 'Modified' end as kind",
        "if(event_type in ('click', 'view') and k % 4 <> 0, k % 3, null) as mtime"
    )


def marks(ev):
    return ev.filter("event_type = 'purchase'").selectExpr("seq", "ts", "'N' || user_id || '.md' as path")


ODD = """case cast(seq % 6 as int) when 0 then '.sync/a.md' when 1 then 'x/.hidden/N' || user_id || '.md' when 2 then 'N' || user_id || '.txt'
  when 3 then 'a/.sync/b.md' when 4 then '.N.md' else 'a.b/N' || user_id || '.md' end"""


@query("flt3_relevant_events", V.with_views(f"""
select seq, path from (select seq, {ODD} as path from ev)
where ends_with(path, '.md') and not starts_with(path, '.') and not contains(path, '/.')""", V.EVENTS))
def relevant_events(spark, sf):
    return C.relevant_events(V.events(spark, sf).selectExpr("seq", f"{ODD} as path"))


@query("win3_dedupe_mtime", V.with_views("""
select seq, path, kind, mtime from (select *, last_value(case when kind = 'Modified' then mtime when kind = 'Deleted' then -1 end ignore nulls)
  over (partition by path order by seq rows between unbounded preceding and 1 preceding) as known from fe)
where not (kind = 'Modified' and coalesce(known = mtime, false))""", V.EVENTS, FILE_EVENTS))
def dedupe_mtime(spark, sf):
    return C.dedupe_mtime(file_events(V.events(spark, sf))).drop("ts")


ECHO_SQL = """
select path, seq, coalesce(pm and (epoch_us(ts) - epoch_us(pt)) / 1e6 < 36000, false) as is_echo
from (select *, lag(is_mark) over w as pm, lag(ts) over w as pt
      from (select path, seq, ts, false as is_mark from fe union all select path, seq, ts, true from marks) window w as (partition by path order by seq))
where not is_mark"""


@query("win4_suppress_echo", V.with_views(ECHO_SQL, V.EVENTS, FILE_EVENTS))
def suppress_echo(spark, sf):
    ev = V.events(spark, sf)
    return C.suppress_echo(marks(ev), file_events(ev), ttl=36000.0).drop("ts")


@query("win9_retry_schedule", V.with_views(f"""
select peer, seq, attempt, least(5 * pow(2, attempt - 1), 60) as delay, epoch_us(ts) + (least(5 * pow(2, attempt - 1), 60) * 1e6)::bigint as next_due,
  epoch_us(timestamp '{NOW}') >= epoch_us(ts) + (least(5 * pow(2, attempt - 1), 60) * 1e6)::bigint as due_now, attempt >= 3 as exceeded
from (select *, row_number() over (partition by peer, grp, success order by seq) as attempt
      from (select *, sum(success::int) over (partition by peer order by seq) as grp
            from (select user_id as peer, seq, ts, event_type in ('purchase', 'signup') as success from ev))) where not success""", V.EVENTS))
def retry_schedule(spark, sf):
    attempts = V.events(spark, sf).selectExpr("user_id as peer", "seq", "ts", "event_type in ('purchase', 'signup') as success")
    return C.retry_schedule(attempts, NOW, max_attempts=3).select(
        "peer", "seq", "attempt", "delay", F.unix_micros("next_due").alias("next_due"), "due_now", "exceeded"
    )


@query("agg12_event_counts", V.with_views("""
select epoch_us(time_bucket(interval 6 hours, ts)) as start_us, event_type as type, count(*) as n, sum(k)::bigint as bytes from ev group by all""", V.EVENTS))
def event_counts(spark, sf):
    ev = V.events(spark, sf).selectExpr("ts", "event_type as type", "k as size")
    return C.event_counts(ev, "6 hours").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "type", "n", "bytes")


# ---- peers

PEER_EVENTS = """pe as (select seq, ts, 'p' || user_id as peer, case event_type when 'signup' then 'connect' when 'error' then 'disconnect' else 'touch' end as kind,
  'a' || k as address, case when k % 2 = 0 then 'incoming' else 'outgoing' end as direction, 'r' || k % 4 as reason from ev)"""


def peer_events(ev):
    return ev.selectExpr(
        "seq", "ts", "'p' || user_id as peer", "case event_type when 'signup' then 'connect' when 'error' then 'disconnect' else 'touch' end as kind",
        "'a' || k as address", "if(k % 2 = 0, 'incoming', 'outgoing') as direction", "'r' || (k % 4) as reason",
    )


REGISTRY_SQL = """base as (select peer, min(seq) as s0 from pe where kind = 'connect' group by peer),
known as (select pe.*, s0 from pe join base using (peer) where seq >= s0),
turn as (select *, lag(kind) over (partition by peer order by seq) as pk from known where kind <> 'touch'),
registry as (select peer, case arg_max(kind, seq) when 'connect' then 'connected' else 'disconnected' end as state,
  case when arg_max(kind, seq) = 'disconnect' then arg_max(reason, seq) end as reason,
  (select epoch_us(min(ts)) from known k where k.peer = turn.peer) as first_seen, (select epoch_us(arg_max(ts, seq)) from known k where k.peer = turn.peer) as last_seen,
  1 + count(*) filter (kind = 'connect' and pk = 'disconnect') as connections,
  arg_max(address, seq) filter (kind = 'connect') as address, arg_max(direction, seq) filter (kind = 'connect') as direction
  from turn group by peer)"""


def _registry_columns(registry):
    return registry.select(
        "peer", "state", "reason", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_seen"),
        F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_seen"), "connections", "address", "direction",
    )


@query("agg10_peer_registry", V.with_views("select * from registry", V.EVENTS, PEER_EVENTS, REGISTRY_SQL))
def peer_registry(spark, sf):
    return _registry_columns(P.peer_registry(peer_events(V.events(spark, sf))))


@query("win5_connect_counts", V.with_views("select peer, connections from registry where state = 'connected'", V.EVENTS, PEER_EVENTS, REGISTRY_SQL))
def connect_counts(spark, sf):
    return P.connected_peers(P.peer_registry(peer_events(V.events(spark, sf)))).select("peer", "connections")


@query("agg11_latest_peers", V.with_views("""
select peer, arg_max(case when k % 2 = 1 then 'a' || k end, seq) filter (true) as address, arg_max(seq, seq) as last_seen, arg_max(via, seq) filter (via is not null) as discovered_via
from (select 'p' || user_id as peer, seq, k, case when k % 7 = 0 then 'v' || k end as via from ev) group by peer""".replace(
    "arg_max(case when k % 2 = 1 then 'a' || k end, seq) filter (true)", "(array_agg(case when k % 2 = 1 then 'a' || k end order by seq desc))[1]"), V.EVENTS))
def latest_peers(spark, sf):
    rows = V.events(spark, sf).selectExpr(
        "'p' || user_id as peer", "seq", "if(k % 2 = 1, 'a' || k, null) as address", "seq as last_seen", "if(k % 7 = 0, 'v' || k, null) as discovered_via"
    )
    return P.latest_peers(rows)


@query("flt4_reconnectable_peers", V.with_views("""
select peer from (select 'p' || user_id as peer, seq, case when k % 2 = 1 then 'a' || k end as address,
  row_number() over (partition by user_id order by seq desc) as rn from ev) where rn = 1 and address is not null""", V.EVENTS))
def reconnectable_peers(spark, sf):
    return P.reconnectable(latest_peers(spark, sf)).select("peer")


@query("jn19_duplicate_connections", V.with_views("""
, c as (select seq, 'p' || (k % 3) as ours, 'p' || user_id as peer, case when (seq // 3) % 2 = 0 then 'incoming' else 'outgoing' end as direction from ev where event_type = 'signup'),
r as (select *, row_number() over (partition by ours, peer order by seq) as n, case when ours < peer then 'outgoing' else 'incoming' end as w from c),
f as (select ours, peer, n, seq, direction, direction as open_dir, 'no duplicate' as verdict from r where n = 1
  union all select r.ours, r.peer, r.n, r.seq, r.direction, case when r.direction = open_dir then r.direction else w end,
    case when r.direction = open_dir then 'no duplicate' when r.direction = w then 'close other' else 'close this' end
  from f join r on r.ours = f.ours and r.peer = f.peer and r.n = f.n + 1)
select seq, ours, peer, direction, verdict from f""".replace("\n, c as", "c as"), V.EVENTS).replace("\nc as", ",\nc as"))
def duplicate_connections(spark, sf):
    conns = V.events(spark, sf).filter("event_type = 'signup'").selectExpr(
        "seq", "'p' || (k % 3) as ours", "'p' || user_id as peer", "if((seq div 3) % 2 = 0, 'incoming', 'outgoing') as direction"
    )
    return P.duplicate_connections(conns)


PEER_ID = """case cast(seq % 5 as int) when 0 then 'ABCDEF' || lpad(cast(user_id as {S}), 10, '0') when 1 then 'abc' when 2 then '0123456789abcdeg'
  when 3 then 'AAAAAAAA-bbbb-4ccc-8ddd-' || lpad(cast(user_id as {S}), 12, '0') else 'AAAAAAAAbbbbb-4ccc-8ddd-' || lpad(cast(user_id as {S}), 12, '0') end"""


@query("prj15_normalize_peer_id", V.with_views(f"""
select seq, case when regexp_full_match(p, '[0-9A-Fa-f]{{16}}') then lower(p) when length(p) = 36 and p[9] = '-' and p[14] = '-' and p[19] = '-' and p[24] = '-'
  then {FNV_SQL.format(x='lower(p)')} end as peer_id from (select seq, {PEER_ID.format(S='varchar')} as p from ev)""", V.EVENTS))
def peer_ids(spark, sf):
    return V.events(spark, sf).selectExpr("seq", PEER_ID.format(S="string") + " as p").select("seq", normalize_peer_id(F.col("p")).alias("peer_id"))


# ---- probes

PROBES = """numbered as (select *, last_value(case when event_type = 'signup' then seq end ignore nulls) over (partition by user_id order by seq) as ping_seq from ev),
pings as (select seq, 'p' || user_id as target, epoch_us(ts) / 1e6 as sent from ev where event_type = 'signup'),
acks as (select ping_seq as seq, min(epoch_us(ts) / 1e6) as at from numbered where event_type = 'view' and ping_seq is not null group by 1),
replies as (select ping_seq as seq, min(epoch_us(ts) / 1e6) filter (k % 2 = 0) as alive_at, count(*) filter (k % 2 = 1) as n_no,
  max(epoch_us(ts) / 1e6) filter (k % 2 = 1) as no_at from numbered where event_type = 'click' and ping_seq is not null group by 1)"""
PING_TIMEOUT = 40000.0


def probe_tables(spark, sf):
    ev = V.events(spark, sf)
    sliced = with_slices(ev, ["user_id"], "seq")
    numbered = carried_value(sliced, ["user_id"], "seq", F.when(F.col("event_type") == "signup", F.col("seq")), "ping_seq").filter("ping_seq is not null")
    pings = ev.filter("event_type = 'signup'").selectExpr("seq", "'p' || user_id as target", "ts", "2 as asked")
    acks = numbered.filter("event_type = 'view'").selectExpr("ping_seq as seq", "ts")
    replies = numbered.filter("event_type = 'click'").selectExpr("ping_seq as seq", "ts", "k % 2 = 0 as alive")
    return pings, acks, replies


@query("jn16_classify_probes", V.with_views("""
select seq, target, c.outcome as outcome, round(c.at, 3) as decided_at from (select seq, target, list_min(list_filter([
    {'at': a.at, 'prio': 0, 'outcome': case when a.at < sent + 40000 then 'ok' else 'late' end}, {'at': alive_at, 'prio': 1, 'outcome': 'alive'},
    {'at': case when n_no >= 2 then no_at end, 'prio': 2, 'outcome': 'suspected'}, {'at': sent + 120000, 'prio': -1, 'outcome': 'suspected'}],
    lambda x: x.at is not null)) as c from pings left join acks a using (seq) left join replies using (seq))""", V.EVENTS, PROBES))
def classify_probes(spark, sf):
    return B.classify_probes(*probe_tables(spark, sf), timeout=PING_TIMEOUT).withColumn("decided_at", F.round("decided_at", 3))


@query("jn17_expire_suspicions", V.with_views(f"""
select peer, seq, case when nt - t < 50000 then nk when nk is not null or {EPOCH_NOW} - t >= 50000 then 'dead' else 'pending' end as outcome
from (select *, lead(kind) over w as nk, lead(t) over w as nt from (select 'p' || user_id as peer, seq, epoch_us(ts) / 1e6 as t,
   case event_type when 'error' then 'renewed' else 'cleared' end as kind from ev where event_type in ('error', 'view')) window w as (partition by peer order by seq))
where kind = 'renewed'""", V.EVENTS))
def expire_suspicions(spark, sf):
    ev = V.events(spark, sf).selectExpr("'p' || user_id as peer", "seq", "ts", "event_type")
    return B.expire_suspicions(ev.filter("event_type = 'error'"), ev.filter("event_type = 'view'"), NOW, timeout=50000.0).drop("ts")


@query("jn18_buddy_status", V.with_views(f"""
, s as (select distinct 'p' || user_id as target from ev),
a as (select *, row_number() over (partition by target order by seq desc) as rn from (select seq, ts, 'p' || user_id as target, 'b' || k % 3 as buddy from ev where event_type = 'signup' and user_id % 5 <> 0)),
r as (select target, buddy, arg_max(alive, r.seq) as alive from (select seq, 'p' || user_id as target, 'b' || k % 3 as buddy, k % 2 = 0 as alive from ev where event_type = 'click') r
  join (select target, buddy, seq as aseq from a where rn = 1) using (target, buddy) where r.seq > aseq group by target, buddy)
select s.target, a.buddy, case when a.seq is null then 'NoBuddy' when alive is null then 'Pending' when alive then 'Alive' else 'Dead' end as status,
  a.seq is not null and alive is null and {EPOCH_NOW} - epoch_us(ts) / 1e6 >= 1500000 as timed_out
from s left join (select * from a where rn = 1) a using (target) left join r using (target)""".replace("\n, s as", "s as"), V.EVENTS).replace("\ns as", ",\ns as"))
def buddy_status(spark, sf):
    ev = V.events(spark, sf).selectExpr("seq", "ts", "user_id", "'p' || user_id as target", "'b' || (k % 3) as buddy", "k % 2 = 0 as alive", "event_type")
    return B.buddy_status(
        ev.select("target"), ev.filter("event_type = 'signup' and user_id % 5 <> 0"), ev.filter("event_type = 'click'"), NOW, timeout=1_500_000.0
    )


# ---- membership

GOSSIP_SPARK = [
    "'p' || (seq % 3) as observer", "seq", "'p' || (user_id % 20) as peer_id",
    "case event_type when 'view' then 'alive' when 'click' then 'suspect' when 'error' then 'dead' else if(k = 7, 'removed', 'alive') end as type",
    "if(event_type = 'purchase' and k = 7, null, k % 5) as incarnation",
    "if(event_type in ('view', 'purchase') and k % 2 = 1 and not (event_type = 'purchase' and k = 7), 'a' || k, null) as address", "'p' || (k % 20) as from",
]
GOSSIP = """gossip as (select 'p' || (seq % 3) as observer, seq, 'p' || (user_id % 20) as peer_id,
  case event_type when 'view' then 'alive' when 'click' then 'suspect' when 'error' then 'dead' else case when k = 7 then 'removed' else 'alive' end end as type,
  case when event_type = 'purchase' and k = 7 then null else k % 5 end as inc,
  case when event_type in ('view', 'purchase') and k % 2 = 1 and not (event_type = 'purchase' and k = 7) then 'a' || k end as addr, 'p' || (k % 20) as via
  from ev),
g as (select *, row_number() over (partition by observer, peer_id order by seq) as n from gossip where observer <> peer_id),
f as (select observer, peer_id, 0::bigint as n, null::bigint as seq, null::varchar as type, null::varchar as st, null::bigint as inc, null::varchar as addr, null::varchar as via, false as changed
  from (select distinct observer, peer_id from g)
  union all
  select o, p, n, seq, type, case when c then case type when 'alive' then 'Alive' when 'suspect' then 'Suspected' when 'dead' then 'Dead' else 'Removed' end else st end,
    case when c and type <> 'removed' then ginc else inc end,
    case when c and type = 'alive' then case when st is null or ginc > inc then gaddr else coalesce(addr, gaddr) end else addr end,
    case when c and type = 'alive' then gvia else via end, c
  from (select g.observer as o, g.peer_id as p, g.n, g.seq, g.type, g.inc as ginc, g.addr as gaddr, g.via as gvia, f.st, f.inc, f.addr, f.via,
    case g.type when 'alive' then f.st is null or (f.st <> 'Removed' and (g.inc > f.inc or (g.inc = f.inc and (f.st <> 'Alive' or (f.addr is null and g.addr is not null)))))
      when 'suspect' then coalesce(f.st = 'Alive' and g.inc >= f.inc, false) when 'dead' then coalesce(f.st <> 'Dead' and g.inc >= f.inc, false)
      else coalesce(f.st <> 'Removed', false) end as c
    from f join g on g.observer = f.observer and g.peer_id = f.peer_id and g.n = f.n + 1)),
members as (select observer, peer_id, arg_max(st, n) as state, arg_max(inc, n) as incarnation, (array_agg(addr order by n desc))[1] as address, (array_agg(via order by n desc))[1] as via
  from f group by observer, peer_id having arg_max(st, n) is not null),
selfs as (select observer, coalesce((select count(*) + greatest(max(inc - j + 1), 0) from (select observer, inc, row_number() over (partition by observer order by seq) as j
  from gossip s where s.peer_id = s.observer and type = 'suspect') x where x.observer = o.observer having count(*) > 0), 0)::bigint as incarnation from (select distinct observer from gossip) o)"""


def gossip(ev):
    return ev.selectExpr(*GOSSIP_SPARK)


@query("str4_membership", V.with_views("select observer, peer_id, state, incarnation, address, via from members", V.EVENTS, GOSSIP))
def membership(spark, sf):
    return M.membership(gossip(V.events(spark, sf)))


@query("str5_gossip_changes", V.with_views("""
select observer, peer_id, seq, type, type = 'alive' as is_new, st as state, inc as incarnation, addr as address from f where changed""", V.EVENTS, GOSSIP))
def gossip_changes(spark, sf):
    return M.gossip_changes(gossip(V.events(spark, sf)))


@query("str4_self_incarnations", V.with_views("select observer, incarnation from selfs", V.EVENTS, GOSSIP))
def self_incarnations(spark, sf):
    return M.self_incarnations(gossip(V.events(spark, sf)))


@query("flt4_members_where", V.with_views("""
select 'alive' as kind, observer, peer_id from members where state = 'Alive' union all select 'dead', observer, peer_id from members where state = 'Dead'
union all select 'removed', observer, peer_id from members where state = 'Removed' union all select 'server', observer, peer_id from members where address is not null
union all select 'client_only', observer, peer_id from members where address is null
union all select 'reconnectable', observer, peer_id from members where state <> 'Removed' and address is not null""", V.EVENTS, GOSSIP))
def members_where(spark, sf):
    return M.members_by_kind(M.membership(gossip(V.events(spark, sf))))


@query("str6_alive_snapshot", V.with_views("""
select observer, observer as peer_id, incarnation, 'self' as address from selfs
union all select observer, peer_id, incarnation, address from members where state = 'Alive'""", V.EVENTS, GOSSIP))
def alive_snapshot(spark, sf):
    rows = gossip(V.events(spark, sf))
    selves = M.self_incarnations(rows).withColumn("address", F.lit("self"))
    return M.alive_snapshot(M.membership(rows), selves)


MESSAGES = r"""case cast(seq % 5 as int) when 0 then '{"type":"gossip","updates":[{"type":"alive","peer":{"peerId":"p' || user_id || '","address":' || case when k % 2 = 0 then 'null' else '"a' || k || '"' end
  || '},"incarnation":' || k || '},{"type":"removed","peer_id":"q' || k || '"}]}' when 1 then '{"type":"sync","data":[1,2],"gossip":[{"type":"dead","peer_id":"p' || user_id || '","incarnation":' || k || '}]}'
  when 2 then '{"type":"sync","data":[1]}' when 3 then 'no json' else '{"type":"gossip","updates":[{"type":"other","peer_id":"x","incarnation":1}]}' end"""


@query("src7_decode_gossip", V.with_views("""
select seq, 'gossip' as message_type, unnest([0, 1])::bigint as update_no, unnest(['alive', 'removed']) as type, unnest(['p' || user_id, 'q' || k]) as peer_id,
  unnest([case when k % 2 = 1 then 'a' || k end, null]) as address, unnest([k, null]) as incarnation from ev where seq % 5 = 0
union all select seq, 'sync', 0, 'dead', 'p' || user_id, null, k from ev where seq % 5 = 1""", V.EVENTS))
def decode_gossip(spark, sf):
    from ..sources.gossip import decode_gossip as decode

    raw = V.events(spark, sf).selectExpr("seq", f"{MESSAGES} as message")
    return decode(raw).withColumn("update_no", F.col("update_no").cast("long"))
