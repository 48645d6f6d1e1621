"""Streaming forms of the event operators.

Each gives the same rows as its batch form when the input arrives in order.  Rows later
than the watermark are dropped; rows of one micro-batch are put in ``seq`` order per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.membership import FOLD_SCHEMA, KEYS, NOTHING, STATE_FIELDS, STATE_SCHEMA, _foreign, fold_rows
from ..operators.probes import PING_TIMEOUT, PROBE_ROUNDS, SUSPICION_TIMEOUT


def debounce(events: DataFrame, gap: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """Last event of a path after a quiet gap: path, kind, mtime, seq, last_ts, closed_at."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return (
        events.groupBy("path", F.session_window("ts", gap))
        .agg(F.max_by(F.struct("kind", "mtime", "seq", "ts"), "seq").alias("e"))
        .select("path", "e.kind", "e.mtime", "e.seq", F.col("e.ts").alias("last_ts"), F.col("session_window.end").alias("closed_at"))
    )


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values("seq")


def suppress_echo_stream(rows: DataFrame, ttl: float = 30.0, watermark: str = "0 seconds") -> DataFrame:
    """Events (path, seq, ts) with ``is_echo`` from a stream of marks and events.

    The state of a path is one row, dropped once a mark in it could no longer count.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        marked_at = state.get[0] if state.exists else None
        out = []
        for row in _in_order(parts).itertuples():
            at = row.ts.value // 1000
            if row.is_mark:
                marked_at = at
            else:
                out.append((key[0], row.seq, row.ts, marked_at is not None and (at - marked_at) / 1e6 < ttl))
                marked_at = None
        if marked_at is None:
            if state.exists:
                state.remove()
        else:
            state.update((marked_at,))
            state.setTimeoutTimestamp(max(marked_at // 1000 + int(ttl * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "seq", "ts", "is_echo"])

    return (
        rows.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy("path")
        .applyInPandasWithState(
            step,
            "path string, seq long, ts timestamp, is_echo boolean",
            "marked_at long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def membership_stream(gossip: DataFrame) -> DataFrame:
    """Changes of the membership table as they happen; the last one per key is its entry."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        member = tuple(state.get) if state.exists else NOTHING
        out = []
        for row in fold_rows(pd.concat(list(parts)), member):
            member = row[4:]
            if row[2]:
                out.append(row)
        if member[0] is not None:
            state.update(member)
        table = pd.DataFrame(out, columns=["seq", "type", "changed", "is_new", *STATE_FIELDS])
        table["m_incarnation"] = table["m_incarnation"].astype("Int64")
        table.insert(0, "observer", key[0])
        table.insert(1, "peer_id", key[1])
        table.insert(2, "_slice", -1)
        yield table

    changes = _foreign(gossip).groupBy(*KEYS).applyInPandasWithState(
        step, FOLD_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
    return changes.select(
        *KEYS, "seq", "type", "is_new", "state", F.col("m_incarnation").alias("incarnation"),
        F.col("m_address").alias("address"), F.col("m_via").alias("via"),
    )


PEER_FIELDS = ["state", "reason", "first_seen", "last_seen", "connections", "address", "direction"]
PEER_SCHEMA = (
    "state string, reason string, first_seen timestamp, last_seen timestamp, connections long, address string, direction string"
)


def advance_peer(entry: tuple | None, kind: str, ts, since, address, direction, reason) -> tuple | None:
    """Registry entry of a peer after one event; None while the peer is unknown."""
    if kind in ("connecting", "handshake"):
        return ("connecting" if kind == "connecting" else "connected", None, since, ts, 1, address, direction)
    if entry is None:
        return ("connected", None, ts, ts, 1, address, direction) if kind == "connect" else None
    state, old_reason, first, _, count, old_address, old_direction = entry
    if kind == "touch":
        return (state, old_reason, first, ts, count, old_address, old_direction)
    if kind == "disconnect":
        return ("disconnected", reason, first, ts, count, old_address, old_direction)
    return ("connected", None, first, ts, count + (state != "connected"), address, direction)


def peer_registry_stream(events: DataFrame) -> DataFrame:
    """The registry entry of a peer after every micro-batch that touched it, with its ``seq``.

    ``events`` has seq, ts, since, kind, peer, address, direction and reason.
    """

    def clean(value):
        return None if value is None or value != value else value

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = tuple(state.get) if state.exists else None
        seq = None
        for row in _in_order(parts).itertuples():
            after = advance_peer(entry, row.kind, row.ts, row.since, clean(row.address), clean(row.direction), clean(row.reason))
            if after is not None:
                entry, seq = after, row.seq
        if seq is not None:
            state.update(entry)
            yield pd.DataFrame([(key[0], seq, *entry)], columns=["peer", "seq", *PEER_FIELDS])

    typed = events.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "since")})
    return typed.groupBy("peer").applyInPandasWithState(
        step, f"peer string, seq long, {PEER_SCHEMA}", PEER_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def handshake_stream(connecting: DataFrame, handshakes: DataFrame, within: str, watermark: str) -> DataFrame:
    """Handshakes joined to the connection they complete: rows for the peer, with ``since``."""
    opened = connecting.select(
        F.col("conn_id").alias("o_conn"), F.col("ts").alias("since"), "address", "direction"
    ).withWatermark("since", watermark)
    done = handshakes.select("seq", "ts", "peer", "conn_id").withWatermark("ts", watermark)
    return done.join(
        opened, (F.col("conn_id") == F.col("o_conn")) & (F.col("since") <= F.col("ts")) & (F.col("ts") <= F.col("since") + F.expr(f"interval {within}"))
    ).select(
        "seq", "ts", "since", F.lit("handshake").alias("kind"), "peer", "address", "direction", F.lit(None).cast("string").alias("reason")
    )


def probe_stream(pings: DataFrame, acks: DataFrame, timeout: float = PING_TIMEOUT, watermark: str = "10 seconds") -> DataFrame:
    """(seq, target, outcome): ok, late or suspected, once time has shown it.

    A left outer join of two streams: a ping without an ack comes out when the watermark
    has passed the end of its probing.
    """
    whole = F.expr(f"interval {int(PROBE_ROUNDS * timeout * 1000)} milliseconds")
    short = F.expr(f"interval {int(timeout * 1000)} milliseconds")
    sent = pings.select("seq", "target", F.col("ts").alias("sent")).withWatermark("sent", watermark)
    got = (
        acks.select(F.col("seq").alias("a_seq"), F.col("ts").alias("ack"))
        .withWatermark("ack", watermark)
        .dropDuplicatesWithinWatermark(["a_seq"])
    )
    joined = sent.join(got, (F.col("seq") == F.col("a_seq")) & (F.col("ack") >= F.col("sent")) & (F.col("ack") < F.col("sent") + whole), "left_outer")
    outcome = F.when(F.col("ack").isNull(), "suspected").when(F.col("ack") < F.col("sent") + short, "ok").otherwise("late")
    return joined.select("seq", "target", outcome.alias("outcome"))


def probe_states_stream(messages: DataFrame, timeout: float = PING_TIMEOUT, watermark: str = "10 seconds") -> DataFrame:
    """(seq, target, outcome, decided_at) of probes, as their time ends.

    ``messages`` has seq (of the probe), ts, kind (ping, ack, reply), target and asked (of a ping) and alive (of
    a reply).  A ping waits in an outer join of two streams for what answers it; once the watermark has passed the end
    of the probing, an aggregate decides as :func:`classify_probes` does on what was heard up to then.  Messages
    without a ping are dropped by the join.  A ping comes before what answers it, or at most the whole probing later.
    """
    whole = PROBE_ROUNDS * timeout
    length = F.expr(f"interval {int(whole * 1000)} milliseconds")
    # Messages of any kind move the time of both sides: a test on the time stays behind the watermark.
    rows = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    of = lambda *kinds: rows.filter(F.when(F.col("ts").isNotNull(), F.col("kind")).isin(*kinds))
    pings = of("ping").select("seq", "target", "asked", F.col("ts").alias("sent")).dropDuplicatesWithinWatermark(["seq"])
    heard = of("ack", "reply").select(F.col("seq").alias("h_seq"), F.col("ts").alias("at"), "kind", "alive")
    inside = (F.col("at") >= F.col("sent") - length) & (F.col("at") < F.col("sent") + length)
    micros = lambda c: F.unix_micros(c) / F.lit(1e6)
    joined = pings.join(heard, (F.col("seq") == F.col("h_seq")) & inside, "left_outer").select(
        "seq", "target", "asked", "sent", "kind", F.coalesce("alive", F.lit(False)).alias("alive"), micros("at").alias("at")
    )
    reply = F.col("kind") == "reply"
    state = joined.groupBy("seq", "target", "asked", "sent").agg(
        F.min(F.when(F.col("kind") == "ack", F.col("at"))).alias("ack_at"),
        F.min(F.when(reply & F.col("alive"), F.col("at"))).alias("alive_at"),
        F.count_if(reply & ~F.col("alive")).alias("n_no"),
        F.max(F.when(reply & ~F.col("alive"), F.col("at"))).alias("no_at"),
    )
    start = micros("sent")
    all_no = F.when((F.col("asked") > 0) & (F.col("n_no") >= F.col("asked")), F.col("no_at"))
    decided = F.least("ack_at", "alive_at", all_no, start + whole)
    return state.select(
        "seq",
        "target",
        F.when(F.col("ack_at") == decided, F.when(F.col("ack_at") < start + timeout, "ok").otherwise("late"))
        .when(F.col("alive_at") == decided, "alive")
        .otherwise("suspected")
        .alias("outcome"),
        decided.alias("decided_at"),
    )


def suspicion_stream(rows: DataFrame, timeout: float = SUSPICION_TIMEOUT, watermark: str = "10 seconds") -> DataFrame:
    """(peer, seq, outcome) of suspicions: cleared, renewed or dead, as soon as it is known.

    ``rows`` has peer, seq, ts and kind (renewed for a suspicion, cleared for a sign of life).  A peer's open
    suspicion is its state; the next row of the peer decides it, or a timer at its end.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], seq, "dead")], columns=["peer", "seq", "outcome"])
            return
        own = _in_order(parts)[["seq", "ts", "kind"]]
        if state.exists:
            seq, at = state.get
            own = pd.concat([pd.DataFrame({"seq": [seq], "ts": pd.to_datetime([at], unit="us").astype(own["ts"].dtype), "kind": ["renewed"]}), own])
        waited = (own["ts"].shift(-1) - own["ts"]).dt.total_seconds()
        own["outcome"] = own["kind"].shift(-1).where(waited < timeout, "dead")
        decided = own.iloc[:-1]
        out = decided.loc[decided["kind"] == "renewed", ["seq", "outcome"]]
        last = own.iloc[-1]
        if last["kind"] == "renewed":
            at = last["ts"].value // 1000
            state.update((int(last["seq"]), at))
            state.setTimeoutTimestamp(max(at // 1000 + int(timeout * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        out.insert(0, "peer", key[0])
        yield out

    return (
        rows.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy("peer")
        .applyInPandasWithState(
            step, "peer string, seq long, outcome string", "seq long, at long", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
