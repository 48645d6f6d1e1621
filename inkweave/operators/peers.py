"""Connections: one row per peer from a log of connects, disconnects and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import ROWS_PER_SLICE, previous_row, with_slices

CONNECTION_KINDS = ("connecting", "handshake", "connect")
# Kinds after which a peer is a fresh entry whatever it was before.
FRESH_KINDS = ("connecting", "handshake")


def resolve_connections(events: DataFrame) -> DataFrame:
    """Events by connection id brought to the peer they turned out to be.

    ``events`` has seq, ts, kind, peer, conn_id, address, direction and reason.  A
    ``connecting`` row is known by its conn_id; the first ``handshake`` of a conn_id names
    the peer and takes over address, direction and first time; later disconnects of the
    conn_id are the peer's.  A handshake of an unknown or used-up conn_id is dropped.
    """
    opened = (
        events.filter("kind = 'connecting'")
        .groupBy("conn_id")
        .agg(F.max(F.struct("seq", "ts", "address", "direction")).alias("open"))
    )
    shaken = (
        events.filter("kind = 'handshake'")
        .join(opened, "conn_id")
        .filter("seq > open.seq")
        .groupBy("conn_id")
        .agg(F.min(F.struct("seq", "ts", "peer", "open")).alias("h"))
    )
    handshakes = shaken.select(
        F.col("h.seq").alias("seq"), "h.ts", F.lit("handshake").alias("kind"), "h.peer", "h.open.address",
        "h.open.direction", F.lit(None).cast("string").alias("reason"), F.col("h.open.ts").alias("since"),
    )
    known = shaken.select(F.col("conn_id"), F.col("h.seq").alias("h_seq"), F.col("h.peer").alias("h_peer"))
    other = (
        events.filter("kind <> 'handshake'")
        .withColumn("conn_id", F.coalesce("conn_id", "peer"))
        .join(known, "conn_id", "left")
        .filter("not (kind = 'connecting' and h_seq is not null)")
        .withColumn("peer", F.when((F.col("seq") > F.col("h_seq")) & (F.col("kind") == "disconnect"), F.col("h_peer")).otherwise(F.coalesce("peer", "conn_id")))
        .select("seq", "ts", "kind", "peer", "address", "direction", "reason", F.col("ts").alias("since"))
    )
    return other.unionByName(handshakes)


def peer_registry(events: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(peer, state, reason, first_seen, last_seen, connections, address, direction).

    ``events`` has seq, ts, kind (connect, disconnect, touch, and after
    :func:`resolve_connections` connecting and handshake), peer, address, direction, reason.
    Rows before a peer's first connect are ignored.  A connect counts only when the peer was
    not connected; a touch only moves last_seen.
    """
    if "since" not in events.columns:
        events = events.withColumn("since", F.col("ts"))
    fresh = F.col("kind").isin(*FRESH_KINDS)
    starts = events.groupBy("peer").agg(
        F.coalesce(F.max(F.when(fresh, F.col("seq"))), F.min(F.when(F.col("kind") == "connect", F.col("seq")))).alias("from_seq")
    )
    rows = events.join(starts.filter("from_seq is not null"), "peer").filter("seq >= from_seq")
    turns = previous_row(with_slices(rows.filter("kind <> 'touch'"), ["peer"], "seq", rows_per_slice), ["peer"], "seq", ["kind"])
    again = (F.col("kind") == "connect") & F.col("prev.kind").isin("disconnect", "connecting")
    last = lambda c, test: F.max_by(c, F.when(test, F.col("seq")))
    state = (
        F.when(F.col("last_kind") == "disconnect", "disconnected").when(F.col("last_kind") == "connecting", "connecting").otherwise("connected")
    )
    known = turns.groupBy("peer").agg(
        F.min(F.when(F.col("seq") == F.col("from_seq"), F.col("since"))).alias("first_seen"),
        F.max_by("ts", "seq").alias("turn_ts"),
        F.max("seq").alias("turn_seq"),
        (F.count_if(again) + 1).alias("connections"),
        F.max_by("kind", "seq").alias("last_kind"),
        F.max_by("reason", "seq").alias("last_reason"),
        last("address", F.col("kind").isin(*CONNECTION_KINDS)).alias("address"),
        last("direction", F.col("kind").isin(*CONNECTION_KINDS)).alias("direction"),
    )
    touched = rows.filter("kind = 'touch'").groupBy("peer").agg(F.max_by("ts", "seq").alias("touch_ts"), F.max("seq").alias("touch_seq"))
    return known.join(touched, "peer", "left").select(
        "peer",
        state.alias("state"),
        F.when(F.col("last_kind") == "disconnect", F.col("last_reason")).alias("reason"),
        "first_seen",
        F.when(F.col("touch_seq") > F.col("turn_seq"), F.col("touch_ts")).otherwise(F.col("turn_ts")).alias("last_seen"),
        "connections",
        "address",
        "direction",
    )


def connected_peers(registry: DataFrame) -> DataFrame:
    return registry.filter("state = 'connected'")


def latest_peers(rows: DataFrame) -> DataFrame:
    """Known peers: last address and time win; ``discovered_via`` only when one is given."""
    return rows.groupBy("peer").agg(
        F.max_by("address", "seq").alias("address"),
        F.max_by("last_seen", "seq").alias("last_seen"),
        F.max_by("discovered_via", F.when(F.col("discovered_via").isNotNull(), F.col("seq"))).alias("discovered_via"),
    )


def reconnectable(peers: DataFrame) -> DataFrame:
    return peers.filter("address is not null")


def duplicate_connections(conns: DataFrame) -> DataFrame:
    """Add ``verdict`` to connections (ours, peer, seq, direction): which of two to close.

    The lower id keeps its outgoing connection and the higher one its incoming, so once the
    winning direction has been seen it stays the open one.  Two minima per pair tell what
    was open before a row, without comparing all connections of a pair.
    """
    winning = F.when(F.col("ours") < F.col("peer"), "outgoing").otherwise("incoming")
    marked = conns.withColumn("_wins", F.col("direction") == winning)
    firsts = marked.groupBy("ours", "peer").agg(
        F.min("seq").alias("_first"), F.min(F.when(F.col("_wins"), F.col("seq"))).alias("_first_win")
    )
    open_wins = F.when(F.col("seq") > F.col("_first_win"), True).when(F.col("seq") > F.col("_first"), False)
    verdict = (
        F.when(open_wins.isNull() | (open_wins == F.col("_wins")), "no duplicate")
        .when(F.col("_wins"), "close other")
        .otherwise("close this")
    )
    return marked.join(firsts, ["ours", "peer"]).select(*conns.columns, verdict.alias("verdict"))
