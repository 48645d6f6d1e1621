"""Tagged JSON messages between peers, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPDATE = "STRUCT<type: STRING, peer: STRUCT<peerId: STRING, address: STRING>, peer_id: STRING, incarnation: BIGINT>"
MESSAGE = f"STRUCT<type: STRING, updates: ARRAY<{UPDATE}>, gossip: ARRAY<{UPDATE}>, data: ARRAY<INT>>"
UPDATE_TYPES = ["alive", "suspect", "dead", "removed"]


def decode_gossip(df: DataFrame, column: str = "message") -> DataFrame:
    """One row per membership update of a message, with the other columns of ``df``.

    A ``gossip`` message holds updates, a ``sync`` message may carry some.  Text that is no
    JSON, other message types and other update types give no rows, as does a whole message
    with one malformed update.
    """
    parsed = df.withColumn("_m", F.from_json(column, MESSAGE))
    kind = F.col("_m.type")
    updates = F.when(kind == "gossip", F.col("_m.updates")).when(kind == "sync", F.coalesce("_m.gossip", F.array()))
    known = lambda u: u["type"].isin(UPDATE_TYPES) & F.when(
        u["type"] == "alive", u["peer"]["peerId"].isNotNull() & u["incarnation"].isNotNull()
    ).otherwise(u["peer_id"].isNotNull() & ((u["type"] == "removed") | u["incarnation"].isNotNull()))
    whole = F.forall(updates, lambda u: F.coalesce(known(u), F.lit(False)))
    return (
        parsed.withColumn("_u", updates)
        .filter(F.coalesce(whole, F.lit(False)))
        .select(
            *[c for c in df.columns if c != column],
            kind.alias("message_type"),
            F.posexplode("_u").alias("update_no", "_x"),
        )
        .select(
            *[c for c in df.columns if c != column],
            "message_type",
            "update_no",
            F.col("_x.type").alias("type"),
            F.when(F.col("_x.type") == "alive", F.col("_x.peer.peerId")).otherwise(F.col("_x.peer_id")).alias("peer_id"),
            F.when(F.col("_x.type") == "alive", F.col("_x.peer.address")).alias("address"),
            F.col("_x.incarnation").alias("incarnation"),
        )
    )
