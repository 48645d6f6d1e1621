"""Health checks between peers: probe outcomes, suspicions, second opinions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import ROWS_PER_SLICE, previous_row, with_slices
from .changes import seconds

# Fixed values in seconds.
PING_TIMEOUT = 0.5
# All probing ends after this many ping timeouts.
PROBE_ROUNDS = 3
SUSPICION_TIMEOUT = 5.0


def classify_probes(pings: DataFrame, acks: DataFrame, replies: DataFrame, timeout: float = PING_TIMEOUT) -> DataFrame:
    """(seq, target, outcome, decided_at) of pings (seq, target, ts, asked).

    ``acks`` (seq, ts) are direct answers, ``replies`` (seq, ts, alive) answers over other
    peers, of which ``asked`` were asked.  ok: acked within the timeout; late: acked before
    the probing ended; alive: found alive by another peer; suspected: nothing in time, or
    every asked peer said no.  The earliest of these decides.
    """
    acked = acks.groupBy("seq").agg(F.min(seconds("ts")).alias("ack_at"))
    no = ~F.col("alive")
    heard = replies.groupBy("seq").agg(
        F.min(F.when(F.col("alive"), seconds("ts"))).alias("alive_at"),
        F.count_if(no).alias("n_no"),
        F.max(F.when(no, seconds("ts"))).alias("no_at"),
    )
    joined = pings.withColumn("sent", seconds("ts")).join(acked, "seq", "left").join(heard, "seq", "left")
    ends = F.col("sent") + PROBE_ROUNDS * timeout
    all_no = F.when((F.col("asked") > 0) & (F.col("n_no") >= F.col("asked")), F.col("no_at"))
    decided = F.least("ack_at", "alive_at", "all_no", "ends")
    acked_in_time = F.when(F.col("ack_at") < F.col("sent") + timeout, "ok").otherwise("late")
    outcome = (
        F.when((F.col("ack_at") == F.col("decided_at")) & (F.col("ack_at") < F.col("ends")), acked_in_time)
        .when((F.col("alive_at") == F.col("decided_at")) & (F.col("alive_at") < F.col("ends")), "alive")
        .otherwise("suspected")
    )
    return (
        joined.withColumn("all_no", all_no)
        .withColumn("ends", ends)
        .withColumn("decided_at", decided)
        .withColumn("outcome", outcome)
        .select("seq", "target", "outcome", "decided_at")
    )


def expire_suspicions(
    suspicions: DataFrame, clears: DataFrame, now, timeout: float = SUSPICION_TIMEOUT, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Add ``outcome`` to suspicions (peer, seq, ts): cleared, renewed, dead or pending.

    What follows next for the peer decides: a clear or a new suspicion inside the timeout,
    else the peer is dead once the timeout has passed.  Only the next row is looked at, so a
    peer with very many suspicions needs no pairwise comparison.
    """
    rows = suspicions.select("peer", "seq", "ts", F.lit("renewed").alias("kind")).unionByName(
        clears.select("peer", "seq", "ts", F.lit("cleared").alias("kind"))
    )
    sliced = with_slices(rows, ["peer"], "seq", rows_per_slice)
    seen = previous_row(sliced, ["peer"], "seq", ["kind", "ts"], out="next", descending=True)
    in_time = seconds("next.ts") - seconds("ts") < timeout
    passed = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - seconds("ts") >= timeout
    outcome = F.when(in_time, F.col("next.kind")).when(passed | F.col("next").isNotNull(), "dead").otherwise("pending")
    return seen.filter("kind = 'renewed'").select("peer", "seq", "ts", outcome.alias("outcome"))


def buddy_status(suspects: DataFrame, assigns: DataFrame, responses: DataFrame, now, timeout: float) -> DataFrame:
    """(target, buddy, status, timed_out): what the peer asked for a second opinion said.

    The latest assignment of a target counts, with the last answer of that peer after it.
    ``assigns`` has seq, ts, target, buddy; ``responses`` seq, target, buddy, alive.
    """
    latest = assigns.groupBy("target").agg(F.max(F.struct("seq", "ts", "buddy")).alias("a")).select(
        "target", F.col("a.seq").alias("a_seq"), F.col("a.ts").alias("a_ts"), F.col("a.buddy").alias("buddy")
    )
    answered = (
        latest.join(responses.select("target", "buddy", "seq", "alive"), ["target", "buddy"])
        .filter("seq > a_seq")
        .groupBy("target")
        .agg(F.max_by("alive", "seq").alias("alive"))
    )
    status = (
        F.when(F.col("a_seq").isNull(), "NoBuddy").when(F.col("alive").isNull(), "Pending").when(F.col("alive"), "Alive").otherwise("Dead")
    )
    waited = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - seconds("a_ts") >= timeout
    return (
        suspects.select("target").distinct().join(latest, "target", "left").join(answered, "target", "left")
        .select("target", "buddy", status.alias("status"), ((F.col("a_seq").isNotNull()) & F.col("alive").isNull() & waited).alias("timed_out"))
    )
