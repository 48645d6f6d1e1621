"""Streams over several micro-batches, and those that no registered query covers."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from inkweave.operators import changes, membership, probes
from inkweave.streaming import events as S
from inkweave.streaming import index
from inkweave.streaming.sinks import run_available, run_in_batches


def as_stream(spark, df, folder):
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_handshakes_join_their_connection(spark, tmp_path):
    opened = spark.createDataFrame(
        [("c1", 10, "a1", "incoming"), ("c2", 20, "a2", "outgoing"), ("c3", 30, "a3", "incoming")],
        "conn_id string, t long, address string, direction string",
    ).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    shaken = spark.createDataFrame(
        [(1, 12, "p", "c1"), (2, 500, "q", "c2"), (3, 40, "r", "c9"), (4, 31, "s", "c3")], "seq long, t long, peer string, conn_id string"
    ).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    joined = S.handshake_stream(
        as_stream(spark, opened, str(tmp_path / "open")), as_stream(spark, shaken, str(tmp_path / "done")), "60 seconds", "10 minutes"
    )
    got = run_available(joined, "handshakes").select("seq", "peer", "address", "direction", F.unix_seconds("since"))
    assert sorted(map(tuple, got.collect())) == [(1, "p", "a1", "incoming", 10), (4, "s", "a3", "incoming", 30)]


def in_batches(spark, df, folder, n=4):
    """A stream that reads the rows of ``df`` in order of ``seq``, one part per micro-batch."""
    rows = df.orderBy("seq").collect()
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read in the order of their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_membership_over_several_batches(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["alive", "alive", "suspect", "dead", "removed"]
    data = []
    for i in range(120):
        kind = rng.choice(kinds)
        number = None if kind == "removed" else rng.randrange(4)
        address = f"a{rng.randrange(3)}" if kind == "alive" and rng.random() < 0.5 else None
        data.append(("o", i, kind, rng.choice("pqr"), address, number, "v"))
    df = spark.createDataFrame(data, "observer string, seq long, type string, peer_id string, address string, incarnation long, from string")
    found = run_available(S.membership_stream(in_batches(spark, df, str(tmp_path / "gossip"))), "members")
    last = found.groupBy("observer", "peer_id").agg(F.max_by(F.struct("state", "incarnation", "address"), "seq").alias("m"))
    got = sorted(map(str, last.select("observer", "peer_id", "m.*").collect()))
    want = membership.membership(df).select("observer", "peer_id", "state", "incarnation", "address")
    assert got == sorted(map(str, want.collect())) and got


def test_echoes_over_several_batches(spark, tmp_path):
    rng = random.Random(9)
    data = [(i, rng.choice("ab"), rng.random() < 0.4, 100 + 2 * i) for i in range(80)]
    df = spark.createDataFrame(data, "seq long, path string, is_mark boolean, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    found = run_available(S.suppress_echo_stream(in_batches(spark, df, str(tmp_path / "rows")), ttl=5.0), "echo")
    want = changes.suppress_echo(df.filter("is_mark").drop("is_mark"), df.filter("not is_mark").drop("is_mark"), ttl=5.0)
    rows = lambda x: sorted((r["seq"], r["path"], r["is_echo"]) for r in x.collect())
    assert rows(found) == rows(want)


def probe_messages(spark, rng):
    """Messages in order of time, and the batch tables they stand for (answers within the probing)."""
    rows = []
    for seq in range(40):
        sent = 100.0 + 3 * seq
        rows.append((seq, sent, "ping", f"p{seq % 5}", rng.randrange(4), None))
        for _ in range(rng.randrange(4)):
            kind = rng.choice(["ack", "reply", "reply"])
            rows.append((seq, sent + rng.choice([0.1, 0.4, 0.5, 0.9, 1.4, 1.5, 7.0]), kind, None, None, rng.random() < 0.3 if kind == "reply" else None))
    rows.append((99, 150.0, "ack", None, None, None))  # of no ping
    rows.sort(key=lambda r: r[1])
    schema = "seq long, t double, kind string, target string, asked long, alive boolean"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def test_probe_states_over_several_batches(spark):
    df = probe_messages(spark, random.Random(11))
    last = df.limit(1).select(
        F.lit(-5).cast("long").alias("seq"), F.timestamp_seconds(F.lit(10**8)).alias("ts"), F.lit("ping").alias("kind"), F.lit("z").alias("target"),
        F.lit(0).cast("long").alias("asked"), F.lit(None).cast("boolean").alias("alive"),
    )
    rows = df.select("seq", "ts", "kind", "target", "asked", "alive")
    parts = [rows.filter((df["t"] >= a) & (df["t"] < b)) for a, b in ((0, 130), (130, 170), (170, 10**6))] + [last]
    got = run_in_batches(parts, lambda s: S.probe_states_stream(s, timeout=0.5, watermark="2 seconds"), "probes")
    pings = df.filter("kind = 'ping'")
    heard = df.filter("kind <> 'ping'").join(pings.selectExpr("seq", "t as sent"), "seq").filter("t < sent + 1.5")
    want = probes.classify_probes(
        pings.select("seq", "target", "ts", "asked"), heard.filter("kind = 'ack'").select("seq", "ts"),
        heard.filter("kind = 'reply'").select("seq", "ts", "alive"), timeout=0.5,
    )
    tuples = lambda x: sorted((r.seq, r.target, r.outcome, round(r.decided_at, 6)) for r in x.collect())
    assert tuples(got) == tuples(want)
    assert {r.outcome for r in got.collect()} == {"ok", "late", "alive", "suspected"}


def test_probe_states_run_no_python_per_probe(spark, tmp_path):
    messages = probe_messages(spark, random.Random(3)).select("seq", "ts", "kind", "target", "asked", "alive")
    states = S.probe_states_stream(as_stream(spark, messages, str(tmp_path / "messages")))
    assert "Pandas" not in states._jdf.queryExecution().logical().toString()


def test_suspicions_over_several_batches(spark):
    rng = random.Random(12)
    data = [(rng.choice("abc"), i, 100.0 + i * rng.choice([1.0, 1.0, 1.0]) + (9 if i > 40 else 0), rng.choice(["renewed", "cleared"])) for i in range(90)]
    df = spark.createDataFrame(data, "peer string, seq long, t double, kind string").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    last = spark.createDataFrame([("z", -1, "renewed")], "peer string, seq long, kind string").withColumn("ts", F.timestamp_seconds(F.lit(10**8)))
    columns = ["peer", "seq", "ts", "kind"]
    parts = [df.filter((F.col("seq") >= a) & (F.col("seq") < b)).select(*columns) for a, b in ((0, 25), (25, 50), (50, 90))] + [last.select(*columns)]
    got = run_in_batches(parts, lambda s: S.suspicion_stream(s, timeout=2.0, watermark="0 seconds"), "suspicions")
    want = probes.expire_suspicions(df.filter("kind = 'renewed'").drop("kind"), df.filter("kind = 'cleared'").drop("kind"), "2030-01-01", timeout=2.0)
    tuples = lambda x: sorted((r.peer, r.seq, r.outcome) for r in x.collect())
    assert tuples(got) == tuples(want) and {r.outcome for r in got.collect()} == {"cleared", "renewed", "dead"}


def test_live_segments_are_like_digits():
    fan = index.FAN
    assert index.live_segments([]) == []
    names = [f"tier-0-upto-{i}" for i in range(fan + 2)] + [f"tier-1-upto-{fan - 1}", "other"]
    assert sorted(index.live_segments(names)) == [f"tier-0-upto-{fan}", f"tier-0-upto-{fan + 1}", f"tier-1-upto-{fan - 1}"]
    assert index.live_segments([f"tier-2-upto-{fan**2 - 1}", f"tier-0-upto-{fan**2 - 1}"]) == [f"tier-2-upto-{fan**2 - 1}"]
    with pytest.raises(ValueError):
        index.live_segments(["tier-0-upto-3"])


def test_index_batches_merge_and_read_only_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FAN", 2)
    rng, folder = random.Random(13), str(tmp_path / "index")
    paths = [f"n{i}.md" for i in range(12)]
    now, asked = {p: "[[a]]" for p in paths}, []
    base = spark.createDataFrame([(p, p[:-3], "old") for p in paths], "src string, src_name string, tgt_name string")
    touched = {}

    def notes(buckets):
        asked.append(len(buckets))
        rows = [(p, p[:-3], c) for p, c in now.items() if c is not None]
        return spark.createDataFrame(rows, "path string, name string, content string").filter(index.bucket_of(F.col("path")).isin(buckets))

    for batch in range(7):
        events = []
        for seq, p in enumerate(rng.sample(paths, 3)):
            now[p] = rng.choice([f"[[b{batch}]] [[c]]", "[[d]]", None])
            touched[p] = now[p]
            events.append((p, "Deleted" if now[p] is None else "Modified", seq))
        df = spark.createDataFrame(events, "path string, kind string, seq long")
        for _ in range(2 if batch == 3 else 1):  # a batch that is run again
            index.write_batch(df, batch, notes, folder)
    assert max(asked) <= 3
    changes_now = index.read_changes(spark, folder)
    got = sorted(tuple(r) for r in index.current_links(base, changes_now).collect())
    want = [(p, p[:-3], "old") for p in paths if p not in touched]
    want += [(p, p[:-3], t) for p, c in touched.items() if c for t in c.replace("[[", "").replace("]]", "").split()]
    assert got == sorted(want)
    some = index.read_changes(spark, folder, [r.bucket for r in changes_now.select("bucket").distinct().limit(1).collect()])
    assert 0 < some.count() < changes_now.count() and "PartitionFilters: [" in some._jdf.queryExecution().toString()
    cache = spark.createDataFrame([(p, "[[d]]") for p in paths], "path string, text string").selectExpr("path", "sha2(text, 256) as content_hash")
    valid = {r.path for r in index.valid_vectors(cache, changes_now).collect()}
    assert valid == {p for p in paths if p not in touched or touched[p] == "[[d]]"}
