"""Operators on small fixtures: golden rows, brute force, and the paths for hot keys."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from inkweave import scale
from inkweave.operators import changes, edits, journal, links, membership, pagerank, peers, projects, reconcile, search
from inkweave.sources.notes import list_notes, publish, read_notes, read_version, sweep_attempts
from inkweave.streaming.events import PEER_FIELDS, advance_peer


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def make_notes(spark, contents):
    data = [(p, p.rsplit("/", 1)[-1].removesuffix(".md"), c) for p, c in contents.items()]
    return spark.createDataFrame(data, "path string, name string, content string")


def brute_rank(notes, pairs, seed, steps):
    """The walk by its definition, over plain dictionaries."""
    by_name = {}
    for path, name in notes.items():
        by_name.setdefault(name, set()).add(path)
    near = {p: set() for p in notes}
    for src, tgt in pairs:
        for other in by_name.get(tgt, ()):
            near[src].add(other)
            near[other].add(src)
    score = dict.fromkeys(notes, 1 / len(notes))
    homes = by_name[seed]
    for _ in range(steps):
        score = {
            p: 0.85 * sum(score[q] / len(near[q]) for q in near[p]) + 0.15 * (1 / len(homes) if p in homes else 0) for p in notes
        }
    return score


def test_ranking_over_relays(spark):
    rng = random.Random(5)
    notes = {f"f{i % 3}/N{i // 3}.md": f"N{i // 3}" for i in range(24)}
    pairs = {(p, f"N{rng.randrange(9)}") for p in notes for _ in range(3)}
    note_df = spark.createDataFrame(list(notes.items()), "path string, name string")
    link_df = spark.createDataFrame([(s, notes[s], t) for s, t in pairs], "src string, src_name string, tgt_name string")
    seeds = spark.createDataFrame([(f"N{i}",) for i in range(10)], "seed string")
    ranking = pagerank.personalized_pagerank(link_df, note_df, seeds, tol=0.0, max_iter=3)
    got = {(r["seed"], r["path"]): r["score"] for r in pagerank.path_scores(ranking).collect()}
    assert len(got) == 8 * 24  # N8 and N9 name no note
    for seed in (f"N{i}" for i in range(8)):
        for path, score in brute_rank(notes, pairs, seed, 3).items():
            assert got[(seed, path)] == pytest.approx(score, abs=1e-12)


def test_ranking_stops_at_the_right_step(spark):
    notes = {f"N{i}.md": f"N{i}" for i in range(12)}
    pairs = [(f"N{i}.md", f"N{(i * 5 + 1) % 12}") for i in range(12)] + [("N3.md", "N0"), ("N7.md", "N0")]
    note_df = spark.createDataFrame(list(notes.items()), "path string, name string")
    link_df = spark.createDataFrame([(s, notes[s], t) for s, t in pairs], "src string, src_name string, tgt_name string").distinct()
    ranking = pagerank.personalized_pagerank(link_df, note_df, spark.createDataFrame([("N0",), ("N5",)], "seed string"), tol=1e-3)
    for seed, step in rows(ranking.stops):
        change = lambda t: sum(
            abs(a - b)
            for a, b in zip(brute_rank(notes, pairs, seed, t).values(), brute_rank(notes, pairs, seed, t - 1).values(), strict=True)
        )
        assert change(step) < 1e-3 <= change(step - 1)


def test_a_step_exchanges_scores_only(spark):
    """The hops lie in buckets; threshold -1 keeps small tables from being broadcast instead."""
    notes = spark.createDataFrame([(f"N{i}.md", f"N{i}") for i in range(30)], "path string, name string")
    link_df = spark.createDataFrame([(f"N{i}.md", f"N{i}", f"N{i * 7 % 30}") for i in range(30)], "src string, src_name string, tgt_name string")
    numbered = pagerank.number_notes(notes)
    hops = pagerank.walk_hops(link_df, numbered)
    state, restarts = pagerank._start(numbered, numbered.select(F.lit(1).cast("long").alias("walk"), "node").limit(1), 0.85)
    with scale.session_setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        step = pagerank._step(scale.cut_lineage(state), [h.rows for h in hops], restarts, 0.85, "s0", "s1", [])
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("SortMergeJoin") == 2 and "Bucketed: true" in final
    scale.drop_buckets(*hops)
    assert not [t for t in spark.catalog.listTables() if t.name in {h.name for h in hops}]


def test_unknown_seed_gives_nothing(spark):
    note_df = spark.createDataFrame([("A.md", "A")], "path string, name string")
    link_df = spark.createDataFrame([], "src string, src_name string, tgt_name string")
    ranking = pagerank.personalized_pagerank(link_df, note_df, spark.createDataFrame([("X",)], "seed string"))
    wanted = spark.createDataFrame([(1, "X", "A")], "q int, seed string, name string")
    assert rows(pagerank.graph_proximity(ranking, wanted, ["q"])) == [(1, 0.0)]


@pytest.mark.parametrize("limit", [1000, 3])
def test_top_k_by_brute_force_in_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "QUERIES_PER_GROUP", limit)
    rng = random.Random(1)
    vecs = {f"p{i:02d}": [rng.gauss(0, 1) for _ in range(4)] for i in range(40)}
    vecs.update({f"copy{i}": vecs["p03"] for i in range(8)})
    queries = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(9)} | {9: vecs["p03"]}
    got = search.top_k_similar(
        spark.createDataFrame(list(queries.items()), "query_id int, vector array<double>"),
        spark.createDataFrame(list(vecs.items()), "path string, vector array<double>"),
        5,
    )
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q, vec in queries.items():
        best = sorted(vecs, key=lambda p: (-round(cos(vec, vecs[p]), 10), p))[:5]
        mine = [r["path"] for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()]
        if q != 9:
            assert mine == best
        else:
            assert len(mine) == 5 and all(vecs[p] == vecs["p03"] for p in mine)


def log_rows(rng, n, keys, kinds):
    return [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rng.choice(keys), rng.choice(kinds), rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("per_slice", [7, 10**6])
def test_change_logs_against_state_machines(spark, per_slice):
    rng = random.Random(3)
    data = log_rows(rng, 300, ["a", "a", "a", "b", "c"], ["Modified", "Deleted", "mark"])
    df = spark.createDataFrame(data, "seq long, ts string, path string, kind string, mtime int").withColumn("ts", F.to_timestamp("ts"))
    events = df.filter("kind <> 'mark'")
    kept, cache = [], {}
    for seq, _, path, kind, mtime in data:
        if kind == "Modified":
            if cache.get(path) != mtime:
                kept.append(seq)
            cache[path] = mtime
        elif kind == "Deleted":
            cache.pop(path, None)
            kept.append(seq)
    assert sorted(r["seq"] for r in changes.dedupe_mtime(events, per_slice).collect()) == kept
    echo, marked = {}, {}
    for seq, _, path, kind, _ in data:
        if kind == "mark":
            marked[path] = seq
        else:
            echo[seq] = path in marked and seq - marked.pop(path) < 4
    got = changes.suppress_echo(df.filter("kind = 'mark'"), events, 4.0, per_slice)
    assert {r["seq"]: r["is_echo"] for r in got.collect()} == echo


@pytest.mark.parametrize("per_slice", [5, 10**6])
def test_retries_and_carried_values(spark, per_slice):
    rng = random.Random(4)
    data = [(i, rng.choice("aab"), rng.random() < 0.2) for i in range(200)]
    df = spark.createDataFrame(data, "seq long, peer string, success boolean").withColumn("ts", F.timestamp_seconds("seq"))
    want, fails = {}, {}
    for seq, peer, success in data:
        fails[peer] = 0 if success else fails.get(peer, 0) + 1
        if not success:
            want[seq] = (fails[peer], min(5 * 2 ** (fails[peer] - 1), 60))
    got = changes.retry_schedule(df, "1970-01-01 00:05:00", rows_per_slice=per_slice)
    assert {r["seq"]: (r["attempt"], r["delay"]) for r in got.collect()} == want


@pytest.mark.parametrize("per_slice,per_group", [(1, 20_000), (1, 5), (3, 20_000), (3, 4), (10**6, 20_000)])
def test_membership_in_slices(spark, per_slice, per_group):
    rng = random.Random(7)
    data = []
    for i in range(240):
        kind = rng.choices(["alive", "suspect", "dead", "removed", "other"], [8, 4, 2, 1, 1])[0]
        address = rng.choice([None, "x", "y"]) if kind == "alive" else None
        inc = None if kind == "removed" else rng.choice([rng.randrange(6), rng.randrange(1 + i // 40)])
        data.append((rng.choice("oo0"), i, kind, rng.choice("ppppq"), address, inc, rng.choice("uvw")))
    df = spark.createDataFrame(data, "observer string, seq long, type string, peer_id string, address string, incarnation long, from string")
    members, changed = {}, {}
    for observer, seq, kind, peer, address, inc, via in data:
        key = (observer, peer)
        members[key], did = membership.advance(members.get(key, membership.NOTHING), kind, inc, address, via)
        if did:
            changed[seq] = (kind == "alive", *members[key][:3])
    got = {(r["observer"], r["peer_id"]): tuple(r)[2:] for r in membership.membership(df, per_slice, per_group).collect()}
    assert got == {k: v for k, v in members.items() if v[0]}
    updates = membership.gossip_changes(df, per_slice, per_group)
    assert {r["seq"]: (r["is_new"], r["state"], r["incarnation"], r["address"]) for r in updates.collect()} == changed
    assert "Pandas" not in updates._jdf.queryExecution().toString()


def test_updates_compose_like_the_fold(spark):
    """The pieces of two stretches, composed, do to every entry what the updates do one by one."""
    rng = random.Random(12)
    kinds = ["alive", "alive", "suspect", "dead", "removed"]
    logs = [[(rng.choice(kinds), rng.randrange(4), rng.choice([None, "x"]), rng.choice([None, "v"])) for _ in range(8)] for _ in range(40)]
    logs = [[(k, i, a if k == "alive" else None, v) for k, i, a, v in log] for log in logs]
    df = spark.createDataFrame([(n, log) for n, log in enumerate(logs)], "n int, u array<struct<type:string,incarnation:long,address:string,via:string>>")
    fold = lambda part: f"aggregate({part}, {membership.NO_UPDATE}, (f, u) -> {membership._composed('f', membership._update('u'))})"
    both = df.withColumns({"a": F.expr(membership._merged(fold("slice(u, 1, 4)"))), "b": F.expr(membership._merged(fold("slice(u, 5, 4)")))})
    whole = both.withColumn("p", F.expr(membership._merged(membership._composed("a", "b"))))
    starts = [(s, k, a, "w") for s in range(1, 5) for k in range(-1, 5) for a in (None, "z")] + [(0, 0, None, None)]
    tried = whole.withColumn("e", F.explode(F.array(*map(F.lit, range(len(starts))))))
    entries = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], f"e int, s {membership.ENTRY}")
    for r in tried.join(entries, "e").withColumn("r", F.expr(membership._after("p", "s"))).collect():
        state, k, address, via = starts[r.e]
        member = (membership.STATES[state - 1], k, address, via) if state else membership.NOTHING
        for u in logs[r.n]:
            member, _ = membership.advance(member, *u)
        got = (membership.STATES[r.r.state - 1], r.r.k, r.r.address, r.r.via) if r.r.state else membership.NOTHING
        assert got == member


def test_long_stretches_stay_short_and_do_what_the_updates_do():
    rng = random.Random(13)
    kinds = ["alive", "alive", "suspect", "dead", "removed", "other"]
    for n in (1, 3, 8, 5_000):
        for _ in range(30 if n < 100 else 1):
            log = [(i, rng.choice(kinds), rng.randrange(9), rng.choice([None, "x", "y"]), rng.choice([None, "v"])) for i in range(n)]
            pieces = membership.stretch(log)
            assert len(pieces) < 200
            starts = [(s, k, a, "w") for s in range(1, 5) for k in range(-1, 10) for a in (None, "z")] + [(0, 0, None, None)]
            for state, k, address, via in starts:
                cls = state and 2 * state + (address is not None)
                (found,) = [p for p in pieces if p[0] == cls and p[1] < k <= p[2]]
                _, _, _, s, new_k, put, new_address, new_via, _ = found
                got = (s, k if new_k is None else new_k, new_address if put else address, new_via or via)
                member = (membership.STATES[state - 1], k, address, via) if state else membership.NOTHING
                for _, *u in log:
                    member, _ = membership.advance(member, *u)
                assert got[0] == (membership.STATES.index(member[0]) + 1 if member[0] else 0)
                assert not got[0] or got[1:] == member[1:]


@pytest.mark.parametrize("per_slice", [4, 10**6])
def test_peer_registry_with_handshakes(spark, per_slice):
    rng = random.Random(8)
    data = []
    for i in range(300):
        kind = rng.choice(["connect", "disconnect", "touch", "connecting", "handshake"])
        conn = f"c{i}" if kind == "connecting" else f"c{rng.randrange(i + 1)}"
        peer = None if kind == "connecting" else rng.choice("xxyz")
        if kind == "disconnect" and rng.random() < 0.5:
            peer = None
        data.append((i, i, kind, peer, conn if kind in ("connecting", "handshake") or peer is None else None, f"a{i}", "incoming", f"r{i}"))
    df = spark.createDataFrame(data, "seq long, t long, kind string, peer string, conn_id string, address string, direction string, reason string")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    known, conns = {}, {}
    for i, _, kind, peer, conn, address, direction, reason in data:
        if kind == "connecting":
            conns[conn] = conn
            known[conn] = advance_peer(None, kind, i, i, address, direction, None)
        elif kind == "handshake":
            if conns.get(conn) == conn and conn in known:
                old = known.pop(conn)
                conns[conn] = peer
                known[peer] = advance_peer(None, kind, i, old[2], old[5], old[6], None)
        else:
            key = conns.get(conn, conn) if peer is None else peer
            after = advance_peer(known.get(key), kind, i, i, address, direction, reason)
            if after:
                known[key] = after
    got = peers.peer_registry(peers.resolve_connections(df), per_slice)
    got = got.withColumns({c: F.unix_seconds(c) for c in ("first_seen", "last_seen")})
    mine = {r["peer"]: tuple(r[c] for c in PEER_FIELDS) for r in got.collect()}
    assert mine == known


@pytest.mark.parametrize("per_slice", [1, 3, 10**6])
def test_copies_are_paired_in_path_order(spark, per_slice):
    files = spark.createDataFrame([(f"n{i:02d}", "same" if i < 20 else str(i)) for i in range(25)], "path string, content string")
    index = spark.createDataFrame([(f"o{i:02d}", "same" if i < 13 else str(i)) for i in range(30)], "path string, content string")
    report = reconcile.reconcile(files, index, per_slice).collect()
    moved = {r["path"]: r["moved_from"] for r in report if r["action"] == "moved"}
    assert moved == {f"n{i:02d}": f"o{i:02d}" for i in [*range(13), *range(20, 25)]}
    assert sum(r["action"] == "indexed" for r in report) == 7 and sum(r["action"] == "orphaned" for r in report) == 12


@pytest.mark.parametrize("per_slice", [1, 2, 10**6])
@pytest.mark.parametrize("place", [lambda i: i, lambda i: i * 1_000_003 - 5 * 10**9, lambda i: -i - 1])
def test_slices_do_not_depend_on_the_numbers(spark, per_slice, place):
    seqs = sorted(place(i) for i in range(40))
    data = [(key, seq, i % 5) for key in ("a", None) for i, seq in enumerate(seqs)] + [("b", 7, 1)]
    df = spark.createDataFrame(data, "k string, seq long, v long").repartition(3)
    sliced = scale.with_slices(df, ["k"], "seq", per_slice)
    assert max(r["count"] for r in sliced.groupBy("k", "_slice").count().collect()) <= per_slice
    out = scale.running_sum(sliced, ["k"], "seq", F.col("v"), "total")
    out = scale.previous_row(out, ["k"], "seq", ["v"])
    out = scale.carried_value(out, ["k"], "seq", F.when(F.col("v") == 0, F.col("seq")), "zero")
    out = scale.carried_value(out, ["k"], "seq", F.when(F.col("v") == 0, F.col("seq")), "earlier", before=True)
    want = [("b", 7, 1, None, None, None)]
    for key in ("a", None):
        total, last, zero = 0, None, None
        for i, seq in enumerate(seqs):
            earlier, zero, total = zero, (seq if i % 5 == 0 else zero), total + i % 5
            want.append((key, seq, total, last, zero, earlier))
            last = i % 5
    got = [(r["k"], r["seq"], r["total"], r["prev"] and r["prev"]["v"], r["zero"], r["earlier"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_modified_without_mtime_leaves_what_is_known(spark):
    data = [(1, "Modified", 5), (2, "Modified", None), (3, "Modified", 5), (4, "Created", None), (5, "Modified", 5), (6, "Deleted", None), (7, "Modified", 5)]
    events = spark.createDataFrame([(s, "a", k, m) for s, k, m in data], "seq long, path string, kind string, mtime long")
    for per_slice in (1, 10**6):
        assert sorted(r["seq"] for r in changes.dedupe_mtime(events, per_slice).collect()) == [1, 2, 4, 6, 7]


@pytest.mark.parametrize("per_slice", [1, 10**6])
def test_large_incarnations_beside_a_removal(spark, per_slice):
    big = 2**53 + 1
    data = [(1, "alive", big), (2, "removed", None), (3, "dead", big)]
    gossip = spark.createDataFrame(
        [("o", s, k, "p", None, i, "v") for s, k, i in data],
        "observer string, seq long, type string, peer_id string, address string, incarnation long, from string",
    )
    assert [(r["state"], r["incarnation"]) for r in membership.membership(gossip, per_slice).collect()] == [("Dead", big)]


def test_query_for_a_note_without_a_vector(spark):
    notes = make_notes(spark, {"A.md": "x"})
    queries = spark.createDataFrame([(1, "[[A]]", [1.0, 2.0])], "query_id long, query string, text_vector array<double>")
    none = spark.createDataFrame([], "path string, vector array<double>")
    assert [tuple(r["vector"]) for r in search.query_vectors(queries, notes, none).collect()] == [(1.0, 2.0)]


def test_reconcile_ignores_key_order_and_line_ends(spark):
    files = spark.createDataFrame([("a", "---\nx: 1\ny: 2\n---\n\nbody"), ("b", "t\r\nu"), ("c", "new")], "path string, content string")
    index = spark.createDataFrame([("a", "---\ny: 2\nx: 1\n---\nbody"), ("b", "t\nu"), ("c", "old")], "path string, content string")
    assert rows(reconcile.reconcile(files, index)) == [("a", "unchanged", None), ("b", "unchanged", None), ("c", "reindexed", None)]


def test_log_round(spark):
    lines = ["## 2025-W48-1 (Mon)", "", "- 9:30 AM – a", "- odd", "- 2:00 PM – b", "", "### note", "- 3:00 PM – lost"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "log_id int, line_no long, line string")
    for per_slice in (2, 10**6):
        got = journal.parse_log(df, per_slice)
        assert [(r["minute"], r["text"]) for r in got.orderBy("line_no").collect()] == [(570, "a"), (None, "odd"), (840, "b")]
    new = spark.createDataFrame([(1, "2025-11-24 10:00:00", "- mid"), (2, "2025-11-24 15:00:00", "late")], "seq long, ts string, text string")
    merged = journal.append_log(journal.parse_log(df), new.withColumn("ts", F.to_timestamp("ts")))
    order = [r["line"] for r in merged.orderBy("day", "at_line", "is_old", "minute", "seq").collect()]
    assert order == ["- 9:30 AM – a", "- odd", "- 10:00 AM – mid", "- 2:00 PM – b", "- 3:00 PM – late"]


def test_edits_and_writes(spark):
    notes = make_notes(spark, {"a.md": "one two two", "b.md": "x"})
    hashes = {r["path"]: r["h"] for r in notes.select("path", F.sha2("content", 256).alias("h")).collect()}
    schema = "path string, content_hash string, edits array<struct<old string, new string>>"
    ask = lambda path, steps: edits.apply_edits(notes, spark.createDataFrame([(path, hashes.get(path, "h"), steps)], schema)).first()
    assert ask("a.md", [("one", "1"), ("1 two", "2")])["content"] == "2 two"
    assert ask("a.md", [("two", "2")])["error"] == "text appears 2 times"
    assert ask("a.md", [("", "2")])["error"] == "text appears 12 times"
    assert ask("a.md", [("no", "2")])["error"] == "text not found"
    assert ask("c.md", [])["error"] == "note not found"
    writes = spark.createDataFrame(
        [(1, "a.md", "A", hashes["a.md"]), (2, "a.md", "B", hashes["a.md"]), (3, "n.md", "N", None), (4, "b.md", "Y", None)],
        "seq long, path string, content string, content_hash string",
    )
    guarded = edits.guard_writes(notes, writes)
    assert [r["action"] for r in guarded.orderBy("seq").collect()] == ["update", None, "create", None]
    assert rows(edits.apply_writes(notes, guarded)) == [("a.md", "A"), ("b.md", "x"), ("n.md", "N")]


def test_move_rewrites_plain_links_only(spark):
    notes = make_notes(spark, {"A.md": "to [[B]] and [[B|alias]] ![[B]]", "B.md": "self [[B]]", "C.md": "[[x/B]]"})
    moves = spark.createDataFrame([(1, "B.md", "k/D.md")], "seq long, src string, dst string")
    assert rows(edits.rewrite_links(notes, links.note_links(notes), moves)) == [("A.md", "to [[D]] and [[B|alias]] ![[D]]")]


def test_suggestions_match_substrings(spark):
    names = [("projects/Web Shop.md", "Web Shop", "shop"), ("projects/x.md", "x", None), ("projects/Long.md", "Long", "a-long-slug")]
    project_df = spark.createDataFrame(names, "path string, name string, slug string")
    dirs = [(i, 0, d) for i, d in enumerate(["shop-api", "web", "zzz", "", "my-a-long-slug-x"])]
    dir_df = spark.createDataFrame(dirs, "session int, depth int, dir_name string")
    none = spark.createDataFrame([], "session int")
    want = set()
    for session, _, d in dirs:
        for _, name, slug in names:
            labels = [name.lower()] + ([slug] if slug else [])
            if any(d in label or label in d for label in labels):
                want.add((session, name))
    assert {(r["session"], r["name"]) for r in projects.suggest_projects(project_df, dir_df, none).collect()} == want


def test_files_round_trip(spark, tmp_path):
    for name, text in {"a b+c.md": "x", "k/N.v1.md": "y", ".git/h.md": "no", "k/.hid.md": "no", "t.txt": "no"}.items():
        target = tmp_path / "vault" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    notes = read_notes(spark, str(tmp_path / "vault"))
    assert rows(notes.select("path", "name", "folder", "content")) == [("a b+c.md", "a b+c", "", "x"), ("k/N.v1.md", "N.v1", "k", "y")]
    publish(notes, str(tmp_path / "out"), 1)
    assert rows(list_notes(read_version(spark, str(tmp_path / "out"), 1), "k/")) == [("k/N.v1.md", "k/N.v1")]
    with pytest.raises(Exception, match="exists"):
        publish(notes, str(tmp_path / "out"), 1)


def test_readers_follow_the_committed_version(spark, tmp_path):
    place = str(tmp_path / "notes")
    with pytest.raises(FileNotFoundError):
        read_version(spark, place)
    frame = lambda text: spark.createDataFrame([("a.md", text)], "path string, content string")
    assert publish(frame("one"), place) == 1
    frame("half").write.parquet(f"{place}/data/attempt")  # a writer that died before its commit
    (tmp_path / "notes" / "versions" / f"{7:012d}").write_text("cut o")  # and one that died in it
    assert rows(read_version(spark, place)) == [("a.md", "one")]
    assert publish(frame("two"), place) == 2
    assert sweep_attempts(spark, place) == 0 and sweep_attempts(spark, place, 0.0) == 1
    assert rows(read_version(spark, place)) == [("a.md", "two")] and rows(read_version(spark, place, 1)) == [("a.md", "one")]


def test_blank_reason_is_refused(spark):
    with pytest.raises(ValueError):
        journal.private_inventory(make_notes(spark, {"private/a.md": ""}), "  ")


def test_rank_in_group_is_dense(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("k"), F.format_string("p%03d", "id").alias("p"))
    got = scale.rank_in_group(df, ["k"], "p", "n", 4).groupBy("k").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
    assert all(r["n"] == list(range(1, 26)) for r in got)


def test_containing_pairs_by_trigrams(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcß ", k=n))
    longs = {text(rng.randint(0, 14)) for _ in range(150)} | {text(10_000), "aa", ""}
    shorts = {text(rng.randint(0, 5)) for _ in range(150)} | {"", "zzz", "abz", *(x[3:9] for x in list(longs)[:20])}
    got = projects.containing_pairs(
        spark.createDataFrame([(x,) for x in longs], "long string"), spark.createDataFrame([(x,) for x in shorts], "short string")
    )
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for x in longs for y in shorts if y in x)


def test_step_tables_are_deleted(spark):
    kept, gone = scale.cut_lineage(spark.range(5), "kept"), scale.cut_lineage(spark.range(7), "gone")
    empty = scale.cut_lineage(spark.range(0), "none")
    scale.drop_steps(gone, empty)
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|FileNotFound|FAILED_READ"):
        gone.collect()
    with pytest.raises(ValueError):
        scale.drop_steps(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def follow(name, renames, moved=None):
    """What a link to ``name`` reads after renames (old, new) in order; ``moved`` is left out at the start."""
    started = False
    for i, (old, new) in enumerate(renames):
        if old == name and (started or i != moved):
            name, started = new, True
    return name


@pytest.mark.parametrize("chain", [7, 33])
def test_renames_in_chains(spark, chain):
    rng = random.Random(chain)
    names = [f"n{i}" for i in range(6)]
    moves = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [(f"c{i}", f"c{i + 1}") for i in range(chain)]
    named = [(i, old, new) for i, (old, new) in enumerate(moves) if old != new]
    df = spark.createDataFrame(named, "seq long, old_name string, new_name string")
    got = {r.seq: r.last_name for r in edits.final_names(df).collect()}
    assert got == {i: follow(new, [m for m in moves[i + 1 :]]) for i, _, new in named}
    assert got[40] == f"c{chain}"


def test_links_follow_renames_at_once(spark):
    notes = make_notes(spark, {"A.md": "[[B]] [[C]] [[B|x]] [[D]]", "x/B.md": "[[B]] [[C]]", "y/C.md": "own [[C]]", "E.md": "[[D]] [[E]]"})
    rows = [(1, "y/C.md", "y/D.md"), (2, "x/B.md", "x/C.md"), (3, "q/D.md", "q/B.md"), (4, "E.md", "k/E.md"), (5, "z/C.md", "z/F.md")]
    moves = spark.createDataFrame(rows, "seq long, src string, dst string")
    got = dict(map(tuple, edits.rewrite_links(notes, links.note_links(notes), moves).collect()))
    # C -> D (1) -> B (3); B -> C (2) -> F (5); D -> B (3).
    assert got["A.md"] == "[[F]] [[B]] [[B|x]] [[B]]" and got["E.md"] == "[[B]] [[E]]"
    assert got["x/B.md"] == "[[B]] [[B]]" and got["y/C.md"] == "own [[F]]"


def plain_insert(lines, entries):
    """One entry after another into a file, days that are there first."""
    from datetime import datetime

    lines = list(lines)
    iso = lambda t: "{0}-W{1:02d}-{2}".format(*datetime.fromisoformat(t).isocalendar())
    header = lambda t: f"## {iso(t)} ({datetime.fromisoformat(t):%a})"
    known = {h for h in lines if h.startswith("## ")}

    def minute(line):
        m = re.fullmatch(r"- (\d+):(\d+) (AM|PM) – .*", line)
        return (int(m[1]) % 12 + 12 * (m[3] == "PM")) * 60 + int(m[2]) if m else None

    for t, _, text in sorted(entries, key=lambda e: (header(e[0]) not in known, e[1])):
        at = datetime.fromisoformat(t)
        entry = f"- {at.hour % 12 or 12}:{at.minute:02d} {'PM' if at.hour > 11 else 'AM'} – {text}"
        if header(t) not in lines:
            lines += [""] * bool(lines) + [header(t), "", entry, ""]
            continue
        start = lines.index(header(t)) + 1
        while start < len(lines) and not lines[start].strip():
            start += 1
        place, i = start, start
        while i < len(lines) and not lines[i].startswith("##"):
            if lines[i].startswith("-"):
                m = minute(lines[i])
                if m is not None and m > at.hour * 60 + at.minute:
                    place = i
                    break
                place = i + 1
            i += 1
        lines.insert(place, entry)
    return lines


@pytest.mark.parametrize("per_slice", [3, 10**6])
def test_entries_put_into_files_out_of_day_order(spark, per_slice):
    rng = random.Random(14)
    days = ["2024-01-03", "2024-01-01", "2024-01-04", "2024-01-02", "2024-01-05", "2024-01-06"]
    heads = ["## 2024-W01-3 (Wed)", "## 2024-W01-1 (Mon)", "## 2024-W01-4 (Thu)", "## 2024-W01-2 (Tue)"]
    files = {1: [], 2: ["text"], 3: []}
    for i, head in enumerate([*heads, heads[0]]):
        files[3] += [head, "", *[""] * (i % 2)]
        for _ in range((0, 3, 5, 2, 1)[i]):
            h = rng.randrange(24)
            files[3].append(rng.choice([f"- {h % 12 or 12}:{rng.randrange(60):02d} {'PM' if h > 11 else 'AM'} – old", "- untimed", "note", "  "]))
        files[3] += ["### part", "- not in the section"] if i == 2 else [""]
    entries = {log: [(f"{rng.choice(days)} {rng.randrange(24):02d}:{rng.choice([0, 30]):02d}:00", 10 * log + i, f"new {i}") for i in range(14)] for log in files}
    lines = spark.createDataFrame([(log, 2 * i + 5, x) for log, own in files.items() for i, x in enumerate(own)], "log_id long, line_no long, line string")
    new = spark.createDataFrame([(log, *e) for log, own in entries.items() for e in own], "log_id long, ts string, seq long, text string").withColumn("ts", F.to_timestamp("ts"))
    got = {}
    for r in journal.insert_into_log(lines, new, per_slice).orderBy("log_id", "line_no").collect():
        got.setdefault(r.log_id, []).append((r.line_no, r.line))
    for log, own in files.items():
        want = plain_insert(own, entries[log])
        assert got[log] == list(enumerate(want, 1)), log


def test_pairs_of_projects_and_directories_are_not_shuffled(spark):
    project_schema = "path string, name string, slug string, remotes array<string>, old_remotes array<string>, old_slugs array<string>"
    project_df = spark.createDataFrame(
        [
            ("projects/a.md", "a", "S", ["x.com/u/r", "x.com/u/q"], ["x.com/u/o"], ["t"]),
            ("projects/b.md", "b", None, ["x.com/u/q"], ["x.com/u/r"], ["s"]),
        ],
        project_schema,
    )
    dir_schema = "session int, depth int, dir_name string, git_remotes array<string>"
    dir_rows = [(1, 0, "s", ["git@x.com:u/Q.git", "x.com/u/r"]), (2, 0, "T", ["x.com/u/o"]), (2, 0, "T", ["x.com/u/o"]), (None, 0, "s", ["x.com/u/q"]), (3, 0, "w", None)]
    dir_df = spark.createDataFrame(dir_rows, dir_schema)
    found = projects.match_projects(project_df, dir_df)
    got = sorted((str(r.session), r.name, r.match_type, r.matched_on, r.matched_value) for r in found.collect())
    assert got == [
        ("1", "a", "strict", "remote", "x.com/u/r"), ("1", "b", "strict", "remote", "x.com/u/q"), ("2", "a", "loose", "old_remote", "x.com/u/o"),
        ("None", "a", "strict", "remote", "x.com/u/q"), ("None", "b", "loose", "old_slug", "s"), ("None", "b", "strict", "remote", "x.com/u/q"),
    ]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(found) and "LeftAnti" not in plan(found)
    named = spark.createDataFrame([("p.md", "ab", "b")], "path string, name string, slug string")
    asked = spark.createDataFrame([(1, 0, "xabx"), (1, 0, "b")], "session int, depth int, dir_name string")
    similar = projects.suggest_projects(named, asked, spark.createDataFrame([], "session int"))
    assert [tuple(r) for r in similar.collect()] == [(1, "p.md", "ab")]
    assert not plan(similar).startswith(("Aggregate", "Distinct"))


def test_messages_go_through_the_matches_once_for_the_outcomes(spark):
    project_schema = "path string, name string, slug string, remotes array<string>, old_remotes array<string>, old_slugs array<string>"
    project_rows = [("projects/a.md", "a", "s", ["x.com/u/r"], ["x.com/u/o"], []), ("projects/wx.md", "wx", None, None, None, None)]
    project_df = spark.createDataFrame(project_rows, project_schema)
    dir_rows = [(1, 0, "s", []), (2, 0, "d", ["x.com/u/o"]), (3, 0, "w", ["x.com/u/n"]), (4, 0, "q", [])]
    dir_df = spark.createDataFrame(dir_rows, "session int, depth int, dir_name string, git_remotes array<string>")
    matches = projects.match_projects(project_df, dir_df)
    similar = projects.suggest_projects(project_df, dir_df, matches)
    messages = projects.discovery_messages(dir_df, project_df, matches, similar)
    got = {}
    for r in messages.orderBy("session", "part", "line").collect():
        got.setdefault(r.session, []).append(r.line)
    assert got[1] == ["Projects auto-loaded:", "[[a]]"]
    assert got[2][:4] == ["**Project disconnect detected**", "Found [[a]] via old_remote match.", "Current: x.com/u/o", "Expected: x.com/u/r"]
    assert got[3] == ["**No project found**", "Dir: w", "Remote: x.com/u/n", "- [[wx]]", "Existing project or new?"]
    assert got[4] == ["**No project found**", "Dir: q", "Remote: none", "Create project note with appropriate frontmatter."]
    # Lines of strict matches, and the first loose match: once each; the outcomes are read from a step.
    plan = messages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 4, plan.count("Aggregate")
