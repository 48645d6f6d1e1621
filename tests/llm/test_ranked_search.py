"""Ranked search over two trees against scores of all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_helpers import prose

from inkweave.llm import ranked_search as module
from inkweave.llm.queries import ORACLES, QUERIES
from inkweave.llm.ranked_search import Best, Found, Sparse, Tree, _search, ranked_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    counts = [(doc, c) for doc, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        rows = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1_000 * c[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **kw):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search(docs, items, **kw).collect()), key=str)


ITEMS = [(1, "One two THREE four"), (2, "dcafe é, ü-ß"), (3, None), (4, " .. "), (None, "a b c d d d"), (5, "nowhere-found"), (1, "spam")]


def test_messy_rows(spark, messy, messy_rows):
    items = [*ITEMS, (6, " ".join(prose(120, 1).split()[:20])), ITEMS[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, doc_id string, score int")
    want = brute([r[:2] for r in messy_rows], items)
    assert want and found(messy, df) == want
    assert found(messy, df, k=2) == brute([r[:2] for r in messy_rows], items, 2)


def test_empty_tables(spark, messy, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(empty, items) == []
    assert found(messy, items.limit(0)) == []


@pytest.mark.parametrize("per_block", [1 << 20, 60])
def test_many_items_in_small_trees(spark, monkeypatch, per_block):
    """More than one block, nodes of few rows, many equal scores."""
    monkeypatch.setattr(module, "TERMS_PER_BLOCK", per_block)
    monkeypatch.setattr(module, "ITEMS_PER_BLOCK", min(per_block, 1024) // 4)
    monkeypatch.setattr(module, "DOC_LEVELS", (24, 8, 2, 1))
    monkeypatch.setattr(module, "ITEM_LEVELS", (12, 4, 2, 1))
    rng = random.Random(4)
    pool = prose(60, 9).split()
    docs = [(rng.randrange(200), " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 6)))) for i in range(40)]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert found(a, b, k=5) == brute(docs, items, 5)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = sorted(con.execute(ORACLES["op11_dual_tree"]).fetchall())
    got = QUERIES["op11_dual_tree"](spark, SF)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(module, "ENTRIES_AT_ONCE", 5_000)
    rng = np.random.default_rng(7)
    row, column = np.repeat(np.arange(4_096), 20), rng.integers(0, 3_000, 4_096 * 20)
    column = (row // 64 * 40 + column % 60) % 3_000  # neighbours share terms
    row, column = np.unique(np.stack([row, column]), axis=1)
    docs = Tree(Sparse(row, column, rng.integers(1, 1_000, len(row)), 3_000, 4_096), module.DOC_LEVELS)
    row, column = np.unique(np.stack([np.repeat(np.arange(40), 10), rng.integers(0, 3_000, 400)]), axis=1)
    items = Tree(Sparse(row, column, rng.integers(1, 1_000, len(row)), 3_000, 40), module.ITEM_LEVELS)
    i, d = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(4_096), indexing="ij"))
    exact = items[-1].products(docs[-1], i, d)
    for level in range(3):
        up = items[level].products(docs[level], i // module.ITEM_LEVELS[level], d // module.DOC_LEVELS[level])
        assert (up >= exact).all()
    scores = exact.reshape(40, -1)
    floor = np.sort(scores, axis=1)[:, -10].astype(np.int64)
    best = Best(floor, 10)
    none = np.zeros(4_096, np.int64)
    pairs = _search(items, docs, Found(none, none, np.arange(4_096), none.astype(bool), none), best)
    assert pairs < 0.6 * len(i)
    item, score = best.found.columns[:2]
    for k in range(40):
        assert sorted(score[item == k].tolist()) == sorted(x for x in np.sort(scores[k])[-10:].tolist() if x > 0)
