"""The n-gram join against all pairs, and its bounds."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import prose, steps_since, words

from inkweave.llm import graph, ngram_join
from inkweave.llm.ngram_join import Bands, ngram_jaccard_classes, one_of_each_class, part_keys, shingle_sets
from inkweave.llm.recurrent import Network, lexicon
from inkweave.llm.words import slices


def grams(text, n):
    w = words(text, fold=True)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(groups.get(find(i), doc), doc)
    return sorted(
        ((doc, len(s), groups.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str
    )


def found(df, **kw):
    return sorted(((r.id, r.n_shingles, r.component) for r in ngram_jaccard_classes(df, **kw).collect()), key=str)


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_messy_rows(messy, messy_rows, n, num):
    assert found(messy, n=n, num=num) == brute([r[:2] for r in messy_rows], n, num, 100)


def test_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents, n=4, num=85) == brute(rows, 4, 85, 100)


def test_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "CROWDED", 10)
    monkeypatch.setattr(ngram_join, "MAX_SENT", 3)
    rng, base, rows = random.Random(2), prose(90, 11).split(), []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(90)] = prose(1, rng.random())
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, n=4, num=85) == brute(rows, 4, 85, 100)


def test_hot_groups_of_short_texts(spark, monkeypatch):
    """Blank parts that are not sent and crowded keys that are dropped must not add up to more than the spare parts."""
    monkeypatch.setattr(ngram_join, "CROWDED", 12)
    rows = []
    for length in range(10, 24):
        for number in range(4):
            base = prose(length, 1_000 * length + number)
            rows += [(len(rows) + i, f"{base} {prose(1, 31 * i + number)}{i}") for i in range(24)]
            rows.append((len(rows), base))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, n=4, num=85) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("sent", [3, 500_000])
def test_near_copies_without_ids(spark, monkeypatch, sent):
    """Texts that only rows without an id have are linked, and link others."""
    monkeypatch.setattr(ngram_join, "MAX_SENT", sent)
    base, rows = prose(120, 21).split(), []
    for i in range(0, 16, 4):  # a chain in which only neighbours link
        text = " ".join([f"w{j}" for j in range(i)] + base[i:])
        rows += [(None, text)] * 3 if i in (4, 8) else [(50 - i, text)]
    lone = prose(60, 22).split()
    rows += [(None, " ".join(lone)), (None, " ".join([*lone, "more"])), (1, prose(60, 23)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 4, 85, 100)
    assert (50, 117, 38) in want
    got = ngram_jaccard_classes(df, n=4, num=85).collect()
    assert sorted(((r.id, r.n_shingles, r.component) for r in got), key=str) == want
    assert len({r.cls for r in got if r.component == 38}) == 4


def test_empty_table(empty):
    assert found(empty) == []


def test_linked_sets_always_share_a_key():
    rng, bands = np.random.default_rng(4), Bands(85, 100)
    for size in [7, 8, 9, 13, 14, 20, 47, 150, 700]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = 15 * 2 * len(a) // 185
            gone = rng.integers(0, most + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, most - gone + 1)), dtype=np.uint64)]))
            union = len(np.union1d(a, b))
            if 100 * len(np.intersect1d(a, b)) < 85 * union or np.array_equal(a, b):
                continue
            keys = [
                set(np.concatenate([part_keys(x, np.array([0, len(x)]), bands, up)[0] for up in (0, 1)]).tolist()) for x in (a, b)
            ]
            assert keys[0] & keys[1]


def test_one_of_each(messy, messy_rows):
    kept = one_of_each_class(messy, ngram_jaccard_classes(messy))
    assert kept.columns == messy.columns
    classes = brute([r[:2] for r in messy_rows], 5, 80, 100)
    groups = {c for _, n, c in classes if n and c is not None}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    full = [r for r in got if words(r[1])]
    assert sorted(i for i, _ in full) == sorted(groups)
    blank = [r for r in messy_rows if not words(r[1])]
    assert len([r for r in got if not words(r[1])]) == len(blank)
    again = ngram_jaccard_classes(kept)
    assert again.filter("n_shingles > 0 and id <> component").count() == 0


def test_components_of_links_that_are_stars_take_one_step(spark, monkeypatch):
    """Nothing is gone through again where every node already hangs on the smallest of its component."""
    steps = []
    write = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, label: steps.append(label) or write(df, label))
    stars = spark.createDataFrame([(i % 5, i) for i in range(5, 40)] + [(39, 4), (3, 3), (None, 7)], "a long, b long")
    assert sorted(map(tuple, graph.components(stars).collect())) == [(i, i % 5) for i in range(40)]
    assert len(steps) == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert sorted(map(tuple, graph.components(chain).collect())) == [(i, 0) for i in range(31)]


def test_only_steps_that_are_still_read_stay(spark, messy, messy_rows):
    with steps_since(spark) as steps:
        found = ngram_jaccard_classes(messy)
    assert sorted(steps) == ["classes", "members", "stars"]
    got = sorted(((r.id, r.n_shingles, r.component) for r in found.collect()), key=str)
    assert got == sorted(brute([r[:2] for r in messy_rows], 5, 80, 100), key=str)


def test_arrays_of_a_task_stay_small():
    """Workers stay alive and keep memory, so what a task takes besides its batch is bounded."""
    texts = pa.array([" ".join(f"w{i * 7919 % 10007}x{j}" for i in range(1000)) for j in range(400)])
    bands = Bands(80, 100)
    tracemalloc.start()
    try:
        for part in slices(texts, getattr(ngram_join, "SLICE", 4 << 20)):
            part_keys(*shingle_sets(part, 5), bands, 0)
        assert tracemalloc.get_traced_memory()[1] < 60e6
        found, _ = lexicon(next(slices(texts, 2 << 20)))
        net, before = Network(1), tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        vectors = net.vectors(found)
        assert tracemalloc.get_traced_memory()[1] - before < 50e6
    finally:
        tracemalloc.stop()
    some = np.add.reduceat(net.p["trigrams"][found.trigrams], found.first[:-1], axis=0)
    assert (vectors[:, -some.shape[1] :] == some / np.diff(found.first).astype(np.float32)[:, None]).all()


def test_hashes_of_spans_far_into_a_slice():
    (part,) = slices(pa.array(["é ab" + " x" * 200_000 + " ab é", "ab"]), 1 << 30)
    hashes = part.word_hashes()
    assert hashes[0] == hashes[-2] and hashes[1] == hashes[-3] == hashes[-1] and len(set(hashes.tolist())) == 3
