"""Mixing, training order, toxicity and the pipeline."""

from __future__ import annotations

import collections
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import prose, steps_since, words

import corpus_pipeline
from inkweave.llm import queries
from inkweave.llm.mixing import mix_sources, pivotal_rounding, source_targets, take_mix
from inkweave.llm.recurrent import Network, window_starts, without_edges
from inkweave.llm.tokens import DEFAULT_VOCABULARY, Tokenizer, encoding, end_token
from inkweave.llm.toxicity import LENGTH, STRIDE, ToxicityModel, fit_toxicity, score_toxicity, without_toxic
from inkweave.llm.training_order import permuted, read_slots, write_training_order
from inkweave.llm.words import slices

SF = "/root/testdata/sf0.001"


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not full:
            return want | {s: weight[s] * level for s in open_}
        want |= {s: cap * sizes[s] for s in full}
        left -= sum(want[s] for s in full)
        open_ -= full
    return want


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 500, None: 70}, {"é": 5, "z": 5, "Z": 5, "": 0}, {"x": 0}, {"a": 9, "b": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_mix_of_whole_table(spark, documents):
    got = mix_sources(documents).collect()
    assert sorted((r.id, r.size) for r in got) == sorted((r.doc_id, len(words(r.text))) for r in documents.collect())
    by = collections.defaultdict(list)
    for r in got:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        by[r.source].append(r)
    want = targets({s: sum(r.size for r in rows) for s, rows in by.items()})
    for source, rows in by.items():
        assert rows[0].target == pytest.approx(want[source])
        # Rounding by falling size: the rest is less than the largest document.
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    again = mix_sources(documents.repartition(7)).collect()
    assert sorted(r[:] for r in again) == sorted(r[:] for r in got)


def test_rounding_keeps_sums(spark):
    rows = [(i % 3, i, 1 + i % 50, 0.3 + 0.1 * (i % 3)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g int, i int, size long, p double")
    got = pivotal_rounding(df, "g", ["i", "size", "p"]).collect()
    assert len(got) == 3_000
    for g in range(3):
        own = [r for r in got if r.g == g]
        assert abs(sum(r["take"] for r in own) - sum(r.p for r in own)) < 1
        assert sum(r["take"] * r["size"] for r in own) == pytest.approx(sum(r.p * r["size"] for r in own), rel=0.01)


def test_rounding_is_fair(spark):
    df = spark.createDataFrame([(0, i, 10, p) for i, p in enumerate((0.2, 0.5, 0.7, 0.6))], "g int, i int, size long, p double")
    taken = collections.Counter()
    for seed in range(40):
        taken.update(r.i for r in pivotal_rounding(df, "g", ["i"], seed=seed).collect() if r["take"])
    assert sum(taken.values()) == 80 and all(abs(taken[i] / 40 - p) < 0.3 for i, p in enumerate((0.2, 0.5, 0.7, 0.6)))


def test_taken_rows(messy, messy_rows, empty):
    mix = mix_sources(messy)
    taken = take_mix(messy, mix)
    assert taken.columns == messy.columns
    assert taken.count() == sum(r.copies for r in mix.collect()) and mix.count() == len(messy_rows)
    count = collections.Counter((r.doc_id, r.text) for r in taken.collect())
    there = collections.Counter(r[:2] for r in messy_rows)
    assert all(n <= 2 * there[k] for k, n in count.items())
    assert take_mix(empty, mix_sources(empty)).count() == 0


def test_permutation():
    for n in (1, 2, 3, 10, 1_000, 4_097):
        assert sorted(permuted(np.arange(n), n, 5)) == list(range(n))
    assert not np.array_equal(permuted(np.arange(100), 100, 1), permuted(np.arange(100), 100, 2))


def test_tokens_are_those_of_whole_texts(documents):
    plain = encoding(DEFAULT_VOCABULARY)
    odd = ["", " ", "a  b\n\n c\t d", "x  y  ", "  lead", "é　z  q", "don't I'll\r\n\r\nok ", None, "\x1c a\x1db", "a  b"]
    texts = odd + [r.text for r in documents.limit(50).collect()]
    import pyarrow as pa

    tokenizer = Tokenizer(DEFAULT_VOCABULARY)
    got = [ids.tolist() for part in slices(pa.array(texts), 1 << 16) for ids in tokenizer.encode(part)]
    assert got == [plain.encode_ordinary(t or "") for t in texts]


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_training_order_round_trip(request, which):
    df, folder = request.getfixturevalue(which), tempfile.mkdtemp()
    rows = write_training_order(df, folder, length=64, per_shard=10).collect()
    stored = list(read_slots(folder))
    assert sorted(r.slot for r in rows) == list(range(len(stored)))
    plain, end = encoding(DEFAULT_VOCABULARY), end_token(DEFAULT_VOCABULARY)
    in_order = sorted(rows, key=lambda r: r.sequence)
    flat = np.concatenate([stored[r.slot] for r in in_order])[: sum(r.n_tokens for r in rows)]
    docs = [tuple(x) for x in np.split(flat, np.flatnonzero(flat == end) + 1) if len(x)]
    want = collections.Counter((*plain.encode_ordinary(r.text or ""), end) for r in df.collect())
    assert collections.Counter(docs) == want
    for r in rows:
        assert zlib.crc32(stored[r.slot].tobytes()) == r.crc32
        assert (r.shard, r.byte_offset) == (r.slot // 10, r.slot % 10 * 128)
    assert np.array_equal(next(read_slots(folder, 3, 1)), stored[3])


def test_training_order_keeps_no_second_copy_of_the_ids(spark, messy):
    folder = tempfile.mkdtemp()
    with steps_since(spark) as steps:
        rows = write_training_order(messy, folder, length=64)
    assert steps == ["sequences"] and rows.count() == len(list(read_slots(folder)))


def test_training_order_of_nothing(empty):
    folder = tempfile.mkdtemp()
    assert write_training_order(empty, folder).count() == 0 and list(read_slots(folder)) == []


def test_windows_cover_all_words():
    for n in range(200):
        starts = window_starts(n, 32, 24)
        assert {w for s in starts for w in range(s, min(s + 32, n))} == set(range(n))


def test_gradients_by_differences():
    import pyarrow as pa

    from inkweave.llm.recurrent import lexicon

    part = next(slices(pa.array(["one two three four", "two five"]), 1 << 20))
    words_, which = lexicon(part)
    net = Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = np.array([which[:4], [*which[4:], 0, 0]])
    mask = np.array([[True] * 4, [True, True, False, False]])
    target, weight = np.array([1.0, 0.0]), np.array([1.0, 1.0])
    grads, _ = net.gradients(words_, ids, mask, target, weight)

    def loss():
        logit = net.logits(net.gates(words_), ids, mask)
        return float((np.log1p(np.exp(logit)) - target * logit).sum())

    rng = np.random.default_rng(1)
    for name, g in grads.items():
        spots = np.argwhere(np.abs(g) > 1e-3)
        for spot in map(tuple, spots[rng.permutation(len(spots))[:3]]):
            old = net.p[name][spot]
            net.p[name][spot] = old + 1e-2
            up = loss()
            net.p[name][spot] = old - 1e-2
            slope = (up - loss()) / 2e-2
            net.p[name][spot] = old
            assert g[spot] == pytest.approx(slope, rel=0.08, abs=2e-3), name


def test_toxicity_of_held_out_documents(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(700):
        text = prose(int(rng.integers(5, 150)), i).split()
        toxic = i % 3 == 0
        if toxic:
            for at in range(int(rng.integers(min(25, len(text)))), len(text), 25):
                text[at] = f"Vile{prose(1, i + at)},"
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    for seed in (205, 5):
        model = fit_toxicity(docs, labels, seed=seed)
        score = {r.id: r.score for r in score_toxicity(docs, model).collect()}
        right = sum((score[r[0]] >= 0.5) == r[2] for r in held)
        assert right >= 0.92 * len(held), (seed, right)
    # A text has the score of its worst window, each window scored as a text of its own.
    some = [r for r in rows if r[0] % 50 == 0]
    cut = [(r[0], " ".join(r[1].split()[a : a + LENGTH])) for r in some for a in window_starts(len(r[1].split()), LENGTH, STRIDE)]
    each = {}
    for r in score_toxicity(spark.createDataFrame(cut, "doc_id long, text string"), model).collect():
        each[r.id] = max(each.get(r.id, 0.0), r.score)
    assert len(cut) > len(some) and each == pytest.approx({r[0]: score[r[0]] for r in some}, abs=1e-5)
    kept = {r.doc_id for r in without_toxic(docs, model).collect()}
    assert kept == {i for i, s in score.items() if s < 0.5}
    odd = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x", "c"), (None, "x", "c")], "doc_id long, text string, _toxicity string")
    assert sorted((r.id or 0, r.score) for r in score_toxicity(odd, model).collect())[2:] == [(1, 0.0), (1, 0.0)]
    assert without_toxic(odd, model).columns == odd.columns and without_toxic(odd.limit(0), model).count() == 0


def test_words_without_outer_punctuation():
    text = "-" * 1_000_000 + " (a) ..b.. ;; c " + "!" * 50 + "d" + "?" * 50 + " é."
    part = next(slices(pa.array([text])))
    starts, ends = without_edges(part.data, part.starts, part.ends)
    got = [part.data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert got == ["-", "a", "b", ";", "c", "d", "é"]


def test_toxicity_without_labels(documents, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit_toxicity(documents, none) == ToxicityModel(None, 0.0)
    assert without_toxic(documents, ToxicityModel(None, 0.0)).count() == documents.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= before and len(after) >= 0.6 * len(before), name
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {d for r in last.collect() for d in r.doc_ids} == before


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_messy_and_empty_tables(spark, messy, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, SF).count() == 0
    out = stage(spark, messy, SF)
    assert out.count() > 0
    if name != "training_order":
        assert out.columns == messy.columns


def test_names():
    ops = {n.split("_")[0] for n in queries.QUERIES}
    assert ops == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
