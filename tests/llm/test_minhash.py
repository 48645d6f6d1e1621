"""MinHash classes against all pairs, and the bounds of the sequential verification."""

from __future__ import annotations

import random

import numpy as np
import pytest
from llm_helpers import prose
from test_ngram_join import brute

from inkweave.llm import minhash, set_links
from inkweave.llm.minhash import band_keys, least_agreements, minhash_classes, number_of_bands, signatures, survivors


def found(df, **kw):
    return sorted(((r.id, r.n_shingles, r.component) for r in minhash_classes(df, **kw).collect()), key=str)


@pytest.mark.parametrize("n", [2, 5])
def test_messy_rows(messy, messy_rows, n):
    assert found(messy, n=n) == brute([r[:2] for r in messy_rows], n, 80, 100)


def test_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents, n=2) == brute(rows, 2, 80, 100)


def test_kept(messy):
    got = minhash_classes(messy, n=2).collect()
    assert all(r.kept == (r.id == r.component) for r in got)
    assert {r.component for r in got if r.n_shingles} == {r.id for r in got if r.n_shingles and r.kept}


def test_empty_table(empty):
    assert found(empty) == []


def test_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(set_links, "MEMBERS_PER_TASK", 4)
    rng, base, rows = random.Random(2), prose(90, 11).split(), []
    for i in range(80):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(90)] = prose(1, rng.random())
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 2, 80, 100)
    assert found(df, n=2) == want
    assert len({c for _, _, c in want}) > 1


def test_chain_without_ids(spark):
    base, rows = prose(120, 21).split(), []
    for i in range(0, 32, 8):  # only neighbours link
        text = " ".join([f"w{j}" for j in range(i)] + base[i:])
        rows += [(None, text)] * 3 if i in (8, 16) else [(50 - i, text)]
    rows += [(None, prose(60, 22)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 2, 80, 100)
    assert (50, 119, 26) in want
    assert found(df, n=2) == want


def test_agreement_is_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1_000, dtype=np.uint64)
    sets = np.concatenate([np.sort(pool[:900]), np.sort(pool[100:])])
    signs = signatures(sets, np.array([0, 900, 900, 1_800]), 2_000)
    assert abs((signs[0] == signs[2]).mean() - 0.8) < 0.04
    assert not signs[1].any()
    keys = band_keys(signs[:, :10], 2, 5)
    assert keys.shape == (3, 2) and len(np.unique(keys)) >= 4


def test_pairs_at_the_threshold_survive():
    size = 5 * number_of_bands(0.8, 5, 1e-6)
    steps = least_agreements(0.8, size, 20, 1e-6)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, (20_000, size), dtype=np.uint32)
    close = np.where(rng.random(base.shape) < 0.8, base, base + 1)
    far = np.where(rng.random(base.shape) < 0.4, base, base + 1)
    signs, x = np.concatenate([base, close, far]), np.arange(20_000)
    assert len(survivors(signs, x, x + 20_000, steps)) == 20_000
    assert len(survivors(signs, x, x + 40_000, steps)) == 0
    assert [n for n, _ in steps] == sorted(n for n, _ in steps) and steps[-1][0] == size


def test_bit_filter(spark):
    values = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 3_000)
    df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "h long")
    bits = set_links.bit_filter(df)
    assert set_links.maybe_in(bits, values).all()
    assert set_links.maybe_in(bits, values + 12_345).mean() < 0.01
    assert not set_links.bit_filter(df.limit(0)).any()
