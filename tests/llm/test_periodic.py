"""Periodic runs against a plain search, and the exact convolution against plain sums."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_helpers import prose, words

from inkweave.llm import periodic
from inkweave.llm.convolve import PRIMES, inverse, primes_for, squared_differences, transform
from inkweave.llm.periodic import find_runs, periodic_runs
from inkweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            smaller = any(w[i : i + length - p] == w[i + p : i + length] for p in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def check(df, rows):
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=str)
    want = []
    for doc, text in rows:
        w = words(text)
        runs = brute(w)
        want.append((doc, len(w), runs, collapsed(w, runs)))
    assert got == sorted(want, key=str)
    return got


def test_messy_rows(messy, messy_rows):
    got = check(messy.filter("length(text) < 9000 or text is null"), [r[:2] for r in messy_rows if len(r[1] or "") < 9000])
    assert any(r[2] for r in got)


def test_empty_table(empty):
    assert periodic_runs(empty).collect() == []


def test_many_small_alphabets(spark, monkeypatch):
    """Random, nested and neighbouring repeats over few words; runs that overlap or touch."""
    rng, rows = random.Random(5), []
    for i in range(160):
        alphabet = "ab"[: rng.randint(1, 2)] + "cdefghij"[: rng.randint(0, 8)]
        w = []
        while len(w) < rng.randint(20, 420):
            unit = [rng.choice(alphabet) for _ in range(rng.randint(1, rng.choice([3, 9, 20, 70])))]
            w += (unit * rng.randint(1, 6))[: rng.randint(1, 400)]
            if rng.random() < 0.2:
                w = w * 2
        rows.append((i, " ".join(w[:600])))
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
    assert sum(len(r[2]) for r in got) > 150
    hashes = [np.array([zlib.crc32(x.encode()) for x in text.split()], np.uint64) for _, text in rows]
    first = np.cumsum([0, *map(len, hashes)])
    whole = find_runs(np.concatenate(hashes), first)
    monkeypatch.setattr(periodic, "NUMBERS_AT_ONCE", 64)
    for one, other in zip(whole, find_runs(np.concatenate(hashes), first), strict=True):
        assert (one == other).all()


def test_bounds_of_length_and_period(spark):
    rows = []
    for q in [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100]:
        unit = prose(q, q).split()
        for length in (3 * q - 1, 3 * q, 3 * q + 1, 23, 24):
            for front in (0, 1, 5, 13):
                w = prose(front, 1000 + front).split() + (unit * (length // q + 1))[:length] + prose(7, 2000 + q).split()
                rows.append((len(rows), " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("unit,times", [("spam", 200_000), ("a b", 100_000), ("a " * 40 + "b", 3_000)])
def test_very_long_periodic_text(spark, unit, times):
    df = spark.createDataFrame([(1, f"x {' '.join([unit] * times)} y")], "doc_id long, text string")
    (row,) = periodic_runs(df).collect()
    q = len(unit.split())
    assert (1, q * times, q) in [tuple(r) for r in row.runs]
    assert tuple(row.strongest) == max(((r.start, r.length, r.period) for r in row.runs), key=lambda r: r[1] / r[2])
    if q < 3:
        assert row.collapsed == f"x {unit} y"


def test_strongest_ties(spark):
    a, b = prose(10, 1), prose(8, 2)
    text = " ".join([b] * 5 + ["x"] + [a] * 5 + ["y"] + ["z"] * 24 + ["u"] + [b] * 5)
    (row,) = periodic_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()
    assert tuple(row.strongest) == (40 + 1 + 50 + 1, 24, 1)
    (row,) = periodic_runs(spark.createDataFrame([(None, " ".join([b] * 5 + ["x"] + [a] * 5))], "doc_id long, text string")).collect()
    assert tuple(row.strongest) == (0, 40, 8)


def test_query_against_plain_search(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    table = {r.doc_id: r.text for r in documents.collect()}
    assert len(got) == len(table)
    changed = 0
    for doc, text in table.items():
        w = words(text)
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            changed += 1
        if len(w) > 2_500:
            continue
        runs, row = brute(w), got[doc]
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row.collapsed_sha256 == digest(collapsed(w, runs))
        if runs:
            s, n, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert row.start is None and row.exponent_milli is None
    assert changed > 5


def test_convolution_is_exact():
    rng = np.random.default_rng(6)
    blocks, wide = rng.integers(0, 1 << 20, (8, 5), dtype=np.uint64), rng.integers(0, 1 << 20, (22, 5), dtype=np.uint64)
    wide[3:11, 2] = blocks[:, 2]
    for p in PRIMES:
        x = rng.integers(0, p, (64, 3), dtype=np.uint64)
        assert (inverse(transform(x, p), p) == x).all()
        got = squared_differences(blocks, wide, p)
        for s in range(15):
            for i in range(5):
                want = sum((int(a) - int(b)) ** 2 for a, b in zip(blocks[:, i], wide[s : s + 8, i], strict=True))
                assert int(got[s, i]) == want % p
        assert got[3, 2] == 0
    assert len(primes_for(1 << 20)) == 1 and len(primes_for(1 << 60)) == 2
    with pytest.raises(ValueError):
        primes_for(1 << 95)
