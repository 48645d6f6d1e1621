"""Quality counts and line dedup against plain Python."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from llm_helpers import prose, words

from inkweave.llm import queries
from inkweave.llm.line_dedup import PASSAGE_WORDS, repeated_runs, repeated_units, without_repeats
from inkweave.llm.quality import js_distance, quality_rules


def base(text):
    t, w = text or "", words(text)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


@pytest.mark.parametrize("which", ["messy", "documents"])
def test_base_counts(request, which):
    df = request.getfixturevalue(which)
    got = quality_rules(df).collect()
    want = sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=str)
    assert sorted(((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdict_by_divergence(spark):
    plain = "The house of the river was on the hill, and it is for all of us to see that this is not a dream. "
    odd = "".join(f"#{i}%{i * 7} " for i in range(120))
    rows = [(i, plain * 8 + prose(3, i), "en") for i in range(80)] + [(99, odd, "en"), (100, plain.upper() * 8, "en"), (101, "Hi.", "en")]
    got = {r.id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    # The prose repeats itself, so the base rules fail it; the distances are what is compared here.
    assert got[0].class_distance < 0.1 < 0.25 < min(got[99].class_distance, got[100].class_distance)
    assert got[0].common_distance < 0.1 and got[99].common_distance > 0.3
    assert got[101].class_distance is None and got[101].common_distance is None


def test_distance():
    p = np.array([[1.0, 0.0], [2.0, 2.0], [0.0, 5.0]])
    assert np.allclose(js_distance(p, np.array([3.0, 0.0])), [0, np.sqrt(0.5 * (np.log2(4 / 3) + 0.5 * np.log2(2 / 3) + 0.5)), 1])


def test_quality_of_nothing(empty):
    assert quality_rules(empty).count() == 0


def lines_of(rows, least):
    out, seen = [], {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        at = 0
        for i, line in enumerate((text or "").split("\n")):
            key = tuple(words(line, fold=True))
            if len(key) >= least:
                if key in seen:
                    out.append((doc, i, at, len(line), *seen[key]))
                else:
                    seen[key] = doc, i
            at += len(line) + 1
    return sorted(out, key=str)


def test_repeated_lines(documents, messy):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = repeated_units(documents, min_words=5).collect()
    assert sorted(((r.id, r.unit, r.start, r.length, r.kept_id, r.kept_unit) for r in got), key=str) == lines_of(rows, 5)
    assert repeated_units(messy, min_words=1).count() > 0


def passages_of(texts, least):
    """Runs of neighbouring lines that occur twice or more, from plain Python."""
    keys = {d: [tuple(words(x, fold=True)) for x in (t or "").split("\n")] for d, t in texts.items()}
    times = collections.Counter(k for own in keys.values() for k in own if k)
    first, out = {}, []
    for d in sorted(keys):
        for i, k in enumerate(keys[d]):
            first.setdefault(k, (d, i))
    for d, own in keys.items():
        run = []
        for i, k in [*enumerate(own), (None, ("end",))]:
            if k and times[k] > 1:
                run.append(i)
            elif k:
                if sum(len(own[j]) for j in run) >= least:
                    gone = sum(len(own[j]) for j in run if first[own[j]] != (d, j))
                    out.append((d, run[0], run[-1], sum(len(own[j]) for j in run), gone))
                run = []
    return sorted(out)


def test_query_takes_all_lines_and_cleans(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = queries.op4_line_dedup(spark, "/root/testdata/sf0.001").collect()
    rows = sorted((r.doc_id, r.first_unit, r.last_unit, r.words, r.removed_words) for r in got)
    assert rows == passages_of(texts, PASSAGE_WORDS)
    assert any(r[4] == 0 for r in rows) and any(0 < r[4] for r in rows)
    for r in got:
        lines = texts[r.doc_id].split("\n")
        at = sum(len(x) + 1 for x in lines[: r.first_unit])
        assert (r.start, r.length) == (at, len("\n".join(lines[r.first_unit : r.last_unit + 1])))
    # Short lines that are no passage are removed all the same.
    gone = collections.defaultdict(set)
    for doc, unit, *_ in lines_of(list(texts.items()), 1):
        gone[doc].add(unit)
    left = {
        d: "".join(x + "\n" * (i + 1 < t.count("\n") + 1) for i, x in enumerate(t.split("\n")) if i not in gone[d])
        for d, t in texts.items() if d in gone
    }
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string").selectExpr("doc_id", "length(text) n", "xxhash64(text) h")
    want = {r.doc_id: (r.n, r.h) for r in rows.collect()}
    assert {(r.doc_id, r.cleaned_length, r.cleaned_digest) for r in got} == {(r.doc_id, *want.get(r.doc_id, (None, None))) for r in got}


def test_runs_over_blank_lines_and_repeated_rows(spark, empty):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(1, f"{a}\n\n{b}\nown words here"), (2, f"start\n{b}\nmore"), (None, f"{a}\n{b}"), (None, f"{a}\n{b}"), (3, None), (3, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = repeated_runs(repeated_units(df, all_occurrences=True))
    assert sorted(((r.id, r.first_unit, r.last_unit, r.start, r.length, r.words, r.removed_words) for r in got.collect()), key=str) == [
        (1, 0, 2, 0, len(a) + 2 + len(b), 12, 12), (None, 0, 1, 0, len(a) + 1 + len(b), 12, 0)
    ]
    assert repeated_runs(repeated_units(empty, all_occurrences=True)).count() == 0


def test_cut_lines_and_paragraphs(spark, empty):
    line = "alpha beta gamma delta"
    rows = [(1, f"{line}\nother line here now\n{line.upper()}  \nend", "x"), (2, f"é 日本\n{line}", "y"), (3, None, "z"), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    cut = without_repeats(df, repeated_units(df, min_words=4))
    got = {(r.doc_id, r.text, r.start, tuple(map(tuple, r.removed_spans))) for r in cut.collect()}
    assert got == {
        (1, f"{line}\nother line here now\nend", "x", ((43, 24),)),
        (2, "é 日本\n", "y", ((5, 22),)),
        (3, None, "z", ()),
    }
    two = [(1, "a b\nc d\n\n\ne f"), (2, "x\n\na  b\nC d\n")]
    units = repeated_units(spark.createDataFrame(two, "doc_id long, text string"), paragraphs=True, min_words=1)
    assert [(r.id, r.start, r.length, r.kept_id) for r in units.collect()] == [(2, 3, 8, 1)]
    assert repeated_units(empty).count() == 0


def test_query_reports_short_repeated_lines(spark, tmp_path):
    rows = [(1, "same words\nown"), (2, "other\nsame words"), (3, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.first_unit, r.words, r.removed_words, r.cleaned_length) for r in got) == [(1, 0, 2, 0, None), (2, 1, 2, 2, 6)]
