"""Passages, benchmark leaks, licences and chats against plain Python."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re

import pyarrow as pa
from llm_helpers import prose, words

from inkweave.llm import decontaminate, queries
from inkweave.llm.chat import canonical_turns, escape, format_chats, format_turn, read_back, read_turns, registry, unescape
from inkweave.llm.decontaminate import benchmark_leaks, templates, without_leaks
from inkweave.llm.licenses import TEMPLATES, _terms, license_scan
from inkweave.llm.suffixes import repeated_passages
from inkweave.llm.words import slices, trimmed


def covered(rows, least):
    own = {i: words(t, fold=True) for i, t in enumerate(t for _, t in rows)}
    count = collections.Counter(tuple(w[p : p + least]) for w in own.values() for p in range(len(w) - least + 1))
    return {
        i: {q for p in range(len(w) - least + 1) if count[tuple(w[p : p + least])] > 1 for q in range(p, p + least)}
        for i, w in own.items()
    }


def test_passages(documents, messy, messy_rows):
    for df, rows in ((documents, [(r.doc_id, r.text) for r in documents.collect()]), (messy, [r[:2] for r in messy_rows])):
        want, ids = covered(rows, 50), collections.defaultdict(set)
        for i, spots in want.items():
            ids[rows[i][0]] |= spots
        got = collections.defaultdict(set)
        for r in repeated_passages(df).collect():
            got[r.id] |= set(range(r.first_word, r.end_word))
        assert {i for i, s in ids.items() if s} == set(got)
        assert all(got[i] <= ids[i] for i in got)
        # Only text that repeats a few words over and over may be covered in part.
        assert sum(map(len, got.values())) >= 0.95 * sum(map(len, ids.values()))


def test_passage_between_different_texts(spark, empty):
    passage = prose(55, 1)
    rows = [(i, f"{prose(200 + i, 100 + i)}\n{passage} {prose(90, 200 + i)}") for i in range(30)] + [(77, prose(400, 999))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.id, r.first_word, r.end_word) for r in got) == [(i, 200 + i, 255 + i) for i in range(30)]
    assert repeated_passages(empty).count() == 0


def test_rare_passage_before_a_frequent_tail(spark):
    """The words to the left of a frequent sentence decide, and its suffixes are too many to meet each other."""
    tail = prose(40, 5)
    texts = [f"{prose(60, 300 + i)} {tail} {prose(20, 900 + i)}" for i in range(120)]
    texts += [f"{prose(40, 1_500 + i)} {prose(15, 2_000 + i // 2)} {tail} {prose(20, 2_500 + i)}" for i in range(40)]
    rows = list(enumerate(texts))
    got = collections.defaultdict(set)
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        got[r.id] |= set(range(r.first_word, r.end_word))
    assert got == {i: spots for i, spots in covered(rows, 50).items() if spots} and len(got) == 40


def test_leaks(spark, documents, messy, empty):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.id, r.item) for r in benchmark_leaks(documents, items).collect()}
    plain = lambda t: re.findall(r"\w+", (t or "").lower())
    texts = {r.doc_id: " ".join(plain(r.text)) for r in documents.collect()}
    want = {
        (d, r.item_id) for r in items.collect() for d, t in texts.items() if re.search(rf"\b{' '.join(plain(r.text))}\b", t)
    }
    assert got == want and got
    clean = without_leaks(documents, items)
    assert clean.columns == documents.columns
    assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in got}
    assert benchmark_leaks(messy, items).count() == 0 and without_leaks(messy, items).count() == messy.count()
    assert benchmark_leaks(empty, items).count() == 0 and benchmark_leaks(documents, items.limit(0)).count() == 0


def test_reparameterised_question(spark):
    question = "A train leaves at 9 with Anna and travels 60 km while Bob waits 15 minutes until Anna calls him back again"
    other = "a train leaves at 7 with Clara and travels 45 km while David waits 20 minutes until Clara calls him back again"
    mixed = "a train leaves at 7 with Clara and travels 45 km while David waits 20 minutes until David calls him back again"
    docs = spark.createDataFrame([(1, f"Once. {other} and so on"), (2, mixed), (3, None), (4, prose(30, 1))], "doc_id long, text string")
    items = spark.createDataFrame([(5, question), (5, question), (6, None), (7, "")], "item_id long, text string")
    assert [(r.id, r.item) for r in benchmark_leaks(docs, items).collect()] == [(1, 5)]


def test_items_of_little_but_placeholders(spark):
    texts = ["He had 7 apples.", "The answer is 42 here", "we live in Rome there", "we met in Paris again", "12 + 13 = 25", "so 12 + 14 = 25 it is"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "42"), (2, "in Paris"), (3, "12 + 13 = 25"), (4, "He had 9 apples.")], "item_id long, text string")
    got = {(r.id, r.item) for r in benchmark_leaks(docs, items).collect()}
    assert got == {(1, 1), (3, 2), (4, 3)}
    assert {(r.id, r.item) for r in benchmark_leaks(docs, items, min_literal=3).collect()} == got | {(0, 4)}


def plain_leaks(texts: dict, items: dict, window: int, min_literal: int, share: float) -> dict:
    """Leaks word by word: item words that some alignment with one-to-one values covers."""
    def of(text):
        made = templates(next(slices(pa.array([text]))))
        return list(zip(made.words.tolist(), made.plain.tolist(), made.slot.tolist(), strict=True))

    def key(words):
        few = sum(not w[2] for w in words) < min_literal
        return tuple(w[1] if few else w[0] for w in words)

    out = {}
    for i, item in items.items():
        a, size = of(item), min(window, len(of(item)))
        for d, text in texts.items():
            b, covered = of(text), set()
            for shift in range(-len(a), len(b)):
                here = set()
                for p in range(len(a) - size + 1):
                    if 0 <= p + shift <= len(b) - size and key(a[p : p + size]) == key(b[p + shift : p + shift + size]):
                        here |= set(range(p, p + size))
                pairs = {(a[p][1], b[p + shift][1]) for p in here if a[p][2]}
                if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                    covered |= here
            if covered and len(covered) >= share * len(a):
                out[d, i] = len(covered)
    return out


def test_leaks_against_plain_alignments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_HITS", 50)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c", "d", "7", "8", "Anna", "Bob", "km", "--"])
    text = lambda n: " ".join(word() for _ in range(n))
    texts = {i: text(rng.randint(1, 60)) for i in range(60)}
    items = {i: text(rng.randint(1, 12)) for i in range(40)} | {90: "a b a b a b a b", 91: "--"}
    texts[77] = "a b " * 60
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for least in (0, 2):
        got = benchmark_leaks(docs, table, window=4, min_literal=least).collect()
        want = plain_leaks(texts, {i: t for i, t in items.items() if t != "--"}, 4, least, 0.5)
        assert {(r.id, r.item): r.covered_words for r in got} == want and len(want) > 50
        assert all(0 <= r.first_word <= r.last_word < len(texts[r.id].split()) for r in got)


def test_many_numbers_and_marks():
    numbers = " ".join(str(i % 977) for i in range(100_000))
    items = [" ".join(str(i * k) for i in range(1, 13)) for k in range(1, 201)]
    block = decontaminate.Block(list(range(200)), items, 8, 4)
    part = next(slices(pa.array([numbers + " " + items[3]])))
    assert [x[:3] for x in block.leaks(part, 0.9)] == [(0, 0, 12), (0, 3, 12)]
    part = next(slices(pa.array(["-" * 1_000_000 + " (a) ..b%.. ;; é. " + "!" * 1_000_000, "", "!", "x"])))
    starts, ends = trimmed(part, decontaminate._EDGE)
    got = [part.data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert got == ["", "a", "b%", "", "é", "", "", "x"]


def test_licences_of_repeated_rows(spark):
    text = "Released under the MIT License.\n" + prose(12, 1)
    rows = [(1, "a/x.py", text)] * 3 + [(2, "a/y.py", "code"), (3, "b/LICENSE", "Released under the MIT License.")] + [(4, "b/z.py", None)] * 2
    rows += [(5, "c/n.py", text), (5, "c/n.py", "Released under the MIT License."), (6, "c/m.py", "q")]
    got = {(r.id, r.notice, r.license, r.inherited_from) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        (1, "MIT", "MIT", None), (2, None, None, None), (3, "MIT", "MIT", None), (4, None, "MIT", "b"),
        (5, "MIT", "MIT", None), (6, None, "MIT", "c"),
    }


def test_licences(spark, empty):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/c/LICENSE", "Licensed under CC BY-NC 4.0.\n"),
        (4, "a/b/c/d/y.py", None), (5, "z/y.py", "# Licensed under the Apache License, Version 2.0\nmore text\nand more of it, so this is no licence file"),
        (6, "z/w.py", ""), (7, None, "Released under the MIT License."), (8, "top.py", prose(30, 1)), (9, "a/b/c/own.py", "x y z k j h g f e d\nThis work is licensed under the GNU General Public License, version 3."),
        (10, "aa/x.py", "nothing"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, path string, text string, license string")
    got = {r.id: (r.notice, r.license, r.inherited_from) for r in license_scan(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 4: (None, "CC-BY-NC-4.0", "a/b/c"),
        5: ("Apache-2.0", "Apache-2.0", None), 6: (None, None, None), 7: ("MIT", "MIT", None), 8: (None, None, None),
        9: ("GPL-3.0", "GPL-3.0", None), 10: (None, None, None),
    }
    assert license_scan(empty.withColumnRenamed("id", "path")).count() == 0


def test_licence_cosines(documents):
    lines = [(r.doc_id, i, _terms(x)) for r in documents.collect() for i, x in enumerate(r.text.split("\n"))]
    known = set().union(*(_terms(t) for _, t in TEMPLATES))
    df = collections.Counter(t for _, _, terms in lines for t in terms & known)
    idf = lambda t: math.log((1 + len(lines)) / (1 + df[t])) + 1
    best = {}
    for doc, i, terms in lines:
        norm = math.sqrt(sum(idf(t) ** 2 for t in terms))
        for name, text in TEMPLATES:
            own = _terms(text)
            dot = sum(idf(t) ** 2 for t in terms & own)
            score = dot / (norm * math.sqrt(sum(idf(t) ** 2 for t in own))) if terms else 0
            if score >= 0.7:
                best[doc] = min(best.get(doc, (0, 0, "")), (-round(score, 9), i, name))
    path = documents.selectExpr("doc_id", "text", "concat(source, '/', doc_id) as path")
    got = {r.id: (-round(r.score, 9), r.notice_line, r.notice) for r in license_scan(path).filter("notice is not null").collect()}
    assert got == best and got


def test_escaping_round_trip():
    for t in ["<|im_end|>", "<\\|im_end|>", "a<\\\\|<||>\\", "<<|", "\n<|\n", "", "<|im_end|><|im_start|>assistant ok"]:
        assert unescape(escape(t)) == t and "<|im" not in escape(t)
        assert list(read_turns(format_turn("a\\n\n<|", t)[0])) == [("a\\n\n<|", t)]


def test_layouts():
    known = registry()
    turns = lambda record: canonical_turns(record, known)[0]
    assert turns({"prompt": "p", "response": "r"}) == [("user", "p"), ("assistant", "r")]
    assert turns({"instruction": "i", "input": "x", "output": "o"}) == [("user", "i\n\nx"), ("assistant", "o")]
    assert turns({"instruction": "i", "output": "o"}) == [("user", "i"), ("assistant", "o")]
    assert turns({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]}) == [("user", "h"), ("assistant", "")]
    assert turns({"messages": [{"role": "user", "content": "u"}, {"content": "c"}]}) == [("user", "u"), ("", "c")]
    assert turns({"messages": []}) == [] and turns({"role": "user"}) == [("user", "")] and turns({}) == [("", "")]
    assert canonical_turns({"foo": {"bar": 1}}, known) is None and canonical_turns([1], known) is None


def test_chats(spark):
    rows = [
        (1, 1, json.dumps({"role": "assistant", "text": "b<|im_end|>"}), "x"), (1, 0, json.dumps({"role": "user", "text": "a"}), "x"),
        (2, None, json.dumps({"prompt": "p", "response": "é日"}), "x"), (None, 0, None, "x"), (3, 0, "no json", "x"), (3, 1, '{"foo": 1}', "x"),
        (4, 0, '{"messages": []}', "x"), (1, 1, json.dumps({"role": "assistant", "text": "b<|im_end|>"}), "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string, id string")
    made = format_chats(df)
    assert made.filter("formatted is null").count() == 2
    got = {r.id: r for r in read_back(made).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {1, 2, None}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, sha("user\na\n" + "assistant\nb<|im_end|>\n" * 2), 22)
    assert (got[2].n_turns, got[2].loss_sha256, got[None].n_turns) == (2, sha("é日"), 1)
    assert format_chats(df.limit(0)).count() == 0


def test_whole_conversations(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in queries.QUERIES["op9_chat_format"](spark, sf).collect()}
    said = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role, r.text or ""))
    said[-1] = [(i, role, "<|im_end|><|im_start|>assistant ok") for i, role in enumerate(("user", "assistant"))]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == set(said)
    for conv, turns in said.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
