"""Golden values of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkweave.functions import dates, frontmatter, hashing, paths, vectors, versions
from inkweave.functions.links import nested_links, parse_link, raw_links
from inkweave.operators.journal import squeeze_blank_lines


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [row[0] for row in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("text", "links"),
    [
        ("[[a [[b]] c]]", ["[[a [[b]] c]]"]),
        ("[[a [[b]]", ["[[b]]"]),
        ("[[a [[b]]]", ["[[a [[b]]]"]),
        ("![[a [[b]]", ["[[b]]"]),
        ("x ![[p]] [[q]]", ["![[p]]", "[[q]]"]),
        ("[[[a]]]", ["[[[a]]"]),
        ("[[open", []),
    ],
)
def test_nested_links(text, links):
    assert nested_links(text) == links


def test_nested_and_plain_scans_agree(spark):
    texts = ["[[a]] ![[b]] [[c|d]]", "[[a\nb]]", "none", "[[]] [[x]]y]]", "![[open [[b]]", "[[a [[b]] c]] [[d]]", None]
    got = values(spark, texts, raw_links)
    assert got == [None if t is None else nested_links(t) for t in texts]


def test_link_parts(spark):
    raw = ["[[private/knowledge/Note.md#header|my note]]", "[[C.local]]", "![[Image]]", "[[Note#^block-123]]", "[[ a/ B ]]", "[[a#b#^c]]"]
    got = values(spark, raw, parse_link)
    fields = ("name", "parent", "extension", "header", "block_id", "alias", "is_embed")
    assert [tuple(r[f] for f in fields) for r in got] == [
        ("Note", "private/knowledge", "md", "header", None, "my note", False),
        ("C", None, "local", None, None, None, False),
        ("Image", None, None, None, None, None, True),
        ("Note", None, None, None, "block-123", None, False),
        (" B", "a", None, None, None, None, False),
        ("a#b", None, None, None, "c", None, False),
    ]


def test_references(spark):
    refs = ["[[memory:knowledge/Note]]", "memory:knowledge/Note.md", " Note ", "[[Note", " x.md"]
    assert [tuple(r) for r in values(spark, refs, paths.normalize_ref)] == [
        ("knowledge/Note", "Note"), ("knowledge/Note", "Note"), ("Note", "Note"), ("[[Note", "[[Note"), ("x", "x"),
    ]
    assert values(spark, ["a/b.c.md", ".md", "x", "a/.hidden.md"], paths.stem) == ["b.c", ".md", "x", ".hidden"]


def test_remotes(spark):
    got = values(spark, ["git@github.com:U/R.git", "https://github.com/u/r/", "ssh://git@h/p", "repo.git/"], paths.normalize_remote)
    assert got == ["github.com/u/r", "github.com/u/r", "git@h/p", "repo.git"]


def test_path_key_and_peer_id(spark):
    assert values(spark, ["", "a", "foobar"], hashing.path_key) == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert values(spark, ["ABCDEF0123456789", "x"], hashing.normalize_peer_id) == ["abcdef0123456789", None]


def test_dates(spark):
    stamps = ["2024-12-30 00:05:00", "2025-11-24 12:00:00", "2021-01-03 23:59:00", None]
    ts = lambda fn: values(spark, stamps, lambda c: fn(c.cast("timestamp")))
    assert ts(dates.iso_week_date) == ["2025-W01-1", "2025-W48-1", "2020-W53-7", None]
    assert ts(dates.format_12h) == ["12:05 AM", "12:00 PM", "11:59 PM", None]
    assert ts(dates.day_name) == ["Monday", "Monday", "Sunday", None]
    assert values(spark, ["2025-W48-1", "2025-W48-9", "x", None], dates.day_abbrev) == ["Mon", "???", "???", "???"]
    assert values(spark, ["12:05 AM", "9:30 pm", "13:00 PM", "x"], lambda c: dates.parse_12h(c, True)) == [5, 1290, None, None]
    assert values(spark, ["12:05 AM", "9:30 pm", "13:00 PM"], lambda c: dates.parse_12h(c, False)) == [5, None, 1500]


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([0.0], [1.0]), ([], []), ([1.0], [1.0, 2.0])],
        "a array<double>, b array<double>",
    )
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]


def test_versions(spark):
    df = spark.createDataFrame(
        [({"p": 2}, {"p": 1}), ({"p": 1}, {"p": 1, "q": 0}), ({}, {"p": 1}), ({"p": 1}, {"q": 1})], "a map<string,int>, b map<string,int>"
    )
    assert [r[0] for r in df.select(versions.compare_versions(F.col("a"), F.col("b"))).collect()] == [
        "includes", "equal", "dominated", "concurrent",
    ]


@pytest.mark.parametrize(
    ("text", "entries"),
    [
        ("title: Test\n", {"title": '"Test"'}),
        ("a: yes\nb: true\nc: 012\nd: 2024-01-01\ne: 1.5\nf: ~\n", {"a": '"yes"', "b": "true", "c": '"012"', "d": '"2024-01-01"', "e": "1.5", "f": "null"}),
        ("tags: [a, 1]\n5: x\n", {"tags": '["a", 1]'}),
        ("a: !x 5\nb: .inf\n", {"a": "5", "b": "null"}),
        ("a: 1\na: 2\n", None),
        ("- a\n", None),
        ("", None),
        ("a: [\n", None),
    ],
)
def test_yaml(text, entries):
    assert frontmatter.yaml_entries(text) == entries


def test_build_and_split(spark):
    df = spark.createDataFrame([("p", "---\ntitle: T\nn: 3\n---\nbody\n")], "path string, content string")
    parsed = frontmatter.frontmatter_table(df)
    assert frontmatter.build_notes(parsed.drop("content")).first()["content"] == "---\nn: 3\ntitle: T\n---\nbody\n"
    assert frontmatter.build_notes(parsed.drop("content"), "sync").first()["content"] == "---\nn: 3\ntitle: T\n---\n\nbody\n"
    crlf = spark.createDataFrame([("---\r\na: 1\r\n---\r\nx",)], "content string")
    assert tuple(frontmatter.split_frontmatter(crlf).select("fm_yaml", "body").first()) == ("a: 1\n", "x")


def test_blank_lines(spark):
    assert values(spark, ["a\n\n\n\n\nb", "a\n \n\t\n  \nb", "a\n\nb", "\n\n\n\na"], squeeze_blank_lines) == [
        "a\n\n\nb", "a\n \n\t\nb", "a\n\nb", "\n\na",
    ]
