"""Wiki links in note text: ``[[folder/Name.ext#Header|alias]]``, ``![[...]]``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import trim_space

LINK_PATTERN = r"(?s)!?\[\[.*?\]\]"


def _balanced_end(text: str, start: int) -> int:
    """Position of the ``]]`` that closes the link opened before ``start``, or -1.

    An inner closer moves the scan by one character only, so three closing brackets
    can count twice.
    """
    depth, at = 1, start
    while at < len(text) - 1:
        pair = text[at : at + 2]
        if pair == "]]":
            depth -= 1
            if depth == 0:
                return at
        at += 2 if pair == "[[" else 1
        depth += pair == "[["
    return -1


def nested_links(text: str) -> list[str]:
    """Links of a text with links inside links, as written."""
    found, at = [], text.find("[[")
    while at >= 0:
        end = _balanced_end(text, at + 2)
        if end >= 0:
            found.append(text[at - (text[at - 1 : at] == "!") : end + 2])
            at = text.find("[[", end + 2)
        else:
            # A failed embed also rules out its own brackets as a plain link.
            at = text.find("[[", at + 1)
            while at > 0 and text[at - 1] == "!" and _balanced_end(text, at + 2) < 0:
                at = text.find("[[", at + 1)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nested_links(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else nested_links(t))


def raw_links(content: Column) -> Column:
    """Links of a text as ARRAY<STRING>, as written.

    Only texts with a link inside a link leave the JVM; the other rows send a null.
    """
    plain = F.regexp_extract_all(content, F.lit(LINK_PATTERN), F.lit(0))
    nested = F.exists(plain, lambda m: m.rlike(r"(?s)^!?\[\[.*\[\["))
    return F.coalesce(_nested_links(F.when(nested, content)), plain)


def parse_link(raw: Column) -> Column:
    """STRUCT<name, parent, extension, header, block_id, alias, is_embed> of one link."""
    is_embed = raw.startswith("!")
    inner = F.regexp_replace(raw, r"(?s)^!?\[\[(.*)\]\]$", "$1")
    target = F.substring_index(inner, "|", 1)
    alias = F.when(
        F.instr(inner, "|") > 0, F.substring(inner, F.instr(inner, "|") + 1, F.length(inner))
    )
    block_at = F.instr(target, "#^")
    header_at = F.instr(target, "#")
    path = trim_space(
        F.when(block_at > 0, F.substring(target, F.lit(1), block_at - 1))
        .when(header_at > 0, F.substring(target, F.lit(1), header_at - 1))
        .otherwise(target)
    )
    file = F.substring_index(path, "/", -1)
    return F.struct(
        F.regexp_replace(file, r"(?s)\.[^.]*$", "").alias("name"),
        F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"(?s)/[^/]*$", "")).alias("parent"),
        F.when(F.instr(file, ".") > 0, F.substring_index(file, ".", -1)).alias("extension"),
        F.when((block_at == 0) & (header_at > 0), F.substring(target, header_at + 1, F.length(target))).alias("header"),
        F.when(block_at > 0, F.substring(target, block_at + 2, F.length(target))).alias("block_id"),
        alias.alias("alias"),
        is_embed.alias("is_embed"),
    )


def linked_note_names(content: Column) -> Column:
    """Distinct names a text links to, ARRAY<STRING>."""
    return F.array_distinct(F.transform(raw_links(content), lambda m: parse_link(m)["name"]))
