"""Front matter: splitting in plain expressions, YAML values in an Arrow-batched UDF.

A parsed front matter is MAP<STRING, STRING>: key -> value as JSON text, so a typed
read is ``parse_json(fm['tags'])`` and an equality test on the map values is exact.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = "---\n"


class _CoreLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2 core scalars: no yes/no booleans, dates stay text, one value per key."""


_CoreLoader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*|0x[0-9a-fA-F]+|0o[0-7]+|0b[01]+)$", list("-+0123456789")),
    (
        "float",
        r"^(?:[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?[0-9]+[eE][-+]?[0-9]+|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$",
        list("-+0123456789."),
    ),
    ("merge", r"^(?:<<)$", ["<"]),
):
    _CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _integer(loader, node):
    text = node.value.replace("+", "").lower()
    sign = -1 if text.startswith("-") else 1
    value = sign * int(text.lstrip("-"), 0)
    return value if -(2**63) <= value < 2**64 else float(value)


def _number(loader, node):
    text = node.value.lower().replace(".inf", "inf").replace(".nan", "nan")
    return float(text)


def _mapping(loader, node):
    pairs = [(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]
    keys = [json.dumps(k, default=str) for k, _ in pairs]
    if len(set(keys)) != len(keys):
        raise yaml.constructor.ConstructorError(None, None, "repeated key", node.start_mark)
    return {k: v for k, v in pairs if isinstance(k, str)}


def _untag(loader, suffix, node):
    if isinstance(node, yaml.MappingNode):
        return _mapping(loader, node)
    if isinstance(node, yaml.SequenceNode):
        return loader.construct_sequence(node, deep=True)
    plain = yaml.ScalarNode(loader.resolve(yaml.ScalarNode, node.value, (True, False)), node.value)
    return loader.construct_object(plain, deep=True)


_CoreLoader.add_constructor("tag:yaml.org,2002:int", _integer)
_CoreLoader.add_constructor("tag:yaml.org,2002:float", _number)
_CoreLoader.add_constructor("tag:yaml.org,2002:map", _mapping)
_CoreLoader.add_multi_constructor("!", _untag)


def _finite(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    return value


def yaml_entries(text: str | None) -> dict[str, str] | None:
    """Top-level entries of YAML text as JSON texts; None unless it is a non-empty map."""
    if text is None:
        return None
    try:
        value = yaml.load(text, Loader=_CoreLoader)  # noqa: S506 - safe loader subclass
    except (yaml.YAMLError, ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or not value:
        return None
    return {k: json.dumps(_finite(v), ensure_ascii=False) for k, v in value.items()}


def entries_yaml(entries) -> str | None:
    """YAML text of top-level entries, keys in order."""
    if entries is None:
        return None
    value = {k: json.loads(v) for k, v in sorted(dict(entries).items())}
    return yaml.safe_dump(value, sort_keys=True, allow_unicode=True, width=2**31) if value else ""


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_yaml(text: pd.Series) -> pd.Series:
    return text.map(yaml_entries)


@F.pandas_udf(T.StringType())
def dump_yaml(entries: pd.Series) -> pd.Series:
    return entries.map(entries_yaml)


def split_strict(content: Column) -> tuple[Column, Column]:
    """(yaml, body): the block ends at a line that is exactly ``---``."""
    lf = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    rest = F.substring(lf, F.lit(5), F.length(lf))
    close = F.locate("\n" + FENCE, F.concat(F.lit("\n"), rest, F.lit("\n")))
    has = lf.startswith(FENCE) & (close > 0)
    return (
        F.when(has, F.substring(rest, F.lit(1), close - 1)),
        F.when(has, F.substring(rest, close + 4, F.length(rest))).otherwise(content),
    )


def split_sync(content: Column) -> tuple[Column, Column]:
    """(yaml, body): the block ends at the first line that starts with ``---``."""
    rest = F.substring(content, F.lit(4), F.length(content))
    close = F.locate("\n---", rest)
    has = content.startswith("---") & (close > 0)
    return (
        F.when(has, F.substring(rest, F.lit(1), close - 1)),
        F.when(has, F.regexp_replace(F.substring(rest, close + 4, F.length(rest)), "^\n+", "")).otherwise(content),
    )


def split_frontmatter(notes: DataFrame, mode: str = "strict") -> DataFrame:
    """Add ``fm_yaml`` (null without front matter) and ``body``."""
    fm, body = {"strict": split_strict, "sync": split_sync}[mode](F.col("content"))
    return notes.withColumns({"fm_yaml": fm, "body": body})


def frontmatter_table(notes: DataFrame, mode: str = "strict") -> DataFrame:
    """Add ``fm`` (MAP of key to JSON text, null when absent, empty or invalid) and ``body``."""
    split = split_frontmatter(notes, mode)
    return split.withColumn("fm", parse_yaml("fm_yaml")).drop("fm_yaml")


def build_content(fm: Column, body: Column, mode: str = "strict") -> Column:
    """Note text from front matter and body; an empty map gives the body alone."""
    gap = {"strict": "", "sync": "\n"}[mode]
    filled = F.when(F.size(F.coalesce(fm, F.create_map().cast("map<string,string>"))) > 0, fm)
    text = dump_yaml(filled)
    return F.when(filled.isNull(), body).otherwise(
        F.concat(F.lit(FENCE), text, F.lit(FENCE + gap), body)
    )


def build_notes(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Add ``content`` from columns ``fm`` and ``body``."""
    return df.withColumn("content", build_content(F.col("fm"), F.col("body"), mode))


def string_value(json_text: Column) -> Column:
    """The text of a JSON string value, null for any other type."""
    return F.when(
        json_text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")
    )


def string_values(json_text: Column) -> Column:
    """The string items of a JSON array value, other items dropped; null for another type."""
    items = F.from_json(json_text, "array<variant>")
    texts = F.filter(F.transform(items, lambda v: F.to_json(v)), lambda t: t.startswith('"'))
    return F.when(json_text.startswith("["), F.transform(texts, string_value))
