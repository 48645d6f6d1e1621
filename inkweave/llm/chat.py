"""Chat formatting with layouts chosen by schema fingerprint.

A record is a JSON text in whatever layout its source used.  The paths of all its fields, with
list positions left out, are hashed; the fingerprint selects a declarative mapping to canonical
turns.  Turns are written in a template whose control strings are escaped inside texts, so the
formatted text can be read back without loss.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``each`` is the path of a list of turns (empty: the record itself is one turn or several);
    ``turns`` gives for each turn the path of its role, or ``=role`` for a fixed one, and the paths
    of its texts, which are joined by a blank line; missing texts are left out.
    ``optional`` names fields that may be absent.
    """

    each: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()
    role_names: dict[str, str] = field(default_factory=dict, hash=False)


SHARE_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
# Layouts as they are found in public instruction and chat collections.
LAYOUTS = (
    Mapping("", (("role", ("text",)),), ("role", "text")),
    Mapping("", (("role", ("content",)),), ("role",)),
    Mapping("messages", (("role", ("content",)),), ("role", "content")),
    Mapping("turns", (("role", ("text",)),), ("role", "text")),
    Mapping("conversations", (("from", ("value",)),), ("from", "value"), SHARE_ROLES),
    Mapping("", (("=user", ("prompt",)), ("=assistant", ("response",)))),
    Mapping("", (("=user", ("prompt",)), ("=assistant", ("completion",)))),
    Mapping("", (("=system", ("system",)), ("=user", ("prompt",)), ("=assistant", ("response",)))),
    Mapping("", (("=user", ("question",)), ("=assistant", ("answer",)))),
    Mapping("", (("=user", ("instruction", "input")), ("=assistant", ("output",))), ("input",)),
    Mapping("", (("=system", ("system",)), ("=user", ("instruction", "input")), ("=assistant", ("output",))), ("input",)),
)


def field_paths(value: object, prefix: str = "") -> set[str]:
    """Paths of the leaves of a JSON value; the members of a list share one path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}") for k, v in value.items())) or {prefix + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) or {prefix + "[]"}
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()


def _fingerprints(mapping: Mapping) -> Iterator[str]:
    """The fingerprints of a layout with every choice of its optional fields."""
    base = f".{mapping.each}[]" if mapping.each else ""
    names = {n for role, texts in mapping.turns for n in (role, *texts) if not n.startswith("=")}
    optional = sorted(names & set(mapping.optional))
    for bits in range(1 << len(optional)):
        gone = {n for i, n in enumerate(optional) if bits >> i & 1}
        left = names - gone
        if left:
            yield fingerprint({f"{base}.{n}" for n in left})
        else:
            yield fingerprint({base + "{}"})
    if mapping.each:
        yield fingerprint({f".{mapping.each}[]"})


def registry(layouts: tuple[Mapping, ...] = LAYOUTS) -> dict[str, Mapping]:
    """Mapping by fingerprint; the first layout listed has the say."""
    out: dict[str, Mapping] = {}
    for mapping in layouts:
        for key in _fingerprints(mapping):
            out.setdefault(key, mapping)
    return out


def _text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: object, known: dict[str, Mapping]) -> tuple[list[tuple[str, str]], str] | None:
    """Role and text of each turn, and the fingerprint; None for an unknown layout.

    Fields a list's members do not share (an absent role, say) are optional ones, so their
    fingerprint is that of the whole list.
    """
    key = fingerprint(field_paths(record))
    mapping = known.get(key)
    if mapping is None:
        return None
    members = record[mapping.each] if mapping.each else [record]
    turns = []
    for member in members:
        for role, names in mapping.turns:
            name = role[1:] if role.startswith("=") else _text(member.get(role))
            texts = [_text(member[n]) for n in names if n in member]
            if len(names) > 1:
                texts = [t for t in texts if t] or [""]
            turns.append((mapping.role_names.get(name, name), "\n\n".join(texts)))
    return turns, key


def escape(text: str) -> str:
    """``<``, backslashes and ``|`` get one backslash more, so no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    body = escape(text)
    head = f"{START}{name}\n"
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted text."""
    for chunk in formatted.split(START)[1:]:
        name, _, body = chunk.partition("\n")
        name = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))
        yield name, unescape(body[: body.rindex(END)])


def format_chats(
    records: DataFrame,
    id_col: str = "conv_id",
    order_col: str = "turn",
    record_col: str = "record",
    layouts: tuple[Mapping, ...] = LAYOUTS,
) -> DataFrame:
    """The records of each conversation in order, as formatted turns.

    Returns one row per turn: ``id``, ``n`` (0, 1, ... in the conversation), ``formatted``,
    ``loss_from`` and ``loss_to`` (the part of ``formatted`` that is trained on, in characters; both
    null outside assistant turns) and ``layout`` (the fingerprint).  The formatted conversation is its
    rows' texts joined in order of ``n``; a row is never cut, and a very long conversation is never
    one value.

    Records of one conversation go by ``order_col``, null first, then by their own text; repeated
    rows are repeated turns.  A null id is a conversation of its own.  A null record, text or role
    is an empty one (a null record: empty role and text).  A record that is no JSON or has an unknown
    layout is kept whole: a row with ``layout`` null and null ``formatted``, outside the count.  An
    empty list of turns gives no row.  An empty table gives an empty result; extra columns are
    ignored.
    """
    known = registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, begun = None, 0, False
        for batch in batches:
            rows = []
            for conv, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or conv != current:
                    current, n, begun = conv, 0, True
                try:
                    found = canonical_turns(json.loads(raw) if raw is not None else {}, known)
                except ValueError:
                    found = None
                if found is None:
                    rows.append((conv, None, None, None, None, None))
                    continue
                turns, layout = found
                for role, text in turns:
                    formatted, a, b = format_turn(role, text)
                    span = (a, b) if role == TRAINED_ROLE else (None, None)
                    rows.append((conv, n, formatted, *span, layout))
                    n += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["id", "n", "formatted", "loss_from", "loss_to", "layout"],
            )

    return (
        records.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(order_col).cast("long").alias("_order"),
            F.col(record_col).cast("string").alias("record"),
        )
        .repartition("id")
        .sortWithinPartitions("id", "_order", "record")
        .mapInArrow(run, "id long, n long, formatted string, loss_from long, loss_to long, layout string")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from nothing but their formatted turns.

    Returns per ``id``: ``n_turns``, ``turns_sha256`` (of role, line break, text, line break per
    turn), ``loss_chars`` and ``loss_sha256`` (of the unescaped text under the loss mask) and
    ``formatted_chars``.  A task holds one turn and one running digest at a time, so a conversation
    may have any number of turns.  Rows without formatted text are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, state = None, None

        def finished() -> list[tuple]:
            if state is None:
                return []
            turns, loss, n, loss_chars, chars = state
            return [(current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for conv, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != current:
                    rows += finished()
                    current, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, body in read_turns(text):
                    state[0].update(f"{role}\n{body}\n".encode())
                    state[2] += 1
                if a is not None:
                    trained = unescape(text[a:b])
                    state[1].update(trained.encode())
                    state[3] += len(trained)
                state[4] += len(text)
            yield batch_of(rows)
        yield batch_of(finished())

    return (
        formatted.filter("formatted is not null")
        .select("id", "n", "formatted", "loss_from", "loss_to")
        .repartition("id")
        .sortWithinPartitions("id", "n")
        .mapInArrow(
            run,
            "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )
