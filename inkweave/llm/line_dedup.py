"""Substring dedup by hashing lines or paragraphs.

A unit is a line, or a paragraph between blank lines.  Its digest is made of its words, with
A-Z folded and white space left out.  One aggregate over all documents gives each digest that
occurs more than once its earliest occurrence, and is written; a join by digest then names all
occurrences.  Both steps carry digests and offsets, never text, and both can be split or combined early
where one line is in very many documents.  Neighbouring repeated units make a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage

from .words import Slice, mix, slices

MIN_WORDS = 1
# The query reports every repeated line; a caller of repeated_runs asks for long passages unless it says otherwise.
PASSAGE_WORDS = 1
LONG_PASSAGE_WORDS = 12


def unit_bounds(part: Slice, paragraphs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the units of a slice, without the line break behind, and their texts."""
    breaks = np.flatnonzero(part.data == 10)
    starts = np.sort(np.concatenate([part.bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, part.bounds[1:]]))
    per_text = 1 + np.diff(np.searchsorted(breaks, part.bounds))
    owner = np.repeat(np.arange(part.n_texts), per_text)
    if not paragraphs:
        return starts, ends, owner
    filled = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, starts)
    follows = np.zeros(len(starts), bool)
    follows[1:] = filled[1:] & filled[:-1] & (owner[1:] == owner[:-1])
    head = np.flatnonzero(filled & ~follows)
    tail = np.flatnonzero(filled & ~np.append(follows[1:], False))
    return starts[head], ends[tail], owner[head]


def unit_digests(part: Slice, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit digests of the words of each unit, and the number of words."""
    words = part.word_hashes(fold=True)
    a, b = np.searchsorted(part.starts, starts), np.searchsorted(part.starts, ends)
    # Every word lies in one unit, so the units tile the words.
    place = np.arange(len(words)) - np.repeat(a, b - a)
    digests = []
    for seed in (1, 2):
        with np.errstate(over="ignore"):
            terms = mix(words + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(seed)))
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(terms, out=total[1:])
            digests.append(mix(total[b] - total[a] + (b - a).astype(np.uint64)))
    return digests[0], digests[1], b - a


def _units(docs: DataFrame, paragraphs: bool, min_words: int) -> DataFrame:
    names = ["id", "text_key", "unit", "nth", "start", "length", "words", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                starts, ends, owner = unit_bounds(part, paragraphs)
                d1, d2, words = unit_digests(part, starts, ends)
                chars = part.code_points()
                first = chars[part.bounds[:-1]]
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                keep = words >= min_words
                own = owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(own + part.first)),
                        batch.column(2).take(pa.array(own + part.first)),
                        pa.array(number[keep]),
                        pa.array(np.arange(len(own)) - np.searchsorted(own, own)),
                        pa.array(chars[starts[keep]] - first[own]),
                        pa.array((chars[ends] - chars[starts])[keep]),
                        pa.array(words[keep]),
                        pa.array(d1[keep].view(np.int64)),
                        pa.array(d2[keep].view(np.int64)),
                    ],
                    names,
                )

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    paragraphs: bool = False,
    min_words: int = MIN_WORDS,
    all_occurrences: bool = False,
) -> DataFrame:
    """Every occurrence of a unit but the earliest, with its offsets in the original text.

    With ``all_occurrences`` the earliest is there as well, and the columns ``kept`` (whether it is this one)
    and ``nth`` (number of the unit among those of the text that have ``min_words`` words) besides.

    Returns ``id``, ``text_key`` (a hash of the whole text), ``unit`` (its number in the text),
    ``start`` and ``length`` in characters, ``words``, and of the earliest occurrence ``kept_id`` and
    ``kept_unit``.  Occurrences rank by id, then text hash, then number of the unit.  Units with
    fewer than ``min_words`` words are left alone.

    Null, empty and blank texts have no units.  A null id ranks before all others.  Rows with the
    same id and text count as one document.  An empty table gives an empty result; extra columns
    are ignored.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")
    )
    units = cut_lineage(_units(source, paragraphs, min_words), "units")
    rank = F.struct("id", "text_key", "unit")
    earliest = cut_lineage(
        units.groupBy("d1", "d2")
        .agg(F.min(rank).alias("kept"), F.max(rank).alias("last"))
        .filter(F.col("kept") != F.col("last"))
        .select("d1", "d2", "kept"),
        "earliest",
    )
    names = ["id", "text_key", "unit", "start", "length", "words"]
    is_kept = F.struct("id", "text_key", "unit").eqNullSafe(F.col("kept"))
    found = units.join(earliest, ["d1", "d2"]).select(
        *names, F.col("kept.id").alias("kept_id"), F.col("kept.unit").alias("kept_unit"), is_kept.alias("kept"), "nth"
    )
    return found if all_occurrences else found.filter(~F.col("kept")).drop("kept", "nth")


def repeated_runs(occurrences: DataFrame, least_words: int = LONG_PASSAGE_WORDS) -> DataFrame:
    """Passages made of neighbouring repeated units, of at least ``least_words`` words.

    ``occurrences`` is what :func:`repeated_units` gives with ``all_occurrences``.  Returns ``id``, ``text_key``,
    ``first_unit``, ``last_unit``, ``start`` and ``length`` in characters, ``words``, and ``removed_words``: those
    in units that are not the earliest occurrence.  Units with too few words to count do not part neighbours.
    """
    # Equal rows of the table are one document; a window holds the repeated lines of one text.
    rows = occurrences.select("id", "text_key", "unit", "nth", "start", "length", "words", "kept").distinct()
    text = Window.partitionBy("id", "text_key").orderBy("nth")
    return (
        rows.withColumn("run", F.col("nth") - F.row_number().over(text))
        .groupBy("id", "text_key", "run")
        .agg(
            F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"), F.min("start").alias("start"),
            F.max(F.col("start") + F.col("length")).alias("end"), F.sum("words").alias("words"),
            F.sum(F.when(F.col("kept"), 0).otherwise(F.col("words"))).alias("removed_words"),
        )
        .filter(F.col("words") >= least_words)
        .select(
            "id", "text_key", "first_unit", "last_unit", "start", (F.col("end") - F.col("start")).alias("length"),
            "words", "removed_words",
        )
    )


def cleaned_texts(
    docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """What :func:`without_repeats` leaves of each document that has a row in ``repeated``.

    Returns ``id``, ``text_key`` (of the original text), ``cleaned_length`` in characters and
    ``cleaned_digest`` (xxhash64) of the text without its repeated units.  All other documents keep their
    text.  Rows with the same id and text are one row here.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")
    )
    return (
        without_repeats(own, repeated, "id", "text")
        .filter(F.size("removed_spans") > 0)
        .select("id", "text_key", F.length("text").alias("cleaned_length"), F.xxhash64("text").alias("cleaned_digest"))
        .distinct()
    )


def _cut_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        kept, at = [], 0
        for span in own or ():
            kept.append(text[at : span["start"]])
            at = span["start"] + span["length"] + 1
        out.append(None if text is None else "".join([*kept, text[at:]]))
    return pa.array(out, pa.string())


def without_repeats(
    docs: DataFrame,
    repeated: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the repeated units cut out of the texts, and what was cut.

    Adds ``removed_spans``: an ascending array of (start, length) in the original text.  A unit goes
    with the line break behind it.  Null texts stay null; other columns are kept as they are.
    """
    # The spans of one document are no more than its lines.
    spans = repeated.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("removed_spans")
    )
    same = docs[id_col].cast("long").eqNullSafe(spans["_id"]) & (F.xxhash64(docs[text_col]) == spans["_key"])
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    return (
        docs.join(spans, same, "left")
        .withColumn("removed_spans", F.coalesce("removed_spans", none))
        .withColumn(text_col, F.arrow_udf(_cut_spans, "string")(docs[text_col], F.col("removed_spans")))
        .drop("_id", "_key")
    )
