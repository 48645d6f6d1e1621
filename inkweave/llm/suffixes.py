"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimisers: positions whose ``GRAM``-word hash is the least of some
``SPAN`` neighbouring ones, so any passage of ``GRAM + SPAN - 1`` words keeps the same suffixes
wherever it stands.  Suffixes whose gram occurs once are left out by a count.  Those whose gram up to
``NEIGHBOURS`` suffixes share are sorted over the whole cluster, with the words to their right and
left, by gram and right context; all of one gram are compared with each other and the matches are
extended left and right.  For more frequent grams no suffix could meet all others: windows of
``min_words`` words in which every span has such a gram as its least are matched by their hash.
Overlapping matches of a text are joined, which extends them over any length.

Copies of a whole text count once here and are reported by their text hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage, drop_steps

from .words import Slice, mix, slices, windows

MIN_WORDS = 50
GRAM = 10
SPAN = 32
RIGHT = 58
LEFT = 42
NEIGHBOURS = 16


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over ``values[i : i + width]`` for each i; the array must be that long."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(part: Slice, gram: int, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word number in the text, and gram hash of each kept suffix of a slice."""
    words = part.word_hashes(fold=True)
    hashes, first = windows(words, part.first_word, gram)
    text = np.repeat(np.arange(part.n_texts), np.diff(first))
    if len(hashes) < span:
        return text[:0], first[:0], hashes[:0]
    least = _sliding(hashes, span, np.minimum)
    inside = text[: len(least)] == text[span - 1 :]
    least = np.where(inside, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    keep = np.flatnonzero(_sliding(padded, span, np.maximum) == hashes)
    keep = keep[part.n_words[text[keep]] >= max(min_words, gram)]
    # In text that repeats a few words over and over one suffix per gram is enough.
    same = np.zeros(len(keep), bool)
    same[1:] = (hashes[keep[1:]] == hashes[keep[:-1]]) & (np.diff(keep) < span) & (text[keep[1:]] == text[keep[:-1]])
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(keep)))) if len(keep) else keep
    step = (keep - keep[run]) // gram
    again = same.copy()
    again[1:] &= step[1:] == step[:-1]
    keep = keep[~again]
    return text[keep], keep - first[text[keep]], hashes[keep]


def _suffixes(docs: DataFrame, gram: int, span: int, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                text, place, hashes = minimisers(part, gram, span, min_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        batch.column(1).take(pa.array(text + part.first)),
                        pa.array(place, pa.int64()),
                    ],
                    ["gram", "text_key", "place"],
                )

    return docs.select("text", "text_key").mapInArrow(run, "gram long, text_key long, place long")


def _hot_windows(part: Slice, words: np.ndarray, hot: np.ndarray, gram: int, span: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Text, first word and hash of each window of ``min_words`` words whose least grams are all in ``hot``.

    A window with another least gram has a suffix there that meets all others with this gram.
    """
    hashes, first = windows(words, part.first_word, gram)
    text = np.repeat(np.arange(part.n_texts), np.diff(first))
    if len(hot) == 0 or len(hashes) <= min_words - gram:
        return text[:0], first[:0], hashes[:0]
    need = np.isin(_sliding(hashes, span, np.minimum), hot)
    need = _sliding(need, min_words - gram - span + 2, np.logical_and)
    at = np.flatnonzero(need & (text[: len(need)] == text[min_words - gram :]))
    text, place = text[at], at - first[text[at]]
    word = part.first_word[text] + place
    found = np.full(len(at), min_words, np.uint64)
    for i in range(min_words):
        with np.errstate(over="ignore"):
            found = mix(found + words[word + i])
    return text, place, found


def _contexts(chosen: DataFrame, gram: int, span: int, min_words: int) -> DataFrame:
    """The suffixes of each text with 31-bit codes of the words to their right and left.

    Windows around frequent grams come as rows without these codes, their hash as the gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "right", "left", "text_key", "place"]
        for batch in batches:
            for part in slices(batch.column(0)):
                words = part.word_hashes(fold=True)
                codes = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                hashes, first = windows(words, part.first_word, gram)
                (place, text), (hot, hot_text) = (
                    (own.flatten().to_numpy(zero_copy_only=False),
                     np.repeat(np.arange(part.n_texts), own.value_lengths().to_numpy(zero_copy_only=False)))
                    for own in (batch.column(i).slice(part.first, part.n_texts) for i in (2, 3))
                )
                for a in range(0, len(place), 8192):
                    p, t = place[a : a + 8192], text[a : a + 8192]
                    at = part.first_word[t] + p
                    right = at[:, None] + np.arange(RIGHT)
                    left = at[:, None] - 1 - np.arange(LEFT)
                    ends, starts = part.first_word[t + 1][:, None], part.first_word[t][:, None]
                    take = lambda i, ok: np.where(ok, codes[np.clip(i, 0, len(codes) - 1)], np.uint32(0))
                    # Big-endian, so that bytes sort as numbers do.
                    r = take(right, right < ends).astype(">u4")
                    lft = take(left, left >= starts).astype(">u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes[first[t] + p].view(np.int64)),
                            pa.array([x.tobytes() for x in r], pa.binary()),
                            pa.array([x.tobytes() for x in lft], pa.binary()),
                            batch.column(1).take(pa.array(t + part.first)),
                            pa.array(p, pa.int64()),
                        ],
                        names,
                    )
                known = np.unique(hashes[first[hot_text] + hot.astype(np.int64)]) if len(hot) else hashes[:0]
                t, p, found = _hot_windows(part, words, known, gram, span, min_words)
                none = pa.nulls(len(t), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), none, none, batch.column(1).take(pa.array(t + part.first)), pa.array(p, pa.int64())],
                    names,
                )

    return chosen.select("text", "text_key", "places", "hot").mapInArrow(
        run, "gram long, right binary, left binary, text_key long, place long"
    )


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words two contexts have in common from their start on."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(axis=1)


def _table(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, width)


def _neighbours(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Matches of each suffix with those before it in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            both = own if last is None else pa.concat_tables([last, own])
            found = _spans(*(both.column(i) for i in range(5)), min_words)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["text_key", "a", "b"])
            last = both.slice(max(0, both.num_rows - NEIGHBOURS))

    return suffixes.mapInArrow(run, "text_key long, a long, b long")


def _spans(gram, right, left, key, place, min_words: int) -> list[np.ndarray]:
    """Text, first and one-past-last word of the matches of rows that stand near each other."""
    gram, key, place = (c.to_numpy() for c in (gram, key, place))
    right, left = _table(right, RIGHT), _table(left, LEFT)
    out = []
    for apart in range(1, NEIGHBOURS + 1):
        at = np.flatnonzero(gram[apart:] == gram[:-apart])
        r, lft = _common(right[at], right[at + apart]), _common(left[at], left[at + apart])
        good = r + lft >= min_words
        at, r, lft = at[good], r[good], lft[good]
        for rows in (at, at + apart):
            out.append((key[rows], place[rows] - lft, place[rows] + r))
    spans = np.stack([np.concatenate(x) for x in zip(*out, strict=True)], axis=1)
    return list(np.unique(spans, axis=0).T)


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a text made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == key and a <= held[2]:
                    held = key, held[1], max(held[2], b)
                else:
                    if held is not None:
                        out.append(held)
                    held = key, a, b
            yield _rows(out)
        yield _rows([held] if held is not None else [])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["text_key", "a", "b"])

    return (
        spans.distinct()
        .repartition("text_key")
        .sortWithinPartitions("text_key", "a", "b")
        .mapInArrow(run, "text_key long, a long, b long")
    )


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
    gram: int = GRAM, span: int = SPAN,
) -> DataFrame:
    """Passages of at least ``min_words`` words that occur twice or more in the texts.

    Returns one row per passage of each row of ``docs``: ``id``, ``first_word`` and ``end_word`` (word
    numbers in the text, the end not included), ``n_words`` (of the text) and ``whole`` (the text has
    copies).  All occurrences are reported, also the earliest, and also those within one text.  Words are
    runs outside ASCII white space with A-Z folded; overlapping passages are one.

    Null and empty texts and texts below ``min_words`` have no passages.  A text that occurs in
    several rows is one passage as a whole.  Null ids come back as null.  An empty table gives an
    empty result; extra columns are ignored.
    """
    if gram < 1 or span < 1 or gram + span - 1 > min_words or min_words > RIGHT + LEFT:
        raise ValueError(f"need gram + span - 1 <= min_words <= {RIGHT + LEFT}")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        "text is not null"
    ).withColumn("text_key", F.xxhash64("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    members = cut_lineage(source.select("id", "text_key", words.alias("n_words")), "texts")
    rows = members.groupBy("text_key", "id").agg(F.count("*").alias("times"), F.min("n_words").alias("n_words"))
    own = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "times")))
    texts = cut_lineage(
        rows.groupBy("text_key")
        .agg(own.alias("own"), F.sum("times").alias("copies"), F.min("n_words").alias("n_words"))
        # Whether the row that stands for the text is there several times.
        .select(
            "text_key", F.col("own.id").alias("rep"), "n_words", "copies", (F.coalesce("own.times", "copies") > 1).alias("again")
        ),
        "copies",
    )
    suffixes = cut_lineage(_suffixes(source, gram, span, min_words), "suffixes")
    at = F.struct("text_key", "place")
    repeated = cut_lineage(
        suffixes.groupBy("gram")
        .agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("times"))
        .filter("lo <> hi")
        .select("gram", "times"),
        "repeated",
    )
    # Copies of a text are one here, so the rows of a gram are only a bound.
    frequent = (
        suffixes.join(repeated.filter(F.col("times") > NEIGHBOURS), "gram", "left_semi")
        .distinct()
        .groupBy("gram")
        .agg((F.count("*") > NEIGHBOURS).alias("often"))
        .filter("often")
    )
    # Written, so that the join below is a plain one whose frequent grams can be split.
    known = cut_lineage(
        repeated.join(frequent, "gram", "left").select("gram", F.coalesce("often", F.lit(False)).alias("often")), "known"
    )
    drop_steps(repeated)
    found = cut_lineage(suffixes.join(known, "gram").select("text_key", "place", "often"), "found")
    drop_steps(suffixes, known)
    places = (
        found.groupBy("text_key")  # no more suffixes than one text has
        .agg(
            F.sort_array(F.collect_set(F.when(~F.col("often"), F.col("place")))).alias("places"),
            F.collect_set(F.when(F.col("often"), F.col("place"))).alias("hot"),
        )
    )
    wanted = places.join(texts.select("text_key", "rep", "again"), "text_key").withColumnsRenamed(
        {"text_key": "_key", "rep": "_rep"}
    )
    same = F.col("id").eqNullSafe(F.col("_rep")) & (F.col("text_key") == F.col("_key"))
    chosen = source.join(wanted, same).select("text", "text_key", "places", "hot", "again")
    # Only rows that are there several times need to be made one.
    chosen = chosen.filter("not again").union(chosen.filter("again").dropDuplicates(["text_key"]))
    contexts = cut_lineage(_contexts(chosen, gram, span, min_words), "contexts")
    drop_steps(found)
    # A gram has up to NEIGHBOURS suffixes here, all of them in one task.
    ordered = contexts.filter("right is not null").repartitionByRange("gram").sortWithinPartitions(
        "gram", "right", "text_key", "place"
    )
    spans = cut_lineage(_neighbours(ordered, min_words), "matches")
    hot = contexts.filter("right is null").select("gram", "text_key", "place")
    again = hot.groupBy("gram").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo <> hi")
    spans = spans.union(
        hot.join(again, "gram", "left_semi").select(
            "text_key", F.col("place").alias("a"), (F.col("place") + min_words).alias("b")
        )
    )
    spans = spans.union(
        texts.filter((F.col("copies") > 1) & (F.col("n_words") >= min_words)).select(
            "text_key", F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b")
        )
    )
    passages = _joined(spans).join(texts.select("text_key", "copies"), "text_key")
    return members.join(passages, "text_key").select(
        "id", F.col("a").alias("first_word"), F.col("b").alias("end_word"), "n_words",
        (F.col("copies") > 1).alias("whole"),
    )
