"""Quality rules by divergence from language references.

Each text is counted once: words, symbols, repeated lines and windows, its characters by class
and its common words.  The counts of all documents of a language give its two reference
histograms.  A text stays if it passes the base rules and both its histograms are near those of
one language, by Jensen-Shannon distance (base 2, so 0 to 1).  Short texts have noisy
histograms: below a minimum length a comparison is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage

from .words import SPACE, Slice, slices, trimmed, windows

# Common function words of each language, lower case.
COMMON_WORDS = {
    "de": "am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es "
    "für hat ich ihr im in ist mit nach nicht noch oder sich sie sind so um und von vor war werden wie "
    "wir wird zu zum zur über",
    "en": "a an and are as at be been but by for from had has have he her his i in is it its not of on "
    "or she that the their there they this to was we were when which will with would you",
    "es": "al como con de del el en entre era es esta este fue ha hay la las le lo los más no o para "
    "pero por que se ser sin sobre son su sus también un una y ya",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais "
    "ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous",
}
SYMBOLS = b"#*$%&|<>"
# Character classes: small and capital ASCII letters, digits, white space, punctuation of
# running text, other ASCII, everything beyond ASCII.
N_CLASSES = 7
_CLASS = np.full(256, 5)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[SPACE] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[0x80:] = 6
_EDGE = np.zeros(256, bool)
_EDGE[33:48] = _EDGE[58:65] = _EDGE[91:97] = _EDGE[123:127] = True

MIN_WORDS = 50
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 100
MAX_CLASS_DISTANCE = 0.25
MAX_COMMON_DISTANCE = 0.30


def _vocabulary(common: dict[str, str]) -> list[str]:
    return sorted({w for words in common.values() for w in words.split()})


def _hashes_of(words: list[str]) -> np.ndarray:
    part = next(iter(slices(pa.array(words))))
    return part.span_hashes(part.bounds[:-1], part.bounds[1:], fold=True)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, how often its (owner, key) is there, and whether it came before."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    group = np.cumsum(new) - 1
    count, later = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    count[order] = np.bincount(group)[group] if len(group) else 0
    later[order] = ~new
    return count, later


def base_counts(part: Slice) -> dict[str, np.ndarray]:
    """The base counts of each text of a slice."""
    n, data = part.n_texts, part.data
    text = np.arange(n)
    in_word = ~SPACE[data]
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    # Windows of three words, only in texts that have as many.
    hashes, first = windows(part.word_hashes(), part.first_word, 3)
    full = part.n_words >= 3
    keep = np.repeat(full, np.diff(first))
    owner = np.repeat(text, np.diff(first))[keep]
    place = np.repeat(part.first_word[:-1] - first[:-1], np.diff(first)) + np.arange(len(hashes))
    count, _ = _repeated(hashes[keep], owner)
    again = place[keep][count > 1]
    covered = np.zeros(len(part.starts), bool)
    for j in range(3):
        covered[again + j] = True
    # Lines, also empty ones; only those with a word count.
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([part.bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, part.bounds[1:]]))
    line_of = np.repeat(text, 1 + _sums(data == 10, part.bounds))
    has_word = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, starts)
    _, later = _repeated(part.span_hashes(starts, ends)[has_word], line_of[has_word])
    return {
        "n_words": part.n_words,
        "word_chars": _sums(in_word & ((data & 0xC0) != 0x80), part.bounds),
        "n_symbols": _sums(marks[data], part.bounds),
        "n_dup_lines": np.bincount(line_of[has_word][later], minlength=n),
        "n_repeat_words": _sums(covered, part.first_word),
    }


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _counted(docs: DataFrame, common: dict[str, str]) -> DataFrame:
    words = _vocabulary(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes_of(words)
        order = np.argsort(hashes)
        ranked = hashes[order]
        for batch in batches:
            for part in slices(batch.column(1)):
                n, base = part.n_texts, base_counts(part)
                text = np.repeat(np.arange(n), np.diff(part.bounds))
                character = (part.data & 0xC0) != 0x80
                classes = np.bincount(
                    (text * N_CLASSES + _CLASS[part.data])[character], minlength=n * N_CLASSES
                )
                found = part.span_hashes(*trimmed(part, _EDGE), fold=True)
                at = np.minimum(np.searchsorted(ranked, found), len(ranked) - 1)
                hit = ranked[at] == found
                common_counts = np.bincount(
                    (part.text_of_word() * len(words))[hit] + order[at[hit]],
                    minlength=n * len(words),
                )
                array = lambda values, k: pa.FixedSizeListArray.from_arrays(
                    pa.array(values), k
                ).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, n),
                        batch.column(2).slice(part.first, n),
                        *(pa.array(base[c]) for c in BASE),
                        array(classes, N_CLASSES),
                        array(common_counts, len(words)),
                    ],
                    ["id", "lang", *BASE, "classes", "common"],
                )

    schema = ", ".join(["id long", "lang string", *(f"{c} long" for c in BASE)])
    return docs.mapInArrow(run, f"{schema}, classes array<long>, common array<long>")


def references(counted: DataFrame, languages: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Class counts, common-word counts and word total of each language over all documents.

    The result has one entry for each listed language at most, so it fits on the driver.
    """
    counted = counted.filter(F.col("lang").isin(languages))
    both = F.concat("classes", "common", F.array("n_words"))
    rows = (
        counted.select("lang", F.posexplode(both).alias("place", "times"))
        .groupBy("lang", "place")
        .agg(F.sum("times").alias("times"))
        .collect()
    )
    out = {}
    for lang in sorted({r.lang for r in rows}):
        own = np.array([r.times for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.place)], float)
        if own[-1] > 0:
            out[lang] = own[:N_CLASSES], own[N_CLASSES:-1], own[-1]
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` to ``q``; rows need not sum to 1."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    q = np.broadcast_to(q / max(q.sum(), 1e-300), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=1)
        return np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: dict[str, str] = COMMON_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_common_distance: float = MAX_COMMON_DISTANCE,
) -> DataFrame:
    """Base counts and the verdict for each row of ``docs``.

    Returns ``id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``nearest`` (the reference with the nearest common
    words), ``class_distance``, ``common_distance`` and ``kept``.  ``lang_col`` only says to
    which reference a text adds its counts; the verdict looks at the text alone.

    A null or empty text has no words and fails the base rules.  A null or unknown language adds
    to no reference; where no reference has words (an empty table, say) nothing can diverge, the
    distances are null and the base rules decide.  A text below 200 characters has no class distance, one below
    100 words no common-word distance; a missing distance is no fault.  Repeated rows are judged one
    by one.  Ties go to the language that is first by name.  Extra columns are ignored.
    """
    languages = sorted(common)
    words = _vocabulary(common)
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col), F.col(lang_col).cast("string")
    )
    counted = cut_lineage(_counted(source, common), "counted")
    known = references(counted, languages)
    places = {lang: np.array([words.index(w) for w in sorted(common[lang].split())]) for lang in known}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            n_words, repeats = (column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words"))
            table = lambda name: np.asarray(column(name).flatten()).reshape(n, -1).astype(float)
            classes, counts = table("classes"), table("common")
            failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
            by_lang = []
            for lang, (class_ref, common_ref, total) in known.items():
                at = places[lang]
                own, ref = counts[:, at], common_ref[at]
                p = np.column_stack([own, np.maximum(n_words - own.sum(axis=1), 0)])
                q = np.append(ref, max(total - ref.sum(), 0))
                by_lang.append((js_distance(p, q), js_distance(classes, class_ref)))
            far_class, far_common, nearest = np.full(n, np.nan), np.full(n, np.nan), np.full(n, -1)
            if by_lang and n:
                far = np.array([x[0] for x in by_lang])
                nearest = far.argmin(axis=0)
                pick = np.arange(n)
                far_common = np.where(n_words >= MIN_COMMON_WORDS, far[nearest, pick], np.nan)
                near_class = np.array([x[1] for x in by_lang])[nearest, pick]
                far_class = np.where(classes.sum(axis=1) >= MIN_CLASS_CHARS, near_class, np.nan)
                nearest = np.where(n_words > 0, nearest, -1)
            kept = ~failed & ~(far_class > max_class_distance) & ~(far_common > max_common_distance)
            names = [*known, None]
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(c) for c in ["id", *BASE]),
                    pa.array(failed),
                    pa.array([names[i] for i in nearest], pa.string()),
                    pa.array(far_class, from_pandas=True),
                    pa.array(far_common, from_pandas=True),
                    pa.array(kept),
                ],
                ["id", *BASE, "base_failed", "nearest", "class_distance", "common_distance", "kept"],
            )

    schema = ", ".join(["id long", *(f"{c} long" for c in BASE)])
    return counted.mapInArrow(
        run,
        f"{schema}, base_failed boolean, nearest string, class_distance double, common_distance double, kept boolean",
    )
