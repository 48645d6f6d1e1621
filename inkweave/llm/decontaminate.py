"""Benchmark decontamination that also catches re-parameterised questions.

Words lose their case and outer punctuation; numbers, names (capitalised words inside a
sentence) and units behind a number become typed placeholders.  Windows of such templates of the
documents are looked up among those of the benchmark.  Where windows meet, the values behind the
placeholders must map one to one between item and document, or the alignment does not count.  Windows
of little but placeholders are compared with their values.  An item leaks into a document if the
windows that hold cover enough of its words.

Documents are scanned where they lie and nothing of them is shuffled.  The benchmark goes to the
tasks in blocks of bounded size; a benchmark larger than one block takes several scans.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Slice, slices, trimmed, windows

WINDOW = 8
MIN_LITERAL = 4
MIN_COVERED = 0.5
BLOCK_WORDS = 500_000
MAX_HITS = 1 << 20
# Units that count as such behind a number.
UNITS = (
    "% ° °c °f a amp amps bar bit bits byte bytes c cal cents cm cm2 cm3 day days db dollar dollars eur euro euros "
    "f feet foot ft g gal gb ghz gram grams h hour hours hr hrs hz in inch inches j k kb kcal kg khz kj km km/h km2 "
    "kw kwh l lb lbs liter liters litre litres m m/s m2 m3 ma mb meter meters metre metres mg mhz mile miles min mins "
    "minute minutes ml mm mol month months mph ms mw n nm ohm ohms oz pa percent pound pounds s sec second seconds t "
    "tb ton tons usd v volt volts w watt watts week weeks yard yards yd year years"
).split()

_EDGE = np.zeros(256, bool)
_EDGE[33:48] = _EDGE[58:65] = _EDGE[91:97] = _EDGE[123:127] = True
_EDGE[ord("%")] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[list(b".,:/-+")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA1, 0xA2, 0xA3))


@dataclass
class Templates:
    """Template words of the texts of a slice."""

    first_word: np.ndarray
    words: np.ndarray  # hash of the template word
    plain: np.ndarray  # hash of the word itself, in lower case
    slot: np.ndarray  # whether the template word is a placeholder
    source_word: np.ndarray  # number of the word in the slice


def _hash_of(words: list[str]) -> np.ndarray:
    part = next(slices(pa.array(words)))
    return np.sort(part.span_hashes(part.bounds[:-1], part.bounds[1:]))


_UNIT_HASHES = _hash_of(UNITS)


def templates(part: Slice) -> Templates:
    """Template words; words of punctuation alone are left out."""
    if len(part.starts) == 0:
        none = np.zeros(0, np.uint64)
        return Templates(part.first_word, none, none, np.zeros(0, bool), part.starts)
    data = part.data
    starts, ends = trimmed(part, _EDGE)
    keep = np.flatnonzero(starts < ends)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    between = lambda sums, a, b: sums[b] - sums[a]
    digits, numeric, breaks = total(_DIGIT[data]), total(_NUMERIC[data]), total(data == 10)
    a, b = starts[keep], ends[keep]
    low = part.lowered()
    low_a, low_b = trimmed(low, _EDGE)
    values = low.span_hashes(low_a[keep], low_b[keep])
    number = (between(digits, a, b) > 0) & (between(numeric, a, b) == b - a)
    # A sentence begins with a text, after a line break, and after a word that ends in a stop.
    text = part.text_of_word()
    opens = np.ones(len(part.starts), bool)
    same = text[1:] == text[:-1]
    opens[1:] = ~same | (between(breaks, part.ends[:-1], part.starts[1:]) > 0) | _STOP[data[part.ends[:-1] - 1]]
    head, second = data[a], data[np.minimum(a + 1, b - 1)]
    capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    small = (data >= 97) & (data <= 122) | (data >= 0x80)
    name = capital & (b - a > 1) & (between(total(small), a + 1, b) == b - a - 1) & ~opens[keep]
    behind = np.zeros(len(keep), bool)
    owner = text[keep]
    behind[1:] = number[:-1] & (owner[1:] == owner[:-1])
    at = np.minimum(np.searchsorted(_UNIT_HASHES, values), len(_UNIT_HASHES) - 1)
    unit = behind & (_UNIT_HASHES[at] == values)
    words = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, values)))
    slot = number | unit | name
    first = np.searchsorted(keep, part.first_word)
    return Templates(first, words, values, slot, keep)


def _window_hashes(made: Templates, size: int, min_literal: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows and each text's first; a window with few words besides placeholders keeps its values."""
    hashes, first = windows(made.words, made.first_word, size)
    count = np.diff(first)
    at = np.repeat(made.first_word[:-1] - first[:-1], count) + np.arange(first[-1])
    end = np.minimum(at + size, np.repeat(made.first_word[1:], count))
    literal = np.concatenate([[0], np.cumsum(~made.slot)])
    few = literal[end] - literal[at] < min_literal
    if few.any():
        hashes = np.where(few, windows(made.plain, made.first_word, size)[0], hashes)
    return hashes, first


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each ``first`` on, ``count`` of them, and the range that each is of."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner], owner


class Block:
    """Windows of some benchmark items, in the order of their hashes."""

    def __init__(self, ids: list[int], texts: list[str], window: int, min_literal: int):
        self.ids, self.window, self.min_literal = ids, window, min_literal
        parts, plain, slot, lengths = defaultdict(list), [], [], []
        for part in slices(pa.array(texts, pa.string())):
            made = templates(part)
            plain.append(made.plain)
            slot.append(made.slot)
            for i in range(part.n_texts):
                a, b = made.first_word[i], made.first_word[i + 1]
                item, size = part.first + i, min(window, int(b - a))
                lengths.append(int(b - a))
                if size:
                    own = Templates(np.array([0, b - a]), made.words[a:b], made.plain[a:b], made.slot[a:b], made.source_word[a:b])
                    hashes, _ = _window_hashes(own, size, min_literal)
                    parts[size].append((hashes, np.full(len(hashes), item), np.arange(len(hashes))))
        self.plain, self.slot = np.concatenate(plain), np.concatenate(slot)
        self.lengths = np.array(lengths)
        self.first_word = np.concatenate([[0], np.cumsum(self.lengths)])
        self.by_size = {}
        for size, found in parts.items():
            hashes, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            filled = np.zeros(1 << 20, bool)
            filled[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = hashes[order], item[order], place[order], filled

    def leaks(self, part: Slice, min_covered: float) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, item, covered words of the item, first and last word in the text."""
        made = templates(part)
        lengths = np.diff(made.first_word)
        found = []
        for size, (hashes, item, place, filled) in self.by_size.items():
            own, first = _window_hashes(made, size, self.min_literal)
            maybe = np.flatnonzero(filled[(own >> np.uint64(44)).astype(np.int64)])
            text = np.searchsorted(first, maybe, "right") - 1
            whole = lengths[text] >= size
            maybe, text = maybe[whole], text[whole]
            lo = np.searchsorted(hashes, own[maybe], "left")
            count = np.searchsorted(hashes, own[maybe], "right") - lo
            # Texts go on together as long as their hits are few; those of one text stay together.
            group = np.cumsum(count) // MAX_HITS
            group = group[np.searchsorted(text, text)] if len(text) else group
            for g in np.unique(group[count > 0]):
                here = (group == g) & (count > 0)
                at, owner = _ranges(lo[here], count[here])
                shift = (maybe - first[text])[here][owner] - place[at]
                found += self._covered(made, text[here][owner], item[at], shift, place[at], size, min_covered)
        for text, item, covered, a, b in sorted(found):
            words = made.source_word[made.first_word[text] + np.array([a, b])] - part.first_word[text]
            yield text, item, covered, int(words[0]), int(words[1])

    def _covered(
        self, made: Templates, text: np.ndarray, item: np.ndarray, shift: np.ndarray, place: np.ndarray, size: int,
        min_covered: float,
    ) -> list[tuple[int, int, int, int, int]]:
        """Text, item, covered words, first and last template word, from windows that meet."""
        order = np.lexsort((place, shift, item, text))
        text, item, shift, place = text[order], item[order], shift[order], place[order]
        # Words that a window adds to those of the window before it in the same alignment.
        new = _starts(text, item, shift)
        begin = place.copy()
        begin[1:] = np.where(new[1:], place[1:], np.maximum(place[1:], place[:-1] + size))
        alignment = np.cumsum(new) - 1
        at, hit = _ranges(begin, place + size - begin)
        fits = _one_to_one(
            alignment[hit], self.first_word[item[hit]] + at, made.first_word[text[hit]] + at + shift[hit], self, made
        )
        keep = fits[alignment[hit]]
        at, hit = at[keep], hit[keep]
        if not len(at):
            return []
        text, item, there = text[hit], item[hit], at + shift[hit]
        order = np.lexsort((at, item, text))
        text, item, at, there = text[order], item[order], at[order], there[order]
        heads = np.flatnonzero(_starts(text, item))
        covered = np.add.reduceat(_starts(text, item, at).astype(np.int64), heads)
        low, high = np.minimum.reduceat(there, heads), np.maximum.reduceat(there, heads)
        rows = zip(text[heads], item[heads], covered, low, high, strict=True)
        return [tuple(map(int, r)) for r in rows if r[2] >= min_covered * self.lengths[r[1]]]


def _one_to_one(
    alignment: np.ndarray, item_word: np.ndarray, text_word: np.ndarray, block: Block, made: Templates
) -> np.ndarray:
    """For each alignment, whether the values in its slots map one to one."""
    n = int(alignment[-1]) + 1
    slot = block.slot[item_word]
    alignment, x, y = alignment[slot], block.plain[item_word[slot]], made.plain[text_word[slot]]
    order = np.lexsort((y, x, alignment))
    alignment, x, y = alignment[order], x[order], y[order]
    pair = _starts(alignment, x, y)
    left = np.bincount(alignment[_starts(alignment, x)], minlength=n)
    alignment, y = alignment[pair], y[pair]
    pairs = np.bincount(alignment, minlength=n)
    order = np.lexsort((y, alignment))
    right = np.bincount(alignment[order][_starts(alignment[order], y[order])], minlength=n)
    return (pairs == left) & (pairs == right)


def _blocks(benchmark: DataFrame, window: int, min_literal: int) -> Iterator[Block]:
    ids, texts, words = [], [], 0
    for row in benchmark.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        words += len(row[1].split())
        if words >= BLOCK_WORDS:
            yield Block(ids, texts, window, min_literal)
            ids, texts, words = [], [], 0
    if ids:
        yield Block(ids, texts, window, min_literal)


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_literal: int = MIN_LITERAL,
    min_covered: float = MIN_COVERED,
) -> DataFrame:
    """Pairs of a document and a benchmark item that leaks into it.

    Returns ``id``, ``item``, ``item_words``, ``covered_words`` and the word numbers ``first_word``
    and ``last_word`` of the passage.  An item with fewer than ``window`` words counts as one window
    of its own length.  A window with fewer than ``min_literal`` words besides placeholders meets only the
    same words, values included: "42" or "in Paris" says nothing about "7" or "in Rome".

    Null or empty texts on either side leak nothing; items without id are left out; a document
    without id gives rows with a null id.  Repeated documents give one row each, a repeated item one
    row with its best cover.  An empty table on either side gives an empty result.  Extra columns
    are ignored.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = (
        benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
        .filter("item is not null and text is not null")
        .distinct()
    )
    schema = "id long, item long, item_words long, covered_words long, first_word long, last_word long"

    def scan(block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for part in slices(batch.column(1)):
                    best = {}
                    for text, item, covered, a, b in block.leaks(part, min_covered):
                        key = text, block.ids[item]
                        row = (covered / block.lengths[item], block.lengths[item], covered, a, b)
                        best[key] = max(best.get(key, row), row)
                    rows = [(ids[part.first + t].as_py(), i, *r[1:]) for (t, i), r in best.items()]
                    columns = list(zip(*rows, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns],
                        ["id", "item", "item_words", "covered_words", "first_word", "last_word"],
                    )

        return source.mapInArrow(run, schema)

    found = None
    for block in _blocks(items, window, min_literal):
        found = scan(block) if found is None else found.union(scan(block))
    return source.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_literal: int = MIN_LITERAL,
    min_covered: float = MIN_COVERED,
) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks, columns unchanged.

    Texts are judged where the rows lie; nothing is shuffled.  Null and empty texts stay.
    """
    items = (
        benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
        .filter("text is not null")
        .distinct()
    )

    def clean(block: Block):
        def run(texts: pa.Array) -> pa.Array:
            out = np.ones(len(texts), bool)
            for part in slices(texts):
                for text, *_ in block.leaks(part, min_covered):
                    out[part.first + text] = False
            return pa.array(out)

        return F.arrow_udf(run, "boolean")

    for block in _blocks(items, window, min_literal):
        docs = docs.filter(clean(block)(F.col(f"`{text_col}`").cast("string")))
    return docs
