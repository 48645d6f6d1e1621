"""Periodic runs of words: block convolution at dyadic scales.

A run of period ``q`` and at least ``3 * q`` words holds, for ``B <= q < 2 * B``, a whole aligned block of
``B`` words that comes again ``q`` words later inside the run: the block begins less than ``B`` words behind
the run's start, and ``2 * B - 1 + q <= 3 * q``.  With at least 24 words, blocks of 8 words serve all periods
up to 15.  So at every scale ``B = 8, 16, 32, ...`` each block is compared with the window of following
words that holds the distances ``B .. 2 * B - 1`` (``1 .. 15`` at the first scale).  The sum of squared
differences of word numbers at all distances is one exact integer convolution, done modulo as many
primes as its largest value needs; a distance is a match where it is zero.  Blocks with a word that
does not come again in its window cannot match and are left out before.

Matches are seeds.  Neighbouring blocks with one distance are one seed; it is extended left and right as
far as words ``distance`` apart agree, by binary search on prefix sums modulo two primes.  The same
stretch is found again at multiples of its period; its smallest distance stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .convolve import LARGEST, PRIMES, powers, primes_for, squared_differences
from .words import Slice, mix, slices

SMALLEST = 8
LEAST_WORDS = 24
LEAST_PERIODS = 3
NUMBERS_AT_ONCE = 1 << 19


class _Words:
    """Numbers of the words of some texts side by side, and where each word comes again."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.first = first
        self.n = len(hashes)
        self.end = np.repeat(first[1:], np.diff(first))
        code = np.unique(hashes, return_inverse=True)[1].reshape(-1) + 1
        self.code = code.astype(np.int64)
        self.places = np.sort(self.code * self.n + np.arange(self.n)) if self.n else self.code
        self._sums: list[tuple[int, np.ndarray, np.ndarray]] = []

    def recur(self, at: np.ndarray, least: int, most: int) -> np.ndarray:
        """Whether the words at ``at`` come again ``least`` to ``most`` words later in their text."""
        own = self.code[at] * self.n
        k = np.searchsorted(self.places, own + at + least)
        found = self.places[np.minimum(k, self.n - 1)]
        return (k < self.n) & (found <= own + np.minimum(at + most, self.end[at] - 1))

    def agree(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from ``i`` and from ``j > i`` are the same."""
        if not self._sums:
            for p in list(PRIMES)[:2]:
                base = int(mix(np.array([p], np.uint64))[0] % np.uint64(p))
                power = powers(base, self.n + 1, p)
                values = mix(self.code.astype(np.uint64)) % np.uint64(p)
                sums = np.zeros(self.n + 1, np.uint64)
                np.cumsum(values * power[:-1] % np.uint64(p), out=sums[1:])
                self._sums.append((p, sums % np.uint64(p), power))
        same = np.ones(len(i), bool)
        for p, sums, power in self._sums:
            mod = np.uint64(p)
            a = (sums[i + length] + (mod - sums[i])) % mod
            b = (sums[j + length] + (mod - sums[j])) % mod
            same &= a * power[j - i] % mod == b
        return same

    def furthest(self, most: np.ndarray, agree) -> np.ndarray:
        """The largest length up to ``most`` for which ``agree`` holds; it holds for all shorter ones."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = agree(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _blocks(words: _Words, size: int, least: int, most: int) -> np.ndarray:
    """First words of the aligned blocks all of whose words come again at such a distance."""
    n = np.diff(words.first)
    count = np.where(n >= max(LEAST_WORDS, LEAST_PERIODS * least), np.maximum((n - size - least) // size + 1, 0), 0)
    before = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(words.first[:-1] - before[:-1] * size, count) + np.arange(before[-1]) * size
    step = size
    while len(at) and step:
        # First word 0, then the middle, then the quarters: most blocks leave at once.
        offsets = np.array([0]) if step == size else np.arange(step, size, 2 * step)
        keep = np.ones(len(at), bool)
        each = max(1, NUMBERS_AT_ONCE // len(offsets))
        for k in range(0, len(at), each):
            own = at[k : k + each, None] + offsets
            keep[k : k + each] = words.recur(own.ravel(), least, most).reshape(own.shape).all(axis=1)
        at, step = at[keep], step // 2
    return at


def _matches(words: _Words, at: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and distances at which they come again without a mismatch."""
    wide = size + most - least
    primes = primes_for(size * int(words.code.max()) ** 2) if len(at) else []
    blocks, distances = [at[:0]], [at[:0]]
    each = max(1, NUMBERS_AT_ONCE // wide)
    for k in range(0, len(at), each):
        own = at[k : k + each]
        left = words.code[own[None, :] + np.arange(size)[:, None]].astype(np.uint64)
        place = own[None, :] + np.arange(least, least + wide)[:, None]
        inside = place < words.end[own][None, :]
        right = np.where(inside, words.code[np.minimum(place, words.n - 1)], 0).astype(np.uint64)
        zero = np.ones((wide - size + 1, len(own)), bool)
        for p in primes:
            zero &= squared_differences(left, right, p) == 0
        shift, block = np.nonzero(zero)
        blocks.append(own[block])
        distances.append(shift + least)
    return np.concatenate(blocks), np.concatenate(distances)


def find_runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of all runs, by text, start and period.

    ``hashes`` are the words of texts side by side, ``first`` the bounds of the texts.
    """
    words = _Words(hashes, first)
    found = [np.zeros((4, 0), np.int64)]
    size, longest = SMALLEST, int(np.diff(first).max(initial=0))
    while size == SMALLEST or LEAST_PERIODS * size <= longest:
        if 2 * size > LARGEST:
            raise ValueError("a text has too many words")
        least, most = (1, 2 * size - 1) if size == SMALLEST else (size, 2 * size - 1)
        at, apart = _matches(words, _blocks(words, size, least, most), size, least, most)
        text = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((at, apart))
        at, apart, text = at[order], apart[order], text[order]
        goes_on = (apart[1:] == apart[:-1]) & (at[1:] == at[:-1] + size) & (text[1:] == text[:-1])
        lead = np.concatenate([[True], ~goes_on]) if len(at) else np.zeros(0, bool)
        at, apart, text = at[lead], apart[lead], text[lead]
        right = words.furthest(first[text + 1] - at - apart, lambda n: words.agree(at, at + apart, n))
        left = words.furthest(at - first[text], lambda n: words.agree(at - n, at + apart - n, n))
        start, length = at - left, left + right + apart
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * apart)
        found.append(np.stack([text[long], start[long] - first[text[long]], length[long], apart[long]]))
        size *= 2
    text, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = (x[new] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return tuple(x[order] for x in (text, start, length, period))


def _strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> dict:
    """The run with the greatest length / period; of several the first, then the shortest period."""
    rows = zip(start.tolist(), length.tolist(), period.tolist(), strict=True)
    s, n, q = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return {"start": s, "length": n, "period": q}


def _joined(part: Slice, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    starts, ends = part.starts[keep], part.ends[keep]
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(keep)])[part.first_word]
    place = np.cumsum(size + 1) - size - 1
    data = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(place, size) + word] = part.data[np.repeat(starts, size) + word]
    bounds = np.append(place, len(data))[first]
    ends = np.where(np.diff(first) > 0, bounds[1:] - 1, bounds[:-1])  # without the space behind the last word
    lengths = ends - bounds[:-1]
    # Close the gaps of one byte between texts.
    mask = np.ones(len(data), bool)
    mask[ends[np.diff(first) > 0]] = False
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(part.n_texts, pa.py_buffer(offsets), pa.py_buffer(data[mask]))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All periodic runs of words, and the texts without the repeats.

    Returns one row per row of ``docs``: ``id``, ``n_words``, ``runs`` (``start``, ``length`` and ``period`` in
    words, by start and period), ``strongest`` (the run with the greatest length / period; of several the
    first, then the one of the shortest period; null without a run) and ``collapsed``: the words that no
    run contains behind its first period, joined by one space.

    Words are runs outside ASCII white space, compared as they stand.  A run is a stretch of words
    whose smallest period is ``period``, of at least 24 words and three periods, that cannot be
    extended.  A null, empty or blank text has no words, no runs and an empty ``collapsed``.  Nothing
    depends on ids, which may be null or repeat; repeated rows stay.  Extra columns are ignored.  An
    empty table gives an empty result.  Memory is in proportion to the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                text, start, length, period = find_runs(part.word_hashes(), part.first_word)
                bounds = np.searchsorted(text, np.arange(part.n_texts + 1))
                steps = np.zeros(len(part.starts) + 1, np.int64)
                np.add.at(steps, part.first_word[text] + start + period, 1)
                np.add.at(steps, part.first_word[text] + start + length, -1)
                strongest = [
                    _strongest(start[a:b], length[a:b], period[a:b]) if a < b else None
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                ]
                rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.n_texts),
                        pa.array(part.n_words.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows),
                        pa.array(strongest, RUN),
                        _joined(part, np.cumsum(steps)[:-1] == 0),
                    ],
                    ["id", "n_words", "runs", "strongest", "collapsed"],
                )

    fields = "struct<start:bigint,length:bigint,period:bigint>"
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(
        run, f"id {id_type}, n_words long, runs array<{fields}>, strongest {fields}, collapsed string"
    )
