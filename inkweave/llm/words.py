"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 never uses these bytes inside
a character, so byte runs are character runs.  All work is vectorised over slices of a few
megabytes of text; only a single text longer than that makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Each slice position gets a power of an odd number; odd numbers have an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]


_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


@dataclass
class Slice:
    """Some whole texts side by side: bytes, text bounds, word bounds, first word of each text."""

    first: int
    texts: pa.Array
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first_word: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.bounds) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.n_words)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """64-bit hash of each byte span; equal spans have equal hashes everywhere."""
        values = (_FOLDED_VALUES if fold else _BYTE_VALUES)[self.data]
        n = len(self.data)
        with np.errstate(over="ignore"):
            # The power of a position is that of its block times that of its place in the block.
            for a in range(0, n, _BLOCK):
                own = values[a : a + _BLOCK]
                own *= _POWERS[: len(own)] * np.uint64(pow(_BASE, a, 1 << 64))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            del values
            blocks = _powers(pow(_INVERSE, _BLOCK, 1 << 64), n // _BLOCK + 1)
            found = (sums[ends] - sums[starts]) * blocks[starts // _BLOCK] * _INVERSES[starts % _BLOCK]
        return mix(found + (ends - starts).astype(np.uint64))

    def word_hashes(self, fold: bool = False) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends, fold)

    def lowered(self) -> Slice:
        """The same texts in lower case (all scripts); words keep their numbers."""
        return next(slices(pc.utf8_lower(self.texts), 1 << 62))

    def code_points(self) -> np.ndarray:
        """Number of characters before each byte position, with one more at the end."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of each text; null is empty."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    raw = large.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, bounds


def slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES, inside: np.ndarray = ~SPACE) -> Iterator[Slice]:
    """Cut a text column into slices of whole texts and find their words, runs of bytes that are ``inside``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, bounds = bytes_of(texts)
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + slice_bytes, "right")) - 1
        to = min(max(to, at + 1), n)
        own = bounds[at : to + 1] - bounds[at]
        part = data[bounds[at] : bounds[to]]
        word = inside[part]
        before = np.zeros(len(part) + 1, bool)
        before[1:] = word
        before[own] = False  # a text begins anew, also right behind another
        starts = np.flatnonzero(word & ~before[:-1])
        after = np.zeros(len(part) + 1, bool)
        after[:-1] = word
        after[own] = False
        ends = np.flatnonzero(word & ~after[1:]) + 1
        yield Slice(at, texts.slice(at, to - at), part, own, starts, ends, np.searchsorted(starts, own))
        at = to


def trimmed(part: Slice, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without the bytes of ``edge`` at either end; a word of nothing else is empty."""
    inner = np.append(np.flatnonzero(~edge[part.data]), len(part.data))
    starts = np.minimum(inner[np.searchsorted(inner, part.starts)], part.ends)
    last = inner[np.searchsorted(inner, part.ends) - 1]
    return starts, np.where(starts < part.ends, last + 1, part.ends)


def windows(words: np.ndarray, first_word: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``q``-word windows and the number of each text's first one.

    A text with fewer than ``q`` words, but at least one, has its whole sequence as one window.
    """
    n = np.diff(first_word)
    count = np.where(n >= q, n - q + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first_word[:-1] - first[:-1], count) + np.arange(first[-1])
    size = np.minimum(n, q)
    length = np.repeat(size, count)
    with np.errstate(over="ignore"):
        acc = length.astype(np.uint64)
        for j in range(q):
            more = mix(acc + words[np.minimum(at + j, len(words) - 1)]) if len(words) else acc
            acc = np.where(j < length, more, acc) if (size < q).any() else more
    return acc, first


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and where each text begins."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (
        np.concatenate(parts) if parts else values[:0],
        np.concatenate([[0], np.cumsum(sizes)]),
    )


def cut(array: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [array[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
