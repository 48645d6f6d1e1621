"""Token ids of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from .words import SPACE, Slice, bytes_of, cut, slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space beyond ASCII; texts with any of it are encoded as they are, not piece by piece.
_OTHER_SPACE = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def end_token(path: str) -> int:
    """The first id that no piece of the vocabulary has; it ends a document."""
    return encoding(path).max_token_value + 1


class Tokenizer:
    """Encodes slices of texts.

    A piece is a run of white space with the word behind it.  The split pattern never crosses from
    a word into white space, so the ids of a text are those of its pieces, one after another, and
    each distinct piece of a slice is encoded once, all in one call.
    """

    def __init__(self, path: str):
        self.encoding = encoding(path)
        self.end = end_token(path)
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.n_bytes = np.array(
            [len(self.encoding.decode_single_token_bytes(i)) for i in range(self.end)], np.int64
        )

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)

    def encode(self, part: Slice) -> list[np.ndarray]:
        """The ids of each text of a slice, without an end token."""
        odd = pc.match_substring_regex(part.texts, _OTHER_SPACE).fill_null(False)
        texts = part.texts
        if odd.true_count:
            own = pc.if_else(odd, pa.scalar("", texts.type), texts)
            part = next(slices(own, 1 << 62))
        out = self._by_piece(part)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = self._plain(texts[i].as_py())
        return out

    def _by_piece(self, part: Slice) -> list[np.ndarray]:
        if len(part.data) == 0:
            return [np.zeros(0, self.dtype)] * part.n_texts
        space = SPACE[part.data]
        # A piece begins where white space follows a word, and with every text.
        opens = np.zeros(len(part.data) + 1, bool)
        opens[1:-1] = space[1:] & ~space[:-1]
        opens[part.bounds] = True
        cuts = np.flatnonzero(opens)
        data = pa.py_buffer(np.ascontiguousarray(part.data))
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
        distinct, bounds = bytes_of(coded.dictionary)
        # Pieces at the edges of texts may not stand in a row with others.
        regular = SPACE[distinct[bounds[:-1]]] & ~SPACE[distinct[bounds[1:] - 1]]
        row = self._plain("".join(coded.dictionary.filter(pa.array(regular)).to_pylist()))
        ends = np.cumsum(self.n_bytes[row])
        stops = np.concatenate([[0], np.cumsum(np.diff(bounds)[regular])])
        at = np.searchsorted(ends, stops, "left") + 1
        at[0] = 0
        edge = [self._plain(p) for p in coded.dictionary.filter(pa.array(~regular)).to_pylist()]
        flat = np.concatenate([row, *edge])
        sizes = np.zeros(len(regular), np.int64)
        sizes[regular] = np.diff(at)
        sizes[~regular] = [len(e) for e in edge]
        first = np.zeros(len(regular), np.int64)
        first[regular] = at[:-1]
        first[~regular] = len(row) + np.cumsum([0, *map(len, edge)])[:-1]
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = sizes[which]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(first[which] - before[:-1], count) + np.arange(before[-1])]
        return cut(ids, before[np.searchsorted(cuts, part.bounds)])
