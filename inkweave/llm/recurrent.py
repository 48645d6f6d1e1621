"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: one by its hash, one as the mean over its character trigrams.  Two
gated recurrent layers read a window of words forwards and backwards; attention weighs the states;
one logit comes out.  The model is trained on documents as bags of windows: a document is as
toxic as its worst window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import Slice, mix, slices

WIDTH = 8
HIDDEN = 8
WORD_BUCKETS = 1 << 13
TRIGRAM_BUCKETS = 1 << 13
TRIGRAM_BLOCK = 1 << 16
WORD_BLOCK = 1 << 13
GATES = 3 * HIDDEN
DECAY = 0.5
DROPPED_WORDS = 0.6
DROPPED_TRIGRAMS = 0.1

_EDGE = np.zeros(256, bool)
_EDGE[33:48] = _EDGE[58:65] = _EDGE[91:97] = _EDGE[123:127] = True


@dataclass
class Lexicon:
    """Distinct words of some texts: word bucket and trigram buckets of each."""

    bucket: np.ndarray
    trigrams: np.ndarray
    first: np.ndarray  # where the trigrams of each word begin


def without_edges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of words without the punctuation around them; a word of nothing else keeps its first mark."""
    inner = np.append(np.flatnonzero(~_EDGE[data]), len(data))
    first = inner[np.searchsorted(inner, starts)]
    last = inner[np.searchsorted(inner, ends) - 1]  # a number before the start, or none, where all are marks
    some = first < ends
    return np.where(some, first, starts), np.where(some, last + 1, starts + 1)


def lexicon(part: Slice) -> tuple[Lexicon, np.ndarray]:
    """The distinct lower-case words of a slice, and which of them each word is."""
    low = part.lowered()
    starts, ends = low.starts.copy(), low.ends.copy()
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Lexicon(none, none, np.zeros(1, np.int64)), none
    starts, ends = without_edges(low.data, starts, ends)
    hashes, sample, which = np.unique(low.span_hashes(starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[sample], ends[sample]
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(first[-1]) + (starts - first[:-1])[owner]
    here = low.data[at]
    before, after = np.ones(len(at), np.uint8), np.ones(len(at), np.uint8)
    before[1:] = here[:-1]
    after[:-1] = here[1:]
    before[first[:-1]] = 1
    after[first[1:] - 1] = 1
    trigrams = np.empty(len(at), np.uint64)
    for a in range(0, len(at), TRIGRAM_BLOCK):
        x, y, z = (c[a : a + TRIGRAM_BLOCK].astype(np.uint64) for c in (before, here, after))
        trigrams[a : a + TRIGRAM_BLOCK] = mix((x << np.uint64(16)) | (y << np.uint64(8)) | z) % np.uint64(TRIGRAM_BUCKETS)
    bucket = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
    return Lexicon(bucket, trigrams.view(np.int64), first), which


def _lexicon_of(texts: list[str]) -> tuple[Lexicon, np.ndarray, np.ndarray]:
    """A lexicon of all texts, the word of each place, and the number of words of each text.

    The texts are read in slices, for hashing takes some tens of bytes for each of theirs; a word of
    several slices is there several times.
    """
    parts, which, counts, n = [], [], [], 0
    for part in slices(pa.array(texts, pa.string()), 1 << 20):
        words, own = lexicon(part)
        parts.append(words)
        which.append(own + n)
        counts.append(part.n_words)
        n += len(words.bucket)
    sizes = np.concatenate([np.diff(p.first) for p in parts])
    words = Lexicon(
        np.concatenate([p.bucket for p in parts]), np.concatenate([p.trigrams for p in parts]), np.concatenate([[0], np.cumsum(sizes)])
    )
    return words, np.concatenate(which), np.concatenate(counts)


def window_starts(n: int, length: int, stride: int) -> np.ndarray:
    """First words of overlapping windows that cover all of ``n`` words; the last ends with them."""
    if n <= length:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - length, stride), n - length)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """The parameters and what is computed with them."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        self.p = {
            "words": normal(0.3, WORD_BUCKETS, WIDTH),
            "trigrams": normal(0.5, TRIGRAM_BUCKETS, WIDTH),
            "inputs": normal(0.25, 2 * WIDTH, 2 * GATES),
            "bias": np.zeros(2 * GATES, np.float32),
            "forward": normal(0.25, HIDDEN, GATES),
            "backward": normal(0.25, HIDDEN, GATES),
            "attention": normal(0.3, 2 * HIDDEN),
            "output": normal(0.3, 2 * HIDDEN),
            "offset": np.full(1, -2.0, np.float32),
        }

    def vectors(self, words: Lexicon) -> np.ndarray:
        size = np.maximum(np.diff(words.first), 1).astype(np.float32)
        total = np.zeros((len(words.bucket), WIDTH), np.float32)
        full = np.flatnonzero(np.diff(words.first))
        # The vectors of all trigrams take many times the text, so they are looked up for some words at a time.
        for a in range(0, len(full), WORD_BLOCK):
            own = full[a : a + WORD_BLOCK]
            begin = words.first[own[0]]
            trigrams = words.trigrams[begin : words.first[own[-1] + 1]]
            total[own] = np.add.reduceat(self.p["trigrams"][trigrams], words.first[own] - begin, axis=0)
        return np.concatenate([self.p["words"][words.bucket], total / size[:, None]], axis=1)

    def _layer(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> list[np.ndarray]:
        """States of one direction; ``x`` is (steps, windows, gates)."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = []
        for step, m in zip(x, mask, strict=True):
            a = h @ u
            zr = _sigmoid(step[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = 2 * _sigmoid(2 * (step[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])) - 1  # tanh, by the faster exp
            new = n + z * (h - n)
            if not m.all():
                new = np.where(m[:, None], new, h)
            if keep is not None:
                keep.append((h, z, r, n, a[:, 2 * HIDDEN :], m))
            h = new
            out.append(h)
        return out

    def logits(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit per window; ``ids`` and ``mask`` are (windows, steps), ``gates`` by word."""
        order, m = ids.T, mask.T
        kept = ([], []) if keep is not None else (None, None)
        there = self._layer(gates[:, :GATES][order], m, self.p["forward"], kept[0])
        back = self._layer(gates[:, GATES:][order[::-1]], m[::-1], self.p["backward"], kept[1])
        states = np.concatenate([np.stack(there), np.stack(back[::-1])], axis=2)
        weight = np.where(m, states @ self.p["attention"], -1e9).astype(np.float32)
        weight -= weight.max(axis=0)
        weight = np.where(m, np.exp(weight), 0)
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if keep is not None:
            keep |= {"states": states, "weight": weight, "pooled": pooled, "layers": kept, "mask": m}
        return pooled @ self.p["output"] + self.p["offset"][0]

    def gates(self, words: Lexicon, vectors: np.ndarray | None = None) -> np.ndarray:
        x = self.vectors(words) if vectors is None else vectors
        return x @ self.p["inputs"] + self.p["bias"]

    def _layer_back(self, grad: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        du = np.zeros_like(u)
        dh = np.zeros_like(grad[0])
        dx = np.zeros((*grad.shape[:2], GATES), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, n, an, m = kept[t]
            d = dh + grad[t]
            own = np.where(m[:, None], d, 0)
            dn = own * (1 - z) * (1 - n * n)
            dz = own * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ da
            dh = np.where(m[:, None], own * z, d) + da @ u.T
        return dx, du

    def gradients(
        self, words: Lexicon, ids: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray,
        keep_inputs: np.ndarray | float = 1.0,
    ):
        """Gradients of the weighted logistic loss over windows; ``keep_inputs`` blanks inputs of words."""
        vectors = self.vectors(words) * keep_inputs
        keep: dict = {}
        logit = self.logits(self.gates(words, vectors), ids, mask, keep)
        error = (weight * (1 / (1 + np.exp(-logit)) - target)).astype(np.float32)
        states, alpha, pooled, m = keep["states"], keep["weight"], keep["pooled"], keep["mask"]
        dpooled = error[:, None] * self.p["output"]
        dstates = alpha[:, :, None] * dpooled[None]
        score = np.einsum("tbh,bh->tb", states, dpooled)
        dalpha = alpha * (score - (alpha * score).sum(axis=0))
        dstates += dalpha[:, :, None] * self.p["attention"]
        g = {
            "output": pooled.T @ error,
            "offset": error.sum(keepdims=True),
            "attention": np.einsum("tb,tbh->h", dalpha, states),
        }
        dthere, g["forward"] = self._layer_back(dstates[:, :, :HIDDEN], keep["layers"][0], self.p["forward"])
        dback, g["backward"] = self._layer_back(dstates[::-1, :, HIDDEN:], keep["layers"][1], self.p["backward"])
        each = np.concatenate([dthere, dback[::-1]], axis=2)[m]
        which = ids.T[m]
        dgates = np.zeros((len(words.bucket), 2 * GATES), np.float32)
        np.add.at(dgates, which, each)
        g["inputs"], g["bias"] = vectors.T @ dgates, dgates.sum(axis=0)
        dx = dgates @ self.p["inputs"].T * keep_inputs
        g["words"] = np.zeros_like(self.p["words"])
        np.add.at(g["words"], words.bucket, dx[:, :WIDTH])
        size = np.diff(words.first)
        g["trigrams"] = np.zeros_like(self.p["trigrams"])
        np.add.at(g["trigrams"], words.trigrams, np.repeat(dx[:, WIDTH:] / np.maximum(size, 1)[:, None], size, axis=0))
        return g, logit


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)
            if k in ("words", "trigrams"):
                self.p[k] *= 1 - self.rate * DECAY


def _part_of(words: Lexicon, ids: np.ndarray) -> tuple[Lexicon, np.ndarray]:
    """The words that occur in ``ids`` as a lexicon of their own, and the ids in it."""
    used, new = np.unique(ids, return_inverse=True)
    size = np.diff(words.first)[used]
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(words.first[used], size)
    return Lexicon(words.bucket[used], words.trigrams[at], first), new.reshape(ids.shape)


def score_windows(net: Network, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, block: int = 1024) -> np.ndarray:
    parts = [net.logits(gates, ids[a : a + block], mask[a : a + block]) for a in range(0, len(ids), block)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def _loss(logit: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
    """Weighted mean of the logistic loss."""
    return float((weight * np.logaddexp(0, np.where(target > 0, -logit, logit))).sum() / weight.sum())


def train(
    windows: list[list[str]], labels: list[int], length: int, epochs: int = 14, batch: int = 128, updates: int = 500,
    rate: float = 0.02, seed: int = 5, held_back: float = 0.2,
) -> tuple[Network, float]:
    """Fit a network on documents given as lists of windows (words joined by blanks); also its loss.

    Each turn scores all windows, takes the worst of every document and, of clean documents, a
    random one besides, and learns from these.  In the first turns toxic documents give a random
    window too, so that words of all windows get a chance.  Few documents get more turns than
    ``epochs``, up to four times as many, for about ``updates`` steps.

    A part of the documents, ``held_back`` of each kind, is not learned from: the network after the
    turn with the least loss on them is returned.  With fewer than ten of a kind all are learned from.
    """
    rng = np.random.default_rng(seed)
    net = Network(seed)
    flat = [w for ws in windows for w in ws]
    doc = np.repeat(np.arange(len(windows)), [len(ws) for ws in windows])
    words, which, n_words = _lexicon_of(flat)
    first_word = np.cumsum(n_words) - n_words
    n = np.minimum(n_words, length)
    place = np.arange(length)
    mask = place < n[:, None]
    ids = np.where(mask, which[np.minimum(first_word[:, None] + place, max(len(which) - 1, 0))], 0)
    labels = np.asarray(labels, np.float32)
    count = np.bincount(doc, minlength=len(windows))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    share = labels.mean()
    by_class = np.where(labels > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) ** 0.5
    judge = np.zeros(len(labels), bool)
    for kind in (0, 1):
        own = np.flatnonzero(labels == kind)
        # The same ones whatever the seed, so that the losses of several fits can be compared.
        judge[np.random.default_rng(kind).permutation(own)[: int(held_back * len(own)) if len(own) >= 10 else 0]] = True
    if len(np.unique(labels[judge])) < 2:
        judge[:] = False
    learn = ~judge
    adam = Adam(net.p, rate)
    epochs = max(epochs, min(4 * epochs, updates * batch // max(2 * int(learn.sum()), 1)))
    best, least = None, np.inf
    for epoch in range(epochs + 1):
        logit = score_windows(net, net.gates(words), ids, mask)
        order = np.lexsort((-logit, doc))
        worst = order[first]
        against = judge if judge.any() else learn
        loss = _loss(logit[worst][against], labels[against], by_class[against])
        if epoch >= epochs // 4 and loss < least:
            best, least = {k: v.copy() for k, v in net.p.items()}, loss
        if epoch == epochs:
            break
        random = first + (rng.random(len(count)) * count).astype(np.int64)
        chosen = np.concatenate([worst[learn], random[learn & ((labels == 0) | (epoch < 3))]])
        rng.shuffle(chosen)
        adam.rate = rate * (1 - 0.8 * epoch / epochs)
        for a in range(0, len(chosen), batch):
            c = chosen[a : a + batch]
            own, local = _part_of(words, ids[c])
            y = labels[doc[c]]
            # A word is often known by its letters alone, so that it is not learned by heart.
            kept = rng.random((len(own.bucket), 2)) >= [DROPPED_WORDS, DROPPED_TRIGRAMS]
            kept = np.repeat(kept, WIDTH, axis=1).astype(np.float32)
            grads, _ = net.gradients(own, local, mask[c], y, by_class[doc[c]].astype(np.float32) / len(c), kept)
            adam.step(grads)
    net.p = best
    return net, least
