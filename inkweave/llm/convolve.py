"""Exact integer convolution modulo primes that have roots of unity of large two-power orders."""

from __future__ import annotations

import numpy as np

# Primes of the form c * 2**k + 1 with k >= 26, and a generator of each.
PRIMES = {2013265921: 31, 1811939329: 13, 469762049: 3}
LARGEST = 1 << 26


def primes_for(bound: int) -> list[int]:
    """As many of the primes as it takes for their product to exceed ``bound``."""
    out, product = [], 1
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > bound:
            return out
    raise ValueError("the numbers are too large for exact convolution")


def powers(base: int, n: int, p: int) -> np.ndarray:
    """``base**i`` modulo ``p`` for ``i < n``, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base % p)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step % np.uint64(p)
        step = step * step % np.uint64(p)
        done *= 2
    return out[:n]


def _reduced(x: np.ndarray, p: np.uint64) -> np.ndarray:
    """``x`` modulo ``p`` for ``x < 2 * p``: below ``p`` the difference wraps to a large number."""
    return np.minimum(x, x - p)


def transform(x: np.ndarray, p: int) -> np.ndarray:
    """Number-theoretic transform along the first axis (a power of two), in bit-reversed order."""
    size, mod = len(x), np.uint64(p)
    root = pow(PRIMES[p], (p - 1) // size, p)
    half = size // 2
    while half:
        pairs = x.reshape(size // (2 * half), 2, half, -1)
        low, high = pairs[:, 0], pairs[:, 1]
        out = np.empty_like(pairs)
        out[:, 0] = _reduced(low + high, mod)
        out[:, 1] = (low + (mod - high)) * powers(root, half, p)[None, :, None] % mod
        x, root, half = out.reshape(x.shape), root * root % p, half // 2
    return x


def inverse(x: np.ndarray, p: int) -> np.ndarray:
    """What :func:`transform` was given."""
    size, mod, half = len(x), np.uint64(p), 1
    while half < size:
        root = pow(PRIMES[p], p - 1 - (p - 1) // (2 * half), p)
        pairs = x.reshape(size // (2 * half), 2, half, -1)
        low = pairs[:, 0]
        high = pairs[:, 1] * powers(root, half, p)[None, :, None] % mod
        out = np.empty_like(pairs)
        out[:, 0] = _reduced(low + high, mod)
        out[:, 1] = _reduced(low + (mod - high), mod)
        x, half = out.reshape(x.shape), 2 * half
    return x * np.uint64(pow(size, -1, p)) % mod


def squared_differences(blocks: np.ndarray, windows: np.ndarray, p: int) -> np.ndarray:
    """Sum of squared differences, modulo ``p``, of each block and its window at every shift.

    ``blocks`` is (length, many), ``windows`` (longer, many); entry ``(s, i)`` of the result compares block
    ``i`` with the words ``s .. s + length - 1`` of window ``i``.
    """
    length, shifts = len(blocks), len(windows) - len(blocks) + 1
    size = 1 << (len(windows) - 1).bit_length()
    mod = np.uint64(p)

    def padded(x: np.ndarray) -> np.ndarray:
        out = np.zeros((size, x.shape[1]), np.uint64)
        out[: len(x)] = x % mod
        return out

    left, right = transform(padded(blocks[::-1]), p), transform(padded(windows), p)
    product = inverse(left * right % mod, p)[length - 1 : length - 1 + shifts]
    below = np.zeros((len(windows) + 1, windows.shape[1]), np.uint64)
    rest = windows % mod
    np.cumsum(rest * rest % mod, axis=0, out=below[1:])
    own = blocks % mod
    squares = (own * own % mod).sum(axis=0)[None, :] + (below[length:] - below[: shifts])
    return (squares + np.uint64(2) * (mod - product)) % mod
