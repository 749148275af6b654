"""Vectorised word hashing over whole texts: a word is a run of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
MIX = [U(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729DA3ED7C5, 0x38495AB5A0B5D2C3, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def fmix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= MIX[0]
    h ^= h >> U(33)
    h *= MIX[1]
    h ^= h >> U(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inv)):
            a = np.full(m, b, U)
            a[0] = 1
            _POW[k] = np.cumprod(a, dtype=U)
    return _POW[0], _POW[1]


def chunks(texts: list, max_chars: int = 1_000_000):
    """(first index, texts) in runs of about max_chars; a longer text is a run of its own."""
    run, n, first = [], 0, 0
    for i, t in enumerate(texts):
        if run and n + len(t) > max_chars:
            yield first, run
            run, n, first = [], 0, i
        run.append(t)
        n += len(t) + 1
    if run:
        yield first, run


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, in order; number of words of each text)."""
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    s, e = edge[0::2], edge[1::2]
    power, inverse = _powers(len(codes) + 1)
    run = np.zeros(len(codes) + 1, U)
    np.cumsum((codes + np.uint32(1)).astype(U) * power[: len(codes)], out=run[1:])
    h = fmix((run[e] - run[s]) * inverse[s])
    return h, np.diff(np.searchsorted(s, ends, "left"), prepend=0)


def shingles(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words within a text, number of them for each text); a text of 1 to k-1 words has one."""
    total = len(h)
    n = n.astype(np.int64)
    first = np.cumsum(n) - n
    v = np.zeros(total, U)
    padded = np.concatenate((h, np.zeros(k, U)))
    left = np.repeat(first + n, n) - np.arange(total)  # words left in the text from here on
    for j in range(k):
        part = padded[j : j + total] * MIX[2 + j]
        v += part if j == 0 else np.where(left > j, part, U(0))
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    keep = (left >= k) | ((np.arange(total) == np.repeat(first, n)) & (np.repeat(n, n) < k))
    return fmix(v[keep]), count
