"""Hashes of words, of runs of words, sets of shingles and MinHash signatures, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1


class WordHashes(dict):
    """64-bit hash by word (bytes). A memo: emptied when it holds ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashes(memo: WordHashes, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % i, seed) | 1 for i in range(n)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; empty where there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors, total = _odd(size, 7), np.zeros(n, np.uint64)
    for j in range(size):
        total += h[j:j + n] * factors[j]
    return mixed(total)


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BYTE[_SPACE] = 0
_BASE = 0xA0761D6478BD642F  # odd, so it has an inverse
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    for i, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        while len(_POWERS[i]) < n:
            have = _POWERS[i]
            _POWERS[i] = np.concatenate([have, have * np.uint64(pow(factor, len(have), 1 << 64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[bytes | None], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of many texts (A-Z as a-z) at once: sorted distinct hashes of all texts, where each
    text's begin and end, and the texts' numbers of words. A text of fewer words makes one shingle."""
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8) if texts else np.empty(0, np.uint8)
    space = _SPACE[data]
    turn = np.flatnonzero(np.diff(space, prepend=True))
    starts = turn[::2]
    edges = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])  # words of each text
    n_words = np.diff(edges)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), n_words
    up, down = _powers(len(data))
    h = mixed(np.add.reduceat(_BYTE[data] * up, starts) * down[starts])
    values = np.zeros(len(h), np.uint64)
    found = runs(h, size)
    values[:len(found)] = found
    valid = np.ones(len(h), bool)
    full = np.flatnonzero(n_words >= size)
    valid[(edges[full + 1][:, None] - 1 - np.arange(size - 1)).ravel()] = False
    for i in np.flatnonzero((n_words > 0) & (n_words < size)):
        a, b = edges[i], edges[i + 1]
        valid[a:b], valid[a] = False, True
        values[a] = runs(h[a:b], int(b - a))[0] ^ np.uint64(b - a)
    values = values[valid]
    bounds = np.r_[0, np.cumsum(np.where(n_words >= size, n_words - size + 1, n_words > 0))]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    new = np.r_[True, values[1:] != values[:-1]]
    new[bounds[:-1][bounds[:-1] < len(new)]] = True
    return values[new], np.r_[0, np.cumsum(new)][bounds], n_words


class Signer:
    """MinHash signatures of ``k`` 32-bit coordinates: the least of k one-to-one maps of the upper hash bits."""

    def __init__(self, k: int, chunk: int = 8192) -> None:
        self.a, self.b = (x.astype(np.uint32)[:, None] | np.uint32(1) for x in (_odd(k, 11), _odd(k, 13)))
        self.chunk, self.work = chunk, np.empty((k, chunk), np.uint32)

    def __call__(self, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """A row of k coordinates for each set ``values[edges[i]:edges[i + 1]]``; of no meaning for empty ones."""
        x = (values >> np.uint64(32)).astype(np.uint32)
        out = np.full((len(edges) - 1, len(self.a)), np.iinfo(np.uint32).max, np.uint32)
        filled = np.flatnonzero(np.diff(edges))
        begin = edges[filled]
        for i in range(0, len(x), self.chunk):
            part = x[i:i + self.chunk]
            work = self.work[:, :len(part)]
            np.multiply(part, self.a, out=work)
            work += self.b
            first, last = np.searchsorted(begin, [i, i + len(part) - 1], side="right") - 1
            at = np.maximum(begin[first:last + 1] - i, 0)
            rows = filled[first:last + 1]
            out[rows] = np.minimum(out[rows], np.minimum.reduceat(work, at, axis=1).T)
        return out


def tokens(signature: np.ndarray) -> np.ndarray:
    """One 64-bit number for each coordinate-value pair of a signature."""
    return mixed((np.arange(len(signature), dtype=np.uint64) << np.uint64(32)) | signature.astype(np.uint64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())
