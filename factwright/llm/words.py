"""Words of whole texts as arrays of 64-bit hashes, worked out on the bytes of an Arrow column with numpy.

Every word set used here splits at ASCII bytes only, so that UTF-8 bytes can be split without decoding.
A word's hash is a polynomial over its bytes modulo 2^64, finished by a mixer; texts are taken in blocks, so
memory follows the longest text, never the batch. Nulls count as empty texts."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SAME = np.arange(256, dtype=np.uint8)

#: Bytes of words under ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words(NamedTuple):
    buf: np.ndarray  # bytes of the block, folded
    start: np.ndarray  # of each word, in buf
    end: np.ndarray
    hash: np.ndarray
    bound: np.ndarray  # words of text i are bound[i] to bound[i + 1]

    def text(self, i: int, j: int) -> str:
        """Words i to j - 1 joined by single spaces."""
        b = self.buf
        return b" ".join(b[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j])).decode("utf-8", "replace")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int):
    """Powers of the base and of its inverse, 0 to n."""
    if len(_powers[0]) <= n:
        size = max(n, BLOCK) + 1
        back = np.uint64(pow(int(_R), -1, 1 << 64))
        for k, base in enumerate((_R, back)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def _hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = start[i]
        j = max(int(np.searchsorted(end, a + BLOCK, "right")), i + 1)
        b = end[j - 1]
        up, down = _tables(int(b - a))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((buf[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out ^ ((end - start).astype(np.uint64) * _Q))


def blocks(texts: pa.Array, limit: int = BLOCK):
    """(first, offsets, bytes) of runs of texts of about ``limit`` bytes, one text at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) is False:
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1, i + 1)
        j = min(j, n)
        yield i, offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
        i = j


def split(offsets: np.ndarray, raw: np.ndarray, kind: np.ndarray = SPACED, fold: np.ndarray = LOWER, hashed: bool = True) -> Words:
    """The words of one block of texts."""
    buf = fold[raw]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    m = kind[buf]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first[inner] = m[inner]
    last[inner - 1] = m[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(buf, start, end, _hash(buf, start, end) if hashed else np.zeros(0, np.uint64), np.searchsorted(start, offsets))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position that has k words after it in the block (texts not minded)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _Q
        out += h[i : i + n]
    return mix(out)


def whole(h: np.ndarray) -> np.uint64:
    """Hash of a sequence of fewer words than a shingle has."""
    with np.errstate(over="ignore"):
        out = np.uint64(len(h)) * _R
        for x in h:
            out = out * _Q + x
    return mix(np.array([out], np.uint64))[0]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text's words: runs of k words, or the whole sequence if it is shorter."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(grams(h, k)) if len(h) >= k else np.array([whole(h)], np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
