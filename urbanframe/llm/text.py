"""Vectorised text primitives over Arrow string buffers.

Everything here works on whole texts as UTF-8 bytes, a bounded chunk of documents at a
time (a document longer than the bound is a chunk of its own).  A null text is an empty
text.  Words are runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random odd value for each byte: the letters of the polynomial hash.
LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i <= n."""
    global _pow, _inv
    if len(_pow) <= n:
        size = max(n + 1, CHUNK + (CHUNK >> 2))
        p, q = np.full(size, _B, np.uint64), np.full(size, _BINV, np.uint64)
        p[0] = q[0] = 1
        p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if n > 8 * CHUNK:  # a very long text: not kept
            return p, q
        _pow, _inv = p, q
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (int64, from 0) of a string or binary column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole documents of about ``limit`` bytes."""
    data, offs = string_buffers(col)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with hash(data[s:e]) = (P[e] - P[s]) * B**-s."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * p[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes, equal hash, wherever they stand."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = separator[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offs[:-1][offs[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = offs[1:]
    after[ends[ends > 0] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    stops = np.flatnonzero(word & after) + 1
    return starts, stops, np.searchsorted(starts, offs)


_C = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (also across documents: the caller picks)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    m = len(words) - k + 1
    out = words[:m] * _C[0]
    for j in range(1, k):
        out += words[j : j + m] * (_C[j % len(_C)] + np.uint64(2 * (j // len(_C))))
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start and count, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def shingles(words: np.ndarray, woffs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word shingle by document, in text order, and the documents' offsets.

    A document of fewer words has its whole sequence as its one shingle, an empty one none.
    """
    n = np.diff(woffs)
    counts = np.where(n >= k, n - k + 1, n > 0).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(offs[-1]), np.uint64)
    full = n >= k
    if full.any():
        at = ranges(woffs[:-1][full], counts[full])
        out[ranges(offs[:-1][full], counts[full])] = window_hashes(words, k)[at]
    for d in np.flatnonzero((n > 0) & ~full):  # fewer than k <= 5 words
        w = words[woffs[d] : woffs[d + 1]]
        h = np.append(w * _C[: len(w)], np.uint64(len(w) << 56)).sum(dtype=np.uint64)
        out[offs[d]] = mix(np.array([h], np.uint64))[0]
    return out, offs


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its lower-cased (A-Z) shingles."""
    low = LOWER[data]
    starts, ends, woffs = word_spans(low, offs)
    sums = prefix_sums(low)
    sh, soffs = shingles(span_hashes(sums, starts, ends), woffs, k)
    out = []
    for a, b in zip(soffs[:-1].tolist(), soffs[1:].tolist()):
        if b - a < 2:
            out.append(sh[a:b])
            continue
        x = np.sort(sh[a:b])
        keep = np.empty(b - a, bool)
        keep[0] = True
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        out.append(x if keep.all() else x[keep])
    return out


def sums_by(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The sum of the values of each document (0 for one without)."""
    return np.diff(np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])[offs])


def repeats_within(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which keys stand twice or more with the same owner."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        both = keys ^ mix(owner.astype(np.uint64))
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def repeated_words(words: np.ndarray, woffs: np.ndarray, k: int = 5) -> np.ndarray:
    """For each document the words in k-word windows that it holds twice or more, the first included."""
    n = np.diff(woffs)
    counts = np.maximum(n - k + 1, 0)
    at = ranges(woffs[:-1], counts)
    again = at[repeats_within(window_hashes(words, k)[at], np.repeat(np.arange(len(n)), counts))]
    edge = np.zeros(len(words) + k + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + k, -1)
    return sums_by((np.cumsum(edge)[: len(words)] > 0).astype(np.int64), woffs)


def duplicate_lines(data: np.ndarray, offs: np.ndarray, sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document its lines with a word that equal an earlier line.  starts: of words."""
    docs = len(offs) - 1
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offs[:-1]]))
    cut = cut[cut < len(data)]
    end = np.append(cut[1:], len(data))
    if not len(cut):
        return np.zeros(docs, np.int64)
    owner = np.searchsorted(offs, cut, "right") - 1
    stop = end - (data[end - 1] == 10)
    full = np.searchsorted(starts, end) > np.searchsorted(starts, cut)
    key, owner = span_hashes(sums, cut[full], stop[full]), owner[full]
    _, first = np.unique(key ^ mix(owner.astype(np.uint64)), return_index=True)
    return np.bincount(owner, minlength=docs) - np.bincount(owner[first], minlength=docs)
