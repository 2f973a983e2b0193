"""Packing: token sequences of a fixed window filled with document pieces, by non-negative least squares.

Documents are tokenised, closed with an end id and cut into full windows and a rest.  The histogram of
piece lengths (at most ``window`` numbers, whatever the input) goes to the driver.  There, shallow
combinations of one to three lengths that fill a window are enumerated, and non-negative least squares
finds how often to repeat each so that the repeats use up the histogram.  The counts are rounded
down to what is there, and what stays is packed greedily, largest length first, again by length
and not by piece.  The plan says for each length which ranks go to which run of sequences; a
piece's rank is its place in its partition plus the counts of partitions before, so no length's pieces are gathered.

Tokens of a word never depend on its neighbours, so words are encoded once and kept, up to ``CACHE``
of them per worker (a bound on memory; others are encoded when met).

Edge cases: a null or empty text is one piece, the end id; a document of exactly n windows has no rest;
a null doc_id stays null and repeated rows are packed each; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import CHUNK, chunks, prefix_sums, ranges, span_hashes, word_spans
from .util import batch, bounded_batches, written

CACHE = 300_000
MARK = "\x01"
_kept: dict = {}


class Words:
    """Token ids of words, by a tokenizer whose pre-tokens never cross white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.place: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.offs = np.zeros(1 << 14, np.int64)
        self.n = 0

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has: a hundred words a call, parted by a mark of one id that no word holds."""
        if any(MARK in w for w in words):
            found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        joined = [f" {MARK} ".join(words[i : i + 100]) + f" {MARK}" for i in range(0, len(words), 100)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        cut = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(np.concatenate([[-1], cut])) - 1

    def _keep(self, keys: list[int], flat: np.ndarray, counts: np.ndarray) -> None:
        ends = self.offs[self.n] + np.cumsum(counts)
        while self.n + len(keys) + 1 > len(self.offs):
            self.offs = np.concatenate([self.offs, np.zeros_like(self.offs)])
        while len(keys) and ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.offs[self.n] : self.offs[self.n] + len(flat)] = flat
        self.offs[self.n + 1 : self.n + 1 + len(keys)] = ends
        self.place.update(zip(keys, range(self.n, self.n + len(keys))))
        self.n += len(keys)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, one after the other, and how many each has."""
        starts, ends, woffs = word_spans(data, offs)
        key = span_hashes(prefix_sums(data), starts, ends)
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        place = np.fromiter((self.place.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        old = place >= 0
        size = np.zeros(len(keys), np.int64)
        begin = np.zeros(len(keys), np.int64)
        begin[old] = self.offs[place[old]]
        size[old] = self.offs[place[old] + 1] - begin[old]
        source = self.flat
        if len(new):
            raw = data.tobytes()
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            flat, counts = self._encode(words)
            size[new] = counts
            used = int(self.offs[self.n])
            begin[new] = used + np.cumsum(counts) - counts
            source = np.concatenate([self.flat[:used], flat])
            if self.n + len(new) <= CACHE:
                self._keep([keys[i] for i in new.tolist()], flat, counts)
        per_word = size[inverse]
        ids = source[ranges(begin[inverse], per_word)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(per_word)])[woffs])


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("rank", pa.int64())])
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"


def _pieces(path: str, window: int, end_id: int):
    def run(batches):
        words, part = Words.of(path), TaskContext.get().partitionId()
        rank = np.zeros(window + 1, np.int64)
        for b in batches:
            keys = b.column("doc_id")
            for lo, _, data, offs in chunks(b.column("text"), 2 * CHUNK):  # the longer, the fewer words are met anew
                ids, counts = words.encode(data, offs)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                end = np.uint32(end_id).tobytes()
                rows, at = [], 0
                for doc, n in enumerate(counts.tolist()):
                    for start in range(0, n + 1, window):
                        stop = min(start + window, n + 1)
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + min(stop, n))])
                        rows.append((doc, start, stop - start, zlib.crc32(end, crc) if stop > n else crc, n + 1))
                    at += n
                doc, start, length, crc, total = np.array(rows, np.int64).T
                order = np.argsort(length, kind="stable")
                at_length = length[order]
                seen = np.arange(len(order)) - np.searchsorted(at_length, at_length)
                place = np.empty(len(order), np.int64)
                place[order] = rank[at_length] + seen
                rank += np.bincount(length, minlength=window + 1)
                yield batch(_PIECE, keys.take(pa.array(lo + doc)), start, length, crc, total, np.full(len(order), part), place)

    return run


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths that are there and fill 98 % or more of a window."""
    window = len(histogram) - 1
    have = np.flatnonzero(histogram[1:]) + 1
    under = np.zeros(window + 1, np.int64)  # the largest length that is there, up to each
    under[have] = have
    under = np.maximum.accumulate(under)
    out = {(window,)} if histogram[window] else set()
    for a in have[have < window].tolist():
        room = window - a
        b = int(under[room])
        out.add(tuple(sorted((a, b))) if b else (a,))
        for share in (2, 3, 4, 6, 8):
            b = int(under[room // share]) if room // share else 0
            c = int(under[room - b])
            if b and c:
                out.add(tuple(sorted((a, b, c))))
    return sorted(c for c in out if 100 * sum(c) >= 98 * window)


def repeats(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes the combinations' lengths, repeated x times, closest to the histogram (multiplicative updates).

    Differences count by the square of the length: short pieces left over still fill gaps, long ones do not.
    """
    if not combos:
        return np.zeros(0)
    slot = np.concatenate([np.array(c) for c in combos])
    owner = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    n, m = len(combos), len(histogram)
    weight = np.arange(m) / m
    weight = weight**2
    goal = np.bincount(owner, (weight * histogram)[slot], n)
    x = goal / np.bincount(owner, (weight * np.bincount(slot, minlength=m))[slot], n)
    for _ in range(rounds):
        x *= goal / np.maximum(np.bincount(owner, (weight * np.bincount(slot, x[owner], m))[slot], n), 1e-12)
    return x


def plan(histogram: np.ndarray) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where each rank of each length goes.

    A run starts at its first rank and first sequence and goes on by one of each.
    """
    left = histogram.astype(np.int64).copy()
    window = len(left) - 1
    done, sequence, rows = np.zeros(window + 1, np.int64), 0, []

    def put(lengths: tuple[int, ...], times: int):
        nonlocal sequence
        offset = 0
        for n in lengths:
            rows.append((n, int(done[n]), sequence, offset))
            done[n] += times
            left[n] -= times
            offset += n
        sequence += times

    def most(lengths) -> int:
        return min(int(left[n]) // lengths.count(n) for n in lengths)

    combos = combinations(left)
    x = repeats(combos, left)
    for i in np.argsort(-x, kind="stable").tolist():
        if (times := min(int(x[i]), most(combos[i]))) > 0:
            put(combos[i], times)
    while left.any():
        have = np.flatnonzero(left)
        under = np.zeros(window + 1, np.int64)
        under[have] = have
        under = np.maximum.accumulate(under)
        lengths, room, used = [int(have[-1])], window - int(have[-1]), {}
        used[lengths[0]] = 1
        while room and (n := int(under[room])):
            while n and used.get(n, 0) >= left[n]:
                n = int(under[n - 1])
            if not n:
                break
            lengths.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
        put(tuple(lengths), most(lengths))
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


_PLACED = pa.schema([*list(_PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(table: np.ndarray):
    key = (table[:, 0] << 48) + table[:, 1]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy()
            row = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            yield batch(_PLACED, *(b.column(f.name) for f in list(_PLACED)[:5]), row[:, 2] + rank - row[:, 1], row[:, 3])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of ``docs`` (doc_id, text)."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(spark, docs.mapInArrow(_pieces(tokenizer, window, end_id), _PIECE_DDL), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `window` rows
        histogram[length] = n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.join(base, ["part", "length"]).mapInArrow(_place(plan(histogram)), placed)
