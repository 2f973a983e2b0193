"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items fall into classes by their number of shingles, each up to twice as large as the one before.
For a class with items of up to u shingles a document is read as windows of 2u shingles that
start every u of them, so that a passage as long as an item lies in one window.  An item of which
80 % are in a window then has a Jaccard similarity of 0.19 or more with it, whatever the document's
length; ``HASHES`` bands of one minimum each meet in one of them but for one case in 700,000
(0.81 ** 64).  Each (document, item) that meets is verified: the share of the item's distinct shingles that the
whole document holds.  A window without any shingle of any item cannot meet one and is not hashed.

The items are read in blocks of at most ``ITEM_SHINGLES`` shingles, each sent to all tasks: a bound on
what is broadcast; every block goes over all documents.

Shingles are five words, lower-cased (A-Z), compared by 64-bit hashes.  Edge cases: null or empty items and texts
match nothing; an item of fewer than five words is one shingle, and so matches only a text that is the same
sequence of words; repeated rows give a row each; null ids stay null.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import LOWER, chunks, mix, prefix_sums, ranges, shingle_sets, shingles, span_hashes, word_spans
from .util import batch, bounded_batches

HASHES = 64
ITEM_SHINGLES = 1 << 20
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(HASHES, windows): the minimum of each hash function over each non-empty window."""
    out = np.empty((HASHES, len(offs) - 1), np.uint64)
    for i in range(HASHES):
        v = (values ^ _XOR[i]) * _MUL[i]
        out[i] = np.minimum.reduceat(v ^ (v >> np.uint64(29)), offs[:-1])
    return out


def _band(signature: np.ndarray) -> np.ndarray:
    return mix(signature ^ _MUL[:, None])


class Items:
    """One block of test items."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.known = np.unique(np.concatenate(sets))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.known & np.uint64((1 << 22) - 1)] = True
        self.classes = []
        size = np.array([len(s) for s in sets])
        kind = np.frexp(size)[1]  # 2 ** (kind - 1) <= size < 2 ** kind
        for c in np.unique(kind).tolist():
            own = np.flatnonzero(kind == c)
            offs = np.concatenate([[0], np.cumsum(size[own])])
            band = _band(minima(np.concatenate([sets[i] for i in own]), offs))
            key = band.ravel()
            order = np.argsort(key)
            self.classes.append(((1 << c) - 1, key[order], np.tile(own, HASHES)[order]))

    def search(self, sh: np.ndarray, soffs: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of all items contained to 80 % or more."""
        at = np.flatnonzero(self.maybe[sh & np.uint64((1 << 22) - 1)])
        at = at[self.known[np.minimum(np.searchsorted(self.known, sh[at]), len(self.known) - 1)] == sh[at]]
        if not len(at):
            return []
        doc = np.searchsorted(soffs, at, "right") - 1
        pairs = []
        for u, key, item in self.classes:
            place = (at - soffs[doc]) // u
            window = np.unique(np.concatenate([doc << 32 | place, (doc << 32 | (place - 1))[place > 0]]))
            owner = window >> 32
            start = soffs[owner] + (window & 0xFFFFFFFF) * u
            count = np.minimum(start + 2 * u, soffs[owner + 1]) - start
            band = _band(minima(sh[ranges(start, count)], np.concatenate([[0], np.cumsum(count)])))
            lo, hi = np.searchsorted(key, band, "left"), np.searchsorted(key, band, "right")
            _, w = np.nonzero(hi > lo)
            met = hi > lo
            pairs.append(np.unique(np.repeat(owner[w], (hi - lo)[met]) << 32 | item[ranges(lo[met], (hi - lo)[met])]))
        out = []
        last, held = -1, None
        for pair in np.unique(np.concatenate(pairs)).tolist():
            d, i = pair >> 32, pair & 0xFFFFFFFF
            if d != last:
                last, held = d, np.unique(sh[soffs[d] : soffs[d + 1]])
            s = self.sets[i]
            shared = int((held[np.minimum(np.searchsorted(held, s), len(held) - 1)] == s).sum())
            if 10 * shared >= 8 * len(s):
                out.append((d, i, shared))
        return out


_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64())])


def _shingled(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, woffs = word_spans(low, offs)
    return shingles(span_hashes(prefix_sums(low), starts, ends), woffs)


def _search(items: Items):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, _, data, offs in chunks(b.column("text")):
                found = items.search(*_shingled(data, offs))
                yield batch(_HIT, [ids[lo + d] for d, _, _ in found], [items.ids[i] for _, i, _ in found], [len(items.sets[i]) for _, i, _ in found], [n for _, _, n in found])

    return run


def _clean(items: Items):
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for lo, _, data, offs in chunks(b.column(b.schema.get_field_index("text"))):
                keep[[lo + d for d, _, _ in items.search(*_shingled(data, offs))]] = False
            yield b.filter(pa.array(keep))

    return run


def item_blocks(benchmark: DataFrame):
    """The items in blocks of bounded size."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a shingle takes two bytes at least
    blocks = max(1, -(-(size // 2) // ITEM_SHINGLES))
    for i in range(blocks):
        rows = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)).collect()  # a bounded block
        ids, sets = [], []
        for row in rows:
            raw = np.frombuffer(row["text"].encode(), np.uint8)
            s = shingle_sets(raw, np.array([0, len(raw)]))[0]
            if len(s):
                ids.append(row["item_id"])
                sets.append(s)
        if sets:
            yield Items(ids, sets)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared) for every document and item with 80 % or more of the item in it."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, item_shingles long, shared long")
    for items in item_blocks(benchmark):
        out = out.unionByName(docs.mapInArrow(_search(items), "doc_id long, item_id long, item_shingles long, shared long"))
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns; nothing is joined or dealt anew."""
    bounded_batches(spark)
    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(_clean(items), docs.schema)
    return docs
