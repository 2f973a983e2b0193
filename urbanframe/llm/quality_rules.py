"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted and raw text, beside counting rules.

Two multinomials over ``BUCKETS`` hashed byte 4-grams are counted over all documents: the raw corpus, and the
trusted target, which is the documents that pass strict rules (``trusted``).  A document's score is the
mean over its 4-grams of log p(target) - log p(raw), add-one smoothed: length-normalised, so one
threshold, ``KEEP``, holds for every document.  Below it, or where a base rule fails, it is not kept.

The counts are tables of a fixed size, added up by slice of buckets; the table of ratios that is
sent to the tasks is 512 KB whatever the input.

Edge cases: a null text has no words, like an empty one, and fails the base rules; a text of under four bytes scores 0;
without any trusted document every score is 0; null and repeated ids are rows like others.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import chunks, duplicate_lines, prefix_sums, repeated_words, span_hashes, sums_by, word_spans
from .util import batch, bounded_batches, width

BUCKETS, SLICES = 1 << 16, 64
KEEP = -0.5
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


def rules(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each document, and whether it is trusted."""
    starts, ends, woffs = word_spans(data, offs)
    sums = prefix_sums(data)
    words = span_hashes(sums, starts, ends)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    by = lambda mask: sums_by(mask.astype(np.int64), offs)
    out = {"n_words": np.diff(woffs), "word_chars": by(inside & ((data & 0xC0) != 0x80)), "n_symbols": by(IS_SYMBOL[data]), "n_dup_lines": duplicate_lines(data, offs, sums, starts), "n_repeat_words": repeated_words(words, woffs)}
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    upper, bang = by((data >= 65) & (data <= 90)), by(data == 33)
    out["trusted"] = (out["n_words"] >= 20) & (out["n_symbols"] + out["n_dup_lines"] + out["n_repeat_words"] == 0) & (10 * upper <= out["word_chars"]) & (100 * bang <= out["word_chars"])
    return out


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 4-grams at each byte but the last three of the chunk, and which of them lie in one document."""
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    x = data.astype(np.uint32)
    x = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    whole = np.ones(len(x), bool)
    for back in (1, 2, 3):
        cut = offs[1:-1] - back
        whole[cut[(cut >= 0) & (cut < len(x))]] = False
    return x >> np.uint32(16), whole


_COUNT = pa.schema([("slice", pa.int32()), ("payload", pa.binary())])


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, data, offs in chunks(b.column("text")):
            g, whole = grams(data, offs)
            good = np.repeat(rules(data, offs)["trusted"], np.diff(offs))[: len(g)]
            raw += np.bincount(g[whole], minlength=BUCKETS)
            target += np.bincount(g[whole & good], minlength=BUCKETS)
    both = np.stack([raw, target], 1).reshape(SLICES, -1)
    yield batch(_COUNT, np.arange(SLICES), [x.tobytes() for x in both])


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for at, payload in zip(*(c.to_pylist() for c in b.columns)):
            x = np.frombuffer(payload, np.int64)
            total[at] = total[at] + x if at in total else x
    yield batch(_COUNT, list(total), [x.tobytes() for x in total.values()])


def ratios(spark: SparkSession, docs: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, from the counts of all documents."""
    kind = "slice int, payload binary"
    rows = docs.mapInArrow(_count, kind).repartition(min(SLICES, width(spark)), "slice").mapInArrow(_add, kind).collect()  # SLICES rows, 1 MB
    both = np.zeros((SLICES, BUCKETS // SLICES, 2))
    for at, payload in rows:
        both[at] = np.frombuffer(payload, np.int64).reshape(-1, 2)
    raw, target = both.reshape(-1, 2).T
    if not target.sum():
        return np.zeros(BUCKETS)
    log = lambda x: np.log((x + 1) / (x.sum() + BUCKETS))
    return log(target) - log(raw)


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])


def _score(table: np.ndarray, keep: float):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, data, offs in chunks(b.column("text")):
                r = rules(data, offs)
                g, whole = grams(data, offs)
                value, there = np.zeros(len(data)), np.zeros(len(data), np.int64)
                value[: len(g)], there[: len(g)] = np.where(whole, table[g], 0), whole
                n = sums_by(there, offs)
                score = np.round(np.where(n > 0, sums_by(value, offs) / np.maximum(n, 1), 0), 9)
                yield batch(_SCORED, ids.slice(lo, hi - lo), *(r[f.name] for f in list(_SCORED)[1:7]), ~r["base_failed"] & (score >= keep), score)

    return run


def rated(spark: SparkSession, docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score for every row of ``docs`` (doc_id, text)."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.mapInArrow(_score(ratios(spark, docs), keep), schema)
