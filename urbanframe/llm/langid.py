"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every text is read as lower-cased code points, everything but letters as one blank; its 2- and 3-grams that hold a
letter are hashed to ``BUCKETS``.  Counts by language come from all training rows, added up by slice of buckets;
the matrix of log probabilities (buckets x languages, add-half smoothed; 256 KB a language) goes to the tasks, where
a batch's n-grams are looked up and added up by document.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when nothing was learned; rows
whose language is null are not learned from; a null doc_id is never a training row, and held_out is false for it;
ties go to the language that sorts first; repeated rows are rows like others.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import chunks, sums_by
from .util import batch, bounded_batches, remainder, width

BUCKETS, SLICES = 1 << 15, 32
#: Lower-cased letters of the first plane of Unicode; 0 stands for all else.
_LETTER = np.array([ord(s) if len(s := chr(i).lower()) == 1 and chr(i).isalpha() else i if chr(i).isalpha() else 0 for i in range(1 << 16)], np.uint32)


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (0: no letter) and the documents' offsets in them."""
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    x = _LETTER[np.minimum(point, 65535)]
    for c in np.unique(point[point > 65535]).tolist():
        x[point == c] = c if chr(c).isalpha() else 0
    return x, first[offs]


def grams(x: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, n): the buckets of the 2- and 3-grams around each code point, and which of them count."""
    if not len(x):
        return np.zeros((2, 0), np.uint32), np.zeros((2, 0), bool)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    full = offs[:-1] < offs[1:]
    before[offs[:-1][full]] = 0
    after[offs[1:][full] - 1] = 0
    two = x * np.uint32(0x9E3779B1) + after * np.uint32(0x85EBCA77)
    three = two + before * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    out = np.stack([two, three])
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out & np.uint32(BUCKETS - 1), np.stack([(x > 0) | (after > 0), x > 0])


_COUNT = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("payload", pa.binary())])


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        lang = b.column("lang").to_pylist()
        for lo, hi, data, offs in chunks(b.column("text")):
            x, o = letters(data, offs)
            g, use = grams(x, o)
            names = sorted(set(lang[lo:hi]))
            which = np.repeat(np.array([names.index(v) for v in lang[lo:hi]]), np.diff(o))
            for i, name in enumerate(names):
                n = np.bincount(g[use & (which == i)], minlength=BUCKETS)
                total[name] = total[name] + n if name in total else n
    rows = [(name, s, part.tobytes()) for name, n in total.items() for s, part in enumerate(n.reshape(SLICES, -1))]
    yield batch(_COUNT, *([r[i] for r in rows] for i in range(3)))


def _add(batches):
    total: dict[tuple, np.ndarray] = {}
    for b in batches:
        for lang, at, payload in zip(*(c.to_pylist() for c in b.columns)):
            x = np.frombuffer(payload, np.int64)
            total[lang, at] = total[lang, at] + x if (lang, at) in total else x
    yield batch(_COUNT, [k[0] for k in total], [k[1] for k in total], [x.tobytes() for x in total.values()])


def learn(spark: SparkSession, train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (buckets, languages) and log priors from all rows of ``train`` (lang, text)."""
    kind = "lang string, slice int, payload binary"
    priors = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(priors)
    counts = np.zeros((len(names), SLICES, BUCKETS // SLICES))
    rows = train.mapInArrow(_count, kind).repartition(min(SLICES, width(spark)), "slice").mapInArrow(_add, kind)
    for lang, at, payload in rows.collect():  # 256 KB a language
        counts[names.index(lang), at] = np.frombuffer(payload, np.int64)
    counts = counts.reshape(len(names), BUCKETS).T + 0.5
    share = np.array([priors[n] for n in names], float)
    return names, np.log(counts / counts.sum(0)).astype(np.float32), np.log(share / share.sum()) if names else share


_FOUND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(names: list[str], table: np.ndarray, prior: np.ndarray):
    label = np.array([*names, "und"], object)

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text")):
                x, o = letters(data, offs)
                g, use = grams(x, o)
                total = np.tile(prior, (hi - lo, 1))
                for row, there in zip(g, use):
                    at = np.concatenate([[0], np.cumsum(there)])[o]
                    found = row[there]
                    for i in range(len(names)):
                        total[:, i] += sums_by(table[found, i].astype(np.float64), at)
                total = np.round(total, 6)  # sums depend in their last places on the texts before, and ties must not
                none = sums_by((x > 0).astype(np.int64), o) == 0
                best = np.full(hi - lo, len(names))
                score = np.zeros(hi - lo)
                if names:
                    best = np.where(none, len(names), total.argmax(1))
                    odds = np.exp(total - total.max(1, keepdims=True))
                    score = np.where(none, 0, 1 / odds.sum(1))
                yield batch(_FOUND, b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), pa.array(label[best], pa.string()), score)

    return run


def identified(spark: SparkSession, docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang); learned from the rows not held out."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (remainder("doc_id", folds) == held).alias("held_out"))
    model = learn(spark, docs.where("not held_out and lang is not null").select("lang", "text"))
    shown = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return shown.mapInArrow(_predict(*model), "doc_id long, held_out boolean, lang_pred string, score double")
