"""Quality classifier: Bradley-Terry ranking learned from preference pairs, thresholded at a score quantile.

Each text becomes a dozen numbers (``FEATURES``) and the shares of its byte 4-grams (A-Z lower-cased) by ``BUCKETS`` hashed
buckets.  Every labelled row that is not held out takes part, and so does every pair of a preferred (quality 1) and an other
(quality 0) row: weights w are found by which w . (f(a) - f(b)) explains the preferences: logistic loss on feature
differences, L2 (stronger on the buckets), by Newton steps.  A document's rank score is w . f.  The threshold is the quantile
of the rank scores of all these rows at the share of quality 0; it is mapped to ``cut`` on the logistic scale, so that
score >= cut is the decision.

Pairs are not listed.  What a row's pairs add is a smooth function of its rank score and of how the rank scores of the other
label lie, and that is taken from counts on a grid of steps of ``STEP``, between whose nodes scores are shared out (an error
below 1e-7 of a pair's probability).  Features are written once; each step of the search passes over them twice, and of a
pass the driver gets sums of fixed size.

Edge cases: a null text is an empty text, and an empty text has features of zeros; rows with a null doc_id or null
quality are not learned from, and held_out is false for a null doc_id; a doc_id that repeats counts as often; without
labels of both kinds every score is ``cut``, which keeps all; a rank score at the threshold is kept.  Other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import IS_SYMBOL
from .text import LOWER, chunks, duplicate_lines, mix, prefix_sums, repeated_words, span_hashes, sums_by, word_spans
from .util import batch, bounded_batches, remainder, written

STEP, COARSE, PARTS, BUCKETS = 1 / 512, 128, 256, 256
FEATURES = ("log_words", "symbols", "capitals", "marks", "digits", "repeated", "lines_again", "same_next", "word_length", "long_words", "distinct", "end_marks")


def gram_shares(data: np.ndarray, offs: np.ndarray, n: int = 4) -> np.ndarray:
    """(documents, BUCKETS): square roots of the shares of each hashed bucket among a text's byte n-grams."""
    docs, m = len(offs) - 1, len(data) - n + 1
    if m <= 0:
        return np.zeros((docs, BUCKETS))
    low = LOWER[data].astype(np.uint32)
    h = np.zeros(m, np.uint32)
    for j in range(n):
        h = h * np.uint32(0x01000193) + low[j : j + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    owner = np.repeat(np.arange(docs), np.diff(offs))[:m]
    inside = np.arange(m) + n <= offs[owner + 1]
    count = np.bincount((owner * BUCKETS + (h % np.uint32(BUCKETS)))[inside], minlength=docs * BUCKETS).reshape(docs, BUCKETS)
    return np.sqrt(count / np.maximum(count.sum(1, keepdims=True), 1))


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, FEATURES and BUCKETS); shares as square roots, so that a little of something rare shows."""
    starts, ends, woffs = word_spans(data, offs)
    sums = prefix_sums(data)
    words = span_hashes(sums, starts, ends)
    n, size = np.diff(woffs), np.diff(offs)
    by = lambda mask: sums_by(mask.astype(np.int64), offs)
    by_word = lambda x: sums_by(x.astype(np.int64), woffs)
    share = lambda x, of: np.sqrt(np.clip(x / np.maximum(of, 1), 0, 1))
    owner = np.repeat(np.arange(len(n)), n)
    next_same = np.zeros(len(words), bool)
    if len(words) > 1:
        next_same[:-1] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    _, first = np.unique(words ^ mix(owner.astype(np.uint64)), return_index=True)
    kinds = np.bincount(owner[first], minlength=len(n))
    length = ends - starts
    chars = by_word(length)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    lines = np.maximum(by(data == 10) + (size > 0), 1)
    counted = np.stack([
        np.log1p(n) / 5, share(by(IS_SYMBOL[data]), chars), share(by((data >= 65) & (data <= 90)), chars), share(by((data == 33) | (data == 63)), chars), share(by((data >= 48) & (data <= 57)), chars),
        share(repeated_words(words, woffs), n), share(duplicate_lines(data, offs, sums, starts), lines), share(by_word(next_same), n), np.log1p(chars / np.maximum(n, 1)), share(by_word(length > 24), n),
        np.where(n > 0, np.log(np.maximum(kinds, 1)) / np.log(n + 1.0001), 0), share(by_word((last == 46) | (last == 44)), n),
    ], 1)
    return np.hstack([counted, gram_shares(data, offs)])


WIDTH = len(FEATURES) + BUCKETS
L2 = np.repeat([1e-3, 1e-2], [len(FEATURES), BUCKETS])


def pairs_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows preferred and rows they are preferred to: all pairs, which ``fit`` takes together."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    return np.repeat(good, len(bad)), np.tile(bad, len(good))


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-t, -500, 500)))


def _shares(s: np.ndarray, lo: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The grid node at or below each score, and the share that the next one gets."""
    at = (s - lo) / step
    node = np.floor(at).astype(np.int64)
    return node, at - node


def _against(counts: np.ndarray, f, step: float) -> np.ndarray:
    """At each node, the sum over nodes b of counts[b] f(b - node), by FFT."""
    n = len(counts)
    size = 1 << (3 * n).bit_length()
    kernel = f(np.arange(1 - n, n) * step)
    got = np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel[::-1], size), size)
    return got[n - 1 : 2 * n - 1]


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights, centre, scale and threshold from features and 0/1 quality, over all pairs."""
    return fit_over(lambda fold, join: join([fold(x, y)]) if len(x) else None)


def _added(totals: list[tuple]) -> tuple:
    return reduce(lambda a, b: tuple(p + q for p, q in zip(a, b)), totals)


def _listed(totals: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(totals)


def fit_over(run) -> dict:
    """As ``fit``; ``run(fold, join)`` gives the joined values of ``fold(x, y)`` over parts of the rows, or None without rows."""
    sums = run(lambda x, y: (np.array([len(y), (y == 1).sum(), (y == 0).sum()]), x.sum(0), (x * x).sum(0)), _added)
    n, good, bad = (int(v) for v in sums[0]) if sums else (0, 0, 0)
    centre = sums[1] / n if n else np.zeros(WIDTH)
    scale = np.sqrt(np.maximum(sums[2] / n - centre**2, 0)) + 0.02 if n else np.ones(WIDTH)
    w = np.zeros(WIDTH)
    if not good or not bad:
        return {"w": w, "centre": centre, "scale": scale, "at": 0.0, "unit": 1.0}
    normal = lambda x: np.clip((x - centre) / scale, -6, 6)
    for _ in range(50):
        lo, size = _grid(w)
        fine = run(lambda x, y: tuple(_counts((normal(x) @ w)[y == k], lo, size) for k in (1, 0)), _added)  # noqa: B023
        fold, curved = _slopes(w, normal, lo, fine, good, bad)
        grad, hess = curved(run(fold, _added))
        step = np.linalg.solve(hess + np.diag(L2), grad - L2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return {"w": w, "centre": centre, "scale": scale} | _cut_at(run, normal, w, bad / n)


def _grid(w: np.ndarray) -> tuple[float, int]:
    """The lowest node and the number of nodes that hold every score: features are clipped to 6."""
    half = int(np.ceil(6 * np.abs(w).sum() / STEP)) + 2
    return -half * STEP, 2 * half + 1


def _counts(s: np.ndarray, lo: float, size: int) -> np.ndarray:
    node, share = _shares(s, lo, STEP)
    return np.bincount(node, 1 - share, size) + np.bincount(node + 1, share, size)


def _slopes(w: np.ndarray, normal, lo: float, fine: tuple, good: int, bad: int):
    """A fold of (gradient, curvature) of the mean over all pairs; the part of the curvature between two rows by a coarse grid."""
    used = np.flatnonzero(fine[0] + fine[1])
    first, nodes = used[0], used[-1] - used[0] + 1
    own = [c[first : first + nodes] for c in fine]
    slope = lambda t: _sigmoid(t) * _sigmoid(-t)
    # of a preferred row: the mean over the others of the probability that they win, and its slope; of an other, over the preferred
    tables = {1: (_against(own[1] / bad, _sigmoid, STEP), _against(own[1] / bad, slope, STEP)), 0: (_against(own[0] / good, lambda t: _sigmoid(-t), STEP), _against(own[0] / good, slope, STEP))}
    at, wide = lo + first * STEP, max(nodes - 1, 1) * STEP / (COARSE - 2)
    places = np.arange(nodes) * STEP + at
    far = np.arange(COARSE) * wide
    between = slope(far[:, None] - far[None, :])
    held = {k: np.zeros((COARSE, WIDTH)) for k in (0, 1)}

    def fold(x, y):
        z = normal(x)
        s = z @ w
        out = [np.zeros(WIDTH), np.zeros((WIDTH, WIDTH)), *held.values()]
        for k, sign, many in ((1, 1, good), (0, -1, bad)):
            mine, score = z[y == k], s[y == k]
            out[0] = out[0] + sign * mine.T @ np.interp(score, places, tables[k][0]) / many
            out[1] = out[1] + (mine * np.interp(score, places, tables[k][1])[:, None]).T @ mine / many
            node, share = _shares(score, at, wide)
            node = np.clip(node, 0, COARSE - 2)
            dealt = np.zeros((len(score), COARSE))
            dealt[np.arange(len(score)), node] = 1 - share
            dealt[np.arange(len(score)), node + 1] = share
            out[2 + k] = out[2 + k] + dealt.T @ mine / many
        return tuple(out)

    def curved(sums):
        grad, hess, others, preferred = sums
        cross = preferred.T @ between @ others
        return grad, hess - cross - cross.T

    return fold, curved


def _cut_at(run, normal, w: np.ndarray, q: float, wide: float = 0.005) -> dict:
    """The threshold, between two exact quantiles of all scores, and the spread of the scores."""
    lo, size = _grid(w)
    cell = lambda s: np.floor((s - lo) / STEP).astype(np.int64)

    def fold(x, y):
        s = normal(x) @ w
        return np.bincount(cell(s), minlength=size), s.sum(), (s * s).sum()

    counts, total, squares = run(fold, _added)
    n, upto = int(counts.sum()), np.cumsum(counts)
    ranks = [(n - 1) * p for p in (max(q - wide, 0), min(q + wide, 1))]
    cells = np.searchsorted(upto, [f(r) for r in ranks for f in (np.floor, np.ceil)], "right")
    wanted = np.unique(cells)
    near = np.sort(run(lambda x, y: (s := normal(x) @ w)[np.isin(cell(s), wanted)], _listed))
    place = lambda r, c: near[int(r) - (upto[c] - counts[c]) + counts[wanted[wanted < c]].sum()]
    at = 0.0
    for k, r in enumerate(ranks):
        low, high = place(np.floor(r), cells[2 * k]), place(np.ceil(r), cells[2 * k + 1])
        at += (low + (high - low) * (r - np.floor(r))) / 2
    return {"at": float(at), "unit": float(max(np.sqrt(max(squares / n - (total / n) ** 2, 0)), 1e-6))}


_ROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(model: dict, cut: float):
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text")):
                z = np.clip((features(data, offs) - model["centre"]) / model["scale"], -6, 6)
                s = (z * model["w"]).sum(1)  # row by row: a product of matrices rounds by where a text stands in its batch
                odds = np.log(cut / (1 - cut)) + 4 * (s - model["at"]) / model["unit"]
                score = np.where(s == model["at"], cut, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
                yield batch(_ROW, b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), score, score >= cut)

    return run


_FEATURE = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])


def _learn_rows(batches):
    for b in batches:
        for lo, hi, data, offs in chunks(b.column("text")):
            yield batch(_FEATURE, b.column("doc_id").slice(lo, hi - lo), list(features(data, offs).astype(np.float32)))


def sample(docs: DataFrame, labels: DataFrame, label: str, train, size: int) -> DataFrame:
    """Text and label of at most ``size`` labelled training rows, those with the smallest hashes of doc_id."""
    chosen = labels.where(F.col(label).isNotNull() & train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", label)


def _over(rows: DataFrame):
    """``run`` of ``fit_over`` for rows (quality, features): one job, of which the driver gets a value a task, at most ``PARTS``."""

    def run(fold, join):
        def part(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    x = b.column("features").flatten().to_numpy().astype(float).reshape(-1, WIDTH)
                    got = fold(x, b.column("quality").to_numpy())
                    total = got if total is None else join([total, got])
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(total), 1)], pa.binary())], ["total"])

        found = [pickle.loads(zlib.decompress(v.as_py())) for v in rows.coalesce(PARTS).mapInArrow(part, "total binary").toArrow().column(0)]
        return join(found) if found else None

    return run


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int, held: int) -> dict:
    bounded_batches(spark)
    train = remainder("doc_id", folds) != held
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(train)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & train)
    rows = docs.mapInArrow(_learn_rows, "doc_id long, features array<float>").join(marks, "doc_id").select("quality", "features")  # no text is moved
    return fit_over(_over(written(spark, rows, "quality")))


def ranked(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text); learned from ``labels`` (doc_id, quality) not held out."""
    model = learned(spark, docs, labels, folds, held)
    shown = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)))
    return shown.mapInArrow(_score(model, cut), "doc_id long, held_out boolean, score double, predicted int")


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, with all their columns; nothing is joined or dealt anew."""
    score = _score(learned(spark, docs, labels, folds, held), cut)

    def run(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            none = pa.nulls(b.num_rows, pa.int64())
            at = 0
            for part in score([pa.RecordBatch.from_arrays([none, text, pa.nulls(b.num_rows, pa.bool_())], ["doc_id", "text", "held_out"])]):
                yield b.slice(at, part.num_rows).filter(pc.equal(part.column("predicted"), 1))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)

