"""Toxicity: weak supervision by many lexicon and pattern voters, a generative label model, and a linear classifier.

1. Voters.  From a bounded sample of labelled rows, words (lexicon voters) and word beginnings of five and six bytes
   (pattern voters) that stand in toxic texts far more often than in others, and not by chance, become voters: a voter says 1 on
   a text that has its word or pattern, else nothing.  All that pass these tests vote.  One more voter says 1 where no other does.
2. Label model.  The true label is latent.  Voters that agree beyond what the label explains (their correlation within
   the posterior classes) are tied into cliques of up to three, whose joint patterns have one table per class; the
   others are independent given the label.  EM estimates the tables, i.e. each voter's accuracy and
   the correlations, with the share of toxic labels as prior; the gold labels take no other part.
3. Classifier.  L1-regularised logistic regression on hashed words and word beginnings, trained on the posteriors.

Words are runs of ASCII letters and bytes from 0x80 on, lower-cased (A-Z).  At most ``SAMPLE`` labelled rows are used, those
of the smallest hashes of doc_id; learning and scoring read whole texts and all of their features.

Edge cases: a null text is an empty text; an empty text gets the intercept's score; rows with a null doc_id or null label
are not learned from, and held_out is false for a null doc_id; repeated rows count as often; without labels
of both kinds, or without voters, every score is the share of toxic labels (0 if none).  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_bt import sample
from .text import LOWER, chunks, prefix_sums, span_hashes, word_spans
from .util import batch, bounded_batches, remainder

SAMPLE, DIMS = 20_000, 1 << 22
SEPARATOR = np.ones(256, bool)
SEPARATOR[128:] = False
SEPARATOR[[*range(65, 91), *range(97, 123)]] = False


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word beginnings, and each one's document."""
    low = LOWER[data]
    starts, ends, woffs = word_spans(low, offs, SEPARATOR)
    sums = prefix_sums(low)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    keys, owners = [span_hashes(sums, starts, ends)], [doc]
    for size in (5, 6):
        at = np.flatnonzero(ends - starts >= size)
        keys.append(span_hashes(sums, starts[at], starts[at] + size) + np.uint64(size << 48))
        owners.append(doc[at])
    return (np.concatenate(keys) & np.uint64(DIMS - 1)).astype(np.int64), np.concatenate(owners)


_FEATURE = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.int32()))])


def _learn_rows(batches):
    for b in batches:
        for lo, hi, data, offs in chunks(b.column("text")):
            key, doc = features(data, offs)
            both = np.unique(doc * DIMS + key)
            cut = np.searchsorted(both, np.arange(hi - lo + 1) * DIMS)
            yield batch(_FEATURE, b.column("toxic").slice(lo, hi - lo), [(both[s:e] % DIMS).astype(np.int32) for s, e in zip(cut[:-1], cut[1:])])


def choose_voters(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, false_share: float = 0.2) -> np.ndarray:
    """All features tied to toxic labels, the surest first: at least 3 toxic texts and 20 times the share of other texts.

    Among very many features some stand in toxic texts by chance.  Each gets the Chernoff bound of the chance that its texts
    are so toxic if it has nothing to do with the label; the Benjamini-Hochberg rule keeps those of which at most
    ``false_share`` are expected to be such.
    """
    good, bad = max(int((y == 0).sum()), 1), max(int((y == 1).sum()), 1)
    t, c = np.bincount(cols[y[rows] == 1], minlength=DIMS), np.bincount(cols[y[rows] == 0], minlength=DIMS)
    at = np.flatnonzero(t + c >= 3)
    t, c, base = t[at], c[at], bad / (good + bad)
    share = t / np.maximum(t + c, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        sure = np.where(t > 0, t * np.log(share / base), 0) + np.where(c > 0, c * np.log((1 - share) / (1 - base)), 0)
    sure = np.where(share > base, sure, 0)
    ranked = np.sort(sure)[::-1]
    passed = np.flatnonzero(ranked >= np.log(len(at) / (false_share * np.arange(1, len(at) + 1)))) if len(at) else at
    if not len(passed):
        return at[:0]
    able = (sure >= ranked[passed[-1]]) & (t >= 3) & (t * good >= 20 * c * bad)
    return at[able][np.argsort(-sure[able], kind="stable")]


def _cliques(n: int, m: int, row: np.ndarray, voter: np.ndarray, post: np.ndarray) -> list[tuple[int, ...]]:
    """Voters tied by what they share beyond the label: their summed covariance within the classes, one voter's row at a time."""
    by, start = np.argsort(voter, kind="stable"), np.searchsorted(row, np.arange(n + 1))
    cut = np.searchsorted(voter[by], np.arange(m + 1))
    one, zero = (np.bincount(voter, w[row], m) for w in (post, 1 - post))
    p, q = max(post.sum(), 1e-9), max((1 - post).sum(), 1e-9)
    sd = np.sqrt(np.maximum(one + zero - one * one / p - zero * zero / q, 1e-9))
    free, cliques = np.ones(m, bool), [(m,)]
    for j in range(m):
        if free[j]:
            free[j] = False
            texts = row[by[cut[j] : cut[j + 1]]]
            size = start[texts + 1] - start[texts]
            at = np.repeat(start[texts] - np.cumsum(size) + size, size) + np.arange(size.sum())
            tie = np.abs(np.bincount(voter[at], minlength=m) - one[j] * one / p - zero[j] * zero / q) / (sd[j] * sd)
            near = np.flatnonzero(free & (tie > 0.3))
            near = near[np.argsort(-tie[near], kind="stable")][:2].tolist()
            free[near] = False
            cliques.append((j, *near))
    return cliques


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Posterior of label 1 for each row of 0/1 votes, and the cliques of correlated voters."""
    return sparse_label_model(*votes.shape, *np.nonzero(votes), prior, rounds)


def sparse_label_model(n: int, m: int, row: np.ndarray, voter: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The same from the votes of 1 alone, each once, in order of row: work and memory follow their number."""
    voted = np.bincount(row, minlength=n) > 0
    post = np.where(voted, 0.9, 0.02)
    cliques: list[tuple[int, ...]] = [(j,) for j in range(m + 1)]
    rows, voters = np.concatenate([row, np.flatnonzero(~voted)]), np.concatenate([voter, np.full((~voted).sum(), m)])
    for phase in range(2):
        if phase:
            cliques = _cliques(n, m, row, voter, post)
        clique, bit = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        for i, c in enumerate(cliques):
            clique[list(c)], bit[list(c)] = i, 1 << np.arange(len(c))
        both, at = np.unique(rows * len(cliques) + clique[voters], return_inverse=True)
        of, which = both // len(cliques), both % len(cliques)
        code = which * 8 + np.bincount(at, bit[voters], len(both)).astype(np.int64)
        able = np.arange(8) < (1 << np.array([len(c) for c in cliques]))[:, None]
        for _ in range(rounds):
            tables = []
            for w in (post, 1 - post):
                table = np.bincount(code, w[of], 8 * len(cliques)).reshape(-1, 8)
                table[:, 0] = np.maximum(w.sum() - table.sum(1), 0)  # the rows without a vote of the clique
                table = np.where(able, table + 0.05, 0)
                tables.append(np.log(np.where(able, table / table.sum(1, keepdims=True), 1)))
            ratio = tables[0] - tables[1]
            odds = np.log(prior / (1 - prior)) + ratio[:, 0].sum() + np.bincount(of, ratio.ravel()[code] - ratio[which, 0], n)
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            moved = np.abs(new - post).max(initial=0)
            post = new
            if moved < 1e-4:
                break
    return post, cliques


def classifier(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, rounds: int = 120, l1: float = 1e-4) -> tuple[np.ndarray, float]:
    """Sparse weights and an intercept: accelerated proximal gradient on the mean logistic loss against soft labels.

    Features of fewer than three texts of the sample have no weight.
    """
    n = len(target)
    kept = np.flatnonzero(np.bincount(cols, minlength=DIMS) >= 3)
    at = np.full(DIMS, -1, np.int32)
    at[kept] = np.arange(len(kept))
    cols = at[cols]
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    dims = len(kept)
    w = v = np.zeros(dims)
    p = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    b = a = float(np.log(p / (1 - p)))
    t, seen = 1.0, np.bincount(cols, minlength=dims)
    rate = 4.0 / (1 + np.minimum(seen, n) / n * 300)  # of each coordinate: rare ones move faster
    for _ in range(rounds):
        z = np.bincount(rows, v[cols], n) + a
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(cols, r[rows], dims) / n
        nw = v - rate * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
        nb = a - r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((v - nw) * (nw - w)).sum() > 0:  # restart
            nt = 1.0
        v, a = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    z, scale, shift = np.bincount(rows, w[cols], n) + b, 1.0, 0.0
    for _ in range(50):  # the penalty shrinks scores towards the mean: two parameters put them back
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        d = p * (1 - p) + 1e-6
        grad = np.array([((p - target) * z).mean() + 1e-4 * (scale - 1), (p - target).mean()])
        hess = np.array([[(d * z * z).mean() + 1e-4, (d * z).mean()], [(d * z).mean(), d.mean() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        scale, shift = scale - step[0], shift - step[1]
    out = np.zeros(DIMS)
    out[kept] = w * scale
    return out, b * scale + shift


def fit(x: list, y: np.ndarray) -> tuple[np.ndarray, float]:
    texts = len(x)
    rows = np.repeat(np.arange(texts, dtype=np.int32), [len(r) for r in x])
    cols = np.concatenate(x).astype(np.int32, copy=False) if texts else np.zeros(0, np.int32)
    del x[:]
    share = float(y.mean()) if len(y) else 0.0
    flat = np.zeros(DIMS), float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share == 1 else -40.0)
    if not 0 < share < 1:
        return flat
    voters = choose_voters(rows, cols, y)
    if not len(voters):
        return flat
    which = np.full(DIMS, -1, np.int32)
    which[voters] = np.arange(len(voters))
    hit = np.flatnonzero(which[cols] >= 0)
    return classifier(rows, cols, sparse_label_model(texts, len(voters), rows[hit].astype(np.int64), which[cols[hit]].astype(np.int64), share)[0])


_ROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(index: np.ndarray, weight: np.ndarray, intercept: float):
    def run(batches):
        w = np.zeros(DIMS, np.float32)
        w[index] = weight
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text")):
                key, doc = features(data, offs)
                at = np.flatnonzero(w[key])
                both = np.unique(doc[at] * DIMS + key[at])
                z = intercept + np.bincount(both // DIMS, w[both % DIMS], hi - lo)
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield batch(_ROW, b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), score, score >= 0.5)

    return run


def rated(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text); learned from ``labels`` (doc_id, toxic) not held out."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = sample(docs, labels, "toxic", remainder("doc_id", folds) != held, SAMPLE).mapInArrow(_learn_rows, "toxic int, features array<int>").orderBy("toxic", "features").toArrow()
    toxic, x = rows.column("toxic").to_numpy().astype(int), [np.asarray(r) for r in rows.column("features").to_numpy()]
    del rows
    w, b = fit(x, toxic)
    index = np.flatnonzero(w)
    shown = docs.withColumn("held_out", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)))
    return shown.mapInArrow(_score(index, w[index], b), "doc_id long, held_out boolean, score double, predicted int")
