"""op2 learns from every labelled row and every pair: against sums over all pairs, however the rows are dealt."""

import numpy as np

from urbanframe.llm import quality_bt

from .test_operators import docs, prose


def slope(z, y, w):
    a, b = quality_bt.pairs_of(y)
    d = z[a] - z[b]
    return -(d / (1 + np.exp(d @ w))[:, None]).mean(0) + quality_bt.L2 * w


def test_every_pair_counts_and_parts_do_not_matter():
    r = np.random.default_rng(4)
    y = (r.random(900) < 0.8).astype(int)
    x = r.normal(0, 0.05, (900, quality_bt.WIDTH)) + 0.04 * y[:, None] * (np.arange(quality_bt.WIDTH) % 11 == 0)
    assert len(quality_bt.pairs_of(y)[0]) == (y == 1).sum() * (y == 0).sum()
    parts = lambda fold, join: join([join([fold(x[i : i + 70], y[i : i + 70])]) for i in range(0, 900, 70)])
    z = np.clip((x - x.mean(0)) / (x.std(0) + 0.02), -6, 6)
    one, many = quality_bt.fit(x, y), quality_bt.fit_over(parts)
    s, q = z @ many["w"], float((y == 0).mean())
    assert np.abs(slope(z, y, many["w"])).max() < 1e-6 and np.abs(one["w"] - many["w"]).max() < 1e-7
    assert abs(many["at"] - (np.quantile(s, q - 0.005) + np.quantile(s, q + 0.005)) / 2) < 1e-9 and abs(many["unit"] - s.std()) < 1e-9


def test_all_labelled_rows_are_learned_from(spark):
    rows = [(i, prose(60, i) if i % 4 else prose(30, i).upper() + " !! " + prose(20, i)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0 or i % 8 == 0)) for i in range(400)], "doc_id long, quality int")
    got = quality_bt.learned(spark, docs(spark, rows).repartition(3), labels, 4, 2)
    kept = [r for r in rows if quality_bt.zlib.crc32(str(r[0]).encode()) % 4 != 2]
    raw = [t.encode() for _, t in kept]
    x = quality_bt.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw])).astype(np.float32).astype(float)
    y = np.array([int(i % 4 > 0 or i % 8 == 0) for i, _ in kept])
    z = np.clip((x - x.mean(0)) / (x.std(0) + 0.02), -6, 6)
    assert np.allclose(got["centre"], x.mean(0)) and np.abs(slope(z, y, got["w"])).max() < 1e-6
