import random
import zlib

import numpy as np

from clarispark.llm import quality


def test_fit_takes_every_labelled_row_and_every_pair(spark):
    rng = random.Random(5)
    rows = []
    for i in range(7200):  # 5,300 or so of quality 1 are not held out, more than any sample that was taken once
        good = i % 60 > 0
        words = [rng.choice(["ta", "Ri", "mo9", "SE", "lu."]) for _ in range(rng.randint(1, 9))]
        rows.append((i, " ".join(words if good or rng.random() < 0.3 else [w + "$" for w in words]), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.fit(spark, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))

    used = [(quality.features(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([f for f, _ in used]), np.array([y for _, y in used])
    assert (y == 1).sum() > 5000
    assert np.allclose(model.mean, x.mean(0), atol=1e-9) and np.allclose(model.std, x.std(0), atol=1e-8)
    z = np.clip((x - model.mean) / model.std, -8, 8)
    w, pairs = model.weights, (y == 1).sum() * (y == 0).sum()
    grad = quality.L2 * w  # of the loss over all pairs, listed: zero at its minimum
    for bad in z[y == 0]:
        d = z[y == 1] - bad
        grad = grad - (d / (1 + np.exp(d @ w))[:, None]).sum(0) / pairs
    assert np.abs(grad).max() < 1e-6 < np.abs(w).max()
    raw = np.sort(model.raw(x))
    n = int((y == 0).sum())
    assert np.isclose(model.cut, (raw[n - 1] + raw[n]) / 2, atol=1e-9) and np.isclose(model.spread, np.median(np.abs(raw - model.cut)) / 4, atol=1e-9)
