"""Latent factors against a dense decomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import latent


def topics(n=120, seed=5):
    rng = np.random.default_rng(seed)
    words = [[f"t{t}w{i}" for i in range(12)] for t in range(4)]
    share = [0.5, 0.25, 0.15, 0.1]
    docs = []
    for i in range(n):
        t = int(rng.choice(4, p=share))
        docs.append((i, t, " ".join(rng.choice(words[t], 25)) + " " + " ".join(rng.choice(words[(t + 1) % 4], 3))))
    return docs


def dense(docs, words):
    split = [t.split() for _, _, t in docs]
    n = len(docs)
    idf = {w: math.log((n + 1) / (sum(w in s for s in split) + 1)) for w in words}
    a = np.array([[s.count(w) * idf[w] for w in words] for s in split])
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def test_subspace_equals_dense_svd(spark):
    docs = topics()
    df = spark.createDataFrame(docs, "id long, topic int, text string").repartition(3)
    model = latent.fit(df, "text", k=4, rounds=12)
    words = sorted({w for _, _, t in docs for w in t.split()})
    a = dense(docs, words)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert model.strength == pytest.approx(s[:4].tolist(), rel=1e-4)
    hashed = {r.word: r for r in model.words.collect()}
    names = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    v = np.array([[hashed[r.h][f"v{i}"] for i in range(4)] for r in names])
    order = {r.w: i for i, r in enumerate(names)}
    v = v[[order[w] for w in words]]
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-6)
    assert np.linalg.svd(vt[:4] @ v)[1].min() > 0.999  # the same subspace
    emb = {r.id: r.embedding for r in model.embed(df, "text").collect()}
    x = np.array([emb[i] for i in range(len(docs))])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    same = x @ x.T
    t = np.array([t for _, t, _ in docs])
    assert same[t[:, None] == t].mean() > 0.9 > 0.5 > same[t[:, None] != t].mean()


def test_fit_is_reproduced_and_odd_texts(spark):
    docs = topics(60, 6) + [(100, 0, None), (101, 0, ""), (102, 0, "only unseen once")]
    schema = "id long, topic int, text string"
    one, two = (latent.fit(spark.createDataFrame(docs, schema).repartition(n), "text", k=3, rounds=8) for n in (1, 4))
    a, b = ({r.word: [r[f"v{i}"] for i in range(3)] for r in m.words.collect()} for m in (one, two))
    assert a.keys() == b.keys() and all(a[w] == pytest.approx(b[w], abs=1e-6) for w in a)
    emb = {r.id: r.embedding for r in one.embed(spark.createDataFrame(docs, schema), "text").collect()}
    assert emb[100] is None and emb[101] is None and emb[102] is None and len(emb) == 63
    stored = latent.embedder(one)(spark.createDataFrame([("x", "t0w1 t0w2"), ("y", "t0w1 t0w2"), ("z", "?")], "key string, body string"), "body").collect()
    by = {r.key: r.embedding for r in stored}
    assert by["x"] == by["y"] and by["z"] is None
    assert latent.fit(spark.createDataFrame([], schema), "text", k=2, rounds=1).words.count() == 0
