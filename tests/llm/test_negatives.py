"""Hard negatives against brute force; residue products against integer ones."""

import math

import numpy as np
import pytest
from test_secrets_warc_vectors import same_as_sql

from lodestone.llm import negatives as N


@pytest.mark.parametrize("width, size", [(1, 2**27), (3, 10), (64, 256), (64, 2**27), (700, 2**20), (5000, 300), (9000, 2**24)])
def test_products_are_exact(width, size):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-size, size + 1, (m, width)) for m in (7, 11))
    a[0], b[0], b[1] = size, size, -size  # the largest scores of both signs
    got = N.products(N.Residues(a), N.Residues(b), slice(None), slice(None))
    assert (got == a.astype(object) @ b.astype(object).T).all()
    moduli = N.chosen(width, width * size * size)
    assert len(set(moduli)) == len(moduli) and all(min(width, N._INNER) * (p // 2) ** 2 <= N._EXACT for p in moduli)


def test_few_primes_for_unit_vectors():
    assert len(N.chosen(64, 70_000)) == 2


def brute(rows, anchors, least=(80, 100), scale=256.0, k=5, n=5):
    def whole(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        out = [math.floor(scale * x) for x in v]
        return out if len(out) * max(map(abs, out)) ** 2 < 2**62 and max(map(abs, out)) < 2**31 else None

    good = [(i, y, q) for i, y, v in rows if i is not None and y is not None and (q := whole(v))]
    want = []
    for i, y, v in dict.fromkeys((i, y, tuple(v)) for i, y, v in anchors if i is not None and y is not None and whole(v)):
        q = whole(v)
        scored = sorted((-sum(a * b for a, b in zip(q, w)), j, z) for j, z, w in good if len(w) == len(q))
        best = [(j, -s) for s, j, z in scored if z == y and j != i][:k]
        for j, s in best:
            inside = [(g, -t) for t, g, z in scored if z != y and least[0] * s <= least[1] * -t <= least[1] * s][:n]
            want += [(i, j, r + 1, g, s, t) for r, (g, t) in enumerate(inside)]
    return sorted(want)


def mined(spark, rows, anchors, **how):
    make = lambda r: spark.createDataFrame(r, "id long, label int, vector array<float>").repartition(3)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in N.hard_negatives(make(rows), make(anchors), **how).select(*columns).collect())


def test_odd_rows_equal_brute_force(spark, monkeypatch):
    for name, n in (("BLOCK", 40), ("SLAB", 7), ("PANEL", 16), ("LISTED", 3)):
        monkeypatch.setattr(N, name, n)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 6)), 1)  # ties
    x[:150] = x[0]  # one vector has a third of all rows
    x[150:200] = -x[:50]  # negative scores
    rows = [(i, int(rng.integers(0, 3)) if i > 60 else 1, v.tolist()) for i, v in enumerate(x)]
    rows += [(500, None, [1.0] * 6), (501, 1, None), (502, 1, []), (503, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (504, 0, [float("nan")] * 6), (505, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (506, 1, [1e30] * 6), (507, 2, [0.0] * 6), (508, 0, [1.0] * 5), (509, 1, [1.0] * 5), (510, 1, [0.9] * 5)]
    rows += [rows[100]] * 3 + [(110, 2, rows[120][2])]  # repeated rows, an id of two labels
    anchors = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] >= 500]
    for how in (dict(), dict(least=(95, 100)), dict(positives=2, negatives=9, scale=3.0)):
        got = mined(spark, rows, anchors, **how)
        want = brute(rows, anchors, how.get("least", (80, 100)), how.get("scale", 256.0), how.get("positives", 5), how.get("negatives", 5))
        assert got == want and got


def test_large_components_and_one_label(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, (rng.normal(size=9) * 2e5).tolist()) for i in range(60)]
    anchors = rows[::5]
    rows32 = [(i, y, np.float32(v).astype(float).tolist()) for i, y, v in rows]
    assert mined(spark, rows, anchors, least=(1, 100)) == brute(rows32, rows32[::5], least=(1, 100))
    assert mined(spark, [(i, 1, v) for i, _, v in rows], anchors) == []


def test_no_rows(spark):
    some = [(1, 1, [1.0, 2.0]), (2, 2, [1.0, 2.0]), (3, 1, [1.0, 2.0])]
    assert mined(spark, [], []) == mined(spark, [], some) == mined(spark, some, []) == []
    assert mined(spark, some, some[:1]) == [(1, 3, 1, 2, 256**2 * 5, 256**2 * 5)]


def test_query_matches_sql(spark):
    same_as_sql(spark, "op13_hard_negatives")
