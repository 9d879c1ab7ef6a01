"""Matrices in tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import latent, sparse, summaries
from lodestone.sources import scratch


def test_products_shuffle_no_terms(spark, monkeypatch):
    """Each product dealt out a row of k sums for nearly every term, twice a round."""
    docs = spark.range(90).select("id", F.concat_ws(" ", F.lit("a b"), *((F.col("id") % n).cast("string") for n in (7, 11, 13)), F.md5(F.col("id").cast("string"))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "3 5"), (95, None)], "id long, text string"))
    made = {}
    for limit in (sparse.LIMIT, 8):
        monkeypatch.setattr(sparse, "LIMIT", limit)
        model = latent.fit(docs.repartition(3), "text", k=2, rounds=2)
        found = model.fitted()
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        made[limit] = model.strength, {r.word: list(r)[1:] for r in model.words.collect()}, {r.id: r.embedding for r in found.collect()}
    one, many = made.values()
    assert one[0] == pytest.approx(many[0]) and one[1].keys() == many[1].keys() and one[2].keys() == many[2].keys() == {*range(90), None}
    assert all(np.allclose(one[i][x], many[i][x], atol=1e-9) for i in (1, 2) for x in one[i])
    # Of the dense blocks, only the last ones are still there.
    assert sum("of-rows" in x[2] or "of-words" in x[2] for x in scratch._made[-20:]) <= 4


def test_start_is_the_hash_of_spark(spark):
    words = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    hashes = spark.createDataFrame([(w,) for w in words], "w long").select(*(F.pmod(F.xxhash64("w", F.lit(i)), F.lit(2_000_003)).alias(f"h{i}") for i in range(3))).collect()
    got = np.stack([latent._start(np.array(words), i) for i in range(3)], 1)
    assert np.array_equal(got, np.array(hashes) / 1_000_001.0 - 1.0)


def test_steps_between_sentences_and_words_shuffle_nothing(spark, monkeypatch):
    """Each step dealt the terms of rarer words out by sentence and by word, and sums back; words were counted by comparing all with all."""
    text = [f"alpha beta w{i % 5} w{i % 3} only{i} gamma alpha. one{i} two{i} three{i} four{i}! w{i % 3} w{i % 4} w{i % 5} beta" for i in range(40)]
    text.append(" ".join(f"x{i % 700} y{i} w1" for i in range(2000)))
    docs = spark.createDataFrame([("ab"[i % 2], t) for i, t in enumerate(text)] + [("c", "too short"), ("d", None)], "source string, text string").repartition(3)
    want = [tuple(r) for r in summaries.summaries(docs, "source", "text", 5, heavy_words=3).orderBy("source", "rank").collect()]
    assert len(want) == 10
    for limit in (sparse.LIMIT, 16):
        monkeypatch.setattr(sparse, "LIMIT", limit)
        assert [tuple(r) for r in summaries.summaries(docs, "source", "text", 5).orderBy("source", "rank").collect()] == want
    scored = summaries.tiled_centrality(scratch.kept(summaries.sentences_of(docs, "source", "text"), "sentences"), 4, 3)
    assert "Exchange hash" not in scored._jdf.queryExecution().executedPlan().toString()
