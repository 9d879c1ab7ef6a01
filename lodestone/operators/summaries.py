"""Extractive summaries: the most central sentences of each source.

Sentences and words of a source are the two sides of a sparse graph; a sentence's words
have weights tf * idf of unit length, so the product of the two steps sentence -> word ->
sentence is the similarity of sentences without any pair of them being made. Power
iteration over it gives each sentence its centrality; a summary is the first sentences by
it. The graph lies in tiles (``sparse``), its words being those of each source: a step is
a pass over the tiles and writes a number for each word or sentence; a word of one
sentence is a number of that sentence. A source that has a third of all sentences lies in
blocks and slabs like any other.

``graph_of`` and ``centrality`` are the same by joins: most terms are of few words, what
these hear is broadcast, only the terms of rarer words are dealt by word. They are slower,
and stand for any number of rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import sparse
from lodestone.operators.text_index import term_counts, words_of
from lodestone.sources.scratch import FEW, dropped, kept, looked_up

ROUNDS = 16  # after which scores that are not made smaller between could be too large for a number


def sentences_of(rows: DataFrame, source: str, text: str) -> DataFrame:
    """(source, id, sentence): the different sentences of each source, white space trimmed and made single."""
    found = F.explode(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))).alias("s")
    return rows.select(F.col(source).alias("source"), found).select("source", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("sentence")).filter("source is not null").distinct().withColumn("id", F.xxhash64("source", "sentence"))


@dataclass
class Graph:
    """Sentences and words of sources, by how many sentences have a word.

    words: (source, id, words array<struct<word, tf>>); heavy: (source, word, idf) of the
    words of most sentences, few enough to be broadcast, so that their terms never leave
    their rows; light: (source, id, word, x) of the other words of two sentences or more;
    lengths: (source, id, square, own), the square of a sentence's length and the part of
    it that its own words have, which no other sentence hears.
    """

    words: DataFrame
    heavy: DataFrame
    light: DataFrame
    lengths: DataFrame


def graph_of(sentences: DataFrame, least_words: int, heavy_words: int = FEW) -> Graph:
    """The graph of sentences (source, id, sentence) of enough different words.

    Words are 64-bit hashes, so that what is joined is narrow.
    """
    words = F.filter(F.split(F.lower("sentence"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    split = sentences.select("source", "id", F.transform(words, lambda w: F.xxhash64(w)).alias("w")).filter(F.size(F.array_distinct("w")) >= least_words)
    # A sentence's words are counted within its row.
    count = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("word"), F.size(F.filter("w", lambda y: y == x)).alias("tf")))
    tf = kept(split.select("source", "id", count.alias("words")), "sentence-words")
    n = tf.groupBy("source").agg(F.count("*").alias("n"))
    df = tf.select("source", F.explode("words.word").alias("word")).groupBy("source", "word").agg(F.count("*").alias("df"))
    df = kept(df.join(n, "source").select("source", "word", "df", (1 + F.log(F.col("n") / F.col("df"))).alias("idf")), "sentence-word-counts")
    heavy = kept(df.filter("df > 1").orderBy(F.desc("df"), "source", "word").limit(heavy_words).select("source", "word", "idf"), "heavy-words")
    flat = tf.select("source", "id", F.inline("words"))
    rest = flat.join(F.broadcast(heavy), ["source", "word"], "left_anti").join(df.hint("merge"), ["source", "word"])
    rest = kept(rest.select("source", "id", "word", "df", (F.col("tf") * F.col("idf")).alias("x")), "light-terms")
    x = F.col("tf") * F.col("idf")
    squares = flat.join(F.broadcast(heavy), ["source", "word"]).groupBy("source", "id").agg(F.sum(x * x).alias("square")).withColumn("own", F.lit(0.0))
    others = rest.groupBy("source", "id").agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.sum(F.when(F.col("df") == 1, F.col("x") * F.col("x")).otherwise(0.0)).alias("own"))
    lengths = kept(squares.unionByName(others).groupBy("source", "id").agg(F.sum("square").alias("square"), F.sum("own").alias("own")), "lengths")
    return Graph(tf, heavy, rest.filter("df > 1").drop("df"), lengths)


def centrality(graph: Graph, rounds: int = 3) -> DataFrame:
    """(source, id, score) after ``rounds`` steps from equal scores, the largest of a source being 1."""
    sentence, word = ["source", "id"], ["source", "word"]
    flat = lambda rows, *more: rows.select("source", "id", *more, F.inline("words")).join(F.broadcast(graph.heavy), word)
    x = F.col("tf") * F.col("idf")
    state = graph.lengths.withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        said = state.select("source", "id", (F.col("score") / F.sqrt("square")).alias("said"))
        heard = flat(graph.words.join(said.hint("shuffle_hash"), sentence), "said").groupBy(word).agg(F.sum(x * F.col("said")).alias("heard"))
        heard = kept(heard, "heard")  # of heavy words
        raw = graph.words.select("source", "id", F.inline("words")).join(F.broadcast(heard.join(F.broadcast(graph.heavy), word)), word).groupBy(sentence).agg(F.sum(x * F.col("heard")).alias("raw"))
        by_word = graph.light.join(said.hint("merge"), sentence).groupBy(word).agg(F.sum(F.col("x") * F.col("said")).alias("heard"))
        light = graph.light.join(by_word.hint("merge"), word).groupBy(sentence).agg(F.sum(F.col("x") * F.col("heard")).alias("raw"))
        raw = raw.unionByName(light).groupBy(sentence).agg(F.sum("raw").alias("raw"))
        # A sentence may have nothing but words of its own.
        raw = state.join(raw.hint("merge"), sentence, "left").withColumn("raw", (F.coalesce("raw", F.lit(0.0)) + F.col("own") * F.col("score") / F.sqrt("square")) / F.sqrt("square"))
        raw = kept(raw.drop("score"), "scores")
        top = raw.groupBy("source").agg(F.max("raw").alias("top"))
        state = raw.join(top, "source").select("source", "id", "square", "own", (F.col("raw") / F.col("top")).alias("score"))
    return state.select("source", "id", "score")


def matrix_of(sentences: DataFrame, least_words: int) -> sparse.Matrix:
    """The matrix of sentences (source, id, sentence) of enough different words; a row's group is the hash of its source."""
    split = sentences.select("id", F.xxhash64("source").alias("group"), F.transform(words_of(F.col("sentence")), lambda w: F.xxhash64("source", w)).alias("w"))
    made = term_counts(split)
    terms = made.filter(F.size("terms") >= least_words)
    n = kept(terms.groupBy("group").agg(F.count("*").alias("n")), "sources")
    terms = terms.join(looked_up(n), "group")
    df = terms.select("n", F.explode("terms.word").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.max("n").alias("n")).filter("df > 1")
    words = kept(df.select("word", (1 + F.log(F.col("n") / F.col("df"))).alias("weight")), "sentence-words")
    matrix = sparse.built(terms.select("id", "group", "terms", (1 + F.log("n")).alias("alone")), words, 1)
    for used in (made, n, words):
        dropped(used)
    return matrix


def tiled_centrality(sentences: DataFrame, least_words: int, rounds: int) -> DataFrame:
    """(id, score) after ``rounds`` steps from equal scores, the largest of a source being 1.

    A source is connected to no other, so its scores are divided by the largest once, at the end.
    """
    a = matrix_of(sentences, least_words)
    score = None

    def said(b: int, n: int) -> np.ndarray:
        return np.ones((n, 1)) if score is None else score.block(b)

    for _ in range(rounds):
        heard = a.by_words(said, 1)
        before, score = score, a.by_rows(lambda s, words: heard.block(s), 1, said)  # noqa: B023
        for used in (heard, *([before] if before else [])):
            dropped(used.uri)

    def scores(b: int) -> pa.RecordBatch:
        ids, groups, _, _ = a.rows(b)
        return pa.RecordBatch.from_arrays([ids, groups, pa.array(said(b, len(ids))[:, 0])], ["id", "group", "raw"])

    raw = sparse.over(a.spark, a.blocks, scores, "id long, group long, raw double")
    top = looked_up(kept(raw.groupBy("group").agg(F.max("raw").alias("top")), "tops"))
    return raw.join(top, "group").select("id", "group", (F.col("raw") / F.col("top")).alias("score"))


def summaries(rows: DataFrame, source: str, text: str, k: int = 3, rounds: int = 3, least_words: int = 4, heavy_words: int | None = None) -> DataFrame:
    """(source, rank, sentence, score) of the k most central sentences of each source, ties to the smaller text; scores to six places.

    ``heavy_words``: by joins, with so many words broadcast, in place of tiles.
    """
    sentences = kept(sentences_of(rows, source, text), "sentences")
    if heavy_words is None and rounds <= ROUNDS:
        scored, by = tiled_centrality(sentences, least_words, rounds), "group"
    else:
        scored, by = centrality(graph_of(sentences, least_words, FEW if heavy_words is None else heavy_words), rounds), "source"
    # Only sentences that can be among the first, ties included, need their texts.
    scored = scored.withColumn("score", F.round("score", 6)).withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.desc("score"))))
    scored = kept(scored.filter(F.col("_r") <= k).select("id", "score"), "best")
    named = sentences.join(looked_up(scored), "id")
    order = Window.partitionBy("source").orderBy(F.desc("score"), F.asc("sentence"))
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("source", "rank", "sentence", "score")


def source_summaries(rows: DataFrame, source: str, text: str, k: int = 3, limit: int = 500) -> DataFrame:
    """(source_id, summary): the chosen sentences as one text, cut at ``limit`` characters."""
    best = summaries(rows, source, text, k)
    joined = best.groupBy(F.col("source").alias("source_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))  # k sentences
    return joined.withColumn("summary", F.when(F.length("summary") > limit, F.concat(F.substring("summary", 1, limit), F.lit("..."))).otherwise(F.col("summary")))
