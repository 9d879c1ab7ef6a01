"""Table functions, the newest-version stream and summaries against plain Python."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import tables
from lodestone.operators.ingest import cut_text
from lodestone.operators.summaries import source_summaries, summaries
from lodestone.streaming import newest


def test_table_functions_keep_columns(spark):
    tables.register(spark)
    rows = [(1, "First. Second one. " * 20, [1, 2], "a"), (2, None, None, "b"), (3, "", [3], None), (4, "x ```py\ncode()\n``` y ```\nplain text here\n``` z ```", [], "d")]
    df = spark.createDataFrame(rows, "id long, text string, tags array<int>, `odd name` string")
    got = spark.sql("SELECT * FROM chunk_text(TABLE({t}), 'text', 50)", t=df)
    assert got.columns == ["id", "tags", "odd name", "chunk_number", "content"] and got.schema["tags"].dataType.simpleString() == "array<int>"
    assert sorted((r.id, r.chunk_number, r.content) for r in got.collect()) == [(i, n, c) for i, t, _, _ in rows for n, c in enumerate(cut_text(t, 50))]
    blocks = spark.sql("SELECT id, block, language, code FROM code_blocks(TABLE({t}), 'text', 3) WHERE block >= 0 ORDER BY ALL", t=df)
    assert [tuple(r) for r in blocks.collect()] == [(4, 0, "py", "code()"), (4, 1, "", "plain text here")]
    lateral = spark.sql("SELECT count(*) AS n FROM chunk_text(TABLE(SELECT text FROM {t} WHERE id < 3), 'text') WHERE length(content) > 0", t=df)
    assert lateral.first().n == 1


@pytest.mark.parametrize("call", ["chunk_text(TABLE({t}), 'nope', 5)", "chunk_text(TABLE({t}), 'text', 0)", "chunk_text(TABLE({t}), 'text', 'x')", "code_blocks(TABLE({t}), 'text', -1)", "chunk_text(TABLE(SELECT text, id AS content FROM {t}), 'text', 5)"])
def test_table_functions_refuse(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="argument|column|chunks need"):
        spark.sql(f"SELECT * FROM {call}", t=spark.createDataFrame([(1, "a")], "id long, text string"))


def test_newest_version_in_any_order(spark, tmp_path):
    """Batches in any order, repeated and with equal times, leave what the whole table gives; state is per key."""
    rng = random.Random(12)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("abcdef"), start + dt.timedelta(minutes=rng.randrange(600)), rng.choice(["v1", "v2", None])) for _ in range(120)]
    rows += rows[:20] + [("late", start, "only"), (None, start, "no key"), ("g", None, "no time")]
    rng.shuffle(rows)
    kind = "url string, at timestamp, body string"
    for i in range(4):
        spark.createDataFrame(rows[i::4], kind).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", newest.PROVIDER)
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        log = newest.newest_versions(stream, "url", "at", "body", late="20 days")
        q = log.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None and len([p for p in q.recentProgress if p.numInputRows]) == 4
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(f"{tmp_path}/out")
    whole = newest.current(spark.createDataFrame(rows, kind).select(F.col("url").alias("key"), F.col("at").alias("time"), F.col("body").alias("value")).filter("key is not null"))
    assert sorted(map(tuple, newest.current(out).collect())) == sorted(map(tuple, whole.collect()))
    assert out.groupBy("key").agg(F.max("versions").alias("n")).filter("key = 'late'").first().n == 1
    assert out.count() < len(rows)  # versions that were older when they came are not in the log


def test_late_versions_are_dropped_and_state_expires(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    day = lambda n: start + dt.timedelta(days=n)
    batches = [[("a", day(0), "a0"), ("b", day(0), "b0")], [("b", day(20), "b20")], [("a", day(1), "too late"), ("b", day(19), "b19")], [("a", day(21), "a21")]]
    kind = "url string, at timestamp, body string"
    source = f"{tmp_path}/in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", newest.PROVIDER)
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(kind).parquet(source)
            q = newest.newest_versions(stream, "url", "at", "body", late="2 days", keep_days=5).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert not q.isActive and q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    log = sorted((r.key, r.value, r.versions) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # b19 is within the watermark but older than what b has; a is new again after its state has expired.
    assert log == [("a", "a0", 1), ("a", "a21", 1), ("b", "b0", 1), ("b", "b20", 2)]


def test_sessions(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([("u", t(0)), ("u", t(29)), ("u", t(59)), ("v", t(0)), ("u", t(200))], "user string, at timestamp")
    got = sorted((r.key, r.n) for r in newest.sessions(df, "at", "user").collect())
    assert got == [("u", 1), ("u", 3), ("v", 1)]  # a gap of just thirty minutes is within a run


def central(docs, rounds, least):
    by = {}
    for s, t in docs:
        for x in re.findall(r"[^.!?\n]+[.!?]*", t or ""):
            by.setdefault(s, set()).add(" ".join(x.split()))
    out = {}
    for s, sentences in by.items():
        split = {x: [w for w in re.split(r"[^\w]+", x.lower()) if w] for x in sentences}
        split = {x: w for x, w in split.items() if len(set(w)) >= least}
        df = {}
        for w in split.values():
            for y in set(w):
                df[y] = df.get(y, 0) + 1
        vec = {x: {y: w.count(y) * (1 + math.log(len(split) / df[y])) for y in w} for x, w in split.items()}
        vec = {x: {y: a / math.sqrt(sum(b * b for b in v.values())) for y, a in v.items()} for x, v in vec.items()}
        score = dict.fromkeys(vec, 1.0)
        for _ in range(rounds):
            new = {x: sum(a * sum(vec[z].get(y, 0) * score[z] for z in vec) for y, a in v.items()) for x, v in vec.items()}
            score = {x: a / max(new.values()) for x, a in new.items()}
        out[s] = sorted((-round(a, 6), x) for x, a in score.items())
    return out


def test_summaries_equal_dense_iteration(spark):
    rng = random.Random(13)
    words = ["Spark", "reads", "tables", "quickly", "été", "and", "the", "rows", "join", "x1"]
    docs = [(rng.choice("pq"), ". ".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(5)) + rng.choice([".", "!", "?\nend"])) for _ in range(12)]
    docs += [("r", "too short. one two. "), ("s", None), (None, "No source for these four words."), ("t", "Only this sentence is here now.")]
    for rounds in (1, 3):
        got = {}
        for r in summaries(spark.createDataFrame(docs, "source string, text string"), "source", "text", 4, rounds).orderBy("source", "rank").collect():
            got.setdefault(r.source, []).append((-r.score, r.sentence))
        want = {s: v[:4] for s, v in central([d for d in docs if d[0]], rounds, 4).items() if v}
        assert got.keys() == want.keys() == {"p", "q", "t"}
        for s in want:
            assert [x for _, x in got[s]] == [x for _, x in want[s]] and [a for a, _ in got[s]] == pytest.approx([a for a, _ in want[s]], abs=2e-6)
    short = {r.source_id: r.summary for r in source_summaries(spark.createDataFrame(docs, "source string, text string"), "source", "text", 2, 20).collect()}
    assert short["t"] == "Only this sentence i..."
