"""Fill-in-middle: every text cut as plain slicing cuts it, and rebuilt from output and form."""

import hashlib
import re

import pytest
from test_secrets_warc_vectors import same_as_sql

from lodestone.llm.infill import UNITS, Infill, restored, transform

ODD = ["hello wörld 😀😀 x", None, "", "a<P>b", "\r\n \n$1\\$ \\1", "abc", "😀" * 3000, "<P<S<M", "<", ">", "S><M>", " ", "\n\n", "x" * 1024, "y" * 1025, "z " * 2049, "é́\x00q"]


def cut(text, unit):
    return re.findall({"char": r"(?s:.)", "word": r"\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}[unit], text, re.ASCII)


def expected(key, text, how):
    text, h = text or "", hashlib.sha256(f"{how.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    parts = cut(text, how.unit)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(x in text for x in (how.prefix, how.suffix, how.middle)) or h[2] % 100 >= 100 - how.plain_percent:
        return n, "plain", None, None, text
    if h[3] % 100 < how.spm_percent:
        return n, "spm", a, b - a, how.suffix + s + how.prefix + p + how.middle + m
    return n, "psm", a, b - a, how.prefix + p + how.suffix + s + how.middle + m


@pytest.mark.parametrize("how", [Infill(), Infill(unit="word", seed="7"), Infill(unit="line", spm_percent=60), Infill("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>", plain_percent=0), Infill("$0\\", "[*]+", "(.^", spm_percent=50)])
def test_cuts_equal_slices_and_texts_come_back(spark, how):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD * 12)] + [(None, "no id at all", "y", 2), (3, "repeated", "z", 3), (3, "repeated", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, `a.b` int").withColumnRenamed("a.b", "output")
    got = transform(docs, how)
    from pyspark.sql import functions as F

    got = got.withColumn("back", restored(F.col("output"), F.col("form"), how)).collect()
    want = sorted(((k, *expected(k, t, how), t or "") for k, t, _, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.back) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_texts_take_linear_time(spark):
    rows = [(1, "x" * 3_000_000 + "é"), (2, "word " * 400_000), (3, "\n" * 1_000_000)]
    for unit in UNITS:
        got = {r.doc_id: r for r in transform(spark.createDataFrame(rows, "doc_id long, text string"), Infill(unit=unit)).collect()}
        for k, t in rows:
            assert tuple(got[k])[2:] == expected(k, t, Infill(unit=unit))


def test_no_rows_and_wrong_markers(spark):
    assert transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for bad in (dict(prefix="<S>"), dict(prefix="<"), dict(prefix=""), dict(prefix="a<", suffix="<b"), dict(unit="byte")):
        with pytest.raises(ValueError):
            Infill(**bad)


def test_one_projection(spark):
    plan = transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query_matches_sql(spark):
    same_as_sql(spark, "op12_fill_in_middle")
