"""Patterns against their meaning: every way to bind the variables, tried one by one."""

import itertools
import random

import pytest

from lodestone.operators.match import Graph, PatternError, match, parse


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(11)
    files = [(i, f"f{i % 7}", i % 3) for i in range(12)]
    classes = [(i, f"C{i % 9}", rng.randrange(14)) for i in range(25)]  # some of no file
    calls = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)] + [(3, 3), (1, 2), (1, 2), (None, 4)]
    g = Graph().node("file", spark.createDataFrame(files, "id int, name string, kind int"), "id").node("class", spark.createDataFrame(classes, "id int, name string, file int"), "id")
    g = g.edge("DEFINES", "file", "class", spark.createDataFrame(classes, "id int, name string, file int"), "file", "id")
    return g.edge("CALLS", "class", "class", spark.createDataFrame(calls, "a int, b int"), "a", "b"), files, classes, calls


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chains_and_both_directions(made):
    g, files, classes, calls = made
    known = {c[0]: c for c in classes}
    pairs = {(a, b) for a, b in calls if a is not None}
    got = match(g, "MATCH (f:file {kind: 1})-[:DEFINES]->(c:class)-[:CALLS]->(d:class)<-[:DEFINES]-(e:file) WHERE c.id > 2 AND d.name STARTS WITH 'C' RETURN f.name AS f, c AS c, d AS d, e.name AS e")
    want = {(f[1], a, b, e[1]) for (a, b), f, e in itertools.product(pairs, files, files) if f[2] == 1 and known[a][2] == f[0] and known[b][2] == e[0] and a > 2}
    assert rows(got) == sorted(want, key=repr) and want
    loops = match(g, "MATCH (c:class)-[:CALLS]->(c) RETURN c")
    assert rows(loops) == sorted(((a,) for a, b in pairs if a == b), key=repr)
    triangle = match(g, "MATCH (a:class)-[:CALLS]->(b:class)-[:CALLS]->(c:class), (c)-[:CALLS]->(a) RETURN a, b, c")
    assert rows(triangle) == sorted(((a, b, d) for (a, b), (c, d) in itertools.product(pairs, pairs) if b == c and (d, a) in pairs), key=repr)


def test_optional_branches_are_counted_by_themselves(made):
    g, files, classes, calls = made
    pairs = {(a, b) for a, b in calls if a is not None}
    out = match(g, "MATCH (f:file) OPTIONAL MATCH (f)-[:DEFINES]->(c:class) OPTIONAL MATCH (f)-[:DEFINES]->(x:class)-[:CALLS]->(d:class) WHERE c.id < 20 RETURN f.name AS name, count(DISTINCT f) AS files, count(DISTINCT c) AS classes, count(DISTINCT d.name) AS called, max(d.name) AS top, collect(DISTINCT c.name)[0..2] AS few ORDER BY name DESC")
    want = []
    for name in sorted({f[1] for f in files}, reverse=True):
        own = {f[0] for f in files if f[1] == name}
        c = {k for k in classes if k[2] in own and k[0] < 20}
        d = {classes[b][1] for a, b in pairs if classes[a][2] in own}
        want.append((name, len(own), len({k[0] for k in c}), len(d), max(d, default=None), sorted({k[1] for k in c})[:2]))
    got = [(r.name, r.files, r.classes, r.called, r.top, r.few or []) for r in out.collect()]
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    total = match(g, "MATCH (f:file) OPTIONAL MATCH (f)-[:DEFINES]->(c:class) RETURN count(DISTINCT f) AS files, count(DISTINCT c) AS classes")
    assert rows(total) == [(12, len({k[0] for k in classes if k[2] < 12}))]


def test_left_rows_and_limits(made):
    g, files, classes, _ = made
    out = match(g, "MATCH (f:file) OPTIONAL MATCH (f)-[:DEFINES]->(c:class) WHERE c.name CONTAINS '3' RETURN f AS f, c.name AS name")
    want = set()
    for f in files:
        own = {(f[0], k[1]) for k in classes if k[2] == f[0] and "3" in k[1]}
        want |= own or {(f[0], None)}
    assert rows(out) == sorted(want, key=repr)
    few = match(g, "MATCH (f:file) RETURN f ORDER BY f DESC LIMIT 3")
    assert [r.f for r in few.collect()] == [11, 10, 9]


@pytest.mark.parametrize(
    "text",
    ["", "MATCH (a:file) RETURN b", "MATCH (a:zzz) RETURN a", "MATCH (a:file), (b:class) RETURN a, b", "MATCH (a:file)-[:NOPE]->(b) RETURN a", "MATCH (a:class)-[:DEFINES]->(b) RETURN a", "MATCH (a:file) RETURN a.nothing", "MATCH (a:file) RETURN count(a)", "MATCH (a:file) RETURN a ORDER BY z", "MATCH (a:file) RETURN collect(DISTINCT a)", "MATCH (a:file", "MATCH (a:file) WHERE a.id ~ 3 RETURN a", "MATCH (a:file) RETURN a, a", "MATCH (a:file) OPTIONAL MATCH (b:class)-[:CALLS]->(c:class) RETURN a", "MATCH (a:file) OPTIONAL MATCH (a) RETURN a", "MATCH (a:file) RETURN a extra 1"],
)
def test_what_is_refused(made, text):
    with pytest.raises(PatternError):
        match(made[0], text)


def test_parse():
    q = parse("MATCH (a:x {k: 'it\\'s', n: -2.5, t: true})<-[:E]-(:y) RETURN a.k AS k LIMIT 2")
    assert [f[1:] for f in q.fixed] == [("k", "=", "it's"), ("n", "=", -2.5), ("t", "=", True)] and q.required[0].dst == "a" and q.limit == 2
