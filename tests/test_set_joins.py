"""Near names, containment and walks of many starts against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import containment, ingest, near_names


def similarity(a, b):
    return len(set(a.lower()) & set(b.lower())) / max(len(a), len(b))


@pytest.mark.parametrize("least", [0.8, 0.5, 0.3, 1.0])
def test_near_names_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    names = ["".join(rng.choice("abcdefghijÄé 😀") for _ in range(rng.randrange(1, 12))) for _ in range(250)]
    names += ["Aa", "aA", "a", "A", "", None, "abcdefghij", "jihgfedcba", "abcdefghiJ", "x", "xy", "xyz"] + [names[0]] * 100 + [names[1].upper()]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(3)
    got = {(r.a, r.b): (r.similarity, r.n_a, r.n_b) for r in near_names.near_names(df, "name", least).collect()}
    count = {n: names.count(n) for n in set(names) if n}
    want = {(a, b): (similarity(a, b), count[a], count[b]) for a in count for b in count if a < b and similarity(a, b) >= least}
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0]), *want[k][1:]) for k in want)


def test_near_names_compare_few_pairs(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    names = {"".join(rng.sample(letters, rng.randrange(6, 14))) for _ in range(1500)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    tried = near_names.candidates(df, "name", 0.8)
    n = tried.count()
    assert n == tried.select("a_class", "b_class").distinct().count()
    assert n < 0.002 * len(names) ** 2 / 2  # of all pairs
    assert near_names.near_names(df, "name", 0.8).count() == sum(similarity(a, b) >= 0.8 for a in names for b in names if a < b)
    assert near_names.near_names(df.limit(0), "name").count() == 0


EXAMPLES = [
    ('{"a": 1, "b": {"c": [1, 2]}}', '{"b": {"c": [2]}}', True),
    ('{"a": 1}', '{"a": 1.0}', True),
    ('{"a": 1}', '{"a": "1"}', False),
    ('{"a": true}', '{"a": "true"}', False),
    ('{"a": null}', '{"a": null}', True),
    ("{}", '{"a": null}', False),
    ('{"a": {}}', '{"a": {}}', True),
    ('{"a": []}', '{"a": {}}', False),
    ('{"a": {"b": 1}}', '{"a": {}}', True),
    ('{"a": [1]}', '{"a": []}', True),
    ('{"a": [1]}', '{"a": 1}', False),
    ('["x", "y"]', '"x"', True),
    ('[["x"]]', '"x"', False),
    ('"x"', '["x"]', False),
    ('"x"', '"x"', True),
    ("[1, 2, 3]", "[3, 1, 3]", True),
    ("[1, 2]", "[[1, 2]]", False),
    ("[1, 2, [1, 3]]", "[[1, 3]]", True),
    ("[[1], [3]]", "[[1, 3]]", False),
    ('[{"a": 1}, {"b": 2}]', '[{"a": 1, "b": 2}]', False),
    ('[{"a": 1}, {"b": 2}]', '[{"b": 2}, {"a": 1}]', True),
    ('{"a/b": 1, "~": 2}', '{"a/b": 1}', True),
    ('{"a": {"b": 1}}', '{"a/b": 1}', False),
    ('{"~*": 1}', "[1]", False),
    ("[1]", '{"~*": 1}', False),
    ('[{"a": []}]', '[{"a": []}]', True),
    ("[[]]", "[[]]", True),
    ("[1]", "[[]]", False),
    ("1e2", "100", True),
    ("{", "{}", False),
    ('{"a": 1}', "{}", True),
    ("[1]", "{}", False),
]


def test_containment_examples(spark):
    docs = spark.createDataFrame([(i, d) for i, (d, _, _) in enumerate(EXAMPLES)] + [(100, None), (None, "{}")], "id long, doc string")
    filters = spark.createDataFrame([(i, f) for i, (_, f, _) in enumerate(EXAMPLES)] + [(100, None), (101, "[")], "filter_id int, want string")
    hits = {tuple(r) for r in containment.contained(docs, "doc", filters, "want").collect()}
    for i, (d, f, ok) in enumerate(EXAMPLES):
        assert ((i, i) in hits) == ok, (d, f)
    assert not any(100 in h or h[0] == 101 for h in hits)


def test_containment_of_random_documents_and_variants(spark):
    rng = random.Random(6)

    def made(depth=0):
        kind = rng.random()
        if depth > 2 or kind < 0.4:
            return rng.choice([0, 1, 1.5, "a", "b", "", None, True])
        if kind < 0.7:
            return {rng.choice("abc"): made(depth + 1) for _ in range(rng.randrange(3))}
        return [made(depth + 1) for _ in range(rng.randrange(4))]

    docs, wants = [made() for _ in range(400)], [made() for _ in range(120)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, doc string")
    filters = spark.createDataFrame([(i, json.dumps(w)) for i, w in enumerate(wants)], "filter_id int, want string")
    want = {(j, i) for i, d in enumerate(docs) for j, w in enumerate(wants) if containment.holds(containment._LOADS(json.dumps(d)), containment._LOADS(json.dumps(w)))}
    assert {tuple(r) for r in containment.contained(rows, "doc", filters, "want").collect()} == want and len(want) > 200
    variants = containment.contained(rows.withColumn("doc", F.parse_json("doc")), "doc", filters.withColumn("want", F.parse_json("want")), "want")
    assert {tuple(r) for r in variants.collect()} == want


def test_walks_of_many_starts(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)] + [(5, 5), (7, None), (None, 8)] + [(1, 2)] * 50
    edges = spark.createDataFrame(pairs, "src long, dst long")
    starts = [("x", 1), ("y", 1), ("y", 30), ("z", 999), ("w", None)]
    to = {}
    for a, b in pairs:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    for depth in (1, 2, 4):
        want = set()
        for name in "xyz":
            level = {n for s, n in starts if s == name}
            seen = {}
            for i in range(depth):
                seen |= {n: i for n in level}
                level = {b for n in level for b in to.get(n, ())} - seen.keys()
            want |= {(name, n, i) for n, i in seen.items()}
        for walk in (ingest.frontiers, ingest.frontiers_recursive):
            assert {tuple(r) for r in walk(spark.createDataFrame(starts, "start string, node long"), edges, depth).select("start", "node", "depth").collect()} == want


def test_a_level_is_a_table(spark):
    """No plan holds the levels before it, whatever the session has set."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    plan = ingest.frontier(spark.createDataFrame([(0,)], "node long"), edges, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
