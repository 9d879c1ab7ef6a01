import hashlib
import re

import duckdb
import numpy as np
import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(body, n):
    t = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
    return {tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))} if t else set()


def brute_groups(rows, n, num, den):
    """component of each row (by position): the smallest id reachable by links."""
    sets = [shingles(b, n) for _, b in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                    low[root(i)] = root(j)
    of = [root(i) for i in range(len(rows))]
    best = {}
    for i, c in enumerate(of):
        x = rows[i][0]
        if c not in best or best[c] is None or (x is not None and x < best[c]):
            best[c] = x
    return [best[c] for c in of], [len(s) for s in sets], of


def near_copies(rng, n_base=12, copies=14, words=90):
    out = []
    for _ in range(n_base):
        base = [f"w{rng.integers(0, 4000)}" for _ in range(int(rng.integers(4, words)))]
        for _ in range(copies):
            t = list(base)
            for _ in range(int(rng.integers(0, 5))):
                if rng.random() < 0.5:
                    t[int(rng.integers(0, len(t)))] = f"x{rng.integers(0, 4000)}"
                else:
                    t = t + [f"y{rng.integers(0, 4000)}"] * int(rng.integers(1, 3))
            out.append(" ".join(t))
    return out


ODD = [None, "", "  \n", "one", "One", "one two", "ONE\ttwo", "a b c", "a b c ", "é à", "É à", "a a a a a a", "long " * 3000, "x"]


@pytest.mark.parametrize("shingle,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_against_brute_force(spark, shingle, num, den):
    from lodestone.llm import jaccard

    rng = np.random.default_rng(shingle)
    bodies = near_copies(rng) + ODD
    rows = [(int(i), b) for i, b in zip(rng.permutation(len(bodies)), bodies)] + [(None, "a b c"), (900, bodies[0]), (900, bodies[0])]
    want, sizes, of = brute_groups(rows, shingle, num, den)
    docs = spark.createDataFrame([(i, b, 7, "s") for i, b in rows], "doc_id long, text string, sig int, rid string").repartition(3)
    for tokens in (400_000, 700):
        jaccard.CHUNK_TOKENS = tokens
        got = jaccard.similar(docs, shingle, num, den).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((i, n, c) for (i, _), n, c in zip(rows, sizes, want)), key=str)
    jaccard.CHUNK_TOKENS = 400_000
    other = jaccard.similar(docs, shingle, num, den, exact=num == 4).collect()
    assert sorted(((r.doc_id, r.component_id) for r in other), key=str) == sorted(((i, c) for (i, _), c in zip(rows, want)), key=str)
    report = jaccard.group_report(docs, shingle, num, den).first()
    assert 0 < report.opened < report.bounded and report.shards < report.in_shards <= report.sets
    kept = jaccard.one_of_each(docs, shingle, num, den).collect()
    groups = {c for c, n in zip(of, sizes) if n}
    assert len(kept) == len(groups) + sum(n == 0 for n in sizes) and kept[0].__fields__ == docs.columns
    assert jaccard.similar(docs.limit(0), shingle, num, den).count() == 0


def test_group_bounds_skip_groups():
    from lodestone.llm.jaccard import links_of

    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(8)]
    sets = []
    for _ in range(40):
        for b in base:
            s = b.copy()
            s[rng.integers(0, len(s), 2)] = rng.integers(0, 2**63, 2)
            sets.append(np.unique(s))
    every = np.arange(len(sets))
    a, b, seen = links_of(sets, every, every, 9, 10, every=True)
    want = {(i, j) for i in every for j in every if i < j and 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a.tolist(), b.tolist())) == want
    assert seen["opened"] < seen["bounded"] / 2
    a, b, _ = links_of(sets, every, every, 9, 10)
    assert set(zip(a.tolist(), b.tolist())) <= want
    assert brute_components(len(sets), zip(a.tolist(), b.tolist())) == brute_components(len(sets), want)
    close = [np.unique(np.append(s[1:], np.uint64(i))) for i, s in enumerate([base[0]] * 300)]
    every = np.arange(len(close))
    a, b, fewer = links_of(close, every, every, 9, 10)
    assert fewer["compared"] < 0.1 * 300**2 and set(brute_components(300, zip(a.tolist(), b.tolist()))) == {0}


def brute_components(n, pairs):
    low = list(range(n))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return [root(i) for i in range(n)]


def test_strangers_with_bare_ranges_stay_apart():
    """Unlike sets hardly ever share a key, however many there are."""
    from lodestone.llm.jaccard import range_contents

    rng = np.random.default_rng(3)
    sizes = rng.integers(10, 40, 60000)
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 2**64 - 1, int(first[-1]), dtype=np.uint64)
    h = np.concatenate([np.sort(h[a:b]) for a, b in zip(first[:-1], first[1:])])
    of, key = range_contents(h, first, 9, 10)
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    assert len(set(of[n[at] > 1].tolist())) < 60


def test_ranges_agree_for_linked_sets():
    from lodestone.llm.jaccard import range_contents

    rng = np.random.default_rng(2)
    for num, den in ((9, 10), (4, 5)):
        for n in (9, 10, 11, 12, 19, 20, 21, 50, 111, 400):
            a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
            for extra in range(0, n):
                for drop in range(0, 4):
                    b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64 - 1, extra, dtype=np.uint64)]))
                    k = len(a) - drop
                    if den * k < num * (len(a) + len(b) - k) or (not extra and not drop):
                        break
                    of, key = range_contents(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, den)
                    assert set(key[of == 0].tolist()) & set(key[of == 1].tolist()), (n, extra, drop)


def brute_repeats(rows, window):
    texts = [WORD.findall(b or "") for _, b in rows]
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - window + 1):
            seen.setdefault(tuple(t[i : i + window]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    kept = [[w for i, w in enumerate(t) if i not in g] for t, g in zip(texts, gone)]
    return [(r[0], len(t), len(g), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, t, g, k in zip(rows, texts, gone, kept)]


def passages(rng, window, words=30):
    shared = [[f"p{rng.integers(0, words)}" for _ in range(int(rng.integers(window - 3, 2 * window)))] for _ in range(6)]
    out = []
    for _ in range(60):
        t = []
        for _ in range(int(rng.integers(0, 4))):
            t += [f"u{rng.integers(0, 50)}" for _ in range(int(rng.integers(0, window)))]
            if rng.random() < 0.6:
                p = shared[int(rng.integers(0, 6))]
                a = int(rng.integers(0, 4))
                t += p[a : len(p) - int(rng.integers(0, 4))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("window", [5, 12, 35, 72, 200])
def test_substrings_against_brute_force(spark, window):
    from lodestone.llm import substrings

    rng = np.random.default_rng(window)
    bodies = passages(rng, window) + [None, "", " \t", "a " * (window - 1), "a " * window, "b " * (window + 1), "same words here " * 40, "  lead\n" + "q r s t u v w x y z " * 20]
    rows = [(i, b) for i, b in enumerate(bodies)] + [(None, bodies[0]), (3, bodies[3]), (3, bodies[3])]
    docs = spark.createDataFrame([(i, b, "x", 1) for i, b in rows], "doc_id long, text string, rid string, box int").repartition(3)
    got = sorted((tuple(r) for r in substrings.repeats(docs, window).collect()), key=str)
    assert got == sorted(brute_repeats(rows, window), key=str)
    usual = substrings.frequent_sequences, substrings.INDEX_WORDS
    try:  # the same where most sequences count as frequent and where indexes hold little
        substrings.frequent_sequences = lambda docs, size, k=8: np.full(1 << 12, 0x7D, np.uint8)
        substrings.INDEX_WORDS = 40 * window
        assert sorted((tuple(r) for r in substrings.repeats(docs, window).collect()), key=str) == got
    finally:
        substrings.frequent_sequences, substrings.INDEX_WORDS = usual
    cut = substrings.without_repeats(docs, window)
    assert cut.schema.names == docs.schema.names
    want = brute_repeats(rows, window)
    for r in cut.collect():
        mine = [x for x in want if x[0] == r.doc_id]
        if r.text is not None:
            assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() in {x[3] for x in mine}
            assert any(x[2] for x in mine) or r.text in bodies
    assert substrings.repeats(docs.limit(0), window).count() == 0


def test_heavy_shards(spark):
    """Only shards beyond what an index holds are cut, by the numbers that are sent to them."""
    from lodestone.llm import substrings

    sent = [(3, 70_000), (3, 70_000), (4, 10), (5, 200), (200_000, 2**40)]
    rows = spark.createDataFrame([(k, bytearray(n.to_bytes(8, "big"))) for k, n in sent], "key int, rows binary")
    got = substrings.heavy_shards(rows, 50)
    assert got == {3: -(-140_000 * 75 // substrings.INDEX_WORDS), 200_000: -(-(2**40) * 75 // substrings.INDEX_WORDS)}


@pytest.mark.parametrize("window", [8, 60, 71, 90, 110])
def test_passages_of_just_a_window(spark, window):
    from lodestone.llm import substrings

    rng = np.random.default_rng(window)
    word = lambda n: [f"w{rng.integers(0, 10**9)}" for _ in range(n)]
    rows = []
    for i in range(60):
        shared = word(window)
        rows += [(2 * i + j, " ".join(word(int(rng.integers(0, 3 * window))) + shared + word(int(rng.integers(0, 3 * window))))) for j in range(2)]
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window).collect()
    assert {r.n_removed for r in got} == {window}


def test_columns_that_clash(spark):
    from lodestone.llm import jaccard, substrings

    shared = " ".join(f"w{i}" for i in range(60))
    names = ["doc_id", "text", "_rid", "_body", "a.b", "rid", "c0", "TEXT", "box"]
    rows = [(1, f"x {shared} y", 1, "k", 2.5, [1], None, "t", 9), (2, f"z {shared}", 2, None, None, None, "c", "u", None), (3, "alone", 3, "b", 1.0, [], "d", None, 0)]
    docs = spark.createDataFrame(rows, "a long, b string, c int, d string, e double, f array<int>, g string, h string, i long").toDF(*names)
    cut = substrings.without_repeats(docs, 50)
    assert cut.columns == names
    assert sorted(tuple(r) for r in cut.collect()) == [(1, "x  y".replace("  ", " "), *rows[0][2:]), (2, "z ", *rows[1][2:]), rows[2]]
    kept = jaccard.one_of_each(docs, 5, 4, 5)
    assert kept.columns == names and sorted(r[0] for r in kept.collect()) == [1, 3]


def test_frequent_sequences(spark):
    from lodestone.llm import substrings, text

    docs = spark.createDataFrame([(i, "one two three four five six seven eight") for i in range(1500)] + [(9, f"other words {' '.join(f'z{i}' for i in range(5000))}")], "rid long, body string").select("rid", "body").repartition(3)
    bits = substrings.frequent_sequences(docs, 100_000)
    import pyarrow as pa

    (w,) = text.blocks(pa.array(["one two three four five six seven eight nine"]))
    assert substrings._in(bits, text.ngrams(w, 8)[1]).tolist() == [True, False]
    assert 1 <= np.unpackbits(bits).sum() <= 2


def test_matching_statistics_against_brute_force():
    from lodestone.llm.fm_index import FMIndex

    rng = np.random.default_rng(1)

    def brute(seqs, weights, q):
        out = []
        for s in q:
            for i in range(len(s)):
                best = 0
                for n in range(1, len(s) - i + 1):
                    if sum(w * sum(t[j : j + n] == s[i : i + n] for j in range(len(t) - n + 1)) for t, w in zip(seqs, weights)) < 2:
                        break
                    best = n
                out.append(best)
        return out

    for _ in range(40):
        v = int(rng.integers(1, 5))
        seqs = [rng.integers(0, v, int(rng.integers(1, 12))).tolist() for _ in range(int(rng.integers(1, 8)))]
        weights = rng.integers(1, 3, len(seqs))
        flat = lambda x: (np.array([w for s in x for w in s], np.uint64), np.array([len(s) for s in x]))
        q = [*seqs, rng.integers(0, v + 1, 9).tolist()]
        assert FMIndex(*flat(seqs), weights).matching_statistics(*flat(q)).tolist() == brute(seqs, weights, q)


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op10_substring_dedup"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    place = [[d[0] for d in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(tuple(r[i] for i in place) for r in want.fetchall())


def test_bands_miss_no_pair_near_the_threshold(spark):
    """At 4/5, 600 pairs of similarity 0.815, each of texts of their own: bands find what the exact way finds, which is all."""
    import random

    from lodestone.llm import jaccard

    rng = random.Random(21)
    rows = []
    for i in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for at in (20, 70, 120, 170):
            other[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for exact in (False, True):
        got = {r.doc_id: r.component_id for r in jaccard.similar(docs, 5, 4, 5, exact=exact).collect()}
        assert got == {d: d - d % 2 for d in got} and len(got) == 1200
