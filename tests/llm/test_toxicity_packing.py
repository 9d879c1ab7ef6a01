import zlib
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    from lodestone.llm.queries import QUERIES

    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert sum(a > b for a, b in held) <= 1


@pytest.fixture(scope="module")
def scorer(spark):
    from lodestone.llm.toxicity import train

    return train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


@pytest.mark.parametrize("disguised,word", [("1d10t", "idiot"), ("stuuuupid", "stupid"), ("p@thetic", "pathetic"), ("$tupid", "stupid"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("l0ser!!", "loser"), ("TR4SH", "trash")])
def test_deobfuscation(scorer, disguised, word):
    from lodestone.llm.toxicity import restored_words, tokens_of

    words = [w for t in tokens_of(f"the {disguised} of", scorer.model) for w in restored_words(t, scorer.model)]
    assert words == ["the", word, "of"]
    body = "the of and there ing on that it was for " * 6
    assert scorer.score(f"{body} {disguised} {body}") == scorer.score(f"{body} {word} {body}")


@pytest.mark.parametrize(
    "disguised,words",
    [("vil3", "vile"), ("idi07", "idiot"), ('"idi07",', "idiot"), ("i d 1 o t", "idiot"), ("l 0 5 3 r", "loser"), ("i  d  i  o  t", "idiot"), ("i\td\n1\to\tt", "idiot"), ("y o u   i d i o t", "you idiot"),
     ("page2", "page"), ("kill!", "kill"), ("great!?!", "great"), ("1 2 3 4", "")],
)
def test_symbols_at_the_end_and_wide_spacing(scorer, disguised, words):
    from lodestone.llm.toxicity import restored_words, tokens_of

    assert [w for t in tokens_of(f"the {disguised} of", scorer.model) for w in restored_words(t, scorer.model)] == ["the", *words.split(), "of"]


def test_ends_of_tokens():
    import time

    from lodestone.llm.toxicity import restored_words, trimmed

    for token, want in (("page.", "page"), ("kill!", "kill!"), ("kill!!!", "kill"), ("a$.", "a$"), ("a$!.x", "a$!.x"), ("x_", "x_"), ("...", ""), ("!!", "!!"), ("a!(,", "a!("), ("", "")):
        assert trimmed(token) == want, token
    began = time.perf_counter()
    for token in ("!" * 200_000 + "a", "a" + "!" * 200_000, ".," * 100_000 + "a", "a" + ".," * 100_000):
        assert len(trimmed(token)) in (1, len(token))
    assert time.perf_counter() - began < 2


def test_fit_against_plain_counts(spark):
    """Features and sums made on the executors are those of a plain count over the sampled texts."""
    from lodestone.llm import toxicity as T

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    counts = T.trigram_counts(docs)
    texts = [(r.doc_id, int(labels[r.doc_id]), r.text) for r in docs.collect() if r.doc_id in labels]
    rates = T.sample_rates(spark.createDataFrame(texts, "doc_id long, y int, body string").repartition(3), counts)
    n = Counter(y for _, y, _ in texts)
    got = T.choose_features(rates, n, 50)
    model = T.CharModel(counts)
    x = {d: {k: round(v * T.UNIT) / T.UNIT for k, v in T._rates(t, model).items()} for d, _, t in texts}
    seen = Counter(k for d, y, _ in texts if y for k in x[d])
    score = {}
    for name in (k for k, c in seen.items() if c >= max(3, int(0.01 * n[1]))):
        v = [np.array([x[d].get(name, 0.0) for d, z, _ in texts if z == y]) for y in (0, 1)]
        score[name] = (v[1].mean() - v[0].mean()) / np.sqrt(v[1].var() / n[1] + v[0].var() / n[0] + 1e-6)
    want = sorted(score, key=lambda k: (-score[k], k))[:50]
    assert set(got) == set(want) and got[:10] == want[:10]


def test_toxicity_odd_rows(spark, scorer):
    from lodestone.llm.toxicity import scores, train, without_toxic

    rows = [(1, None, 2), (2, "", 2), (None, "idiot scum", 3), (4, "idiot " * 5, 4), (5, "4" * 50000 + "a", 5), (6, "ab1" * 20000, None), (7, "\x00   ß İ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in scores(docs.drop("score"), scorer).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    labels = spark.createDataFrame([(4, 1), (4, 0), (9, 1), (None, 1), (2, None), (6, None)], "doc_id long, toxic int")
    assert train(docs, labels).constant is not None
    assert {r.doc_id for r in without_toxic(docs, labels.limit(0)).collect()} == {r[0] for r in rows}
    assert without_toxic(docs, labels.limit(0)).columns == docs.columns
    assert without_toxic(docs.limit(0), labels.limit(0)).count() == 0


def least_cost(sizes, lengths, overhead, span):
    """The cost of the best of all partitions of a few sequences into bins."""
    from lodestone.llm.packing import bin_cost

    def partitions(rest):
        if not rest:
            yield []
            return
        head, *tail = rest
        for p in partitions(tail):
            yield [[head], *p]
            for i in range(len(p)):
                yield [*p[:i], [head, *p[i]], *p[i + 1 :]]

    best = float("inf")
    for p in partitions(sizes):
        if all(sum(b) <= lengths[-1] for b in p):
            best = min(best, sum(bin_cost(min(c for c in lengths if c >= sum(b)), overhead, span) for b in p))
    return best


def test_best_fit():
    from lodestone.llm.packing import best_fit, total_cost

    rng = np.random.default_rng(0)
    lengths = (64, 128, 256)
    for _ in range(50):
        sizes = rng.integers(1, 257, int(rng.integers(1, 200))).tolist()
        place, capacity = best_fit(sizes, lengths, 4.0, 512.0)
        held = Counter()
        for n, (b, offset) in zip(sizes, place):
            held[b] += n
            assert offset + n <= capacity[b]
        for b, n in held.items():
            assert capacity[b] == min(c for c in lengths if c >= n)
        spans = sorted((b, o, o + n) for n, (b, o) in zip(sizes, place))
        assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(spans, spans[1:]))
    assert best_fit([], lengths) == ([], [])


@pytest.mark.parametrize("overhead,span", [(4.0, 512.0), (32.0, 16384.0), (400.0, 1e9), (0.0, 64.0)])
def test_joint_lengths_cost_less_than_any_single_one(overhead, span):
    from lodestone.llm.packing import LENGTHS, best_fit, total_cost

    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(6.4, 1.1, 3000).astype(int) + 1, LENGTHS[-1]).tolist()
    _, joint = best_fit(sizes, LENGTHS, overhead, span)
    _, single = best_fit(sizes, LENGTHS[-1:], overhead, span)
    assert set(single) == {LENGTHS[-1]} and sum(joint) < 1.01 * sum(sizes)
    assert total_cost(joint, overhead, span) <= total_cost(single, overhead, span)
    if (overhead, span) == (32.0, 16384.0):
        assert len(set(joint)) == len(LENGTHS) and total_cost(joint, overhead, span) < 0.9 * total_cost(single, overhead, span)


def test_best_fit_against_all_partitions():
    from lodestone.llm.packing import best_fit, total_cost

    rng = np.random.default_rng(2)
    ratio = []
    for _ in range(60):
        sizes = rng.integers(1, 33, int(rng.integers(1, 8))).tolist()
        lengths, overhead, span = (8, 16, 32), float(rng.integers(0, 12)), float(rng.integers(16, 200))
        least = least_cost(sizes, lengths, overhead, span)
        ratio.append(total_cost(best_fit(sizes, lengths, overhead, span)[1], overhead, span) / least)
    assert min(ratio) > 1 - 1e-9 and max(ratio) < 1.25 and np.mean(np.array(ratio) < 1 + 1e-9) > 0.7


def test_packing_covers_every_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm.packing import pack, pack_documents

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    counts = {d: len(e.ids) + 1 for d, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    for tokenizer, want in ((None, {d: len(t.split()) for d, t in texts.items()}), (path, counts)):
        rows = pack_documents(docs, (128, 256, 512), tokenizer).collect()
        got = Counter()
        for r in rows:
            got[r.doc_id] += r.length
            assert r.length == 0 or r.offset + r.length <= r.capacity
        assert got == Counter(want)
    odd = spark.createDataFrame([(1, 0, "x", 1), (None, 3, "y", 1), (2, 3, "z", 1), (2, 3, "z", 1), (3, None, "z", 1), (4, 1300, None, 1)], "doc_id long, length long, shard string, `a.b` int")
    rows = pack(odd, (128, 512)).collect()
    assert len(rows) == 8 and sorted(r.length for r in rows if r.doc_id == 4) == [276, 512, 512]
    assert all(r.bin_id is None for r in rows if not r.length)
    assert pack(odd.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from lodestone.llm.secrets import find
    from test_jaccard_substrings import WORD, brute_groups

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        from lodestone.llm import cluster

        tables.append(cluster.saved(stage(spark, tables[-1], sf), "stage"))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert tables[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:5]]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r[0] for r in rows[0]} - {r[0] for r in rows[1]}
    assert gone and all(labels.get(d, 1) for d in gone)
    want, sizes, _ = brute_groups(rows[1], 5, 4, 5)
    assert {r[0] for r in rows[2]} == {c for c, n in zip(want, sizes) if n} | {r[0] for r, n in zip(rows[1], sizes) if not n}
    assert [r[0] for r in sorted(rows[3])] == [r[0] for r in sorted(rows[2])]
    seen = Counter(tuple(w[i : i + 50]) for _, t in rows[3] for w in [WORD.findall(t)] for i in range(len(w) - 49))
    before = Counter(tuple(w[i : i + 50]) for _, t in rows[2] for w in [WORD.findall(t)] for i in range(len(w) - 49))
    assert not {k for k, n in before.items() if n > 1} & seen.keys()
    assert not any(find(t) for _, t in rows[4]) and len(rows[4]) == len(rows[3])
    packed = Counter()
    for r in tables[5].collect():
        packed[r.doc_id] += r.length
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packed == Counter({d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows[4]})
    assert corpus_pipeline.run(spark, sf).count() == tables[5].count()
