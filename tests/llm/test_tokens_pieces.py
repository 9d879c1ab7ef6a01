import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (None, "null id", 7), (5, None, 1), (6, "", 2), (7, " ", 3), (8, "  two  spaces \n and\tthis ", 4), (9, "a<|endoftext|>b <s> </s>", 5),
    (10, "é à 漢字 emoji 😀 ▁mark ▁▁x", 6), (11, "x" * 70000, 7), (12, "word\n \n next  \n", 8), (12, "word\n \n next  \n", 9), (13, "\x1c \x1f \x85　 a", 1), (14, "tab\x00nul 12345 ab12", 0),
]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, ids int").repartition(3)


def test_token_files_match_library(spark):
    from tokenizers import Tokenizer

    from lodestone.llm.tokens import token_files

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd(spark), odd(spark).limit(0)):
        _, back, _ = token_files(docs, P.path("byte_bpe_50k.json"), end_id=2, parts=3)
        got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.ids)) for r in back.collect())
        want = [(-1 if d.doc_id is None else d.doc_id, t.encode(d.text or "", add_special_tokens=False).ids + [2]) for d in docs.collect()]
        assert sorted(g[1:] for g in got) == sorted((d, len(i), np.array(i, "<u4").tobytes()) for d, i in want)
        at = 0
        for start, _, n, _ in got:
            assert start == at
            at += n
        assert [g[1] for g in got] == sorted(g[1] for g in got)


def test_pieces_match_library(spark):
    import sentencepiece

    from lodestone.llm.pieces import digests, encode

    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd(spark), odd(spark).limit(0)):
        rows = encode(docs, P.path("piece_bpe_32k.model"), add_end=True)
        want = sorted((d.doc_id or -1, s.encode(d.text or "") + [2], d.text or "") for d in docs.collect())
        got = sorted(((r.doc_id or -1, np.frombuffer(r.ids, "<i4").tolist(), np.frombuffer(r.spans, "<i4").reshape(-1, 2).tolist(), bytes(r.decoded)) for r in rows.collect()), key=lambda x: (x[0], x[1]))
        assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want]
        for (_, ids, spans, plain), (_, _, text) in zip(got, want):
            assert plain.decode() == s.decode(ids)
            assert b"".join(text.encode()[a:b] for a, b in spans) == text.encode()
        d = {(r.doc_id or -1, r.ids_sha256) for r in digests(docs, P.path("piece_bpe_32k.model"), add_end=True).collect()}
        assert d == {(w[0], hashlib.sha256(" ".join(map(str, w[1])).encode()).hexdigest()) for w in want}


def _darts(entries):
    """A small double-array trie in the library's layout, for a map of bytes to bytes."""
    pool, trie = bytearray(), {}
    for k, v in sorted(entries.items()):
        node = trie
        for b in k:
            node = node.setdefault(b, {})
        node[-1] = len(pool)
        pool += v + b"\0"
    units = {0: 0}
    free = [256]

    def place(at, node):
        base = free[0]
        free[0] += 512
        offset = (base & ~255) ^ (at & ~255) ^ 0
        base = at ^ offset
        units[at] = (units[at] & ~(0x7FFFFF << 10)) | (offset << 10)
        if -1 in node:
            units[at] |= 1 << 8
            units[base] = 1 << 31 | node[-1]
        for b in node:
            if b >= 0:
                units[base ^ b] = b
        for b, child in node.items():
            if b >= 0:
                place(base ^ b, child)

    place(0, trie)
    n = (max(units) // 256 + 1) * 256
    import struct

    return struct.pack("<I", 4 * n) + struct.pack(f"<{n}I", *(units.get(i, 0) for i in range(n))) + bytes(pool)


def test_character_map_longest_prefix_and_alignment():
    from lodestone.llm.pieces import CharMap, Model

    m = Model.__new__(Model)
    m.map = CharMap(_darts({b"ab": b"X", b"abc": b"yz", "ﬁ".encode(): b"fi", b"\t": b" "}))
    m.dummy, m.squeeze, m.escape = False, False, False
    out, back = m.normalise("abcab\tﬁq")
    assert out == b"yzX fiq"
    assert back.tolist() == [0, 0, 3, 5, 6, 6, 9, 10]
    m.dummy = m.squeeze = m.escape = True
    out, back = m.normalise("  ab \t q ")
    assert out.decode() == "▁X▁q"
    assert len(back) == len(out) + 1 and back[0] == 2


def test_query_digests(spark):
    from tokenizers import Tokenizer

    from lodestone.llm.queries import QUERIES

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    start, want = 0, {}
    for d in sorted(texts):
        ids = t.encode(texts[d], add_special_tokens=False).ids + [2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_files"](spark, SF).collect()} == want
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in QUERIES["op8_sentencepiece"](spark, SF).collect()}
    assert rows == {d: (len(i), hashlib.sha256(s.decode(i).encode()).hexdigest()) for d, x in texts.items() for i in [s.encode(x) + [2]]}


def test_parts_of_rows_without_id_and_wide_ids(spark):
    from lodestone.llm import cluster, tokens

    rows = [(None if i % 3 == 0 else i // 2, f"word {i} " * (i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plan = tokens.plan_parts(docs, 9)
    assert plan.bare >= 2 and 6 <= len(plan) <= 9
    written, back, _ = tokens.token_files(docs, P.path("byte_bpe_50k.json"), end_id=2, parts=9)
    assert written.count() >= 6
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in back.collect())
    assert len(got) == 400 and [g[1] is None for g in got] == sorted([r[0] is None for r in rows], reverse=True)
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    ids = [(0, 5, [70000, 3]), (0, None, []), (1, 9, [2**31])]
    wide = spark.createDataFrame([(p, d, bytearray(np.array(i, "<u4").tobytes())) for p, d, i in ids], "part int, doc_id long, ids binary")
    folder = cluster.scratch(spark, "wide")
    back = tokens.read(tokens.write(wide, folder, 4, 2), folder)
    got = {(r.start, r.doc_id, *np.frombuffer(r.ids, "<u4").tolist()) for r in back.collect()}
    assert got == {(0, None), (0, 5, 70000, 3), (2, 9, 2**31)}


def test_columns_that_clash(spark):
    """Columns of the same name in another case, with dots, or named as ours play no part."""
    from lodestone.llm import packing, pieces, secrets, tokens, toxicity

    names = ["doc_id", "text", "TEXT", "Doc_Id", "a.b", "ids", "part", "score", "body", "c0"]
    rows = [(1, "token = abcdefgh12", "x", 5, 1, "y", 2, 0.5, "z", None), (2, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "a long, b string, c string, d int, e int, f string, g int, h double, i string, j string").toDF(*names)
    assert {(r.doc_id, len(r.spans)) for r in secrets.scan(docs).collect()} == {(1, 1), (2, 0)}
    assert [r[1] for r in sorted(secrets.redacted(docs).collect())] == ["[SECRET]", None]
    assert {r.doc_id for r in pieces.digests(docs, P.path("piece_bpe_32k.model")).collect()} == {1, 2}
    assert {r.doc_id for r in tokens.token_files(docs, P.path("byte_bpe_50k.json"), parts=2)[1].collect()} == {1, 2}
    assert {(r.doc_id, r.length) for r in packing.pack_documents(docs).collect()} == {(1, 3), (2, 0)}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).columns == names
    scored = toxicity.scores(docs, toxicity.train(docs, labels), keep=["doc_id", "a.b"])
    assert scored.columns == ["doc_id", "a.b", "score"] and scored.count() == 2


def test_no_folder_that_is_not_shared():
    """On a cluster a folder of one machine is never taken for a shared one."""
    from types import SimpleNamespace as N

    from lodestone.llm.cluster import shared_folder

    none = N(isDefined=lambda: False)
    context = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)), setCheckpointDir=lambda x: None)
    with pytest.raises(RuntimeError):
        shared_folder(N(conf=N(get=lambda *a: None), sparkContext=context))
    assert shared_folder(N(conf=N(get=lambda *a: "hdfs://x/y"), sparkContext=context)) == "hdfs://x/y"
