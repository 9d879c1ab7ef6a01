"""Operators on small rows with hand-derived results, and folds against plain statements of their rule."""

import random

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import extract, graph, ingest, params, report, retrieve, rules, signatures, validate
from lodestone.sources import files as S
from lodestone.sources import fixtures as X


def plain_chunks(t, size):
    out, start = [], 0
    if not t:
        return out
    while True:
        if start + size >= len(t):
            return [*out, t[start:].strip()]
        w = t[start : start + size]
        fence, blank, stop = w.rfind("```"), w.rfind("\n\n"), w.rfind(". ")
        cut = size
        if fence > 0.3 * size:
            cut = fence
        elif blank >= 0:
            cut = blank if blank > 0.3 * size else size
        elif stop > 0.3 * size:
            cut = stop + 1
        if w[:cut].strip():
            out.append(w[:cut].strip())
        start += cut


def test_chunks_against_plain_rule(spark):
    r = random.Random(4)
    bits = ["word ", ". ", "\n\n", "```", "\n", "é漢 ", "x" * 30, "   "]
    texts = ["", "   ", "a" * 99, "a" * 100, "a" * 101, "```" + "b" * 200, "a\n\n" + "c. " * 80, "z" * 150 + " " * 60] + ["".join(r.choice(bits) for _ in range(r.randint(1, 120))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = sorted((r.id, r.chunk_number, r.content) for r in ingest.chunk_rows(df, "t", 100).collect())
    assert rows == [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(plain_chunks(t, 100))]
    assert ingest.chunk_rows(df.select("id", F.lit(None).cast("string").alias("t")), "t", 100).count() == 0


def test_urls_and_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.source_id(F.lit("http://u@h.org:8/x#y"))) == "u@h.org:8"
    assert one(T.source_id(F.lit("local/path.txt"))) == "local/path.txt"
    assert one(T.normalize_url(F.lit("http://a/b#c#d"))) == "http://a/b"
    assert [one(T.crawl_route(F.lit(u))) for u in ("http://a/sitemap.txt", "http://a/sitemap.xml", "http://a/sitemaps/x", "http://a/b")] == ["text_file", "sitemap", "sitemap", "webpage"]
    assert [one(T.line_number(F.lit(x))) for x in ("line 12", "a.ts:7", "nowhere", "Line 3")] == [12, 7, 1, 1]
    assert one(T.truncated_summary(F.lit("x" * 501))) == "x" * 500 + "..."
    assert one(T.char_similarity(F.lit("useIdd"), F.lit("useId"))) == 5 / 6
    assert one(T.repo_name(F.lit("https://h/u/r.git"))) == "r"
    assert one(T.code_query(F.lit("q"))) == "Code example for q\n\nSummary: Example code showing q"
    assert one(T.section_headers(F.lit("# A\ntext\n##  B c"))) == "# A; ## B c"


def test_code_blocks(spark):
    md = "intro\n```python\nprint(1)\n```\nmid\n```\nno language here\nx\n```\ntail ``` open"
    got = spark.range(1).select(T.code_blocks(F.lit(md), 1).alias("b")).first().b
    assert [(b.language, b.code) for b in got] == [("python", "print(1)"), ("", "no language here\nx")]
    assert got[0].context_before == "intro" and got[0].context_after.startswith("mid")
    assert spark.range(1).select(T.code_blocks(F.lit("none"), 0).alias("b")).first().b == []
    lead = "```a```b```c```"
    pairs = lambda compat: [b.code for b in spark.range(1).select(T.code_blocks(F.lit(lead), 0, compat).alias("b")).first().b]
    assert pairs(False) == ["a", "c"] and pairs(True) == ["b"]


def test_hybrid_merge_order(spark):
    v = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.85), (3, "c", 0.5)], "rank long, id string, similarity double")
    w = spark.createDataFrame([(1, "c"), (2, "d"), (3, "a")], "rank long, id string")
    got = [(r.id, round(r.similarity, 6), r.tier) for r in retrieve.hybrid_merge(v, w, 3).orderBy("rank").collect()]
    assert got == [("c", 0.6, 0), ("a", 1.0, 0), ("b", 0.85, 1)]
    assert [r.id for r in retrieve.hybrid_merge(v, w, 4).orderBy("rank").collect()] == ["c", "a", "b", "d"]


def test_retrieval_ignores_zero_vectors_and_blank_sources(spark):
    rows = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0], "s"), (2, "beta", [0.0, 0.0], "s"), (3, None, None, "t"), (4, "gamma alpha", [0.6, 0.8], "t")], "id long, content string, embedding array<double>, source string")
    assert [r.id for r in retrieve.vector_search(rows, [1.0, 0.0], 5).collect()] == [1, 4]
    assert [r.id for r in retrieve.keyword_search(rows, "ALPHA", 5, ["content"], where=retrieve.metadata_filter(" ")).collect()] == [1, 4]
    out = retrieve.rag_query(rows, "alpha", [0.0, 1.0], 2, "t", reranking=True).collect()
    assert [(r.id, r.tier) for r in out] == [(4, 0)]


def test_replace_and_upsert(spark):
    old = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("w", 1, "c")], "url string, n int, t string")
    new = spark.createDataFrame([("u", 1, "z")], "url string, n int, t string")
    assert sorted(map(tuple, ingest.replace_by_key(old, new, "url").collect())) == [("u", 1, "z"), ("w", 1, "c")]
    s = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    assert sorted(map(tuple, ingest.upsert(s, spark.createDataFrame([("b", 5), ("c", 6)], "k string, n long"), "k").collect())) == [("a", 1), ("b", 5), ("c", 6)]


def test_frontier_stops_at_depth(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1)], "src long, dst long")
    s = spark.createDataFrame([(1,)], "node long")
    assert sorted(map(tuple, ingest.frontier(s, e, 3).collect())) == [(1, 0), (2, 1), (3, 2)]


def test_rules_give_lines_and_snippets(spark):
    got = {(r.rule, r.line): r.snippet for r in rules.scan(spark.createDataFrame(X.FILES, X.FILE).filter("path = 'src/legacy.js'")).collect()}
    assert got["eval_usage", 1].startswith("// eval") and ("eval_usage", 6) in got and got["document_write", 5] == 'document.write("<p>");'
    assert ("event_listener_leak", 8) in got
    assert {r.message for r in rules.unused_variables(spark.createDataFrame(X.FILES, X.FILE)).collect()} >= {"unusedThing"}


def test_parameter_checks(spark):
    from lodestone.plans.code import _calls

    rows = _calls(spark, "/root/testdata/sf0.001").collect()  # a project for each supplier, its calls numbered by it
    assert len({r.call_id // 1000 for r in rows}) == 10
    got = sorted((r.call_id - 1000, r.error) for r in rows if r.call_id // 1000 == 1)
    assert got == [(2, "ENUM"), (2, "JSON"), (2, "TYPE"), (2, "TYPE"), (3, "COUNT"), (3, "MISSING"), (3, "MISSING"), (3, "MISSING"), (4, "COUNT"), (6, "NOT_FOUND"), (7, "JSON"), (7, "TYPE"), (7, "TYPE")]
    kinds = spark.createDataFrame([("1",), ('"x"',), ("true",), ("{}",), ("[1]",), ("data.id",), (f'{X._ID}',)], "v string").select(params.inferred_type(F.col("v")).alias("t"))
    assert [r.t for r in kinds.collect()] == ["INTEGER", "STRING", "BOOLEAN", "JSON", "JSON", "UNKNOWN", "UUID"]


def test_call_objects_are_balanced():
    code = "x();\nclient.rpc('f', { a: 1, 'b': \"q, }\", c: { d: [1, 2] }, e: user.id, // note\n g: true });\nclient.rpc(`h`);"
    assert extract.call_objects(code) == [(2, "f", {"a": "1", "b": '"q, }"', "c": "{}", "e": None, "g": "true"}), (4, "h", {})]


def test_python_facts():
    facts = {(k, o, n): (p, r) for _, k, o, n, _, p, r in extract.python_facts(*X.PYTHON[0])}
    assert facts["method", "Item", "total"] == (["n:int=1", "[var_positional] *more:str", "[keyword_only] tax:Any=None", "[var_keyword] **rest:Dict[str, Any]"], "float")
    assert ("function", None, "inner") in facts and ("function", None, "load") in facts and ("method", "Item", "_private") not in facts
    assert ("attribute", "Item", "price") in facts and ("import", None, ".base") in facts
    assert extract.python_facts(*X.PYTHON[1])[0][1] == "error"


def test_confidence_example(spark):
    f = spark.createDataFrame([("p", "CRITICAL", 0.8), ("p", "HIGH", 0.9), ("p", "LOW", 0.5)], "path string, severity string, confidence double")
    got = {r.path: round(r.confidence, 6) for r in report.confidence(f, spark.createDataFrame([("p",), ("q",)], "path string")).collect()}
    assert got == {"p": 0.713333, "q": 1.0}


def test_code_graph_commands(spark):
    t = dict(
        repository=spark.createDataFrame([("shop",)], "name string"),
        file=spark.createDataFrame([("a.py", "shop", "a.py", "a", 3)], "path string, repo string, name string, module_name string, line_count int"),
        method=spark.createDataFrame([("a.Item", "Item", "total", ["n:int"], "float")], "class_full_name string, c string, name string, params array<string>, return_type string"),
        attribute=spark.createDataFrame([("a.Item", "price", "")], "class_full_name string, name string, type string"),
        function=spark.createDataFrame([("a.py", "load", ["p"], None)], "path string, name string, params array<string>, return_type string"),
        component=spark.createDataFrame([("c.tsx", "Cart", "function", True)], "path string, name string, type string, is_exported boolean"),
        hook=spark.createDataFrame([("c.tsx", "useState", "")], "path string, name string, args string"),
    )
    t["class"] = spark.createDataFrame([("a.Item", "a.py", "Item")], "full_name string, path string, name string")
    g = graph.CodeGraph(**t)
    assert [tuple(r) for r in g.command("EXPLORE shop").collect()] == [("shop", 1, 1, 1, 1)]
    assert [(r.kind, r.member, r.detail) for r in g.command("class Item").collect()] == [("method", "total", "(n:int) -> float"), ("attribute", "price", "Any")]
    assert [r.limited for r in g.command("classes shop").collect()] == [False]
    assert g.command("explore nothing").count() == 0 and g.command("hook useState").count() == 1
    assert g.command("sql SELECT name FROM repository").count() == 1
    assert not spark.catalog.tableExists("repository")  # its views are gone
    assert [r.n for r in g.command("sql WITH x AS (SELECT 'drop it; now' AS n) SELECT n FROM x").collect()] == ["drop it; now"]
    for bad in ("sql DROP TABLE x", "sql SELECT 1; DROP TABLE x", "sql WITH x AS (SELECT 1) INSERT INTO repository SELECT * FROM x", "nonsense", "class"):
        try:
            g.command(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_source_trees_and_embedder(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1\n", "src/test_a.py": "", "tests/b.py": "", "src/.git/c.py": "", "src/big.py": "#" * 500_001, "src/W.tsx": "const W = () => 1;", "src/W.test.tsx": "", "node_modules/m.js": ""}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    tail = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())
    root = str(tmp_path / "repo")
    assert tail(S.python_files(spark, root)) == ["a.py"] and tail(S.typescript_files(spark, root)) == ["W.tsx"]
    for above in ("build", ".hidden", "tests/dist"):  # what stands above the root plays no part
        p = tmp_path / above / "repo" / "src" / "a.py"
        p.parent.mkdir(parents=True)
        p.write_text("x = 1\n")
        assert [r.path for r in S.python_files(spark, str(tmp_path / above / "repo")).collect()] == ["src/a.py"]
        assert [tuple(r) for r in S.all_files(spark, f"file://{tmp_path / above / 'repo'}/").collect()] == [("src/a.py", "a.py", ".py", 6)]
    v = [r.embedding for r in S.embedded(spark.createDataFrame([("a b a",), ("",)], "content string"), 8).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[1] == [0.0] * 8


def test_streaming_ingest_replaces_by_url(spark, tmp_path):
    from lodestone.operators.ingest import crawled_pages
    from lodestone.streaming.ingest import current_pages, ingest_pages

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "url string, markdown string"
    for batch in ([("http://a/1", "one. two"), ("http://a/2", "keep"), ("http://a/3", "gone")], [("http://a/1", "new"), ("http://a/1", "newer")], [("http://a/3", "")]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(src)
        q = ingest_pages(spark.readStream.schema(kind).parquet(src), out, str(tmp_path / "cp"), 100)
        q.awaitTermination(120)
    schema = crawled_pages(spark.createDataFrame([], kind), 100).schema
    rows = lambda n: sorted(map(tuple, current_pages(spark, out, n, schema).select("url", "content").collect()))
    assert rows(3) == [("http://a/1", "newer"), ("http://a/2", "keep")]
    assert rows(2) == [("http://a/1", "newer"), ("http://a/2", "keep"), ("http://a/3", "gone")] and rows(0) == []


def test_signature_facts(spark):
    lines = signatures.source_lines(spark.createDataFrame(X.FILES, X.FILE))
    names = {(r.kind, r.name) for r in signatures.definitions(lines).collect()}
    assert {("interface", "Empty"), ("interface", "LineProps"), ("type", "Discount"), ("function", "subtotal"), ("component", "Cart")} <= names
    assert signatures.component_issues(spark.createDataFrame([("p", "cart", "class", 11, 1, False), ("p", "Cart", "class", 1, 0, False)], "path string, name string, type string, n_props int, n_hooks int, exported boolean")).count() == 4
    assert {r.issue for r in signatures.hook_issues(spark.createDataFrame([("p", "useState", 2, 1), ("p", "usecase", 0, 2), ("p", "useMine", 3, 3)], "path string, name string, n_args long, line long")).collect()} == {"INCORRECT_SIGNATURE", "BAD_PRACTICE"}
    got = spark.createDataFrame([("react", "shop"), ("./x", "shop"), ("shop.cart", "shop.api"), ("utils", "shop"), ("mock_x", "shop"), ("ab", "shop")], "m string, p string").select("m", signatures.is_internal_module(F.col("m"), F.col("p")).alias("x"))
    assert {r.m: r.x for r in got.collect()} == {"react": False, "./x": True, "shop.cart": True, "utils": True, "mock_x": False, "ab": False}


def test_frontier_over_all_lineitem_rows(spark, tmp_path):
    from lodestone import plans

    rows = [(1, 1, 10), (2, 2, 10), (1, 2, 11), (3, 3, 11), (2, 3, 12), (4, 1, 12), (None, 2, 10), (1, 3, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = {f"s{s}" for s, _, p in rows if s and (1, p) in {(a, b) for a, _, b in rows}}
    want = {("s1", 0), ("p10", 1), ("p11", 1)} | {(x, 2) for x in near - {"s1"}}
    got = {(r.node, r.depth) for r in plans.QUERIES["frontier_bfs_all"](spark, str(tmp_path)).collect()}
    assert got == want == {("s1", 0), ("p10", 1), ("p11", 1), ("s2", 2), ("s3", 2)}


def test_all_text_rules_run_over_documents(spark, tmp_path):
    from lodestone import plans

    rows = [(1, 'It is so. We go. token = "0af" no!!'), (2, "Sentences everywhere. Yes!! No!!!"), (3, "grün für. ärzte ist."), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in plans.QUERIES["rule_scan_documents_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, "sentence_short", 2), (1, "token_value", 1), (1, "shouting", 1), (2, "shouting", 2), (3, "sentence_short", 2)}


def test_findings_of_all_labels(spark, tmp_path):
    from lodestone import plans

    rows = [(i, i % 2) for i in range(1, 41)] + [(41, None)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert sum(r.total for r in run("severity_stats_all")) == 41
    assert {r.path for r in run("confidence_score_all")} == {f"f{i}" for i in range(1, 42)} | {"none"}
    assert [r.seq for r in run("top_detections_all")][:3] == [35, 25, 15]
    assert sum(r.recommendation == "turn strict mode on" for r in run("recommendations_all")) == 41
    assert {r.severity: round(r.mean_confidence, 6) for r in run("mean_confidence_all")}["CRITICAL"] == round(sum((1 + i % 9) / 10 for i in range(5, 41, 5)) / 8, 6)


def test_tsx_reader():
    from lodestone.operators.tsx import facts

    rows = lambda src, kind: [(n, o, a, d) for _, k, n, _, o, a, d in facts("p", src) if k == kind]
    assert rows("import {\n  a as b,\n  type C\n} from 'm'; import * as n from \"k\"; // import x from 'y'\nconst s = 'import z from q';", "import") == [("m", None, ["b", "C"], "named"), ("k", None, ["n"], "namespace")]
    assert rows("const A: FC<P<Q>> = React.memo(async ({ x, y: z, ...rest }) => { useIt(1, [a, b]); });\nexport { A };", "component") == [("A", "export", ["x", "y"], "arrow")]
    assert rows("const A = () => { useIt<T[]>(1, f(2, 3), 'x'); };\nuseOut();", "hook") == [("useIt", "A", ["1", "<Call>", "x"], ""), ("useOut", None, [], "")]
    assert rows("function B(props) { return 1 } class C extends PureComponent { go() { this.x.run(`t`, y.z) } }", "call") == [("run", "x", ["<TemplateLiteral>", "y.z"], "")]
    assert [c[0] for c in rows("function B() {} class C extends PureComponent {} class D {} const e = 1; const F = 3;", "component")] == ["B", "C"]
    for odd in ("", "(((", "'unclosed", "`open", "/* open", "import", "import {", "export default", "const A = ", "const A = (", "class A extends", "x" * 50000, "{" * 5000):
        facts("p", odd)


def test_stored_code_and_embedding_hook(spark):
    import numpy as np

    rows = spark.createDataFrame([("http://h/a", 0, "print(1)", "python")], "url string, block long, code string, language string")
    out = ingest.code_store(rows, embed=lambda df, text: S.embedded(df, 3, text, lambda texts, dims: np.array([[len(t), dims, 0.0] for t in texts]))).first()
    assert out.embedded_text == "print(1)\n\nSummary: Code example for demonstration purposes." and out.source_id == "h" and out.metadata.language == "python"
    assert out.embedding == [len(out.embedded_text), 3.0, 0.0]
    assert ingest.code_store(rows, F.lit("mine")).first().summary == "mine"


def test_repository_of_two_languages(spark, tmp_path):
    from lodestone.operators.validate import analyze_repository

    for name, body in {"src/shop/__init__.py": "", "src/shop/cart.py": "class Cart:\n    def add(self, n: int) -> None: ...\n", "src/App.tsx": "export const App = () => { useState(1); return go(2); };"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    g = analyze_repository(spark, str(tmp_path), "r")
    assert {(r.path, r.module_name) for r in g.t["file"].collect()} == {("src/shop/__init__.py", "shop"), ("src/shop/cart.py", "shop.cart"), ("src/App.tsx", "src/App")}
    assert [r.full_name for r in g.command("classes r").collect()] == ["r.shop.cart.Cart"] and [r.name for r in g.command("component App").collect()] == ["App"]
    assert {r.name for r in g.command("functions r").collect()} == {"go"} and g.command("hook useState").count() == 1


def test_repository_is_cleared_collected_and_stored(spark, tmp_path):
    """One call refreshes one repository; others stay, and what is gone from the tree is gone from the tables."""
    for repo, name in (("one", "A"), ("two", "B")):
        (tmp_path / repo / "src").mkdir(parents=True)
        (tmp_path / repo / "src" / "m.py").write_text(f"class {name}:\n    def go(self):\n        pass\n\n\ndef f():\n    pass\n")
        (tmp_path / repo / "src" / f"{name}.tsx").write_text(f"export const {name}x = (props) => <p>{{props.t}}</p>;\n")
    target = f"{tmp_path}/graph"
    stats = [validate.refresh_repository(spark, f"{tmp_path}/{r}", r, target).first() for r in ("one", "two")]
    assert [(s.name, s.files, s.classes, s.functions, s.components) for s in stats] == [("one", 2, 1, 1, 1), ("two", 2, 1, 1, 1)]
    (tmp_path / "one" / "src" / "m.py").write_text("def g():\n    pass\n\n\ndef h():\n    pass\n")
    for _ in range(2):  # a repeated run gives the same tables
        again = validate.refresh_repository(spark, f"{tmp_path}/one", "one", target).first()
        assert (again.files, again.classes, again.functions, again.components) == (2, 0, 2, 1)
    known = validate.stored_graph(validate.analyze_repository(spark, f"{tmp_path}/one", "one"), target)
    assert [r.name for r in known.command("repos").collect()] == ["one", "two"]
    assert [r.name for r in known.t["class"].collect()] == ["B"] and known.t["method"].count() == 1


def test_declared_types_and_their_edges(spark):
    code = "export interface A<T> extends B, C<T> {\n  x: number;\n  readonly y?: Map<string, T>\n  call(): void;\n}\ninterface Empty {}\ntype U = 'a' | 'b';\ntype O = { p: string; q?: number };\nconst z = { not: 1 };\n"
    types = extract.declared_types(spark.createDataFrame([("t.ts", code), ("none.ts", None)], "path string, content string"))
    got = {r.name: (r.label, r.extends, r.definition, [tuple(p) for p in r.properties]) for r in types.collect()}
    assert got["Empty"] == ("interface", None, None, []) and got["U"] == ("type", None, "'a' | 'b'", [])
    assert got["O"] == ("type", None, None, [("p", "string", False), ("q", "number", True)])
    assert got["A"][:2] == ("interface", "B, C<T>") and [p[0] for p in got["A"][3]] == ["x", "y"]
    edges = {(r.src, r.dst, r.kind) for r in extract.type_edges(types).collect()}
    assert ("t.ts", "t.ts::A", "DEFINES_INTERFACE") in edges and ("t.ts::A", "t.ts::C", "EXTENDS") in edges and ("t.ts::O", "t.ts::O::q", "HAS_PROPERTY") in edges and ("t.ts", "t.ts::U", "DEFINES_TYPE") in edges
