"""Queries over whole validations, TSX facts and graphs, signatures, procedure arguments and catalogs of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import columns
from lodestone.operators import catalog, extract, graph, params, report, signatures, tsx, validate
from lodestone.plans.code import COLUMN, COLUMNS, FINDINGS_SQL, _columns, _keys, findings, rows_sql
from lodestone.plans.registry import query, table
from lodestone.sources import fixtures as X

APP = """import React, {
  useState,
  useMemo as memoize,
} from 'react';
import next from 'next';
import { createClient } from '@scope/client';

export default function Shop({ a, b, c, d, e, f, g, h, i, j, k }: Props) {
  const [v, setV] = useState<number>(1, 2);
  useseu();
  db.from('orders').select('*');
  db.from('ghost').select('*');
  db.rpc('report_usage', { account: v });
  db.rpc('no_such', {});
  list.seuRef();
  return <div>don't {v}</div>;
}

const Hidden = (props) => <p>{props.text}</p>;

class Old extends React.Component {
  render() { return useMemo(() => 1, []); }
}

getStaticProps(a, b);
"""
SOURCES = [("src/App.tsx", APP), ("src/gone.ts", None)]
PAIR = "path string, content string"


def sources(spark, d):
    return X.over(spark, d, SOURCES, PAIR, "path")


FACTS = [
    ("src/App.tsx", "import", "react", 1, None, "React,useState,memoize", "named"),
    ("src/App.tsx", "import", "next", 5, None, "next", "default"),
    ("src/App.tsx", "import", "@scope/client", 6, None, "createClient", "named"),
    ("src/App.tsx", "export", "Shop", 8, None, "", "default"),
    ("src/App.tsx", "component", "Shop", 8, "export", "a,b,c,d,e,f,g,h,i,j,k", "function"),
    ("src/App.tsx", "hook", "useState", 9, "Shop", "1,2", ""),
    ("src/App.tsx", "call", "useseu", 10, None, "", ""),
    ("src/App.tsx", "call", "from", 11, "db", "orders", ""),
    ("src/App.tsx", "call", "select", 11, None, "*", ""),
    ("src/App.tsx", "call", "from", 12, "db", "ghost", ""),
    ("src/App.tsx", "call", "select", 12, None, "*", ""),
    ("src/App.tsx", "call", "rpc", 13, "db", "report_usage,<Object>", ""),
    ("src/App.tsx", "call", "rpc", 14, "db", "no_such,<Object>", ""),
    ("src/App.tsx", "call", "seuRef", 15, "list", "", ""),
    ("src/App.tsx", "component", "Hidden", 19, None, "props", "arrow"),
    ("src/App.tsx", "component", "Old", 21, None, "", "class"),
    ("src/App.tsx", "hook", "useMemo", 22, "Old", "<Function>,<Array>", ""),
    ("src/App.tsx", "call", "getStaticProps", 25, None, "a,b", ""),
    ("src/gone.ts", "error", "FILE_ERROR", 1, None, "", ""),
]


@query(rows_sql("path, kind, name, line, owner, args, detail", FACTS, "path", line="BIGINT"))
def tsx_syntax(spark, d):
    return tsx.syntax(sources(spark, d)).withColumn("args", F.array_join("args", ","))


SYNTAX_FINDINGS = [
    ("src/gone.ts", "file", "INVALID_TYPE", "CRITICAL", 1.0, 1, "the file can't be read"),
    ("src/App.tsx", "components", "INCORRECT_SIGNATURE", "MEDIUM", 0.8, 9, "hook useState"),
    ("src/App.tsx", "components", "BAD_PRACTICE", "HIGH", 1.0, 21, "hooks_in_class Old"),
    ("src/App.tsx", "practice", "BAD_PRACTICE", "MEDIUM", 0.8, 8, "too_many_props Shop"),
    ("src/App.tsx", "practice", "BAD_PRACTICE", "LOW", 0.7, 19, "not_exported Hidden"),
    ("src/App.tsx", "practice", "BAD_PRACTICE", "LOW", 0.7, 21, "not_exported Old"),
    ("src/App.tsx", "components", "INCORRECT_SIGNATURE", "HIGH", 0.9, 25, "getStaticProps takes 1 arguments, not 2"),
    ("src/App.tsx", "knowledge", "METHOD_NOT_FOUND", "HIGH", 0.8, 15, "method seuRef may not exist on list"),
    ("src/App.tsx", "catalog", "TABLE_NOT_FOUND", "HIGH", 0.85, 12, "ghost is unknown; known: nation, note, orders, person"),
    ("src/App.tsx", "catalog", "FUNCTION_NOT_FOUND", "HIGH", 0.85, 14, "no_such is unknown; known: check_access, report_usage, send_note"),
]


def catalogs(spark):
    return spark.createDataFrame(COLUMNS, COLUMN).select(F.col("table").alias("name")), spark.createDataFrame([(n,) for n in X.FUNCTIONS], "name string")


@query(rows_sql("path, stage, type, severity, confidence, line, message", SYNTAX_FINDINGS, "path", confidence="DOUBLE", line="BIGINT"))
def syntax_findings(spark, d):
    return validate.syntax_findings(tsx.syntax(sources(spark, d)), *catalogs(spark))


def full(spark, d):
    files = sources(spark, d).unionByName(X.files(spark, d).select("path", "content"))
    calls = X.over(spark, d, [("src/App.tsx", 13, "period", "MISSING")], "path string, line long, name string, error string", "path")
    return files, validate.full_findings(files, None, *catalogs(spark), calls=calls)


STAGES = [("src/App.tsx", 2, 3), ("src/App.tsx", 3, 1), ("src/App.tsx", 4, 2), ("src/App.tsx", 5, 1), ("src/App.tsx", 8, 3), ("src/gone.ts", 1, 1), ("src/Cart.tsx", 8, 0)]


@query(rows_sql("path, stage_no, n", [s for s in STAGES if s[2]], "path", stage_no="BIGINT", n="BIGINT"))
def validation_stages(spark, d):
    """How many findings each stage of a whole validation has, signatures and patterns left out (other queries have these)."""
    _, found = full(spark, d)
    return found.filter("stage not in ('signatures', 'patterns') and (path LIKE '%/src/App.tsx' OR path LIKE '%/src/gone.ts')").groupBy("path", "stage_no").agg(F.count("*").alias("n"))


@query(rows_sql("path, language, frameworks, critical", [("src/App.tsx", "typescript", "next; react", 0), ("src/gone.ts", "typescript", "", 1), ("src/Cart.tsx", "typescript", "react", 0), ("src/legacy.js", "javascript", "", 4), ("src/Label.tsx", "typescript", "react", 0), ("src/empty.ts", "typescript", "", 0)], "path", critical="BIGINT"))
def validation_full_report(spark, d):
    files, found = full(spark, d)
    imports = tsx.syntax(files).filter("kind = 'import'").select("path", F.col("name").alias("module"))
    return validate.full_report(files, found, imports).select("path", "language", "frameworks", "critical")


@query(FINDINGS_SQL + """, m AS (SELECT path, type, severity, 'Security of ' || lower(type) AS message FROM findings)
SELECT path, 'security_issues' AS bucket, count(*) AS n FROM m GROUP BY path
UNION ALL SELECT path, 'component_issues', count(*) FROM m WHERE type = 'COMPONENT_NOT_FOUND' GROUP BY path UNION ALL SELECT path, 'catalog_issues', count(*) FROM m WHERE type = 'TABLE_NOT_FOUND' GROUP BY path
UNION ALL SELECT path, 'signature_issues', count(*) FROM m WHERE type = 'INCORRECT_SIGNATURE' GROUP BY path UNION ALL SELECT path, 'type_issues', count(*) FROM m WHERE type = 'INVALID_TYPE' GROUP BY path""")
def finding_buckets(spark, d):
    return report.type_buckets(findings(spark, d).withColumn("message", F.concat(F.lit("Security of "), F.lower("type"))))


@query(FINDINGS_SQL + " SELECT path, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'immediate' WHEN severity = 'MEDIUM' THEN 'soon' ELSE 'eventually' END AS urgency, count(*) AS n FROM findings GROUP BY 1, 2")
def finding_actions(spark, d):
    return report.action_items(findings(spark, d))


@query(FINDINGS_SQL + """ SELECT path, '{"success":true,"path":"' || path || '","n":' || count(*) || ',"metadata":{"total_results":' || count(*) || ',"limited":' || (count(*) >= 20) || '}}' AS response FROM findings GROUP BY path""")
def finding_responses(spark, d):
    return report.response(findings(spark, d).groupBy("path").agg(F.count("*").alias("n")), "path", "n", 20)


CHECKED = [("a.ts", None, "pattern_validation"), ("b.py", None, "knowledge_graph"), ("c.rb", "only these files are checked: .py, .js, .jsx, .ts, .tsx", None), ("", "a path is needed", None), ("x/d.jsx", None, "pattern_validation")]


@query(rows_sql("id, path, error, analyzer", [(i, *c) for i, c in enumerate(CHECKED)], "id", id="BIGINT"))
def checked_paths(spark, d):
    rows = X.over(spark, d, [(i, c[0]) for i, c in enumerate(CHECKED)], "id long, path string", "id")
    return rows.select("id", "path", report.path_error(F.col("path"), (".py", ".js", ".jsx", ".ts", ".tsx")).alias("error"), validate.analyzer_of(F.col("path")).alias("analyzer"))


@query(rows_sql("src, dst, kind", [("src/App.tsx", f"src/App.tsx::{x}", "DEFINES") for x in ("Shop", "Hidden", "Old")] + [(f"src/App.tsx::{x}", f"src/App.tsx::{x}::props", "HAS_PROPS") for x in ("Shop", "Hidden")] + [("src/App.tsx::Shop", "src/App.tsx::Shop::hook::useState", "USES_HOOK"), ("src/App.tsx::Old", "src/App.tsx::Old::hook::useMemo", "USES_HOOK")], "src", "dst"))
def component_edges(spark, d):
    return validate.component_edges(tsx.syntax(sources(spark, d)))


def _tsx_graph(spark, d):
    return validate.tsx_graph(sources(spark, d).filter("content is not null"), "web")


@query(rows_sql("name, path, type, is_exported", [("Hidden", "src/App.tsx", "arrow", False), ("Old", "src/App.tsx", "class", False), ("Shop", "src/App.tsx", "function", True)], "path") + " ORDER BY name, path LIMIT 20")
def graph_components(spark, d):
    return _tsx_graph(spark, d).command("components web").select("name", "path", "type", "is_exported")


@query(rows_sql("name, path, owner, args", [("useMemo", "src/App.tsx", "Old", "<Function>, <Array>"), ("useState", "src/App.tsx", "Shop", "1, 2")], "path") + " ORDER BY name, path LIMIT 20")
def graph_hooks(spark, d):
    return _tsx_graph(spark, d).command("hooks").select("name", "path", "owner", "args")


@query("SELECT unnest(['function', 'arrow', 'class']) AS kind, n FROM (SELECT count(*) AS n FROM supplier)")
def graph_sql(spark, d):
    return _tsx_graph(spark, d).command("sql SELECT type AS kind, count(*) AS n FROM component GROUP BY type")


@query("""
SELECT 'web' AS name, count(*) AS files, 0 AS classes, 6 * count(*) AS functions, 3 * count(*) AS components, 2 * count(*) AS hooks,
  array_to_string(list_sort(list('s' || s_suppkey || '/src/App'))[1:5], ',') AS first_modules FROM supplier""")
def repository_stats(spark, d):
    return validate.repository_stats(_tsx_graph(spark, d), "web")


@query("""
SELECT s_suppkey AS key, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags FROM supplier
LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def file_contents(spark, d):
    li = table(spark, d, "lineitem")
    prio = li.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("path"), F.col("o_orderpriority").alias("name"))
    out = graph.file_contents(table(spark, d, "supplier").select(F.col("s_suppkey").alias("path")), priority=prio, flag=li.select(F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("name")))
    return out.select(F.col("path").alias("key"), F.nullif(F.array_join("prioritys", ","), F.lit("")).alias("priorities"), F.array_join("flags", ",").alias("flags"))


@query("""
SELECT 'repository' AS label, count(*) AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'file', count(*) FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT 'order', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'all', 0""")
def clear_repository(spark, d):
    t = {
        "repository": table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name")),
        "file": table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").cast("string").alias("repo")),
        "order": table(spark, d, "orders").select(F.col("o_custkey").alias("path"), "o_orderkey"),
    }
    left = graph.clear_file_level(t, "3")
    return graph.label_counts(left | {"all": graph.emptied(t)["order"]})


TYPES = [("string", "primitive", "string"), ("A | B", "union", "A | B"), ("Item[]", "array", "Item"), ("Map<string, Item>", "generic", "Map"), ("Cart", "interface", "Cart"), ("Promise", "primitive", "Promise")]


@query(rows_sql("id, name, kind, base", [(i, *t) for i, t in enumerate(TYPES)], "id", id="BIGINT"))
def type_kinds(spark, d):
    rows = X.over(spark, d, [(i, t[0]) for i, t in enumerate(TYPES)], "id long, name string", "id")
    return rows.select("id", "name", signatures.type_kind(F.col("name")).alias("kind"), signatures.base_type(F.col("name")).alias("base"))


SIGNED = "function plain(): void {\nexport async function sum<T>(a: T, b?: number, c: string = 'x', ...rest): Promise<T> {\nfunction bare(x) {\n"


@query(rows_sql("path, line, name, signature", [("s.ts", 1, "plain", "plain(): void"), ("s.ts", 2, "sum", "sum(a: T, b?: number, c?: string, ...rest: any): Promise<T>")], "path", line="BIGINT"))
def signature_texts(spark, d):
    lines = signatures.source_lines(X.over(spark, d, [("s.ts", SIGNED)], PAIR, "path"))
    return signatures.function_signatures(lines).select("path", "line", "name", "signature")


PACKAGES = [("src/shop/__init__.py", "shop"), ("src/shop/api/cart.py", "shop.api.cart"), ("src/shop/api/__init__.py", "shop.api"), ("lib/tool.py", "tool"), ("src/lib/deep/x.py", "deep.x"), ("run.py", "run"), ("app/lib/y.py", "app.lib.y")]


@query(f"WITH {X.values('p', 'path, module_name', PACKAGES)} SELECT 'src/t' || s_suppkey || '/' || path AS path, CASE WHEN module_name LIKE 'shop%' THEN module_name ELSE 't' || s_suppkey || '.' || replace(regexp_replace(path, '[.]py$', ''), '/', '.') END AS module_name FROM p, supplier")
def module_names(spark, d):
    return extract.module_names(X.over(spark, d, [p[0] for p in PACKAGES], "path string", "path").select(F.concat(F.lit("src/t"), F.expr("substring(path, 2)")).alias("path")))


IMPORTED = [("a.py", "import", "shop.cart"), ("a.py", "import", "shop.cart"), ("a.py", "import", "./near"), ("a.py", "import", "react"), ("a.py", "import", "@mui/core"), ("a.py", "import", "helpers"), ("a.py", "import", "xy"), ("a.py", "import", "mocklib"), ("a.py", "class", "shop")]


@query(rows_sql("path, name", [("a.py", "shop.cart"), ("a.py", "./near"), ("a.py", "helpers")], "path"))
def internal_imports(spark, d):
    return extract.internal_imports(X.over(spark, d, IMPORTED, "path string, kind string, name string", "path"), F.lit("shop"))


TS = "interface A { x: number }\ntype B = string;\nimport type { C } from './c';\nconst n: number = get<string>(a!.b, c as D);\nfunction f(x: string, y?: any): void { return x; }\n"
JS = "const n = get(a.b, c);\nfunction f(x, y) { return x; }"


@query(rows_sql("path, source", [("t.ts", JS)], "path").replace(" source FROM given", " source || chr(10) || '// ' || s_name AS source FROM given JOIN supplier ON path = 's' || s_suppkey || '/t.ts'"))
def plain_javascript(spark, d):
    out = extract.typescript_to_javascript(F.col("content"))
    return X.over(spark, d, [("t.ts", TS)], PAIR, "path").select("path", F.trim(F.regexp_replace(F.trim(out), r"^\s+|\s+$", "")).alias("source"))


@query(rows_sql("call_id, function, name", [(4, "check_access", "extra"), (4, "check_access", "other")], "call_id", call_id="BIGINT"))
def param_extra(spark, d):
    c = X.over(spark, d, X.CALLS, "call_id long, function string", "call_id")
    v = X.over(spark, d, X.PROVIDED, "call_id long, name string, value string", "call_id")
    p = spark.createDataFrame(X.PARAMS, "function string, name string, type string, mode string, position int, default string")
    return params.extra_parameters(c, v, p)


VALUES = [("1", "INTEGER"), ('"x"', "STRING"), ("true", "BOOLEAN"), ('{"a":1}', "JSON"), ("[1]", "JSON"), ("data.id", "UNKNOWN"), ('"2024-01-02T03:04:05Z"', "TIMESTAMP"), ("1.5", "STRING")]


@query(rows_sql("id, value, type", [(i, *v) for i, v in enumerate(VALUES)], "id", id="BIGINT"))
def param_inferred(spark, d):
    rows = X.over(spark, d, [(i, v[0]) for i, v in enumerate(VALUES)], "id long, value string", "id")
    return rows.select("id", "value", params.inferred_type(F.col("value")).alias("type"))


@query(rows_sql("path, name, value", [("a.ts", "account", "00000000-0000-0000-0000-000000000000"), ("a.ts", "label", "string_variable"), ("a.ts", "period", "week"), ("a.ts", "detailed", "true"), ("a.ts", "n", "3")], "path"))
def first_call_arguments(spark, d):
    code = "db.rpc('other', { x: 1 });\ndb.rpc('report', { account: user.id, label: name,\n  period: 'week', detailed: true, n: 3 });\ndb.rpc('report', { n: 9 });"
    return X.over(spark, d, [("a.ts", code)], PAIR, "path").select("path", F.explode(params.first_call("content", "report")).alias("name", "value"))


INDEXES = [("app", "note", "note_pkey", "CREATE UNIQUE INDEX note_pkey ON app.note USING btree (id)"), ("app", "note", "note_by", "CREATE INDEX note_by ON app.note USING btree (author, body)")]
POLICIES = [("app", "note", "own", "PERMISSIVE", "{public}", "SELECT", "author = uid()", None), ("app", "note", "add", "PERMISSIVE", "{public}", "INSERT", None, "true")]
TABLES = [("app", "note", True), ("app", "person", None), ("main", "orders", False), ("main", "nation", None)]
VIEWS = [("app", "recent", "SELECT 1"), ("pg_catalog", "pg_views", "SELECT 2"), ("main", "all_orders", "SELECT 3")]
INDEX, POLICY = "schema string, table string, name string, definition string", "schema string, table string, name string, permissive string, roles string, command string, qualifier string, with_check string"


def _views(spark, d):
    """Views of each project's schemas; those of the system's own schema are one and the same."""
    rows = X.over(spark, d, VIEWS, "schema string, name string, definition string", "schema")
    return rows.withColumn("schema", F.regexp_replace("schema", "^s[0-9]+/pg_", "pg_"))


def _tables(spark, d):
    return X.over(spark, d, TABLES, "schema string, name string, rls_enabled boolean", "schema")


@query(rows_sql("sch, name, is_unique, columns", [("app", "note_pkey", True, "id"), ("app", "note_by", False, "author,body")], "sch"))
def catalog_indexes(spark, d):
    return catalog.indexes_of(X.over(spark, d, INDEXES, INDEX, "schema")).select(F.col("schema").alias("sch"), "name", "is_unique", F.array_join("columns", ",").alias("columns"))


@query("WITH " + X.values_over("p", "sch, tab, rls_enabled, policies", [("app", "note", True, "add,own"), ("app", "person", False, ""), ("main", "orders", False, ""), ("main", "nation", False, "")], "sch") + ' SELECT sch AS "schema", tab AS "table", rls_enabled, policies FROM p')
def catalog_policies(spark, d):
    return catalog.policies_of(_tables(spark, d), X.over(spark, d, POLICIES, POLICY, "schema")).withColumn("policies", F.array_join("policies.name", ","))


@query(rows_sql("kind, name", [("view", "app.recent"), ("view", "main.all_orders"), ("schema", "app"), ("schema", "main")], "name") + " UNION ALL SELECT 'extension', unnest(['vector', 'uuid'])")
def catalog_others(spark, d):
    names = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "name")
    views = catalog.views_of(_views(spark, d))
    schemas = catalog.user_schemas(X.over(spark, d, ["app", "main", "pg_toast", "app"], "name string", "name").withColumn("name", F.regexp_replace("name", "^s[0-9]+/pg_", "pg_")))
    more = catalog.extensions_of(X.over(spark, d, ["vector", "uuid"], "name string"))
    return names(views.select(F.concat_ws(".", "schema", "name").alias("name")), "view").unionByName(names(schemas, "schema")).unionByName(names(more, "extension"))


@query(rows_sql("name, is_nullable, is_definer", [("a", True, False), ("b", False, True), ("c", False, False)], "name"))
def catalog_flags(spark, d):
    rows = X.over(spark, d, [("a", "YES", "INVOKER"), ("b", "NO", "DEFINER"), ("c", None, None)], "name string, nullable string, security string", "name")
    return catalog.flags(rows, is_nullable=("nullable", "YES"), is_definer=("security", "DEFINER")).select("name", "is_nullable", "is_definer")


REPORTED = [("app.note", 3, 1, 1, 2, 2, True), ("app.person", 1, 1, 0, 0, 0, False), ("main.orders", 2, 0, 0, 0, 0, False), ("main.nation", 1, 0, 0, 0, 0, False)]


@query(rows_sql("name, n_columns, n_keys, n_foreign, n_indexes, n_policies, rls_enabled", REPORTED, "name", **dict.fromkeys(("n_columns", "n_keys", "n_foreign", "n_indexes", "n_policies"), "BIGINT")))
def catalog_tables(spark, d):
    con, keys, used = _keys(spark, d)
    out = catalog.table_report(_tables(spark, d), _columns(spark, d), catalog.primary_keys(con, keys), catalog.foreign_keys(con, keys, used), X.over(spark, d, INDEXES, INDEX, "schema"), X.over(spark, d, POLICIES, POLICY, "schema"))
    return out.withColumn("name", F.concat_ws(".", "schema", "table")).drop("schema", "table")


@query(f"""
WITH {X.values_over('c', 'schema, tab, name, data_type, ordinal', COLUMNS, 'schema')},
w AS (SELECT schema || '.' || tab AS name, count(*) AS n FROM c GROUP BY schema, tab ORDER BY count(*) DESC, schema, tab LIMIT 2)
SELECT 'counts' AS section, 'tables' AS name, 4 * count(*) AS n FROM supplier UNION ALL SELECT 'counts', 'views', 2 * count(*) FROM supplier
UNION ALL SELECT 'tables', name, n FROM w UNION ALL (SELECT 'functions', 's' || s_suppkey || '/report_usage', 4 FROM supplier ORDER BY 's' || s_suppkey || '/report_usage' LIMIT 2)""")
def catalog_analysis(spark, d):
    views = catalog.views_of(_views(spark, d))
    p = X.over(spark, d, X.PARAMS, "function string, name string, type string, mode string, position int, default string", "function")
    return catalog.analysis({"tables": _tables(spark, d), "views": views}, _columns(spark, d), p, 2)


OBJECTS = [("db", "db.app.recent", "CONTAINS_VIEW"), ("db", "db.main.all_orders", "CONTAINS_VIEW"), ("db", "db.app.ping", "CONTAINS_FUNCTION"), ("db", "db.app.mood", "CONTAINS_ENUM"), ("db.app.note", "db.app.note.policy.own", "HAS_POLICY"), ("db.app.note", "db.app.note.policy.add", "HAS_POLICY")]


@query(f"""
WITH {X.values('o', 'src, dst, kind', OBJECTS)}
SELECT CASE WHEN src = 'db' THEN src ELSE 'db.s' || s_suppkey || '/' || substr(src, 4) END AS src, 'db.s' || s_suppkey || '/' || substr(dst, 4) AS dst, kind FROM o, supplier""")
def catalog_objects(spark, d):
    pair = "schema string, name string"
    views = catalog.views_of(_views(spark, d))
    _, edges = catalog.object_graph(views, X.over(spark, d, [("app", "ping")], pair, "schema"), X.over(spark, d, [("app", "mood")], pair, "schema"), X.over(spark, d, POLICIES, POLICY, "schema"))
    return edges


MERGED = [(1, "a", "9"), (1, "b", "2"), (1, "c", "3"), (2, "a", "1")]


@query(rows_sql("id, name, value, missing", [(*m, "none") for m in MERGED], "id", id="BIGINT"))
def metadata_merge(spark, d):
    """The later of two maps counts, a null map adds nothing, a missing key has its default."""
    rows = X.over(spark, d, [(1, {"a": "1", "b": "2"}, {"a": "9", "c": "3"}), (2, {"a": "1"}, None)], "id long, x map<string,string>, y map<string,string>", "id")
    both = columns.merged(F.col("x"), F.col("y"))
    return rows.select("id", F.explode(both).alias("name", "value"), columns.value_of(both, "zzz", "none").alias("missing"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, true AS ok, false AS other FROM events")
def event_stamps(spark, d):
    stamp = columns.stamp(F.col("ts"))
    return table(spark, d, "events").select("event_id", stamp.alias("stamp"), columns.is_stamp(stamp).alias("ok"), columns.is_stamp(F.col("event_type")).alias("other"))
