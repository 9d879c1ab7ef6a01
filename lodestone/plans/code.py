"""Queries over source files, calls, catalogs and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import char_similarity
from lodestone.operators import catalog, extract, params, report, rules, signatures, validate
from lodestone.plans import expected
from lodestone.plans.registry import ORACLES, query, table
from lodestone.sources import fixtures as X

Q = X.quoted


def rows_sql(columns: str, rows: list, *tagged: str, **casts: str) -> str:
    """A SELECT of rows given by hand, for each supplier where columns are tagged; casts: types of columns that literals don't tell."""
    names = [c.strip() for c in columns.split(",")]
    picked = ", ".join(f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in names)
    given = X.values_over("given", columns, rows, *tagged) if tagged else X.values("given", columns, rows)
    return f"WITH {given} SELECT {picked} FROM given"


def _matches(rule: rules.Rule, source: str = "files", key: str = "path") -> str:
    p = Q("(?ms)" + rule.pattern)
    return f"""SELECT {key}, '{rule.name}' AS rule, '{rule.kind}' AS kind, '{rule.severity}' AS severity, unnest(generate_series(1, len(m))) AS i, m, seg, content
  FROM (SELECT {key}, content, regexp_extract_all(content, {p}, 0) AS m, string_split_regex(content, {p}) AS seg FROM {source})"""


SAFE = [r for r in rules.RULES if not r.looks_around]
SCAN_SQL = f"WITH {X.FILES_SQL}, hits AS (" + " UNION ALL ".join(_matches(r) for r in SAFE) + """),
lined AS (SELECT path, rule, kind, severity, i, content, array_to_string(seg[1:i], '') || array_to_string(m[1:i - 1], '') AS before FROM hits)
SELECT path, rule, kind, severity, CAST(0.8 AS DOUBLE) AS confidence, CAST(i - 1 AS BIGINT) AS seq, CAST(1 + length(before) - length(replace(before, chr(10), '')) AS BIGINT) AS line,
  trim(string_split(content, chr(10))[1 + length(before) - length(replace(before, chr(10), ''))]) AS snippet FROM lined"""


@query(SCAN_SQL)
def rule_scan_safe(spark, d):
    return rules.scan(X.files(spark, d), SAFE)


@query(f"WITH {X.FILES_SQL}, c AS (" + " UNION ALL ".join(f"SELECT path, '{r.name}' AS rule, len(regexp_extract_all(content, {Q('(?ms)' + r.pattern)}, 0)) AS n FROM files" for r in SAFE) + ") SELECT path, rule, CAST(n AS BIGINT) AS n FROM c WHERE n > 0")
def rule_counts(spark, d):
    return rules.rule_counts(X.files(spark, d), SAFE)


@query(rows_sql("path, rule, kind, severity, confidence, seq, line, snippet", expected.LOOKAHEAD, "path", confidence="DOUBLE", seq="BIGINT", line="BIGINT"))
def rule_scan_lookahead(spark, d):
    return rules.scan(X.files(spark, d), [r for r in rules.RULES if r.looks_around])


TEXT_RULES = [rules.Rule("sentence_short", "STYLE", "LOW", r"\b\w{1,3}\."), rules.Rule("token_value", "SECURITY_RISK", "HIGH", r"token\s*=\s*\"[0-9a-f]+\""), rules.Rule("shouting", "STYLE", "LOW", r"!!+")]


TEXT_SQL = "WITH docs AS (SELECT doc_id, text AS content FROM documents), c AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS rule, len(regexp_extract_all(content, {Q('(?ms)' + r.pattern)}, 0)) AS n FROM docs" for r in TEXT_RULES) + ") SELECT doc_id, rule, CAST(n AS BIGINT) AS n FROM c WHERE n > 0"


@query(TEXT_SQL)
def rule_scan_documents(spark, d):
    # \w is ASCII in both engines, \b only in SQL's: said here by what may not stand before.
    scanned = [rules.Rule(r.name, r.kind, r.severity, r.pattern.replace(r"\b\w", r"(?<!\w)\w")) for r in TEXT_RULES]
    return rules.rule_counts(table(spark, d, "documents"), scanned, "doc_id", "text")


@query(TEXT_SQL)
def rule_scan_documents_all(spark, d):
    """The same under the name that it had when the other one left out a rule."""
    return rule_scan_documents(spark, d)


@query("WITH pages_ AS (SELECT page_id, html AS content FROM pages), hits AS (" + _matches(rules.Rule("heading", "STRUCTURE", "INFO", r"<h[1-3]>"), "pages_", "page_id") + """),
lined AS (SELECT page_id, rule, i, array_to_string(seg[1:i], '') || array_to_string(m[1:i - 1], '') AS before FROM hits)
SELECT page_id, rule, CAST(i - 1 AS BIGINT) AS seq, CAST(1 + length(before) - length(replace(before, chr(10), '')) AS BIGINT) AS line FROM lined""")
def rule_scan_pages(spark, d):
    return rules.scan(table(spark, d, "pages"), [rules.Rule("heading", "STRUCTURE", "INFO", r"<h[1-3]>")], "page_id", "html").select("page_id", "rule", "seq", "line")


@query(f"""WITH {X.FILES_SQL}, u AS (SELECT path, unnest(regexp_extract_all(content, '(\\w+)=\\{{(\\w+)\\}}', 2)) AS name FROM files)
SELECT path, name || ' x ' || count(*) AS message FROM u GROUP BY path, name HAVING count(*) > 3""")
def prop_drilling(spark, d):
    return rules.prop_drilling(X.files(spark, d)).select("path", "message")


EFFECT = r"useEffect\s*\(\s*\(\s*\)\s*=>\s*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}\s*,\s*\[([^\]]*)\]\s*\)"


@query(f"""WITH {X.FILES_SQL}, e AS (SELECT path, unnest(regexp_extract_all(content, {Q('(?s)' + EFFECT)}, 1)) AS body, unnest(regexp_extract_all(content, {Q('(?s)' + EFFECT)}, 2)) AS deps FROM files),
m AS (SELECT path, list_sort(list_filter(list_distinct(regexp_extract_all(body, '\\w+')), lambda w: NOT list_contains(regexp_extract_all(deps, '\\w+'), w) AND NOT list_contains(['console', 'document', 'window'], w))) AS missing FROM e)
SELECT path, array_to_string(missing, ', ') AS missing FROM m WHERE len(missing) > 0""")
def effect_deps(spark, d):
    return rules.missing_effect_dependencies(X.files(spark, d)).select("path", F.col("message").alias("missing"))


@query(f"""WITH {X.FILES_SQL}, n AS (SELECT path, len(list_filter(regexp_extract_all(content, 'import\\s+.*?\\s+from\\s+[''"]([^''"]+)[''"]', 1), lambda m: starts_with(m, '.'))) AS n FROM files)
SELECT path, CAST(n AS VARCHAR) AS n FROM n WHERE n > 5""")
def cyclic_imports(spark, d):
    return rules.cyclic_dependencies(X.files(spark, d)).select("path", F.col("message").alias("n"))


@query(f"WITH {X.FILES_SQL}, c AS (SELECT path, len(regexp_extract_all(content, 'style=\\{{\\{{[^}}]+\\}}\\}}', 0)) AS n FROM files) SELECT path, CAST(n AS BIGINT) AS n FROM c WHERE n > 0")
def inline_styles(spark, d):
    return rules.inline_styles(X.files(spark, d)).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {X.FILES_SQL} SELECT path, unnest(regexp_extract_all(content, 'interface\\s+(\\w+)\\s*\\{{\\s*\\}}', 1)) AS name FROM files")
def empty_interfaces(spark, d):
    return rules.empty_interfaces(X.files(spark, d)).select("path", F.col("message").alias("name"))


@query(f"""WITH {X.FILES_SQL}, v AS (SELECT DISTINCT path, content, unnest(regexp_extract_all(content, '(?:const|let|var)\\s+(\\w+)', 1)) AS name FROM files)
SELECT path, name FROM v WHERE NOT starts_with(name, '_') AND len(regexp_extract_all(content, '\\b' || name || '\\b')) = 1""")
def unused_variables(spark, d):
    return rules.unused_variables(X.files(spark, d)).select("path", F.col("message").alias("name"))


@query(f"""WITH {X.FILES_SQL}, a AS (SELECT path, content, unnest(regexp_extract_all(content, '(\\w+)\\.([\\w\\[\\]\\.]+)\\s*=\\s*[^=]', 1)) AS v FROM files)
SELECT path, 'mutates ' || v AS message FROM a WHERE regexp_matches(content, v || '\\s*=\\s*useState\\(') OR regexp_matches(content, 'const\\s+\\[' || v || ',')
  OR regexp_matches(content, 'this\\.state\\.' || v) OR regexp_matches(content, v || '\\s*=\\s*this\\.state')""")
def state_mutations(spark, d):
    return rules.complex_state_mutation(X.files(spark, d)).select("path", "message")


@query(f"""WITH {X.FILES_SQL}, c AS (SELECT path, content, '(const|function)\\s+([A-Z]\\w*)\\s*[=:].*?\\([^)]*\\)\\s*=>' AS p FROM files),
s AS (SELECT path, content, unnest(regexp_extract_all(content, '(?:const|function)\\s+(?:[A-Z]\\w*)\\s*[=:].*?\\([^)]*\\)\\s*=>', 0)) AS head FROM files)
SELECT path, CAST(sum(len(regexp_extract_all(substr(content, strpos(content, head)), '\\bthis\\b'))) AS BIGINT) AS n FROM s
GROUP BY path HAVING sum(len(regexp_extract_all(substr(content, strpos(content, head)), '\\bthis\\b'))) > 0""")
def this_in_components(spark, d):
    return rules.this_in_functional_component(X.files(spark, d)).groupBy("path").agg(F.count("*").alias("n"))


@query(rows_sql("path, rule, kind, severity, confidence, line, message", expected.FINDINGS, "path", confidence="DOUBLE", line="BIGINT"))
def all_findings(spark, d):
    return rules.detect(X.files(spark, d), rules.RULES + rules.EXTRA_RULES)


LINES_SQL = f"""WITH {X.FILES_SQL}, raw AS (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files),
lines AS (SELECT path, CAST(line AS BIGINT) AS line, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS text FROM raw WHERE regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(trim(t), '//')),
types AS (SELECT DISTINCT path, regexp_extract(text, {Q(signatures.INTERFACE)}, 1) AS name FROM lines WHERE regexp_matches(text, {Q(signatures.INTERFACE)})
  UNION SELECT DISTINCT path, regexp_extract(text, {Q(signatures.TYPE_ALIAS)}, 1) FROM lines WHERE regexp_matches(text, {Q(signatures.TYPE_ALIAS)})),
uses AS (SELECT path, split_part(unnest(regexp_extract_all(text, {Q(signatures.TYPE_USE)}, 1)), '<', 1) AS name FROM lines),
funs AS (SELECT path, regexp_extract(text, {Q(signatures.FUNCTION)}, 3) AS name, list_filter(list_transform(string_split(regexp_extract(text, {Q(signatures.FUNCTION)}, 5), ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM lines WHERE regexp_matches(text, {Q(signatures.FUNCTION)})),
calls AS (SELECT path, line, unnest(regexp_extract_all(text, {Q(signatures.CALL)}, 1)) AS name, unnest(regexp_extract_all(text, {Q(signatures.CALL)}, 2)) AS args FROM lines),
"""


def _lines(spark, d):
    return signatures.source_lines(X.files(spark, d))


@query(LINES_SQL + f"x AS (SELECT 1) SELECT DISTINCT path, name FROM uses WHERE name NOT IN ({', '.join(map(Q, signatures.BUILTIN_TYPES))}) AND (path, name) NOT IN (SELECT (path, name) FROM types)")
def type_undefined(spark, d):
    return signatures.undefined_types(_lines(spark, d))


@query(LINES_SQL + X.values("hooks", "name, least, most", signatures.HOOK_SIGNATURES) + """,
n AS (SELECT path, line, name, len(list_filter(list_transform(string_split(args, ','), lambda x: trim(x)), lambda x: x <> '')) AS n_args FROM calls),
o AS (SELECT path, name, len(list_filter(ps, lambda p: NOT contains(p, '?') AND NOT contains(p, '=') AND NOT starts_with(p, '...'))) AS least, len(ps) AS most FROM funs),
b AS (SELECT n.*, coalesce(h.least, o.least) AS least, coalesce(h.most, o.most) AS most FROM n LEFT JOIN hooks h ON h.name = n.name LEFT JOIN o ON o.name = n.name AND o.path = n.path)
SELECT path, line, name, CASE WHEN n_args < least THEN 'MISSING_ARGUMENTS' ELSE 'TOO_MANY_ARGUMENTS' END AS error, CAST(n_args AS BIGINT) AS n_args FROM b WHERE n_args < least OR n_args > most""")
def arity_check(spark, d):
    return signatures.arity_errors(_lines(spark, d))


@query(LINES_SQL + """x AS (SELECT 1)
SELECT path, name, 'UNUSED_TYPE' AS issue FROM types WHERE (path, name) NOT IN (SELECT (path, name) FROM uses)
UNION ALL SELECT path, name, 'UNUSED_FUNCTION' FROM funs WHERE (path, name) NOT IN (SELECT (path, name) FROM calls)""")
def unused_defs(spark, d):
    return signatures.unused_definitions(_lines(spark, d))


MODULES = [(1, "react"), (2, "./local"), (3, "@types/react"), (4, "@scope/x"), (5, "left-pad"), (6, "axios")]


@query(f"WITH {X.values_over('m', 'id, module', MODULES, 'id')}, {X.values('lib', 'name, c', signatures.LIBRARIES)} " + """
SELECT CAST(id AS BIGINT) AS id, CASE WHEN name IS NOT NULL THEN 'VALID' ELSE 'UNCERTAIN' END AS status,
  CAST(CASE WHEN name IS NOT NULL THEN c WHEN starts_with(module, '.') THEN 0.7 WHEN starts_with(module, '@') THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence FROM m LEFT JOIN lib ON name = module""")
def import_ladder(spark, d):
    return X.over(spark, d, MODULES, "id long, module string", "id").select("id", signatures.import_verdict(F.col("module")).alias("v")).select("id", "v.*")


METHODS = [(1, "x", "useState"), (2, "x", "map"), (3, "Object", "keys"), (4, "x", "keys"), (5, "console", "warn"), (6, "p", "then"), (7, "c", "componentDidMount"), (8, "x", "useIdd"), (9, None, "zzz"), (10, "x", "seuRef")]
IN = lambda names: "(" + ", ".join(map(Q, names)) + ")"
SIMILAR = "len(list_intersect(list_distinct(string_split(lower({a}), '')), list_distinct(string_split(lower({b}), '')))) / greatest(length({a}), length({b}))"


@query(f"WITH {X.values_over('m', 'id, obj, method', METHODS, 'id')}, {X.values('hooks', 'hook', signatures.REACT_HOOKS)}, " + f"""
s AS (SELECT id, obj, method, max({SIMILAR.format(a='method', b='hook')}) AS likeness FROM m, hooks GROUP BY ALL),
v AS (SELECT id, CASE WHEN method IN {IN(signatures.REACT_HOOKS)} THEN 1 WHEN method IN {IN(signatures.ARRAY_METHODS)} THEN 2 WHEN obj = 'Object' AND method IN {IN(signatures.OBJECT_METHODS)} THEN 3
  WHEN obj = 'console' AND method IN {IN(signatures.CONSOLE_METHODS)} THEN 4 WHEN method IN {IN(signatures.PROMISE_METHODS)} THEN 5 WHEN method IN {IN(signatures.LIFECYCLE_METHODS)} THEN 6 WHEN likeness > 0.8 THEN 7 ELSE 8 END AS k FROM s)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN k < 7 THEN 'VALID' WHEN k = 7 THEN 'INVALID' ELSE 'UNCERTAIN' END AS status, CAST([0.95, 0.9, 0.95, 0.98, 0.85, 0.9, 0.7, 0.3][k] AS DOUBLE) AS confidence FROM v""")
def method_ladder(spark, d):
    rows = X.over(spark, d, METHODS, "id long, obj string, method string", "id")
    return rows.select("id", signatures.method_verdict(F.col("obj"), F.col("method")).alias("v")).select("id", "v.*")


NAMES = [(1, "memo", "x", "Map", "title", "document"), (2, "setTimeout", "x", "Element", "title", "window"), (3, "Widget", "x", "Foo", "log", "console"), (4, "doit", "x", "Date", "clear", "localStorage")]


@query(f"WITH {X.values_over('n', 'id, fn, x, cls, attr, obj', NAMES, 'id')} " + f"""
SELECT CAST(id AS BIGINT) AS id, CAST(CASE WHEN fn IN {IN(signatures.REACT_FUNCTIONS + signatures.TIMERS)} THEN 0.95 WHEN regexp_matches(fn, '^[A-Z]') THEN 0.6 ELSE 0.4 END AS DOUBLE) AS fn_confidence,
  CAST(CASE WHEN cls IN {IN(signatures.BUILTIN_CLASSES)} THEN 0.95 WHEN cls IN {IN(signatures.DOM_CLASSES)} THEN 0.9 ELSE 0.5 END AS DOUBLE) AS class_confidence,
  CAST(CASE WHEN """ + " OR ".join(f"(obj = '{o}' AND attr IN {IN(v)})" for o, v in signatures.GLOBAL_PROPERTIES.items()) + " THEN 0.9 ELSE 0.4 END AS DOUBLE) AS attribute_confidence FROM n")
def name_ladders(spark, d):
    rows = X.over(spark, d, NAMES, "id long, fn string, x string, cls string, attr string, obj string", "id")
    return rows.select("id", signatures.function_verdict(F.col("fn"))["confidence"].alias("fn_confidence"), signatures.class_verdict(F.col("cls"))["confidence"].alias("class_confidence"), signatures.attribute_verdict(F.col("obj"), F.col("attr"))["confidence"].alias("attribute_confidence"))


@query(f"SELECT a.p_partkey AS a, b.p_partkey AS b, round({SIMILAR.format(a='a.p_name', b='b.p_name')}, 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def char_similarity_pairs(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("b_name"))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("a"), "b", F.round(char_similarity("p_name", "b_name"), 6).alias("similarity"))


CALLS_SQL = f"WITH {X.values('fns', 'name', X.FUNCTIONS)}, {X.values('ps', 'function, name, type, mode, position, dflt', X.PARAMS)}, {X.values('en', 'name, vals', X.ENUMS)}, {X.values_over('cs', 'call_id, function', X.CALLS, 'call_id')}, {X.values_over('pr', 'call_id, name, value', X.PROVIDED, 'call_id')}, " + """
ex AS (SELECT function, ps.name, CASE WHEN en.name IS NOT NULL THEN 'ENUM' ELSE upper(type) END AS type, mode = 'IN' AND coalesce(dflt, '') = '' AS required, vals FROM ps LEFT JOIN en ON en.name = ps.type),
rl AS (SELECT * FROM cs WHERE function IN (SELECT name FROM fns)),
vl AS (SELECT rl.call_id, ex.name, type, vals, value, trim(value, '"') AS s, CASE WHEN starts_with(value, '"') THEN 'string' WHEN value IN ('true', 'false') THEN 'boolean' WHEN starts_with(value, '{') THEN 'object' WHEN starts_with(value, '[') THEN 'array' ELSE 'number' END AS kind
  FROM rl JOIN ex USING (function) JOIN pr ON pr.call_id = rl.call_id AND pr.name = ex.name),
er AS (
  SELECT call_id, function AS name, 'NOT_FOUND' AS error FROM cs WHERE function NOT IN (SELECT name FROM fns)
  UNION ALL SELECT call_id, function, 'COUNT' FROM (SELECT rl.*, (SELECT count(*) FROM pr WHERE pr.call_id = rl.call_id) AS g, (SELECT count(*) FROM ex WHERE ex.function = rl.function) AS t, (SELECT count(*) FROM ex WHERE ex.function = rl.function AND required) AS r FROM rl) WHERE g < r OR g > t
  UNION ALL SELECT call_id, ex.name, 'MISSING' FROM rl JOIN ex USING (function) WHERE required AND (call_id, ex.name) NOT IN (SELECT (call_id, name) FROM pr)
  UNION ALL SELECT call_id, name, 'TYPE' FROM vl WHERE (type = 'UUID' AND NOT (kind = 'string' AND regexp_matches(s, '^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$')))
    OR (type = 'INTEGER' AND NOT regexp_matches(s, '^-?\\d+$')) OR (type = 'BOOLEAN' AND NOT (kind = 'boolean' OR lower(s) IN ('true', 'false', '0', '1')))
    OR (type = 'TIMESTAMP' AND NOT regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{3})?Z?$'))
  UNION ALL SELECT call_id, name, 'ENUM' FROM vl WHERE type = 'ENUM' AND NOT list_contains(vals, s)
  UNION ALL SELECT call_id, name, 'JSON' FROM vl WHERE type IN ('JSON', 'JSONB') AND kind <> 'object')
SELECT CAST(call_id AS BIGINT) AS call_id, name, error FROM er"""


def _calls(spark, d):
    f = spark.createDataFrame([(n,) for n in X.FUNCTIONS], "name string")
    p = spark.createDataFrame(X.PARAMS, "function string, name string, type string, mode string, position int, default string")
    e = spark.createDataFrame(X.ENUMS, "name string, values array<string>")
    c = X.over(spark, d, X.CALLS, "call_id long, function string", "call_id")
    v = X.over(spark, d, X.PROVIDED, "call_id long, name string, value string", "call_id")
    return params.check_calls(c, v, f, p, e)


def _errors(name, *kinds):
    def plan(spark, d):
        return _calls(spark, d).filter(F.col("error").isin(*kinds))

    plan.__name__ = name
    query(CALLS_SQL + " WHERE error IN " + IN(kinds))(plan)


_errors("param_count", "COUNT", "NOT_FOUND")
_errors("param_missing", "MISSING")
_errors("param_types", "TYPE")
_errors("param_enum", "ENUM")
_errors("param_json", "JSON")

FINDINGS_SQL = """WITH findings AS (SELECT 'f' || doc_id % 50 AS path, doc_id AS seq, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][1 + doc_id % 5] AS severity, (1 + doc_id % 9) / 10.0 AS confidence,
  ['BAD_PRACTICE', 'INCORRECT_SIGNATURE', 'TABLE_NOT_FOUND', 'COMPONENT_NOT_FOUND', 'INVALID_TYPE', 'OTHER', 'OTHER'][1 + doc_id % 7] AS type FROM labels)"""


def findings(spark, d):
    """Findings made of every row of labels."""
    rows = table(spark, d, "labels")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (1 + F.col("doc_id") % n).cast("int"))
    return rows.select(F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("path"), F.col("doc_id").alias("seq"), pick(["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"], 5).alias("severity"), ((1 + F.col("doc_id") % 9) / 10.0).alias("confidence"), pick(["BAD_PRACTICE", "INCORRECT_SIGNATURE", "TABLE_NOT_FOUND", "COMPONENT_NOT_FOUND", "INVALID_TYPE", "OTHER", "OTHER"], 7).alias("type"))


@query(FINDINGS_SQL + """ SELECT path, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM findings GROUP BY path""")
def severity_stats(spark, d):
    return report.statistics(findings(spark, d), "path")


@query(FINDINGS_SQL + """ SELECT path, round(greatest(0.0, 1 - sum(CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 WHEN 'LOW' THEN 0.4 ELSE 0.2 END * confidence) / (2 * count(*))), 6) AS confidence FROM findings GROUP BY path
UNION ALL SELECT 'none', 1.0""")
def confidence_score(spark, d):
    f = findings(spark, d)
    files = f.select("path").unionByName(spark.createDataFrame([("none",)], "path string"))
    return report.confidence(f, files).select("path", F.round("confidence", 6).alias("confidence"))


@query(FINDINGS_SQL + """ SELECT seq, severity, CAST(confidence AS DOUBLE) AS confidence FROM findings ORDER BY list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity), findings.confidence DESC, seq LIMIT 10""")
def top_detections(spark, d):
    return report.top(findings(spark, d)).select("seq", "severity", "confidence")


@query(FINDINGS_SQL + """, c AS (SELECT path, count(*) FILTER (type = 'COMPONENT_NOT_FOUND') AS a, count(*) FILTER (type = 'TABLE_NOT_FOUND') AS b, count(*) FILTER (type = 'INCORRECT_SIGNATURE') AS e, count(*) FILTER (type = 'BAD_PRACTICE') AS g FROM findings GROUP BY path)
SELECT path, a || ' unknown components: check their imports' AS recommendation FROM c WHERE a > 0 UNION ALL SELECT path, b || ' unknown tables: check their names against the schema' FROM c WHERE b > 0
UNION ALL SELECT path, e || ' calls with wrong arguments: check the signatures' FROM c WHERE e > 0 UNION ALL SELECT path, g || ' findings on practice: follow the framework''s guides' FROM c WHERE g > 0
UNION ALL SELECT path, 'turn strict mode on' FROM c""")
def recommendations(spark, d):
    f = findings(spark, d)
    files = f.select("path", F.lit("typescript").alias("language"), F.array().cast("array<string>").alias("frameworks")).distinct()
    return report.recommendations(f, files)


@query(FINDINGS_SQL + " SELECT severity, round(avg(confidence), 6) AS mean_confidence, round(count(*) / greatest(count(DISTINCT path), 1), 6) AS density FROM findings GROUP BY severity")
def mean_confidence(spark, d):
    f = findings(spark, d)
    n = f.groupBy("severity").agg(F.round(report.density(F.count("*"), F.count_distinct("path")), 6).alias("density"))
    return report.mean_confidence(f, "severity").join(n, "severity").select("severity", F.round("mean_confidence", 6).alias("mean_confidence"), "density")


def _of_all_labels(plan, sql):
    """The plan under the name that it had when the other one left rows out."""

    def whole(spark, d):
        return plan(spark, d)

    whole.__name__ = f"{plan.__name__}_all"
    query(sql)(whole)


for _plan in (severity_stats, confidence_score, top_detections, recommendations, mean_confidence):
    _of_all_labels(_plan, ORACLES[_plan.__name__])


@query(f"WITH {X.FILES_SQL}, m AS (SELECT path, lower(unnest(regexp_extract_all(content, 'from\\s+[''\"]([^''\"]+)[''\"]', 1))) AS m FROM files) SELECT DISTINCT path, CASE WHEN contains(m, 'react') THEN 'react' WHEN contains(m, 'next') THEN 'next' WHEN contains(m, 'vue') THEN 'vue' END AS framework FROM m WHERE regexp_matches(m, 'react|next|vue')")
def frameworks_detected(spark, d):
    imports = extract.extract_tsx(X.files(spark, d)).filter("kind = 'import'").select("path", F.col("name").alias("module"))
    return report.frameworks(imports)


COLUMNS = [("main", "orders", "o_orderkey", "bigint", 1), ("main", "orders", "o_custkey", "bigint", 2), ("main", "nation", "n_nationkey", "int", 1), ("app", "note", "id", "uuid", 1), ("app", "note", "body", "text", 2), ("app", "note", "author", "uuid", 3), ("app", "person", "id", "uuid", 1)]
LABELS = [("app", "mood", "sad", 1), ("app", "mood", "happy", 3), ("app", "mood", "ok", 2), ("app", "size", "s", 1), ("app", "size", "l", 2)]
CONSTRAINTS = [("note_pk", "PRIMARY KEY"), ("person_pk", "PRIMARY KEY"), ("note_author", "FOREIGN KEY")]
KEYS = [("note_pk", "app", "note", "id"), ("person_pk", "app", "person", "id"), ("note_author", "app", "note", "author")]
USED = [("note_author", "app", "person", "id")]


COLUMN = "schema string, table string, name string, data_type string, ordinal int"


def _columns(spark, d):
    return X.over(spark, d, COLUMNS, COLUMN, "schema").withColumn("is_nullable", F.col("ordinal") > 1)


@query(f"WITH {X.values_over('c', 'schema, tab, name, data_type, ordinal', COLUMNS, 'schema')} SELECT schema, tab AS \"table\", name, data_type, CAST(ordinal AS INTEGER) AS ordinal FROM c")
def catalog_columns(spark, d):
    return catalog.columns_of(_columns(spark, d)).select("schema", "table", "name", "data_type", "ordinal")


@query(f"WITH {X.values_over('l', 'schema, name, label, o', LABELS, 'schema')} SELECT schema, name, string_agg(label, ',' ORDER BY o) AS labels FROM l GROUP BY ALL")
def catalog_enums(spark, d):
    rows = X.over(spark, d, LABELS, "schema string, name string, label string, sort_order int", "schema")
    return catalog.enum_values(rows).select("schema", "name", F.array_join("values", ",").alias("labels"))


KEYS_SQL = f"WITH {X.values_over('con', 'constraint_name, t', CONSTRAINTS, 'constraint_name')}, {X.values_over('k', 'constraint_name, schema, tab, col', KEYS, 'constraint_name', 'schema')}, {X.values_over('u', 'constraint_name, schema, tab, col', USED, 'constraint_name', 'schema')} "


def _keys(spark, d):
    con = X.over(spark, d, CONSTRAINTS, "constraint_name string, constraint_type string", "constraint_name")
    kind = "constraint_name string, schema string, table string, column string"
    return con, *(X.over(spark, d, rows, kind, "constraint_name", "schema") for rows in (KEYS, USED))


@query(KEYS_SQL + "SELECT k.schema, k.tab AS \"table\", k.col AS \"column\", u.schema AS f_schema, u.tab AS f_table, u.col AS f_column, constraint_name FROM con JOIN k USING (constraint_name) JOIN u USING (constraint_name) WHERE t = 'FOREIGN KEY'")
def catalog_fk(spark, d):
    return catalog.foreign_keys(*_keys(spark, d))


@query(KEYS_SQL + "SELECT DISTINCT schema, tab AS \"table\", col AS \"column\" FROM con JOIN k USING (constraint_name) WHERE t = 'PRIMARY KEY'")
def catalog_pk(spark, d):
    con, keys, _ = _keys(spark, d)
    return catalog.primary_keys(con, keys)


@query(f"WITH {X.values_over('c', 'schema, tab, name, data_type, ordinal', COLUMNS, 'schema')} SELECT schema, tab AS \"table\", count(*) AS column_count FROM c GROUP BY ALL ORDER BY column_count DESC, schema, tab LIMIT 10")
def catalog_widest(spark, d):
    return catalog.widest_tables(_columns(spark, d))


@query(f"WITH {X.values_over('c', 'schema, tab, name, data_type, ordinal', COLUMNS, 'schema')} SELECT 'db.' || schema || '.' || tab AS src, count(*) AS n FROM c GROUP BY 1")
def catalog_graph(spark, d):
    cols = _columns(spark, d)
    con, keys, used = _keys(spark, d)
    tables = cols.select("schema", F.col("table").alias("name")).distinct()
    _, edges = catalog.graph_of(tables, cols, catalog.foreign_keys(con, keys, used))
    return edges.filter("kind = 'HAS_COLUMN'").groupBy("src").agg(F.count("*").alias("n"))


ROUTINES = ["get_user", "get_user_all", "ping"]
SPECIFIC = [("get_user_1", "id", "uuid", 1), ("get_user_all_2", "page", "int", 1), ("ping_3", "host", "text", 1)]


@query(f"WITH {X.values_over('r', 'name', ROUTINES, 'name')}, {X.values_over('p', 'sn, name, type, position', SPECIFIC, 'sn')} SELECT r.name AS function, p.name, type, CAST(position AS INTEGER) AS position FROM r JOIN p ON p.sn LIKE '%' || r.name || '%'")
def catalog_function_params(spark, d):
    r = X.over(spark, d, ROUTINES, "name string", "name")
    return catalog.function_parameters(r, X.over(spark, d, SPECIFIC, "specific_name string, name string, type string, position int", "specific_name"))


USES = [("a.ts", 3, "orders"), ("a.ts", 9, "ghost"), ("b.ts", 1, "nation"), ("b.ts", 2, "phantom")]


@query(f"WITH {X.values_over('u', 'path, line, name', USES, 'path')} SELECT path, CAST(line AS BIGINT) AS line, name, 'nation, note, orders, person' AS suggestion FROM u WHERE name NOT IN ('nation', 'note', 'orders', 'person')")
def unknown_tables(spark, d):
    uses = X.over(spark, d, USES, "path string, line long, name string", "path")
    return signatures.unknown_names(uses, spark.createDataFrame(COLUMNS, COLUMN).select(F.col("table").alias("name")))


@query(rows_sql("path, kind, owner, name, line, params, return_type", expected.PYTHON_FACTS, "path", line="BIGINT"))
def python_extract(spark, d):
    return extract.extract_python(X.python_files(spark, d)).withColumn("params", F.array_join("params", "; "))


@query(rows_sql("path, kind, name, line, detail", expected.TSX_LINES, "path", line="BIGINT"))
def tsx_extract(spark, d):
    return extract.extract_tsx(X.files(spark, d))


ARITY_SQL = X.values("hooks", "name, least, most", signatures.HOOK_SIGNATURES) + """,
n AS (SELECT path, line, name, len(list_filter(list_transform(string_split(args, ','), lambda x: trim(x)), lambda x: x <> '')) AS n_args FROM calls),
o AS (SELECT path, name, len(list_filter(ps, lambda p: NOT contains(p, '?') AND NOT contains(p, '=') AND NOT starts_with(p, '...'))) AS least, len(ps) AS most FROM funs),
b AS (SELECT n.*, coalesce(h.least, o.least) AS least, coalesce(h.most, o.most) AS most FROM n LEFT JOIN hooks h ON h.name = n.name LEFT JOIN o ON o.name = n.name AND o.path = n.path)"""


@query(LINES_SQL + ARITY_SQL + f""",
hits AS (""" + " UNION ALL ".join(f"SELECT path, '{r.severity}' AS severity, unnest(regexp_extract_all(content, {Q('(?ms)' + r.pattern)}, 0)) AS m FROM files" for r in SAFE) + f"""),
f AS (SELECT path, severity FROM hits UNION ALL SELECT path, CASE WHEN n_args < least THEN 'HIGH' ELSE 'MEDIUM' END FROM b WHERE n_args < least OR n_args > most
  UNION ALL SELECT path, 'HIGH' FROM (SELECT DISTINCT path, name FROM uses WHERE name NOT IN ({', '.join(map(Q, signatures.BUILTIN_TYPES))}) AND (path, name) NOT IN (SELECT (path, name) FROM types))
  UNION ALL SELECT path, 'LOW' FROM types WHERE (path, name) NOT IN (SELECT (path, name) FROM uses)
  UNION ALL SELECT path, 'LOW' FROM funs WHERE (path, name) NOT IN (SELECT (path, name) FROM calls))
SELECT files.path, count(severity) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, round(CASE WHEN count(severity) = 0 THEN 1.0 ELSE 1 - sum(0.8 * CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 ELSE 0.4 END) / (2 * count(severity)) END, 6) AS confidence
FROM files LEFT JOIN f ON f.path = files.path GROUP BY files.path""")
def validation_report(spark, d):
    files = X.files(spark, d).select("path", "content")
    out = validate.summary(files, validate.findings(files, SAFE, context=False))
    return out.select("path", "total", "critical", "high", "medium", "low", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {X.values_over('m', 'id, module', MODULES, 'id')}, {X.values('lib', 'name, c', signatures.LIBRARIES)} " + """
SELECT count(*) AS n, round(avg(CASE WHEN name IS NULL THEN 0.0 ELSE 1.0 END), 6) AS valid, 0.0 AS invalid, round(avg(CASE WHEN name IS NULL THEN 1.0 ELSE 0.0 END), 6) AS uncertain FROM m LEFT JOIN lib ON name = module""")
def verdict_rates(spark, d):
    rows = X.over(spark, d, MODULES, "id long, module string", "id").select(signatures.import_verdict(F.col("module")).alias("v")).select("v.*")
    return report.verdict_rates(rows)


@query("SELECT 'shop' AS name, 2 * count(*) AS files, count(*) AS classes, 2 * count(*) AS functions, count(*) AS methods FROM supplier")
def python_graph_explore(spark, d):
    return validate.python_graph(X.python_files(spark, d), "shop").command("explore shop")


@query(rows_sql("path, line, name, status", [("src/shop/model.py", 1, "os", "UNCERTAIN"), ("src/shop/model.py", 2, ".base", "VALID")], "path", line="BIGINT"))
def python_import_check(spark, d):
    files = X.python_files(spark, d)
    return validate.check_python(files, validate.python_graph(files, "shop"))


@query(rows_sql("path, line, procedure, name, value", [("a.ts", 1, "report_usage", "account", None), ("a.ts", 1, "report_usage", "period", '"week"'), ("a.ts", 1, "report_usage", "detailed", "true"), ("a.ts", 2, "ping", None, None)], "path", line="BIGINT"))
def call_arguments(spark, d):
    code = "db.rpc('report_usage', { account: user.id, period: 'week', detailed: true });\ndb.rpc('ping');\n"
    return extract.extract_calls(X.over(spark, d, [("a.ts", code)], "path string, content string", "path"))
