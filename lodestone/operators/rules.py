"""Rule scans over source text: every rule is a Column expression, all rules one projection.

A rule's occurrences come from the text between its matches, so positions and line
numbers need no function outside the JVM. Rules are an unrolled array of literals: each
pattern is compiled once, and a scan needs no exchange.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import col


@dataclass(frozen=True)
class Rule:
    """A pattern (multi-line, dot matches all), how its findings are filed, and whether it looks around."""

    name: str
    kind: str
    severity: str
    pattern: str
    looks_around: bool = False
    confidence: float = 0.8


# The rule patterns.
RULES = [
    Rule("hooks_conditional", "HOOK_VIOLATION", "CRITICAL", r"if\s*\([^)]+\)\s*\{\s*use[A-Z]\w*\("),
    Rule("hooks_in_loop", "HOOK_VIOLATION", "CRITICAL", r"(for|while)\s*\([^)]+\)\s*\{[^}]*use[A-Z]\w*\("),
    Rule("hooks_in_function", "HOOK_VIOLATION", "HIGH", r"function\s+\w+\s*\([^)]*\)\s*\{[^}]*use[A-Z]\w*\("),
    Rule("inline_object_prop", "PERFORMANCE_ISSUE", "MEDIUM", r"(\w+)=\{\{[^}]+\}\}"),
    Rule("inline_function_prop", "PERFORMANCE_ISSUE", "MEDIUM", r"(\w+)=\{[^}]*=>[^}]*\}"),
    Rule("missing_key_prop", "PERFORMANCE_ISSUE", "HIGH", r"\.map\s*\([^)]+\)\s*=>\s*<\w+(?![^>]*key=)", True),
    Rule("dangerous_html", "SECURITY_RISK", "HIGH", r"dangerouslySetInnerHTML\s*=\s*\{\{[^}]*\}\}"),
    Rule("eval_usage", "SECURITY_RISK", "CRITICAL", r"\beval\s*\("),
    Rule("document_write", "SECURITY_RISK", "HIGH", r"document\.write\s*\("),
    Rule("direct_state_mutation", "ANTI_PATTERN", "HIGH", r"(\w+)\.push\s*\(|(\w+)\.pop\s*\(|(\w+)\[\d+\]\s*="),
    Rule("missing_cleanup", "MEMORY_LEAK", "HIGH", r"useEffect\s*\([^,]+,\s*\[\]\s*\)[^}]*setTimeout|setInterval"),
    Rule("event_listener_leak", "MEMORY_LEAK", "MEDIUM", r"addEventListener\s*\([^)]+\)(?![^}]*removeEventListener)", True),
    Rule("unused_import", "IMPORT_INCONSISTENCY", "LOW", r"import\s+\{([^}]+)\}\s+from"),
    Rule("relative_import_depth", "IMPORT_INCONSISTENCY", "MEDIUM", r"from\s+['\"](\.\./){3,}"),
    Rule("any_type_usage", "TYPE_SAFETY", "MEDIUM", r":\s*any\b"),
    Rule("non_null_assertion", "TYPE_SAFETY", "MEDIUM", r"\w+!\.|\w+!\["),
    Rule("missing_alt_text", "ACCESSIBILITY", "MEDIUM", r"<img(?![^>]*alt=)[^>]*>", True),
    Rule("missing_aria_label", "ACCESSIBILITY", "LOW", r"<button(?![^>]*aria-label=)(?![^>]*>.*?</button>)[^>]*/>", True),
]

#: Variants that also see what the patterns above miss in annotated code: declarations between, arrow bodies.
EXTRA_RULES = [
    Rule("hooks_conditional_any", "HOOK_VIOLATION", "CRITICAL", r"if\s*\([^)]*\)\s*\{[^}]*\buse[A-Z]\w*\("),
    Rule("missing_key_in_map", "PERFORMANCE_ISSUE", "HIGH", r"\.map\s*\([^=]*=>\s*\(?\s*<\w+(?![^>]*key=)", True),
]

_NEWLINES = r"\n"


def newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def occurrences(content: Column | str, pattern: str, flags: str = "(?ms)") -> Column:
    """Non-overlapping matches: array of (start, line, match), start from 0 and line from 1."""
    c = col(content)
    p = flags + pattern
    none = F.array().cast("array<struct<start:int,line:int,match:string>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        line = acc["line"] + newlines(x["before"])
        one = F.struct(start.alias("start"), line.alias("line"), x["match"].alias("match"))
        return F.struct((start + F.length(x["match"])).alias("at"), (line + newlines(x["match"])).alias("line"), F.concat(acc["out"], F.array(one)).alias("out"))

    def found(matches: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(c, p, -1), 1, F.size(matches)), matches, lambda b, m: F.struct(b.alias("before"), m.alias("match")))
        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    # The text is cut only where the pattern occurs.
    return F.when(c.rlike(p), found(F.regexp_extract_all(c, F.lit(p), F.lit(0)))).otherwise(none)


def scan(files: DataFrame, rules: list[Rule] | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """(path, rule, kind, severity, confidence, seq, line, snippet) of every match of every rule.

    Lines are looked up beside the content, before findings become rows, so no finding
    carries the file with it; files without a match make no row.
    """
    rules = RULES if rules is None else rules
    lines = F.col("_lines")

    def of(r: Rule) -> Column:
        return F.transform(occurrences(content, r.pattern), lambda o, i: F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), i.cast("long").alias("seq"), o["line"].cast("long").alias("line"), F.trim(F.element_at(lines, o["line"])).alias("snippet")))

    rows = files.select(key, content, F.split(content, _NEWLINES).alias("_lines"))
    return rows.select(key, F.inline(F.flatten(F.array(*map(of, rules)))))


def rule_counts(files: DataFrame, rules: list[Rule] | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """(path, rule, n) where n > 0, from counts alone: no positions are made."""
    rules = RULES if rules is None else rules
    n = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.regexp_count(content, F.lit("(?ms)" + r.pattern)).alias("n")) for r in rules])
    return files.select(key, F.explode(F.filter(n, lambda x: x["n"] > 0)).alias("x")).select(key, "x.rule", F.col("x.n").cast("long").alias("n"))


def _findings(rows: DataFrame, rule: str, kind: str, severity: str, confidence: float, message: Column, line: Column) -> DataFrame:
    return rows.select("path", F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), line.cast("long").alias("line"), message.alias("message"))


def _at(files: DataFrame, pattern: str, flags: str = "") -> DataFrame:
    return files.select("path", F.explode(occurrences("content", pattern, flags)).alias("o")).select("path", "o.*")


def _group(pattern: str, i: int) -> Column:
    return F.regexp_extract("match", pattern, i)


def this_in_functional_component(files: DataFrame) -> DataFrame:
    """Each ``this`` from the start of each arrow component to the end of the file."""
    pattern = r"(const|function)\s+([A-Z]\w*)\s*[=:].*?\([^)]*\)\s*=>"
    both = files.select("path", F.explode(occurrences("content", pattern, "")).alias("c"), occurrences("content", r"\bthis\b", "").alias("uses"))
    rows = both.select("path", F.regexp_extract("c.match", pattern, 2).alias("name"), F.explode(F.filter("uses", lambda u: u["start"] >= F.col("c.start"))).alias("u"))
    return _findings(rows, "this_in_functional_component", "ANTI_PATTERN", "HIGH", 0.9, F.concat(F.lit("this in "), "name"), F.col("u.line"))


def complex_state_mutation(files: DataFrame) -> DataFrame:
    """Assignments to members of what looks like component state in the same file, judged before they become rows of their own."""
    pattern = r"(\w+)\.([\w\[\]\.]+)\s*=\s*[^=]"  # fixed value, as are the forms of state below

    def is_state(v: Column) -> Column:
        forms = [F.concat(v, F.lit(r"\s*=\s*useState\(")), F.concat(F.lit(r"const\s+\["), v, F.lit(",")), F.concat(F.lit(r"this\.state\."), v), F.concat(v, F.lit(r"\s*=\s*this\.state"))]
        return reduce(lambda a, b: a | b, [F.regexp_like("content", f) for f in forms])

    found = F.transform(occurrences("content", pattern, ""), lambda o: F.struct(o["line"].alias("line"), F.regexp_extract(o["match"], pattern, 1).alias("v")))
    rows = files.select("path", "content", found.alias("found")).select("path", F.explode(F.filter("found", lambda o: is_state(o["v"]))).alias("o"))
    return _findings(rows, "complex_state_mutation", "ANTI_PATTERN", "HIGH", 0.7, F.concat(F.lit("mutates "), "o.v"), F.col("o.line"))


def missing_effect_dependencies(files: DataFrame) -> DataFrame:
    """Words of an effect's body that are not among its dependencies."""
    pattern = r"useEffect\s*\(\s*\(\s*\)\s*=>\s*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}\s*,\s*\[([^\]]*)\]\s*\)"
    words = lambda x: F.regexp_extract_all(x, F.lit(r"\b(\w+)\b"), F.lit(1))
    known = F.array(*[F.lit(x) for x in ("console", "document", "window")])
    missing = F.sort_array(F.array_except(F.array_except(F.array_distinct(words(_group(pattern, 1))), words(_group(pattern, 2))), known))
    rows = _at(files, pattern, "(?s)").withColumn("missing", missing).filter(F.size("missing") > 0)
    return _findings(rows, "missing_effect_dependencies", "HOOK_VIOLATION", "MEDIUM", 0.6, F.array_join("missing", ", "), F.col("line"))


def prop_drilling(files: DataFrame, least: int = 4) -> DataFrame:
    """Identifiers that are passed on as a property at least ``least`` times."""
    names = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(\w+)=\{(\w+)\}"), F.lit(2))).alias("name"))
    rows = names.groupBy("path", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return _findings(rows, "prop_drilling", "ANTI_PATTERN", "LOW", 0.5, F.concat("name", F.lit(" x "), "n"), F.lit(1))


def unused_variables(files: DataFrame) -> DataFrame:
    """Declared names that occur nowhere else in the file; names in _ are meant to be unused. A name that occurs once is declared once, so no rows meet."""
    pattern = r"(?:const|let|var)\s+(\w+)"  # fixed value
    found = F.transform(occurrences("content", pattern, ""), lambda o: F.struct(o["line"].alias("line"), F.regexp_extract(o["match"], pattern, 1).alias("name")))
    once = lambda o: ~o["name"].startswith("_") & (F.regexp_count("content", F.concat(F.lit(r"\b"), o["name"], F.lit(r"\b"))) == 1)
    rows = files.select("path", "content", found.alias("found")).select("path", F.explode(F.filter("found", once)).alias("o"))
    return _findings(rows, "unused_variable", "IMPORT_INCONSISTENCY", "LOW", 0.8, F.col("o.name"), F.col("o.line"))


def cyclic_dependencies(files: DataFrame, most: int = 5) -> DataFrame:
    """Files with more relative imports than ``most``."""
    modules = F.regexp_extract_all("content", F.lit(r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]"), F.lit(1))
    rows = files.withColumn("n", F.size(F.filter(modules, lambda m: m.startswith(".")))).filter(F.col("n") > most)
    return _findings(rows, "potential_cyclic_dependency", "IMPORT_INCONSISTENCY", "MEDIUM", 0.4, F.col("n").cast("string"), F.lit(1))


def missing_memo(files: DataFrame) -> DataFrame:
    pattern = r"const\s+([A-Z]\w*)\s*=.*?\(([^)]*)\)"
    rows = _at(files.filter(~F.col("content").contains("memo(")), pattern).filter(F.length(_group(pattern, 2)) > 50)
    return _findings(rows, "missing_memo", "PERFORMANCE_ISSUE", "LOW", 0.5, _group(pattern, 1), F.col("line"))


def empty_interfaces(files: DataFrame) -> DataFrame:
    pattern = r"interface\s+(\w+)\s*\{\s*\}"
    return _findings(_at(files, pattern), "empty_interface", "TYPE_SAFETY", "LOW", 0.9, _group(pattern, 1), F.col("line"))


def inline_styles(files: DataFrame) -> DataFrame:
    return _findings(_at(files, r"style=\{\{[^}]+\}\}"), "inline_styles", "PERFORMANCE_ISSUE", "LOW", 0.7, F.lit("inline style"), F.col("line"))


CONTEXT_RULES = (this_in_functional_component, complex_state_mutation, missing_effect_dependencies, prop_drilling, cyclic_dependencies, missing_memo, empty_interfaces, inline_styles)


def detect(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """All findings of the pattern and context rules, one table."""
    out = scan(files, rules).select("path", "rule", "kind", "severity", "confidence", "line", F.col("snippet").alias("message"))
    for f in CONTEXT_RULES:
        out = out.unionByName(f(files))
    return out
