"""Rollups of findings: statistics, confidence, recommendations, top findings, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities with their weights, and how findings are filed.
WEIGHTS = [("CRITICAL", 1.0), ("HIGH", 0.8), ("MEDIUM", 0.6), ("LOW", 0.4), ("INFO", 0.2)]
PATTERN_TYPES = {
    "IMPORT_INCONSISTENCY": "IMPORT_NOT_FOUND", "HOOK_VIOLATION": "HOOK_NOT_FOUND", "PERFORMANCE_ISSUE": "BAD_PRACTICE", "SECURITY_RISK": "BAD_PRACTICE",
    "ANTI_PATTERN": "BAD_PRACTICE", "MEMORY_LEAK": "BAD_PRACTICE", "TYPE_SAFETY": "INVALID_TYPE", "ACCESSIBILITY": "BAD_PRACTICE",
}
SIGNATURE_TYPES = {
    "TYPE_NOT_DEFINED": "INVALID_TYPE", "MISSING_ARGUMENTS": "INCORRECT_SIGNATURE", "TOO_MANY_ARGUMENTS": "INCORRECT_SIGNATURE",
    "UNUSED_TYPE": "BAD_PRACTICE", "UNUSED_FUNCTION": "BAD_PRACTICE", "PARSE_ERROR": "INVALID_TYPE", "FILE_ERROR": "INVALID_TYPE",
}

KNOWLEDGE_TYPES = {"INVALID_IMPORT": "IMPORT_NOT_FOUND", "INVALID_METHOD_CALL": "METHOD_NOT_FOUND", "INVALID_FUNCTION_CALL": "HOOK_NOT_FOUND", "INVALID_ATTRIBUTE_ACCESS": "ATTRIBUTE_NOT_FOUND"}
CALL_TYPES = {
    "TYPE": "RPC_PARAMETER_TYPE_MISMATCH", "MISSING": "RPC_MISSING_REQUIRED_PARAM", "ENUM": "RPC_INVALID_ENUM_VALUE",
    "JSON": "RPC_INVALID_JSON_STRUCTURE", "COUNT": "RPC_PARAMETER_COUNT_MISMATCH", "NOT_FOUND": "FUNCTION_NOT_FOUND",
}
SEVERITIES = {name: name for name, _ in WEIGHTS}


def weight(severity: Column) -> Column:
    out = F.lit(0.6)
    for name, w in WEIGHTS:
        out = F.when(F.upper(severity) == name, w).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _ in reversed(WEIGHTS)]), F.upper(severity)), F.lit(0))


def filed_as(kind: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for name, to in table.items():
        out = F.when(kind == name, to).otherwise(out)
    return out


def statistics(findings: DataFrame, *by: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy(*by).agg(F.count("*").alias("total"), count("CRITICAL").alias("critical"), count("HIGH").alias("high"), count("MEDIUM").alias("medium"), count("LOW").alias("low"))


def confidence(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(path, confidence): 1 less the weighted confidences over twice their count; 1 without findings."""
    sums = findings.groupBy("path").agg(F.sum(weight(F.col("severity")) * F.col("confidence")).alias("s"), F.count("*").alias("n"))
    return files.select("path").distinct().join(sums, "path", "left").select("path", F.when(F.col("n").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("s") / (2 * F.col("n")))).alias("confidence"))


def mean_confidence(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))


def density(findings: Column, lines: Column) -> Column:
    return findings / F.greatest(lines, F.lit(1))


def top(findings: DataFrame, k: int = 10, seq: str = "seq") -> DataFrame:
    """The k first by severity, then confidence, in their own order where these are equal."""
    return findings.orderBy(F.desc(rank(F.col("severity"))), F.desc("confidence"), F.asc(seq)).limit(k)


def recommendations(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(path, recommendation): findings (path, type) and files (path, language, frameworks array)."""
    n = lambda t: F.count_if(F.col("type") == t)
    counts = findings.groupBy("path").agg(n("COMPONENT_NOT_FOUND").alias("components"), n("TABLE_NOT_FOUND").alias("tables"), n("INCORRECT_SIGNATURE").alias("signatures"), n("BAD_PRACTICE").alias("practices"))
    rows = files.join(counts, "path", "left").na.fill(0, ["components", "tables", "signatures", "practices"])
    says = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    react = F.coalesce(F.array_contains("frameworks", "react"), F.lit(False))
    found = F.array_compact(F.array(
        says("components", " unknown components: check their imports"),
        says("tables", " unknown tables: check their names against the schema"),
        says("signatures", " calls with wrong arguments: check the signatures"),
        says("practices", " findings on practice: follow the framework's guides"),
        F.when(react, "check hooks with the framework's lint rules"),
        F.when(F.col("language") == "typescript", "turn strict mode on").otherwise("typed source would allow better checks"),
    ))
    return rows.select("path", F.explode(found).alias("recommendation"))


def buckets(findings: DataFrame) -> DataFrame:
    """(path, bucket, n) by the kind of finding."""
    bucket = filed_as(F.col("kind"), {"PERFORMANCE_ISSUE": "performance", "SECURITY_RISK": "security", "ACCESSIBILITY": "accessibility", "TYPE_SAFETY": "types", "HOOK_VIOLATION": "hooks"}, "other")
    return findings.groupBy("path", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def frameworks(imports: DataFrame) -> DataFrame:
    """(path, framework): the first of react, next, vue in each imported module's name."""
    m = F.lower("module")
    return imports.select("path", F.when(m.contains("react"), "react").when(m.contains("next"), "next").when(m.contains("vue"), "vue").alias("framework")).filter("framework is not null").distinct()


def verdict_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Shares of the statuses of validations (status)."""
    share = lambda s: F.round(F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)), 6)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share("VALID").alias("valid"), share("INVALID").alias("invalid"), share("UNCERTAIN").alias("uncertain"))


def severity_of(name: Column) -> Column:
    """A severity in any case; MEDIUM where it is none."""
    return filed_as(F.upper(name), SEVERITIES, "MEDIUM")


def type_buckets(findings: DataFrame) -> DataFrame:
    """(path, bucket, n) of unified findings (path, type, message); a finding may be in several buckets."""
    text, kind = F.lower("message"), F.col("type")
    has = lambda *words: text.rlike("|".join(words))
    cases = [
        ("component_issues", kind == "COMPONENT_NOT_FOUND"), ("hook_issues", kind == "HOOK_NOT_FOUND"), ("catalog_issues", kind.isin("TABLE_NOT_FOUND", "FUNCTION_NOT_FOUND")),
        ("signature_issues", kind == "INCORRECT_SIGNATURE"), ("type_issues", kind == "INVALID_TYPE"), ("performance_issues", (kind == "BAD_PRACTICE") & has("performance")),
        ("security_issues", has("security", "xss")), ("accessibility_issues", has("accessibility", "alt", "aria")),
    ]
    names = F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in cases]))
    return findings.select("path", F.explode(names).alias("bucket")).groupBy("path", "bucket").agg(F.count("*").alias("n"))


def action_items(findings: DataFrame) -> DataFrame:
    """(path, urgency, n): immediate for CRITICAL and HIGH, soon for MEDIUM, eventually for the rest."""
    when = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "immediate").when(F.col("severity") == "MEDIUM", "soon").otherwise("eventually")
    return findings.groupBy("path", when.alias("urgency")).agg(F.count("*").alias("n"))


def response(rows: DataFrame, key: str, total: str, limit: int | None = None) -> DataFrame:
    """(key, response): a JSON text of success, the row's other columns, and how many results there are and whether that is the limit."""
    meta = F.struct(F.col(total).alias("total_results"), (F.col(total) >= limit if limit else F.lit(False)).alias("limited"))
    body = F.struct(F.lit(True).alias("success"), *rows.columns, meta.alias("metadata"))
    return rows.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def failure(key: Column, message: Column) -> Column:
    """The JSON text of a request that can't be answered."""
    return F.to_json(F.struct(F.lit(False).alias("success"), key.alias("path"), message.alias("error")))


def path_error(path: Column, suffixes: tuple[str, ...]) -> Column:
    """What is wrong with the path of a file to check, or null."""
    known = F.exists(F.array(*map(F.lit, suffixes)), lambda x: path.endswith(x))
    return F.when(path.isNull() | (F.trim(path) == ""), "a path is needed").when(~known, F.concat(F.lit("only these files are checked: "), F.lit(", ".join(suffixes))))


def with_sequence(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy(*order)).cast("long"))
