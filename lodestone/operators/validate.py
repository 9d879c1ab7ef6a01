"""Compositions: all validation stages of a file set as one findings table, and code graphs from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import language_of
from lodestone.operators import extract, graph, ingest, report, rules, signatures, tsx
from lodestone.sources import files

#: Stages in the order in which their findings are listed.
STAGES = ("file", "components", "knowledge", "catalog", "calls", "signatures", "patterns", "practice")


def findings(files: DataFrame, rule_set: list[rules.Rule] | None = None, context: bool = True) -> DataFrame:
    """(path, stage, type, severity, confidence, line, message) of every stage over (path, content).

    The files are read once; each stage is a projection or a join on the path, and the
    stages are one union.
    """
    lines = signatures.source_lines(files)
    kind = lambda t: report.filed_as(F.lit(t), report.SIGNATURE_TYPES, "INVALID_TYPE")
    row = lambda df, stage, t, severity, confidence, line, message: df.select("path", F.lit(stage).alias("stage"), t.alias("type"), severity.alias("severity"), F.lit(confidence).alias("confidence"), line.cast("long").alias("line"), message.alias("message"))
    out = row(signatures.undefined_types(lines), "signatures", kind("TYPE_NOT_DEFINED"), F.lit("HIGH"), 0.8, F.lit(1), F.concat(F.lit("undefined type "), "name"))
    arity = signatures.arity_errors(lines)
    out = out.unionByName(row(arity, "signatures", F.lit("INCORRECT_SIGNATURE"), F.when(F.col("error") == "MISSING_ARGUMENTS", "HIGH").otherwise("MEDIUM"), 0.8, F.col("line"), F.concat("error", F.lit(" "), "name")))
    out = out.unionByName(row(signatures.unused_definitions(lines), "signatures", F.lit("BAD_PRACTICE"), F.lit("LOW"), 0.8, F.lit(1), F.concat("issue", F.lit(" "), "name")))
    found = rules.detect(files, rule_set) if context else rules.scan(files, rule_set).select("path", "rule", "kind", "severity", "confidence", "line", F.col("snippet").alias("message"))
    patterns = found.select("path", F.lit("patterns").alias("stage"), report.filed_as(F.col("kind"), report.PATTERN_TYPES, "BAD_PRACTICE").alias("type"), "severity", "confidence", "line", F.concat("rule", F.lit(": "), "message").alias("message"))
    return out.unionByName(patterns)


def _row(df: DataFrame, stage: str, kind: Column | str, severity: Column | str, confidence: Column | float, message: Column, line: Column | None = None) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("path", F.lit(stage).alias("stage"), text(kind).alias("type"), text(severity).alias("severity"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), (F.col("line") if line is None else line).cast("long").alias("line"), message.alias("message"))


def syntax_findings(facts: DataFrame, tables: DataFrame | None = None, functions: DataFrame | None = None) -> DataFrame:
    """Findings of what files say (tsx.syntax): files that can't be read, hooks and components, page functions, unlikely names, unknown tables and functions, practice."""
    of = lambda kind: facts.filter(F.col("kind") == kind)
    calls, hooks = of("call"), of("hook")
    out = _row(of("error"), "file", report.filed_as(F.col("name"), report.SIGNATURE_TYPES, "INVALID_TYPE"), "CRITICAL", 1.0, F.lit("the file can't be read"))
    wrong = signatures.hook_issues(hooks.select("path", "name", "line", F.size("args").cast("long").alias("n_args")))
    out = out.unionByName(_row(wrong, "components", F.col("issue"), F.col("severity"), F.col("confidence"), F.concat(F.lit("hook "), "name")))
    used = hooks.filter("owner is not null").groupBy("path", F.col("owner").alias("name")).agg(F.count("*").alias("n_hooks"))
    parts = of("component").select("path", "name", "line", F.col("detail").alias("type"), F.size("args").cast("long").alias("n_props"), F.col("owner").isNotNull().alias("exported")).join(used, ["path", "name"], "left").na.fill(0, ["n_hooks"])
    issues = signatures.component_issues(parts).join(parts.groupBy("path", "name").agg(F.min("line").alias("line")), ["path", "name"])
    early = F.col("issue").isin("lower_case_name", "hooks_in_class")
    for stage, rows in (("components", issues.filter(early)), ("practice", issues.filter(~early))):
        out = out.unionByName(_row(rows, stage, "BAD_PRACTICE", F.col("severity"), F.col("confidence"), F.concat("issue", F.lit(" "), "name")))
    pages = signatures.page_function_errors(calls, of("import"))
    out = out.unionByName(_row(pages, "components", "INCORRECT_SIGNATURE", "HIGH", 0.9, F.concat("name", F.lit(" takes "), "expected", F.lit(" arguments, not "), "n_args")))
    odd = signatures.unlikely_calls(calls)
    out = out.unionByName(_row(odd, "knowledge", report.filed_as(F.col("type"), report.KNOWLEDGE_TYPES, "INVALID_TYPE"), report.severity_of(F.col("severity")), 0.8, F.col("description")))
    first = F.element_at("args", 1)
    for known, name, kind, use in ((tables, "from", "TABLE_NOT_FOUND", calls.filter("owner is not null")), (functions, "rpc", "FUNCTION_NOT_FOUND", calls)):
        if known is not None:
            asked = use.filter((F.col("name") == name) & (F.size("args") > 0)).select("path", "line", first.alias("name")).filter("name <> '' and not startswith(name, '<')")
            gone = signatures.unknown_names(asked, known)
            out = out.unionByName(_row(gone, "catalog", kind, "HIGH", 0.85, F.concat("name", F.lit(" is unknown; known: "), "suggestion")))
    return out


def full_findings(files: DataFrame, rule_set: list[rules.Rule] | None = None, tables: DataFrame | None = None, functions: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Every stage over (path, content), numbered in the order of STAGES.

    calls: (path, line, name, error) of checked procedure calls (params.check_calls), if there are any.
    """
    out = syntax_findings(tsx.syntax(files), tables, functions).unionByName(findings(files.filter("content is not null"), rule_set))
    if calls is not None:
        kind = report.filed_as(F.col("error"), report.CALL_TYPES, "INCORRECT_SIGNATURE")
        out = out.unionByName(_row(calls, "calls", kind, F.when(F.col("error").isin("TYPE", "MISSING", "NOT_FOUND"), "HIGH").otherwise("MEDIUM"), 0.9, F.concat("error", F.lit(" "), "name")))
    number = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return out.withColumn("stage_no", number.cast("long"))


def full_report(files: DataFrame, found: DataFrame, imports: DataFrame) -> DataFrame:
    """One row a file: language, counts by severity, confidence, density, frameworks, buckets and recommendations as texts.

    imports: (path, module).
    """
    out = summary(files.select("path", F.coalesce("content", F.lit("")).alias("content")), found)
    joined = lambda rows, value, name: rows.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(value)), "; ").alias(name))  # noqa: E731  a few of a file
    kinds = joined(report.type_buckets(found), F.concat_ws(" ", "bucket", "n"), "buckets")
    items = joined(report.action_items(found), F.concat_ws(" ", "urgency", "n"), "actions")
    named = report.frameworks(imports)
    frames = joined(named, F.col("framework"), "frameworks")
    info = files.select("path", language_of("path").alias("language")).join(named.groupBy("path").agg(F.collect_set("framework").alias("f")), "path", "left")
    says = joined(report.recommendations(found, info.select("path", "language", F.coalesce("f", F.array().cast("array<string>")).alias("frameworks"))), F.col("recommendation"), "recommendations")
    out = out.withColumn("language", language_of("path"))
    for rows in (frames, kinds, items, says):
        out = out.join(rows, "path", "left")
    return out.na.fill("", ["frameworks", "buckets", "actions", "recommendations"])


def analyzer_of(path: Column) -> Column:
    """Which check a file goes to, by its language."""
    return F.when(path.endswith(".py"), "knowledge_graph").when(language_of(path).isin("typescript", "javascript"), "pattern_validation")


def tsx_graph(files: DataFrame, repo: str) -> graph.CodeGraph:
    """The code graph of (path, content) TypeScript files: components with their hooks, functions as they are called, internal imports."""
    spark = files.sparkSession
    facts = tsx.syntax(files)
    of = lambda kind: facts.filter(F.col("kind") == kind)
    file = files.select("path", F.lit(repo).alias("repo"), F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", r"\.[jt]sx?$", "").alias("module_name"), F.size(F.split("content", r"\n")).alias("line_count"))
    component = ingest.first_wins(of("component").select("path", "name", F.col("detail").alias("type"), F.col("owner").isNotNull().alias("is_exported"), "args", "line"), ["path", "name"], F.col("line"))
    hook = of("hook").select("path", "name", "line", "owner", F.array_join("args", ", ").alias("args"))
    function = ingest.first_wins(of("call").select("path", "name", F.col("args").alias("params"), F.lit("any").alias("return_type"), "line"), ["path", "name"], F.col("line"))
    none = spark.createDataFrame([], "full_name string, path string, name string, class_full_name string, params array<string>, return_type string, type string")
    return graph.CodeGraph(repository=spark.createDataFrame([(repo,)], "name string"), file=file, component=component, hook=hook, function=function, **{"class": none.select("full_name", "path", "name")}, method=none.select("class_full_name", "name", "params", "return_type"), attribute=none.select("class_full_name", "name", "type"))


def analyze_repository(spark: SparkSession, root: str, repo: str) -> graph.CodeGraph:
    """The code graph of a source tree: its Python and its TypeScript files, each read once by its own reader."""
    one, two = python_graph(files.python_files(spark, root), repo), tsx_graph(files.typescript_files(spark, root), repo)
    both = {k: one.t[k].unionByName(two.t[k], allowMissingColumns=True) for k in one.t if k not in ("repository", "hook", "component")}
    return graph.CodeGraph(repository=one.t["repository"], hook=two.t["hook"], component=two.t["component"], **both)


def store_repository(known: graph.CodeGraph, repo: str, target: str) -> None:
    """Clear a repository in the tables under ``target``, then store it anew; other repositories are not touched.

    Each node table is cut by repository, so clearing is removing a folder and storing is
    adding one. Tables of a run that stops between the two lack the repository until it is
    repeated, which gives the same tables.
    """
    spark = known.t["repository"].sparkSession
    # Paths begin with the repository, so that those of two repositories differ.
    own = lambda df: df.withColumn("path", F.concat(F.lit(f"{repo}/"), "path")) if "path" in df.columns else df
    made = {label: own(df.drop("repo")).withColumn("repo", F.lit(repo)) for label, df in known.t.items()}
    for label, df in made.items():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{label}")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        old = spark._jvm.org.apache.hadoop.fs.Path(folder, "repo=" + spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo))
        store.delete(old, True)
        df.write.mode("append").partitionBy("repo").parquet(f"{target}/{label}")


def stored_graph(like: graph.CodeGraph, target: str) -> graph.CodeGraph:
    """The graph of all repositories stored under ``target``; like: any graph of the same kinds of tables."""
    spark = like.t["repository"].sparkSession
    tables = {}
    for label, df in like.t.items():
        schema = T.StructType([*(f for f in df.schema.fields if f.name != "repo"), T.StructField("repo", T.StringType())])
        rows = spark.read.schema(schema).parquet(f"{target}/{label}")
        tables[label] = rows if label == "file" else rows.drop("repo")
    return graph.CodeGraph(**tables)


def refresh_repository(spark: SparkSession, root: str, repo: str, target: str) -> DataFrame:
    """Clear, collect and store a source tree as one call; returns the statistics of what is stored of it."""
    known = analyze_repository(spark, root, repo)
    store_repository(known, repo, target)
    return repository_stats(stored_graph(known, target), repo)


def component_edges(facts: DataFrame) -> DataFrame:
    """(src, dst, kind) below files: what each defines, the props of a component and the hooks it uses."""
    node = F.concat_ws("::", "path", "name")
    of = lambda kind: facts.filter(F.col("kind") == kind)
    out = of("component").select(F.col("path").alias("src"), node.alias("dst"), F.lit("DEFINES").alias("kind"))
    out = out.unionByName(of("component").filter(F.size("args") > 0).select(node.alias("src"), F.concat(node, F.lit("::props")).alias("dst"), F.lit("HAS_PROPS").alias("kind")))
    uses = of("hook").filter("owner is not null")
    owner = F.concat_ws("::", "path", "owner")
    out = out.unionByName(uses.select(owner.alias("src"), F.concat_ws("::", owner, F.lit("hook"), "name").alias("dst"), F.lit("USES_HOOK").alias("kind")))
    return out.distinct()


def repository_stats(known: graph.CodeGraph, repo: str) -> DataFrame:
    """One row of a repository: its files, classes, methods, functions, components and hooks, and its first five module names."""
    files = known.t["file"].filter(F.col("repo") == repo)
    count = lambda label, name: known._of_repo(label, repo).agg(F.count("*").alias(name))
    few = files.select("module_name").distinct().orderBy("module_name").limit(5).agg(F.array_join(F.sort_array(F.collect_list("module_name")), ",").alias("first_modules"))
    out = known.t["repository"].filter(F.col("name") == repo).select("name").crossJoin(F.broadcast(files.agg(F.count("*").alias("files"))))
    for label, name in (("class", "classes"), ("function", "functions"), ("component", "components"), ("hook", "hooks")):
        out = out.crossJoin(F.broadcast(count(label, name)))  # one row each
    return out.crossJoin(F.broadcast(few))


def summary(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, total, critical, high, medium, low, confidence, density): one row a file, also those without findings."""
    n = files.select("path", F.size(F.split("content", r"\n")).alias("lines"))
    stats = report.statistics(found, "path")
    out = n.join(stats, "path", "left").join(report.confidence(found, files), "path")
    return out.na.fill(0, ["total", "critical", "high", "medium", "low"]).select("path", "total", "critical", "high", "medium", "low", "confidence", report.density(F.col("total"), F.col("lines")).alias("density"))


def python_graph(files: DataFrame, repo: str) -> graph.CodeGraph:
    """The code graph of (path, content) Python files; keys carry the repository, so repositories don't collide."""
    spark = files.sparkSession
    facts = extract.extract_python(files)
    module = F.col("module_name")
    named = extract.module_names(files)
    facts = facts.join(named, "path")
    file = files.join(named, "path").select("path", F.lit(repo).alias("repo"), F.element_at(F.split("path", "/"), -1).alias("name"), module, F.size(F.split("content", r"\n")).alias("line_count"))
    key = F.concat_ws(".", F.lit(repo), module)
    of = lambda kind: facts.filter(F.col("kind") == kind)
    cls = ingest.first_wins(of("class").select(F.concat_ws(".", key, "name").alias("full_name"), "path", "name", "line"), ["full_name"], F.col("line"))
    method = ingest.first_wins(of("method").select(F.concat_ws(".", key, "owner").alias("class_full_name"), "name", "params", "return_type", "line"), ["class_full_name", "name"], F.col("line"))
    attribute = of("attribute").select(F.concat_ws(".", key, "owner").alias("class_full_name"), "name", F.col("return_type").alias("type"))
    function = ingest.first_wins(of("function").select("path", "name", "params", "return_type", "line"), ["path", "name"], F.col("line"))
    none = spark.createDataFrame([], "path string, name string, type string, is_exported boolean")
    return graph.CodeGraph(repository=spark.createDataFrame([(repo,)], "name string"), file=file, method=method, attribute=attribute, function=function, component=none, hook=none.select("path", "name", F.lit("").alias("args")), **{"class": cls})


def check_python(files: DataFrame, known: graph.CodeGraph) -> DataFrame:
    """(path, line, name, status): imports of files against a graph: VALID in it, UNCERTAIN if external, NOT_FOUND else."""
    imports = extract.extract_python(files).filter("kind = 'import'").select("path", "line", "name")
    modules = known.t["file"].select(F.col("module_name").alias("name"), F.lit(True).alias("in_graph")).distinct()
    rows = imports.join(modules, "name", "left")
    repo = known.t["file"].select(F.substring_index("module_name", ".", 1).alias("top")).distinct()
    rows = rows.join(repo, F.substring_index("name", ".", 1) == F.col("top"), "left")
    status = F.when(F.col("in_graph"), "VALID").when(F.col("name").startswith("."), "VALID").when(F.col("top").isNotNull(), "NOT_FOUND").otherwise("UNCERTAIN")
    return rows.select("path", "line", "name", status.alias("status")).distinct()
