"""Facts from source files: Python through its syntax tree, TSX by line patterns and a brace scanner."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.signatures import source_lines

PYTHON_FACTS = "path string, kind string, owner string, name string, line long, params array<string>, return_type string"


def annotation(node: ast.AST | None, default: str = "Any") -> str:
    return default if node is None else ast.unparse(node)


def parameters(args: ast.arguments) -> list[str]:
    """Parameters but self, as ``[kind] name:type=default``."""
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    text = lambda a, d, kind: f"[{kind}] " * (kind != "positional") + f"{a.arg}:{annotation(a.annotation)}" + (f"={ast.unparse(d)}" if d is not None else "")
    out = [text(a, d, "positional") for a, d in zip(plain, defaults) if a.arg != "self"]
    if args.vararg:
        out.append(f"[var_positional] *{args.vararg.arg}:{annotation(args.vararg.annotation)}")
    out += [text(a, d, "keyword_only") for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    if args.kwarg:
        out.append(f"[var_keyword] **{args.kwarg.arg}:{annotation(args.kwarg.annotation, 'Dict[str, Any]')}")
    return out


def python_facts(path: str, content: str) -> list[tuple]:
    """Classes, their public methods and annotated public attributes, functions outside class bodies, imports."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "error", None, type(e).__name__, int(getattr(e, "lineno", 0) or 0), None, None)]
    out, methods = [], set()
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            out.append((path, "class", None, node.name, node.lineno, [annotation(b) for b in node.bases], None))
            for item in node.body:
                if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    methods.add(item)
                    if not item.name.startswith("_"):
                        out.append((path, "method", node.name, item.name, item.lineno, parameters(item.args), annotation(item.returns)))
                elif isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name) and not item.target.id.startswith("_"):
                    out.append((path, "attribute", node.name, item.target.id, item.lineno, None, annotation(item.annotation)))
        elif isinstance(node, ast.Import):
            out += [(path, "import", None, a.name, node.lineno, None, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((path, "import", None, "." * node.level + (node.module or ""), node.lineno, [a.name for a in node.names], None))
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and node not in methods and not node.name.startswith("_"):
            out.append((path, "function", None, node.name, node.lineno, parameters(node.args), annotation(node.returns)))
    return out


def extract_python(files: DataFrame) -> DataFrame:
    """Facts of (path, content) Python files; a file that doesn't parse is one error fact."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("owner", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("params", pa.list_(pa.string())), ("return_type", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [f for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in python_facts(p, c or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, PYTHON_FACTS)


def module_name(path: Column) -> Column:
    """Importable name of a file: leading source folders and the suffix dropped."""
    bare = F.regexp_replace(path, r"(/__init__)?\.py$", "")
    return F.replace(F.regexp_replace(bare, "(?i)^((src|lib|source|python|pkg|packages)/)+", ""), F.lit("/"), F.lit("."))


def module_names(files: DataFrame) -> DataFrame:
    """(path, module_name): from the outermost folder on that is a package (holds __init__.py), else as module_name says."""
    parts = F.split("path", "/")
    package = files.filter(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("folder")).filter("folder <> ''").distinct()
    folders = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    outer = folders.join(package, "folder").groupBy("path").agg(F.min(F.size(F.split("folder", "/"))).alias("depth"))
    rows = files.select("path").join(outer, "path", "left")
    bare = F.regexp_replace("path", r"\.py$", "")
    inside = F.array_join(F.slice(F.split(bare, "/"), F.col("depth"), F.size(parts)), ".")
    return rows.select("path", F.when(F.col("depth").isNotNull(), F.regexp_replace(inside, r"\.__init__$", "")).otherwise(module_name(F.col("path"))).alias("module_name"))


def internal_imports(facts: DataFrame, project: Column) -> DataFrame:
    """Import facts that are likely to be of the project itself, without repeats."""
    from lodestone.operators.signatures import is_internal_module

    return facts.filter((F.col("kind") == "import") & is_internal_module(F.col("name"), project)).select("path", "name").distinct()


def typescript_to_javascript(source: Column) -> Column:
    """Without type annotations, interfaces, aliases, generics of calls and assertions: a chain of rewrites, for display."""
    steps = [
        (r"(?ms)^\s*(export\s+)?interface\s+\w+[^{]*\{[^}]*\}\s*", ""), (r"(?m)^\s*(export\s+)?type\s+\w+[^=\n]*=[^;\n]*;?\s*$", ""), (r"(?m)^import\s+type\s.*$", ""),
        (r"\s+as\s+(const|[A-Za-z_][\w.]*(<[^<>]*>)?(\[\])*)", ""), (r"(\w)<[A-Za-z_][\w\s,\[\]|.]*>(?=\()", "$1"),
        (r"(\w|\))\?:\s*", "$1: "), (r"([\w)\]}])\s*:\s*(string|number|boolean|any|void|unknown|never|null|undefined|object|[A-Z]\w*(<[^<>]*>)?)(\[\])*(\s*\|\s*\w+)*(?=\s*[,)=;{\n])", "$1"),
        (r"(\w)!(?=[.\[;,)])", "$1"),
    ]
    for pattern, to in steps:
        source = F.regexp_replace(source, pattern, to)
    return source


def extract_tsx(files: DataFrame) -> DataFrame:
    """(path, kind, name, line, detail): imports, components, hook calls and exports, line by line."""
    lines = source_lines(files)
    found = lambda pattern, i: F.regexp_extract_all("text", F.lit(pattern), F.lit(i))
    fact = lambda kind, names, detail: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), detail.alias("detail")))
    facts = F.flatten(F.array(
        fact("import", found(r"^import\s+(?:.+?\s+from\s+)?[\"']([^\"']+)[\"']", 1), F.regexp_extract("text", r"^import\s+(.+?)\s+from", 1)),
        fact("import", found(r"require\(\s*[\"']([^\"']+)[\"']\s*\)", 1), F.lit("")),
        fact("component", found(r"(?:^|\s)(?:function|const|class)\s+([A-Z]\w*)\b(?=\s*[=:(<]|\s+extends)", 1), F.when(F.col("text").rlike(r"\bclass\s"), "class").otherwise("function")),
        fact("hook", found(r"\b(use[A-Z]\w*)\s*(?:<[^>]*>)?\(", 1), F.regexp_extract("text", r"const\s+(\[[^\]]*\]|\w+)\s*=", 1)),
        fact("export", found(r"^export\s+(?:default\s+)?(?:const|function|class|interface|type|async\s+function)?\s*(\w+)", 1), F.when(F.col("text").contains("export default"), "default").otherwise("")),
    ))
    return lines.select("path", "line", F.explode(facts).alias("f")).select("path", "f.kind", "f.name", "line", "f.detail")


def call_objects(content: str, function: str = "rpc") -> list[tuple[int, str, dict[str, str | None]]]:
    """(line, procedure, arguments) of each ``.function('procedure', {...})``, braces balanced; variables are None."""
    out, mark = [], f".{function}("
    at = content.find(mark)
    while at >= 0:
        i = at + len(mark)
        while i < len(content) and content[i].isspace():
            i += 1
        quote = content[i : i + 1]
        end = content.find(quote, i + 1) if quote in ("'", '"', "`") else -1
        if end > 0:
            name, j = content[i + 1 : end], end + 1
            while j < len(content) and content[j] in " ,\n\t\r":
                j += 1
            args = _object(content, j) if content[j : j + 1] == "{" else {}
            out.append((content.count("\n", 0, at) + 1, name, args))
        at = content.find(mark, at + 1)
    return out


def _object(s: str, at: int) -> dict[str, str | None]:
    """Top-level entries of an object literal as JSON texts."""
    depth, i, key, start, out = 0, at, "", at + 1, {}
    quote = ""
    while i < len(s):
        c = s[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif s.startswith("//", i):
            i = (s.find("\n", i) + 1 or len(s)) - 1
        elif c in "{[(":
            depth += 1
        elif c in "}])" or (c == "," and depth == 1):
            if depth == 1:
                _entry(s[start:i], out)
                start = i + 1
            if c != ",":
                depth -= 1
                if depth == 0:
                    break
        i += 1
    return out


def _entry(text: str, out: dict[str, str | None]) -> None:
    import json
    import re

    text = re.sub(r"(?m)//.*$", "", text).strip()
    m = re.match(r"""['"]?(\w+)['"]?\s*(?::\s*(.*))?$""", text, re.S)
    if not m:
        return
    raw = (m[2] or "").strip()
    if re.fullmatch(r"-?\d+(\.\d+)?|true|false|null", raw):
        out[m[1]] = raw
    elif len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"`" and "${" not in raw:
        out[m[1]] = json.dumps(raw[1:-1])
    elif raw.startswith("{") or raw.startswith("["):
        out[m[1]] = "{}" if raw[0] == "{" else "[]"
    else:
        out[m[1]] = None


def extract_calls(files: DataFrame, function: str = "rpc") -> DataFrame:
    """(path, line, procedure, name, value) of the arguments of each call; one row with null name where there are none."""
    schema = pa.schema([("path", pa.string()), ("line", pa.int64()), ("procedure", pa.string()), ("name", pa.string()), ("value", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(p, line, proc, k, v) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for line, proc, args in call_objects(c or "", function) for k, v in (args.items() or [(None, None)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, line long, procedure string, name string, value string")


def table_uses(files: DataFrame) -> DataFrame:
    """(path, line, name): tables named in ``.from('name')``."""
    lines = source_lines(files)
    return lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\.from\(\s*['\"](\w+)['\"]"), F.lit(1))).alias("name"))


#: An interface or an alias of an object type, with what it extends and its body (no braces inside).
_DECLARED = r"(?s)(?:export\s+)?(?:interface\s+(\w+)[^{=]*?(?:extends\s+([\w\s,.<>]+?))?\s*\{([^{}]*)\}|type\s+(\w+)[^=;{}]*=\s*\{([^{}]*)\})"
_ALIAS = r"(?m)^\s*(?:export\s+)?type\s+(\w+)[^=;{}\n]*=\s*([^{};\n]+);?\s*$"
_PROPERTY = r"(?m)(?:^|[;,])\s*(?:readonly\s+)?(\w+)(\??)\s*:\s*([^;,\n]+)"


def declared_types(files: DataFrame) -> DataFrame:
    """(path, label, name, extends, definition, properties): a node for each interface and type alias of (path, content) files.

    properties: array of (name, type, optional) of object types, in order; of other
    aliases, ``definition`` is what they stand for.
    """
    every = lambda p, i, c="content": F.regexp_extract_all(c, F.lit(p), F.lit(i))
    props = F.zip_with(F.arrays_zip(every(_PROPERTY, 1, "body").alias("n"), every(_PROPERTY, 2, "body").alias("q")), every(_PROPERTY, 3, "body"), lambda a, t: F.struct(a["n"].alias("name"), F.trim(t).alias("type"), (a["q"] == "?").alias("optional")))
    shapes = F.arrays_zip(every(_DECLARED, 1).alias("interface"), every(_DECLARED, 2).alias("extends"), every(_DECLARED, 3).alias("inside"), every(_DECLARED, 4).alias("alias"), every(_DECLARED, 5).alias("members"))
    one = files.select("path", F.explode(shapes).alias("d")).select("path", F.when(F.col("d.interface") != "", "interface").otherwise("type").alias("label"), F.concat("d.interface", "d.alias").alias("name"), F.nullif(F.trim("d.extends"), F.lit("")).alias("extends"), F.concat("d.inside", "d.members").alias("body"))
    one = one.select("path", "label", "name", "extends", F.lit(None).cast("string").alias("definition"), props.alias("properties"))
    aliases = files.select("path", F.explode(F.arrays_zip(every(_ALIAS, 1).alias("name"), every(_ALIAS, 2).alias("is"))).alias("d"))
    two = aliases.select("path", F.lit("type").alias("label"), "d.name", F.lit(None).cast("string").alias("extends"), F.trim("d.is").alias("definition"), F.array().cast(one.schema["properties"].dataType).alias("properties"))
    return one.unionByName(two)


def type_edges(types: DataFrame) -> DataFrame:
    """(src, dst, kind): files define types, types have properties, interfaces extend others."""
    node = F.concat_ws("::", "path", "name")
    out = types.select(F.col("path").alias("src"), node.alias("dst"), F.when(F.col("label") == "interface", "DEFINES_INTERFACE").otherwise("DEFINES_TYPE").alias("kind"))
    out = out.unionByName(types.select(node.alias("src"), F.explode("properties.name").alias("p")).select("src", F.concat_ws("::", "src", "p").alias("dst"), F.lit("HAS_PROPERTY").alias("kind")))
    bases = types.filter("extends is not null").select(node.alias("src"), "path", F.explode(F.split("extends", r"\s*,\s*")).alias("base"))
    return out.unionByName(bases.select("src", F.concat_ws("::", "path", F.regexp_replace("base", "<.*$", "")).alias("dst"), F.lit("EXTENDS").alias("kind"))).distinct()
