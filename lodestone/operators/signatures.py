"""Facts of source lines, and checks of types, calls and names against what is defined or known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import char_similarity
from lodestone.operators.ingest import first_wins

# Names that a language or library defines.
BUILTIN_TYPES = """string number boolean bigint symbol undefined null void any unknown never object Object Array Promise
Date RegExp Error Map Set WeakMap WeakSet Function CallableFunction NewableFunction ReactNode ReactElement ReactChild
ReactChildren ReactFragment ReactPortal JSX.Element JSX.IntrinsicElements ComponentType FunctionComponent FC Component
PureComponent RefObject MutableRefObject HTMLElement HTMLDivElement HTMLInputElement HTMLButtonElement Event MouseEvent
KeyboardEvent Partial Required Readonly Record Pick Omit Exclude Extract NonNullable""".split()
#: Hook, required and most arguments.
HOOK_SIGNATURES = [("useState", 0, 1), ("useEffect", 1, 2), ("useContext", 1, 1), ("useCallback", 2, 2), ("useMemo", 2, 2), ("useRef", 0, 1)]
REACT_HOOKS = "useState useEffect useContext useReducer useCallback useMemo useRef useImperativeHandle useLayoutEffect useDebugValue useDeferredValue useTransition useId useSyncExternalStore".split()
LIBRARIES = [("react", 0.95), ("react-dom", 0.95), ("react-router", 0.90), ("react-router-dom", 0.90), ("axios", 0.95), ("lodash", 0.90), ("@types/react", 0.95), ("@types/node", 0.95), ("typescript", 0.95)]
ARRAY_METHODS = "map filter reduce forEach find some every push pop shift unshift slice splice sort".split()
OBJECT_METHODS = "keys values entries assign freeze seal".split()
CONSOLE_METHODS = "log error warn info".split()
PROMISE_METHODS = "then catch finally resolve reject all race".split()
LIFECYCLE_METHODS = "componentDidMount componentDidUpdate componentWillUnmount shouldComponentUpdate getSnapshotBeforeUpdate componentDidCatch getDerivedStateFromError".split()
REACT_FUNCTIONS = "createElement cloneElement createContext lazy Suspense memo".split()
TIMERS = "setTimeout clearTimeout setInterval clearInterval".split()
BUILTIN_CLASSES = "Date Array Object Promise Map Set Error".split()
DOM_CLASSES = "Element HTMLElement Document XMLHttpRequest".split()
GLOBAL_PROPERTIES = {
    "window": "location document localStorage sessionStorage".split(),
    "document": "body head title cookie".split(),
    "console": "log error warn info".split(),
    "localStorage": "getItem setItem removeItem clear".split(),
    "sessionStorage": "getItem setItem removeItem clear".split(),
}
#: Props that any component may take.
COMMON_PROPS = "children className style key ref dangerouslySetInnerHTML".split()
#: Functions of a page framework and how many arguments they take.
PAGE_FUNCTIONS = [("getServerSideProps", 1), ("getStaticProps", 1), ("getStaticPaths", 0), ("getInitialProps", 1)]
EXTERNAL_MODULES = """react react-dom react-router react-router-dom react-query react-hook-form react-table react-select
react-spring framer-motion next gatsby remix @remix-run nuxt vite create-react-app redux @reduxjs/toolkit mobx zustand
jotai recoil context antd @ant-design material-ui @mui chakra-ui react-bootstrap semantic-ui-react styled-components
@emotion tailwindcss lodash ramda date-fns moment dayjs uuid classnames clsx axios fetch swr apollo-client @apollo/client
graphql socket.io-client ws typescript @types webpack rollup parcel babel @babel prettier eslint @typescript-eslint jest
@testing-library fs path os crypto buffer stream events util url querystring http https net cluster child_process express
fastify koa helmet cors morgan winston bcrypt jsonwebtoken passport nodemailer multer sharp dotenv config yup joi zod
class-validator""".split()

# The line patterns.
INTERFACE = r"^interface\s+(\w+)(<[^>]*>)?\s*(\{.*?\}|\{)"
TYPE_ALIAS = r"^type\s+(\w+)(<[^>]*>)?\s*=\s*(.+)"
FUNCTION = r"^(export\s+)?(async\s+)?function\s+(\w+)(<[^>]*>)?\s*\(([^)]*)\)\s*:\s*([^{]+)"
COMPONENT = r"^(export\s+)?(const|function)\s+([A-Z]\w*)(<[^>]*>)?\s*[=:].*?\(([^)]*)\)"
IMPORT = r"^import\s+(.+?)\s+from\s+[\"']([^\"']+)[\"']"
CALL = r"(\w+)\s*\(([^)]*)\)"
TYPE_USE = r":\s*([A-Z]\w*(?:<[^>]*>)?)"


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of the stripped lines that are neither blank nor comments."""
    rows = files.select("path", F.posexplode(F.split("content", r"\n")).alias("i", "raw"))
    rows = rows.select("path", (F.col("i") + 1).cast("long").alias("line"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("text"))
    return rows.filter((F.col("text") != "") & ~F.col("text").startswith("//"))


def split_list(x: Column) -> Column:
    """Comma-separated parts, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")


def type_kind(x: Column) -> Column:
    """primitive, union, array, generic or interface, of a type's text."""
    t = F.trim(x)
    return F.when(t.isin(*BUILTIN_TYPES), "primitive").when(t.contains("|"), "union").when(t.endswith("[]"), "array").when(t.contains("<") & t.contains(">"), "generic").otherwise("interface")


def base_type(x: Column) -> Column:
    """A type's text without generic arguments or, where it has none, without array marks."""
    return F.when(x.contains("<"), F.substring_index(x, "<", 1)).when(x.endswith("[]"), F.substring(x, 1, 1 << 30).substr(F.lit(1), F.length(x) - 2)).otherwise(x)


def generics(x: Column) -> Column:
    """Names between angle brackets."""
    return split_list(F.regexp_replace(x, "^<+|>+$", ""))


def parameter_list(x: Column) -> Column:
    """array of (name, type, default, optional, rest) of a parameter list; commas inside types part them too."""

    def one(p: Column) -> Column:
        rest = p.startswith("...")
        bare = F.when(rest, F.substring(p, 4, 1 << 30)).otherwise(p)
        typed = bare.contains(":")
        name = F.trim(F.when(typed, F.regexp_extract(bare, r"(?s)^([^:]*):", 1)).otherwise(bare))
        after = F.when(typed, F.regexp_extract(bare, r"(?s)^[^:]*:(.*)$", 1))
        set_ = after.contains("=")
        return F.struct(
            F.regexp_replace(name, r"\?+$", "").alias("name"), F.trim(F.regexp_extract(after, r"(?s)^([^=]*)", 1)).alias("type"), F.when(set_, F.trim(F.regexp_extract(after, r"(?s)=(.*)$", 1))).alias("default"),
            (name.endswith("?") | F.coalesce(set_, F.lit(False))).alias("optional"), rest.alias("rest"),
        )

    return F.transform(split_list(x), one)


def signature_text(name: Column, params: Column, returns: Column) -> Column:
    """``name(a: T, b?: U): R`` from a parameter_list."""
    part = lambda p: F.concat(F.when(p["rest"], "...").otherwise(""), p["name"], F.when(p["optional"], "?").otherwise(""), F.lit(": "), F.coalesce(p["type"], F.lit("any")))
    return F.concat(name, F.lit("("), F.array_join(F.transform(params, part), ", "), F.lit("): "), F.coalesce(F.nullif(F.trim(returns), F.lit("")), F.lit("void")))


def function_signatures(lines: DataFrame) -> DataFrame:
    """(path, line, name, signature) of the functions that are declared on one line."""
    rows = lines.filter(F.col("text").rlike(FUNCTION))
    part = lambda i: F.regexp_extract("text", FUNCTION, i)
    return rows.select("path", "line", part(3).alias("name"), signature_text(part(3), parameter_list(part(5)), part(6)).alias("signature"))


def page_function_errors(calls: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, line, name, n_args, expected): calls (path, line, name, args) of page functions with another number of arguments.

    Only in files that import the framework (modules: path, name).
    """
    uses = modules.filter(F.lower("name").contains("next") & ~F.lower("name").contains("react")).select("path").distinct()
    known = F.create_map(*[F.lit(x) for pair in PAGE_FUNCTIONS for x in pair])
    rows = calls.filter(F.col("name").isin(*[n for n, _ in PAGE_FUNCTIONS])).join(uses, "path", "left_semi")
    rows = rows.withColumns({"n_args": F.size("args").cast("long"), "expected": F.element_at(known, F.col("name")).cast("long")})
    return rows.filter("n_args <> expected").select("path", "line", "name", "n_args", "expected")


def unlikely_calls(calls: DataFrame) -> DataFrame:
    """(path, line, type, description, severity) of calls (path, line, owner, name) and imports that the ladders call invalid."""
    found = calls.withColumn("v", method_verdict(F.col("owner"), F.col("name"))).filter((F.col("v.status") == "INVALID") & F.col("owner").isNotNull())
    text = F.concat(F.lit("method "), "name", F.lit(" may not exist on "), "owner")
    return found.select("path", "line", F.lit("INVALID_METHOD_CALL").alias("type"), text.alias("description"), F.lit("high").alias("severity"))


def definitions(lines: DataFrame) -> DataFrame:
    """(path, kind, name, line, n_required, n_most): interfaces, types, functions, components; the last of a name stands."""
    one = lambda kind, pattern, name, params: lines.filter(F.col("text").rlike(pattern)).select("path", F.lit(kind).alias("kind"), F.regexp_extract("text", pattern, name).alias("name"), "line", split_list(F.regexp_extract("text", pattern, params) if params else F.lit("")).alias("params"))
    rows = one("interface", INTERFACE, 1, 0).unionByName(one("type", TYPE_ALIAS, 1, 0)).unionByName(one("function", FUNCTION, 3, 5)).unionByName(one("component", COMPONENT, 3, 5))
    last = first_wins(rows, ["path", "kind", "name"], F.desc("line"))
    optional = lambda p: p.contains("?") | p.contains("=") | p.startswith("...")
    rest = F.exists("params", lambda p: p.startswith("..."))
    required = F.size(F.filter("params", lambda p: ~optional(p))).cast("long")
    return last.select("path", "kind", "name", "line", required.alias("n_required"), F.when(rest, F.lit(1 << 31)).otherwise(F.size("params")).cast("long").alias("n_most"))


def calls(lines: DataFrame) -> DataFrame:
    """(path, line, name, n_args); declarations match as well."""
    names = F.regexp_extract_all("text", F.lit(CALL), F.lit(1))
    args = F.regexp_extract_all("text", F.lit(CALL), F.lit(2))
    rows = lines.select("path", "line", F.explode(F.arrays_zip(names.alias("name"), args.alias("args"))).alias("c"))
    return rows.select("path", "line", F.col("c.name").alias("name"), F.size(split_list(F.col("c.args"))).cast("long").alias("n_args"))


def type_uses(lines: DataFrame) -> DataFrame:
    """(path, line, name) with generic arguments cut off."""
    rows = lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(TYPE_USE), F.lit(1))).alias("t"))
    return rows.select("path", "line", F.substring_index("t", "<", 1).alias("name"))


def undefined_types(lines: DataFrame) -> DataFrame:
    """(path, name): used types that the file does not define and no language does."""
    known = definitions(lines).filter(F.col("kind").isin("interface", "type")).select("path", "name")
    return type_uses(lines).select("path", "name").distinct().filter(~F.col("name").isin(*BUILTIN_TYPES)).join(known, ["path", "name"], "left_anti")


def arity_errors(lines: DataFrame) -> DataFrame:
    """(path, line, name, error, n_args): calls of hooks and of the file's functions with too few or many arguments."""
    spark = lines.sparkSession
    hooks = spark.createDataFrame(HOOK_SIGNATURES, "name string, h_required long, h_most long")
    own = definitions(lines).filter("kind = 'function'").select("path", "name", "n_required", "n_most")
    rows = calls(lines).join(F.broadcast(hooks), "name", "left").join(own, ["path", "name"], "left")
    rows = rows.withColumns({"least": F.coalesce("h_required", "n_required"), "most": F.coalesce("h_most", "n_most")})
    error = F.when(F.col("n_args") < F.col("least"), "MISSING_ARGUMENTS").when(F.col("n_args") > F.col("most"), "TOO_MANY_ARGUMENTS")
    return rows.withColumn("error", error).filter("error is not null").select("path", "line", "name", "error", "n_args")


def unused_definitions(lines: DataFrame) -> DataFrame:
    """(path, name, issue): types never used and functions never called."""
    d = definitions(lines)
    types = d.filter(F.col("kind").isin("interface", "type")).join(type_uses(lines).select("path", "name").distinct(), ["path", "name"], "left_anti")
    functions = d.filter("kind = 'function'").join(calls(lines).select("path", "name").distinct(), ["path", "name"], "left_anti")
    return types.select("path", "name", F.lit("UNUSED_TYPE").alias("issue")).unionByName(functions.select("path", "name", F.lit("UNUSED_FUNCTION").alias("issue")))


def _verdict(*cases: tuple[Column, str, float], default: tuple[str, float]) -> Column:
    out = F
    for i, (when, status, confidence) in enumerate(cases):
        out = (F if i == 0 else out).when(when, F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence")))
    return out.otherwise(F.struct(F.lit(default[0]).alias("status"), F.lit(default[1]).alias("confidence")))


def import_verdict(module: Column) -> Column:
    known = [(module == name, "VALID", confidence) for name, confidence in LIBRARIES]
    return _verdict(*known, (module.startswith("."), "UNCERTAIN", 0.7), (module.startswith("@"), "UNCERTAIN", 0.6), default=("UNCERTAIN", 0.4))


def method_verdict(obj: Column, method: Column) -> Column:
    typo = F.greatest(*[char_similarity(method, F.lit(h)) for h in REACT_HOOKS]) > 0.8
    none = F.coalesce(obj, F.lit(""))
    return _verdict(
        (method.isin(*REACT_HOOKS), "VALID", 0.95),
        (method.isin(*ARRAY_METHODS), "VALID", 0.90),
        ((none == "Object") & method.isin(*OBJECT_METHODS), "VALID", 0.95),
        ((none == "console") & method.isin(*CONSOLE_METHODS), "VALID", 0.98),
        (method.isin(*PROMISE_METHODS), "VALID", 0.85),
        (method.isin(*LIFECYCLE_METHODS), "VALID", 0.90),
        (typo, "INVALID", 0.7),
        default=("UNCERTAIN", 0.3),
    )


def function_verdict(name: Column) -> Column:
    return _verdict((name.isin(*REACT_FUNCTIONS), "VALID", 0.95), (name.isin(*TIMERS), "VALID", 0.95), (name.rlike("^[A-Z]"), "UNCERTAIN", 0.6), default=("UNCERTAIN", 0.4))


def class_verdict(name: Column) -> Column:
    return _verdict((name.isin(*BUILTIN_CLASSES), "VALID", 0.95), (name.isin(*DOM_CLASSES), "VALID", 0.90), default=("UNCERTAIN", 0.5))


def attribute_verdict(obj: Column, name: Column) -> Column:
    return _verdict(*[((obj == o) & name.isin(*names), "VALID", 0.90) for o, names in GLOBAL_PROPERTIES.items()], default=("UNCERTAIN", 0.4))


def is_internal_module(module: Column, project: Column) -> Column:
    """Whether an import is likely to be of the project itself."""
    top = F.when(module.startswith("@"), F.concat_ws("/", F.slice(F.split(module, "/"), 1, 2))).otherwise(F.substring_index(F.substring_index(module, "/", 1), ".", 1))
    scope = F.substring_index(module, "/", 1)
    return (
        F.when(module.startswith("."), F.lit(True))
        .when(module.isin(*EXTERNAL_MODULES) | top.isin(*EXTERNAL_MODULES) | scope.isin(*EXTERNAL_MODULES), F.lit(False))
        .when(module.startswith(F.substring_index(project, ".", 1)), F.lit(True))
        .otherwise(~F.lower(module).rlike("test|mock|fake") & ~module.startswith("_") & (F.length(module) > 2))
    )


def hook_issues(hooks: DataFrame) -> DataFrame:
    """hooks (path, name, n_args, line) -> findings on arity and on names."""
    most = F.lit(None).cast("long")
    for name, _, n in HOOK_SIGNATURES:
        most = F.when(F.col("name") == name, F.lit(n).cast("long")).otherwise(most)
    issue = F.when(F.col("n_args") > most, "INCORRECT_SIGNATURE").when(most.isNull() & F.col("name").rlike("^use[a-z]"), "BAD_PRACTICE")
    out = hooks.withColumn("issue", issue).filter("issue is not null")
    return out.select("path", "name", "line", "issue", F.when(F.col("issue") == "BAD_PRACTICE", "LOW").otherwise("MEDIUM").alias("severity"), F.when(F.col("issue") == "BAD_PRACTICE", 0.9).otherwise(0.8).alias("confidence"))


def component_issues(components: DataFrame) -> DataFrame:
    """components (path, name, type, n_props, n_hooks, exported) -> (path, name, issue, severity, confidence)."""
    upper = F.col("name").rlike("^[A-Z]")
    issue = lambda name, severity, confidence: F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
    checks = F.array(
        F.when(~upper, issue("lower_case_name", "MEDIUM", 0.95)),
        F.when((F.col("type") == "class") & (F.col("n_hooks") > 0), issue("hooks_in_class", "HIGH", 1.0)),
        F.when(~F.col("exported") & upper, issue("not_exported", "LOW", 0.7)),
        F.when(F.col("n_props") > 10, issue("too_many_props", "MEDIUM", 0.8)),
    )
    return components.select("path", "name", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")).select("path", "name", "c.*")


def unknown_names(uses: DataFrame, catalog: DataFrame, suggest: int = 5) -> DataFrame:
    """uses (path, line, name) that are not in the catalog (name), with its first names as suggestion."""
    names = catalog.select("name").distinct().orderBy("name").limit(suggest).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("suggestion"))
    return uses.join(catalog.select("name").distinct(), "name", "left_anti").crossJoin(F.broadcast(names))  # one row
