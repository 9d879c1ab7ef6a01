"""Property graphs as node and edge tables; lookups are equi-joins.

Nodes: one table a label with a unique key. Edges: (src, dst, kind). Fixed-length
patterns are joins; optional patterns are aggregated branch by branch before they are
joined, so counts need no cross product.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTING = 20


@dataclass
class Level:
    """A level of a containment hierarchy: its table, key, parent's key and name column."""

    rows: DataFrame
    key: str
    parent: str | None
    name: str


@dataclass
class Hierarchy:
    """Repository-like containment: levels from the root down."""

    levels: list[Level]

    def roots(self) -> DataFrame:
        top = self.levels[0]
        return top.rows.select(F.col(top.name).alias("name")).orderBy("name")

    def counts(self) -> DataFrame:
        """For each root, its number of nodes at each lower level, 0 where there are none.

        Keys are unique in a level, so counts add up from below: one join and one
        aggregation a level, whose partial sums stay small.
        """
        names = [f"level{i}" for i in range(1, len(self.levels))]
        below = None  # by the key above: the counts of the levels from here down
        for i in range(len(self.levels) - 1, 0, -1):
            level = self.levels[i]
            rows = level.rows.select(F.col(level.parent).alias("up"), F.col(level.key).alias("key")).dropDuplicates(["key"])
            if below is not None:
                rows = rows.join(below, "key", "left")
            sums = [F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names[i:]]
            below = rows.groupBy(F.col("up").alias("key")).agg(F.count("key").alias(names[i - 1]), *sums)
        top = self.levels[0]
        out = top.rows.select(F.col(top.key).alias("key"), F.col(top.name).alias("name")).join(below, "key", "left")
        return out.select(F.col("key").alias("root"), "name", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names))

    def explore(self, name: str) -> DataFrame:
        """Counts below one root; its row is missing where the root is."""
        top = self.levels[0]
        one = Hierarchy([Level(top.rows.filter(F.col(top.name) == name), top.key, None, top.name), *self.levels[1:]])
        return one.counts()

    def children(self, i: int, root: str | None = None, limit: int = LISTING) -> DataFrame:
        """The first nodes of a level by name; ``limited`` says whether there may be more."""
        level = self.levels[i]
        rows = level.rows
        if root is not None:
            for j in range(i, 0, -1):
                up, here = self.levels[j - 1], self.levels[j]
                keys = up.rows.filter(F.col(up.name) == root) if j == 1 else up.rows
                if j == i:
                    rows = rows.withColumn("_up", F.col(here.parent))
                rows = rows.join(keys.select(F.col(up.key).alias("_up"), *([F.col(up.parent).alias("_next")] if j > 1 else [])), "_up")
                rows = rows.drop("_up").withColumnRenamed("_next", "_up") if j > 1 else rows.drop("_up")
        out = rows.select(F.col(level.name).alias("name"), F.col(level.key).alias("key")).orderBy("name", "key").limit(limit)
        return out.withColumn("limited", F.count("*").over(Window.partitionBy()) >= limit)

    def detail(self, i: int, name: str) -> DataFrame:
        """A node of a level by name or key (the first by key) with its children in order."""
        level, below = self.levels[i], self.levels[i + 1]
        node = level.rows.filter((F.col(level.name) == name) | (F.col(level.key).cast("string") == name)).orderBy(level.key).limit(1)
        kids = node.select(F.col(level.key).alias("key"), F.col(level.name).alias("name")).join(below.rows.select(F.col(below.parent).alias("key"), F.col(below.name).alias("child")), "key", "left")
        return kids.select("key", "name", "child").orderBy("child")


def search(nodes: DataFrame, column: str, text: str) -> DataFrame:
    """Nodes whose column contains the text."""
    return nodes.filter(F.col(column).contains(text))


def label_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n) of each node or edge table."""
    out = None
    for label, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def first_children(rows: DataFrame, key: list[str], value: str, n: int = 5) -> DataFrame:
    """The first n distinct values of each key, in order, and how many there are; no more than n of a key are gathered."""
    once = rows.select(*key, value).filter(F.col(value).isNotNull()).distinct()
    few = first_rows(once, key, [value], n).groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias("values"))
    return once.groupBy(*key).agg(F.count("*").alias("n")).join(few, key).select(*key, "values", "n")


def first_rows(rows: DataFrame, key: list[str], order: list[Column | str], n: int = 10) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def optional_stats(top: DataFrame, key: str, branches: dict[str, DataFrame]) -> DataFrame:
    """Left-join the distinct count of each branch (columns ``key`` and ``value``) to the top."""
    out = top
    for name, rows in branches.items():
        n = rows.groupBy("key").agg(F.count_distinct("value").alias(name))
        out = out.join(n, out[key] == n["key"], "left").drop(n["key"]).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def cascade_delete(levels: list[Level], root_key: object) -> list[DataFrame]:
    """Each level without what hangs below the root: a chain of anti-joins from the root down."""
    top = levels[0]
    gone = top.rows.filter(F.col(top.key) == root_key).select(F.col(top.key).alias("up"))
    out = [top.rows.filter(F.coalesce(F.col(top.key) != root_key, F.lit(True)))]
    for level in levels[1:]:
        out.append(level.rows.join(gone, F.col(level.parent) == F.col("up"), "left_anti"))
        gone = level.rows.join(gone, F.col(level.parent) == F.col("up"), "left_semi").select(F.col(level.key).alias("up"))
    return out


def merge_nodes(existing: DataFrame, incoming: DataFrame, key: list[str], order: str, last_wins: bool = False) -> DataFrame:
    """MERGE by key: existing nodes stay (or, with last_wins, give way to later ones)."""
    both = existing.withColumns({"_src": F.lit(0)}).unionByName(incoming.withColumns({"_src": F.lit(1)}))
    by = [F.desc("_src"), F.desc(order)] if last_wins else [F.asc("_src"), F.asc(order)]
    return first_rows(both, key, by, 1).drop("_src")


_WRITES = {"insert", "merge", "update", "delete", "create", "drop", "alter", "truncate", "set", "reset", "use", "cache", "uncache", "refresh", "load", "call"}


def _over(text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A SELECT over named tables, which are views only while it is analysed."""
    spark = next(iter(tables.values())).sparkSession
    had = {k for k in tables if spark.catalog.tableExists(k)}
    if had:
        raise ValueError(f"the session has tables of these names already: {', '.join(sorted(had))}")
    try:
        for k, v in tables.items():
            v.createTempView(k)
        return spark.sql(text)
    finally:
        for k in tables:
            spark.catalog.dropTempView(k)


def clear_file_level(tables: dict[str, DataFrame], repo: str) -> dict[str, DataFrame]:
    """Node tables (path, ...) and ``file`` (path, repo) without what hangs below the files of a repository."""
    gone = tables["file"].filter(F.col("repo") == repo).select("path")
    out = {k: v.join(gone, "path", "left_anti").select(*v.columns) if "path" in v.columns else v for k, v in tables.items()}
    if "repository" in tables:
        out["repository"] = tables["repository"].filter(F.col("name") != repo)
    return out


def emptied(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without its rows."""
    return {k: v.filter(F.lit(False)) for k, v in tables.items()}


def file_contents(file: DataFrame, **members: DataFrame) -> DataFrame:
    """(path, <member>s...) of each file: the distinct names of each member table (path, name), in order; gathered branch by branch."""
    out = file.select("path").distinct()
    for name, rows in members.items():
        held = rows.groupBy("path").agg(F.sort_array(F.collect_set("name")).alias(f"{name}s"))  # the names in one file
        out = out.join(held, "path", "left").withColumn(f"{name}s", F.coalesce(f"{name}s", F.array().cast("array<string>")))
    return out


COMMANDS = ("repos", "explore", "classes", "class", "method", "components", "component", "hooks", "hook", "functions", "function", "sql")


class CodeGraph:
    """Node tables of a code graph and the lookup commands over them.

    tables: repository(name), file(path, repo, name, module_name, line_count),
    class(full_name, path, name), method(class_full_name, name, params, return_type),
    attribute(class_full_name, name, type), function(path, name, params, return_type),
    component(path, name, type, is_exported), hook(path, name, args).
    """

    def __init__(self, **tables: DataFrame):
        self.t = tables

    def _of_repo(self, label: str, repo: str | None) -> DataFrame:
        rows = self.t[label]
        if repo is None:
            return rows
        return rows.join(self.t["file"].filter(F.col("repo") == repo).select("path"), "path", "left_semi")

    def repos(self) -> DataFrame:
        return self.t["repository"].select("name").orderBy("name")

    def explore(self, repo: str) -> DataFrame:
        """One row of counts; none where the repository is unknown."""
        files = self.t["file"].filter(F.col("repo") == repo).select("path")
        count = lambda df, name: df.agg(F.count("*").alias(name))
        cls = self.t["class"].join(files, "path", "left_semi")
        methods = self.t["method"].join(cls.select(F.col("full_name").alias("class_full_name")), "class_full_name", "left_semi")
        out = self.t["repository"].filter(F.col("name") == repo).select("name")
        for df, name in ((files, "files"), (cls, "classes"), (self.t["function"].join(files, "path", "left_semi"), "functions"), (methods, "methods")):
            out = out.crossJoin(F.broadcast(count(df, name)))  # one row each
        return out

    def listing(self, label: str, repo: str | None = None) -> DataFrame:
        out = self._of_repo(label, repo).orderBy("name", "path").limit(LISTING)
        return out.withColumn("limited", F.count("*").over(Window.partitionBy()) >= LISTING)

    def class_detail(self, name: str) -> DataFrame:
        """(full_name, kind, member, detail) of the first class of that name, methods first."""
        one = self.t["class"].filter((F.col("name") == name) | (F.col("full_name") == name)).orderBy("full_name").limit(1).select("full_name")
        m = self.t["method"].select(F.col("class_full_name").alias("full_name"), F.lit("method").alias("kind"), F.col("name").alias("member"), F.concat(F.lit("("), F.array_join(F.coalesce("params", F.array().cast("array<string>")), ", "), F.lit(") -> "), F.coalesce(F.nullif("return_type", F.lit("")), F.lit("Any"))).alias("detail"))
        a = self.t["attribute"].select(F.col("class_full_name").alias("full_name"), F.lit("attribute").alias("kind"), F.col("name").alias("member"), F.coalesce(F.nullif("type", F.lit("")), F.lit("Any")).alias("detail"))
        return m.unionByName(a).join(F.broadcast(one), "full_name").orderBy(F.desc("kind"), "member")

    def method(self, name: str, of_class: str | None = None) -> DataFrame:
        rows = self.t["method"].filter(F.col("name") == name)
        if of_class is None:
            return rows.orderBy("class_full_name").limit(LISTING)
        return rows.join(self.t["class"].filter((F.col("name") == of_class) | (F.col("full_name") == of_class)).select(F.col("full_name").alias("class_full_name")), "class_full_name", "left_semi").orderBy("class_full_name")

    def named(self, label: str, name: str, repo: str | None = None) -> DataFrame:
        return self._of_repo(label, repo).filter(F.col("name") == name).orderBy("path").limit(LISTING)

    def sql(self, text: str) -> DataFrame:
        """One SELECT over the graph's tables, 20 rows at most; it sees no other tables by these names and leaves none behind."""
        bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
        words = re.findall(r"[a-z_]+", bare.lower())
        if not words or words[0] not in ("select", "with") or ";" in bare.strip().rstrip(";") or _WRITES & set(words):
            raise ValueError("only one SELECT statement is run")
        return _over(text, self.t).limit(LISTING)

    def command(self, line: str) -> DataFrame:
        """Dispatch a lookup command; the first word in any case."""
        word, *args = line.split()
        word = word.lower()
        if word not in COMMANDS:
            raise ValueError(f"unknown command {word!r}; there are {', '.join(COMMANDS)}")
        if word == "repos":
            return self.repos()
        if word == "sql":
            return self.sql(" ".join(args))
        if word in ("explore", "class", "method", "component", "hook", "function") and not args:
            raise ValueError(f"{word} needs a name")
        first, second = (args + [None, None])[:2]
        if word == "explore":
            return self.explore(first)
        if word == "class":
            return self.class_detail(first)
        if word == "method":
            return self.method(first, second)
        if word in ("component", "hook", "function"):
            return self.named(word, first, second)
        return self.listing({"classes": "class", "components": "component", "hooks": "hook", "functions": "function"}[word], first)

    def files_importing(self, imports: DataFrame, target: str) -> DataFrame:
        return imports.filter(F.col("module").contains(target)).select("path", "module").distinct().orderBy("path", "module")

    def classes_in_file(self, path: str) -> DataFrame:
        return self.t["class"].filter(F.col("path").contains(path)).select("name", "full_name").orderBy("full_name")

    def methods_of_class(self, name: str) -> DataFrame:
        return self.t["method"].filter(F.col("class_full_name").contains(name)).select("class_full_name", "name", "params").orderBy("class_full_name", "name")
