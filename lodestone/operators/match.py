"""Fixed-length graph patterns over node and edge tables, compiled to joins.

    MATCH (r:region {r_name: 'ASIA'})-[:HOLDS]->(n:nation)-[:HAS]->(c:customer)
    OPTIONAL MATCH (c)-[:PLACED]->(o:orders)
    WHERE c.c_acctbal > 0 AND n.n_name CONTAINS 'IN'
    RETURN n.n_name AS nation, count(DISTINCT c) AS customers, count(DISTINCT o) AS orders
    ORDER BY nation LIMIT 20

Required patterns become inner joins from the node that a property fixes, or the first.
A branch of OPTIONAL MATCH that is only aggregated is never joined to the rows of other
branches: its rows are aggregated by what is returned and then joined, so no product of
branches is formed. A branch with a plain column in RETURN is a left join. Patterns that
share no variable would be a cross product and are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign><>|<=|>=|->|<-|\.\.|[-<>=(){}\[\]:,.]))""")
_KEYWORDS = {"match", "optional", "where", "return", "order", "by", "limit", "and", "as", "distinct", "desc", "asc"}
_COMPARE = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
_AGGREGATES = {"count", "collect", "min", "max"}


class PatternError(ValueError):
    """A pattern that is not well formed, or names what the graph does not have."""


@dataclass
class Graph:
    """nodes: label -> (table, key column); edges: kind -> (label, label, table with src and dst)."""

    nodes: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    edges: dict[str, tuple[str, str, DataFrame]] = field(default_factory=dict)

    def node(self, label: str, rows: DataFrame, key: str) -> Graph:
        return Graph(self.nodes | {label: (rows, key)}, self.edges)

    def edge(self, kind: str, src: str, dst: str, rows: DataFrame, src_column: str, dst_column: str) -> Graph:
        """Edges as two columns of any table; a foreign key is one."""
        pairs = rows.select(F.col(src_column).alias("src"), F.col(dst_column).alias("dst")).filter("src is not null and dst is not null")
        return Graph(self.nodes, self.edges | {kind: (src, dst, pairs)})


@dataclass
class Step:
    """An edge of a pattern between two variables, in the direction of its table."""

    kind: str
    src: str
    dst: str


@dataclass
class Item:
    """What is returned: variable and property, under a function or not."""

    name: str
    var: str
    prop: str | None
    how: str | None = None
    first: int | None = None


@dataclass
class Query:
    labels: dict[str, str] = field(default_factory=dict)
    fixed: list[tuple[str, str, str, object]] = field(default_factory=list)
    required: list[Step] = field(default_factory=list)
    lone: list[str] = field(default_factory=list)
    branches: list[list[Step]] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


class _Parser:
    def __init__(self, text: str):
        self.tokens, at, self.at, self.q, self.names = [], 0, 0, Query(), 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PatternError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self, *words: str) -> bool:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return kind in ("word", "sign") and value.lower() in words

    def take(self, *words: str) -> bool:
        found = self.peek(*words)
        self.at += found
        return found

    def need(self, word: str) -> None:
        if not self.take(word):
            raise PatternError(f"{word!r} expected")

    def word(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "word" or value.lower() in _KEYWORDS:
            raise PatternError("a name expected")
        self.at += 1
        return value

    def literal(self) -> object:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
        self.at += 1
        if kind == "text":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "number":
            return float(value) if "." in value else int(value)
        if kind == "word" and value.lower() in ("true", "false"):
            return value.lower() == "true"
        raise PatternError("a value expected")

    def whole(self) -> Query:
        while self.peek("match", "optional"):
            branch: list[Step] | None = [] if self.take("optional") else None
            self.need("match")
            self.path(branch)
            while self.take(","):
                self.path(branch)
            if branch is not None:
                if not branch:
                    raise PatternError("an optional pattern needs an edge")
                self.q.branches.append(branch)
        if self.take("where"):
            self.condition()
            while self.take("and"):
                self.condition()
        self.need("return")
        self.item()
        while self.take(","):
            self.item()
        if self.take("order"):
            self.need("by")
            self.ordered()
            while self.take(","):
                self.ordered()
        if self.take("limit"):
            self.q.limit = int(self.literal())
        if self.at < len(self.tokens):
            raise PatternError(f"unexpected {self.tokens[self.at][1]!r}")
        return self.q

    def node(self) -> str:
        self.need("(")
        if self.peek(":", ")"):
            self.names += 1
            var = f"_{self.names}"
        else:
            var = self.word()
        if self.take(":"):
            label = self.word()
            if self.q.labels.setdefault(var, label) != label:
                raise PatternError(f"{var} has two labels")
        if self.take("{"):
            while True:
                prop = self.word()
                self.need(":")
                self.q.fixed.append((var, prop, "=", self.literal()))
                if not self.take(","):
                    break
            self.need("}")
        self.need(")")
        return var

    def path(self, branch: list[Step] | None) -> None:
        var, steps = self.node(), self.q.required if branch is None else branch
        if branch is None:
            self.q.lone.append(var)
        while self.peek("-", "<-"):
            back = self.take("<-") or not self.take("-")
            self.need("[")
            self.need(":")
            kind = self.word()
            self.need("]")
            self.need("-" if back else "->")
            other = self.node()
            steps.append(Step(kind, other, var) if back else Step(kind, var, other))
            var = other

    def condition(self) -> None:
        var = self.word()
        self.need(".")
        prop = self.word()
        for sign in sorted(_COMPARE, key=len, reverse=True):
            if self.take(sign):
                self.q.fixed.append((var, prop, sign, self.literal()))
                return
        if self.take("contains"):
            self.q.fixed.append((var, prop, "contains", self.literal()))
        elif self.take("starts"):
            self.need("with")
            self.q.fixed.append((var, prop, "starts", self.literal()))
        else:
            raise PatternError("a comparison expected")

    def item(self) -> None:
        word, how, first = self.word(), None, None
        if self.take("("):
            how = word.lower()
            if how not in _AGGREGATES:
                raise PatternError(f"no function {word!r}")
            if not self.take("distinct") and how in ("count", "collect"):
                raise PatternError(f"{how} must be of DISTINCT values: rows of a pattern are not counted")
            word = self.word()
        var, prop = word, None
        if self.take("."):
            prop = self.word()
        if how:
            self.need(")")
            if how == "collect" and self.take("["):
                if self.literal() != 0:
                    raise PatternError("a slice begins at 0")
                self.need("..")
                first = int(self.literal())
                self.need("]")
            if how == "collect" and first is None:
                raise PatternError("collect needs a slice [0..n]")
        name = self.word() if self.take("as") else prop or var
        self.q.items.append(Item(name, var, prop, how, first))

    def ordered(self) -> None:
        name = self.word()
        down = self.take("desc")
        if not down:
            self.take("asc")
        self.q.order.append((name, down))


def parse(text: str) -> Query:
    return _Parser(text).whole()


class _Plan:
    def __init__(self, graph: Graph, query: Query):
        self.g, self.q = graph, query
        for step in [*query.required, *(s for b in query.branches for s in b)]:
            if step.kind not in graph.edges:
                raise PatternError(f"no edges {step.kind!r}")
            for var, label in zip((step.src, step.dst), graph.edges[step.kind][:2]):
                if query.labels.setdefault(var, label) != label:
                    raise PatternError(f"{step.kind} does not join {query.labels[var]!r} there")
        for var, prop, *_ in query.fixed:
            self._known(var, prop)
        for item in query.items:
            self._known(item.var, item.prop)
        names = [i.name for i in query.items]
        if len(set(names)) < len(names) or any(n not in names for n, _ in query.order):
            raise PatternError("returned names must differ, and rows are ordered by them")
        self.bound = {v for s in query.required for v in (s.src, s.dst)} | set(query.lone)
        if not self.bound:
            raise PatternError("nothing to match")

    def _known(self, var: str, prop: str | None) -> None:
        label = self.q.labels.get(var)
        if label not in self.g.nodes:
            raise PatternError(f"no nodes for {var!r}")
        if prop is not None and prop not in self.g.nodes[label][0].columns:
            raise PatternError(f"{label} has no {prop!r}")

    def rows(self, var: str) -> DataFrame:
        """The nodes of a variable that its conditions allow: its key and the properties that are returned."""
        table, key = self.g.nodes[self.q.labels[var]]
        for v, prop, how, value in self.q.fixed:
            if v == var:
                c = F.col(prop)
                table = table.filter(c.contains(value) if how == "contains" else c.startswith(value) if how == "starts" else getattr(c, _COMPARE[how])(F.lit(value)))
        props = dict.fromkeys(i.prop for i in self.q.items if i.var == var and i.prop)
        return table.select(F.col(key).alias(var), *(F.col(p).alias(f"{var}.{p}") for p in props))

    def extended(self, rows: DataFrame, have: set[str], steps: list[Step]) -> DataFrame:
        """``rows`` joined along the steps, in an order in which each has a bound end."""
        left = list(steps)
        while left:
            step = next((s for s in left if s.src in have or s.dst in have), None)
            if step is None:
                raise PatternError("patterns that share no variable are a cross product")
            left.remove(step)
            edges = self.g.edges[step.kind][2].select(F.col("src").alias(step.src), F.col("dst").alias(step.dst)) if step.src != step.dst else self.g.edges[step.kind][2].filter("src = dst").select(F.col("src").alias(step.src))
            on = [v for v in dict.fromkeys((step.src, step.dst)) if v in have]
            rows = rows.join(edges.distinct(), on)
            for var in dict.fromkeys((step.src, step.dst)):
                if var not in have:
                    rows = rows.join(self.rows(var), var)
                    have.add(var)
        return rows

    def required(self) -> DataFrame:
        # From a node that a value fixes, so that the first join is small.
        given = [v for v, _, how, _ in self.q.fixed if how == "=" and v in self.bound]
        start = given[0] if given else self.q.lone[0]
        have = {start}
        rows = self.extended(self.rows(start), have, self.q.required)
        if self.bound - have:
            raise PatternError("patterns that share no variable are a cross product")
        return rows

    def branch(self, steps: list[Step]) -> tuple[list[str], DataFrame]:
        """The bound variables that a branch begins at, and its rows."""
        inside = {v for s in steps for v in (s.src, s.dst)}
        ends = sorted(inside & self.bound)
        if not ends:
            raise PatternError("an optional pattern must begin at a matched variable")
        start = ends[0]
        first = self.g.nodes[self.q.labels[start]]
        rows = self.extended(first[0].select(F.col(first[1]).alias(start)).distinct(), {start}, steps)
        return ends, rows

    def run(self) -> DataFrame:
        q = self.q
        rows = self.required()
        pending = []
        for steps in q.branches:
            ends, found = self.branch(steps)
            own = {v for s in steps for v in (s.src, s.dst)} - self.bound
            if any(i.var in own and not i.how for i in q.items):
                # A column of the branch is returned as it is.
                keep = [c for c in found.columns if c in ends or c.split(".")[0] in own]
                rows = rows.join(found.select(*(F.col(f"`{c}`") for c in keep)), ends, "left")
                self.bound |= own
            else:
                pending.append((own, ends, found))
        by = [i for i in q.items if not i.how]
        column = lambda i: F.col(f"`{i.var}.{i.prop}`" if i.prop else f"`{i.var}`")

        def aggregate(i: Item) -> Column:
            c = column(i)
            if i.how == "count":
                return F.count_distinct(c).alias(i.name)
            if i.how == "collect":
                return F.slice(F.sort_array(F.collect_set(c)), 1, i.first).alias(i.name)
            return (F.min(c) if i.how == "min" else F.max(c)).alias(i.name)

        own_items = [i for i in q.items if i.how and i.var in self.bound]
        if not own_items and not any(i.how for i in q.items):
            out = rows.select(*(column(i).alias(i.name) for i in by)).distinct()
        else:
            keys = [column(i).alias(i.name) for i in by]
            names = [i.name for i in by]
            keyed = rows.select(*keys, *(F.col(f"`{c}`") for c in rows.columns if c not in names))
            out = rows.groupBy(*keys).agg(*map(aggregate, own_items)) if own_items else rows.select(*keys).distinct() if keys else rows.limit(1).select(F.lit(1).alias("_one"))
            for own, ends, found in pending:
                items = [i for i in q.items if i.how and i.var in own]
                if not items:
                    continue
                # Each branch by itself: what is returned, once with each of its beginnings.
                starts = keyed.select(*names, *ends).distinct()
                part = starts.join(found, ends).groupBy(*names).agg(*map(aggregate, items))
                if names:
                    same = reduce(lambda a, b: a & b, (out[n].eqNullSafe(part[n]) for n in names))
                    out = out.join(part, same, "left").select(*(out[c] for c in out.columns), *(part[i.name] for i in items))
                else:
                    out = out.join(F.broadcast(part))  # one row each
                for i in items:
                    if i.how == "count":
                        out = out.withColumn(i.name, F.coalesce(i.name, F.lit(0).cast("long")))
        out = out.select(*(F.col(f"`{i.name}`") for i in q.items))
        if q.order:
            out = out.orderBy(*(F.desc(n) if down else F.asc(n) for n, down in q.order))
        return out.limit(q.limit) if q.limit is not None else out


def match(graph: Graph, text: str) -> DataFrame:
    """The rows that a pattern returns."""
    return _Plan(graph, parse(text)).run()
