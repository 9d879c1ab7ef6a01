"""Facts from TypeScript and JSX sources, by a small tokenizer: imports, components, hooks, calls, exports.

Files are independent, so Spark deals them out and each task reads its own; names may
span lines, and nothing inside strings or comments counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

FACTS = "path string, kind string, name string, line long, owner string, args array<string>, detail string"

_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/"
    r"|(?P<text>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")"
    r"|(?P<template>`(?:\\.|[^`\\])*`)"
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|[^\s\w])",
    re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_WORDS = frozenset("if for while switch catch function return typeof await new in of do else throw delete void case super".split())
_HOOK = re.compile(r"use[A-Z]\w*")
_WRAPPERS = frozenset(("memo", "forwardRef"))


@dataclass
class Token:
    kind: str
    text: str
    line: int


def tokens_of(source: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], line))
    return out


class Reader:
    """The tokens of a file and what stands between matching brackets."""

    def __init__(self, source: str):
        self.t = tokens_of(source)
        self.match: dict[int, int] = {}
        held: list[int] = []
        for i, x in enumerate(self.t):
            if x.kind == "mark" and x.text in _OPEN:
                held.append(i)
            elif x.kind == "mark" and x.text in _CLOSE and held and _OPEN[self.t[held[-1]].text] == x.text:
                self.match[held.pop()] = i

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def after_generics(self, i: int) -> int:
        """The place after ``<...>`` that begins at i, or i."""
        if self.text(i) != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.t), i + 200)):
            x = self.text(j)
            depth += (x == "<") - (x == ">")
            if depth == 0:
                return j + 1
            if x in (";", "(") and depth and x == ";":
                break
        return i

    def split(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The parts of tokens lo to hi that commas separate, brackets kept whole."""
        out, start, i = [], lo, lo
        while i < hi:
            if i in self.match and self.match[i] < hi:
                i = self.match[i]
            elif self.text(i) == ",":
                out.append((start, i))
                start = i + 1
            i += 1
        return [(a, b) for a, b in [*out, (start, hi)] if b > a]

    def value(self, lo: int, hi: int) -> str:
        """An argument as a short text: literals and names as they are, others by their kind."""
        first = self.t[lo]
        if hi - lo == 1:
            return first.text[1:-1] if first.kind == "text" else "<TemplateLiteral>" if first.kind == "template" else first.text
        if hi - lo == 3 and self.text(lo + 1) == "." and self.kind(lo + 2) == "name":
            return f"{first.text}.{self.text(lo + 2)}"
        if any(self.text(i) == "=>" for i in range(lo, hi)) or first.text == "function":
            return "<Function>"
        return {"{": "<Object>", "[": "<Array>", "<": "<Element>"}.get(first.text, "<Call>" if self.text(hi - 1) == ")" else "<Expression>")

    def arguments(self, at: int) -> list[str]:
        """Values of the arguments of the parenthesis at a place."""
        return [self.value(a, b) for a, b in self.split(at + 1, self.match[at])] if at in self.match else []

    def properties(self, at: int) -> list[str]:
        """Names that the first parameter of the parenthesis at a place stands for: its own, or those it takes apart."""
        parts = self.split(at + 1, self.match[at]) if at in self.match else []
        if not parts:
            return []
        lo, _ = parts[0]
        if self.text(lo) == "{" and lo in self.match:
            return [next((self.text(i) for i in range(a, b) if self.kind(i) == "name"), "") for a, b in self.split(lo + 1, self.match[lo]) if self.text(a) != "..."]
        return [self.text(lo)] if self.kind(lo) == "name" else []

    def body_end(self, i: int) -> int:
        """Where a body that begins at a place ends: its braces, or the end of an expression."""
        if self.text(i) in _OPEN and i in self.match:
            return self.match[i]
        while i < len(self.t):
            if i in self.match:
                i = self.match[i]
            elif self.text(i) == ";":
                return i
            i += 1
        return len(self.t)


def _component(r: Reader, i: int) -> tuple[str, list[str], str, int] | None:
    """(name, properties, kind, end) of the component that is declared at a place, or None."""
    word, name = r.text(i), r.text(i + 1)
    if word not in ("function", "const", "class") or r.kind(i + 1) != "name" or not name[0].isupper():
        return None
    if word == "class":
        j = i + 2
        while j < len(r.t) and r.text(j) not in ("{", ";"):
            j += 1
        base = [r.text(k) for k in range(i + 2, j)]
        return (name, [], "class", r.body_end(j)) if "extends" in base and any(x in ("Component", "PureComponent") for x in base) else None
    if word == "function":
        at = r.after_generics(i + 2)
        if r.text(at) != "(" or at not in r.match:
            return None
        j = r.match[at]
        while j < len(r.t) and r.text(j) != "{":
            j += 1
        return name, r.properties(at), "function", r.body_end(j)
    j = i + 2
    while j < len(r.t) and r.text(j) not in ("=", ";", "=>"):  # a type may stand before the value
        j = r.match[j] + 1 if j in r.match else j + 1
    if r.text(j) != "=":
        return None
    j += 1
    while r.text(j) in _WRAPPERS or r.text(j) in ("React", ".", "async") or (r.text(j) == "(" and r.text(j - 1) in _WRAPPERS):
        j += 1
        j = r.after_generics(j)
    j = r.after_generics(j)
    if r.text(j) == "function":
        at = j + 1 + (r.kind(j + 1) == "name")
        if at not in r.match:
            return None
        return name, r.properties(at), "function", r.body_end(r.match[at] + 1)
    if r.text(j) == "(" and j in r.match:
        k = r.match[j] + 1
        while k < len(r.t) and r.text(k) not in ("=>", ";", "{") and k < r.match[j] + 40:
            k += 1
        return (name, r.properties(j), "arrow", r.body_end(k + 1)) if r.text(k) == "=>" else None
    if r.kind(j) == "name" and r.text(j + 1) == "=>":
        return name, [r.text(j)], "arrow", r.body_end(j + 2)
    return None


def facts(path: str, source: str) -> list[tuple]:
    """Rows of FACTS of one file, in order."""
    r, out = Reader(source), []
    t = r.t
    components: list[tuple[int, int, str]] = []
    exported = {r.text(a) for i, x in enumerate(t) if x.text == "export" and r.text(i + 1) == "{" and i + 1 in r.match for a, _ in r.split(i + 2, r.match[i + 1])}
    exported |= {r.text(i + 2) for i, x in enumerate(t) if x.text == "export" and r.text(i + 1) == "default" and r.kind(i + 2) == "name"}
    add = lambda kind, name, i, owner=None, args=(), detail="": out.append((path, kind, name, t[i].line, owner, list(args), detail))
    for i, x in enumerate(t):
        if x.kind != "name" or (r.text(i - 1) == "." and x.text in ("import", "export")):
            continue
        if x.text == "import":
            if r.text(i + 1) == "(":
                for name in r.arguments(i + 1)[:1]:
                    add("import", name, i, detail="dynamic")
                continue
            j = i + 1
            while j < len(t) and t[j].kind != "text" and r.text(j) != ";" and j < i + 400:
                j += 1
            if j < len(t) and t[j].kind == "text":
                inner = [k for k in range(i + 1, j) if r.text(k) == "{" and k in r.match]
                names = [r.text(b - 1) for k in inner for a, b in r.split(k + 1, r.match[k])]
                head = [r.text(k) for k in range(i + 1, inner[0] if inner else j) if t[k].kind == "name" and r.text(k) not in ("from", "type", "as")]
                detail = "named" if inner else "namespace" if "*" in {r.text(k) for k in range(i + 1, j)} else "default" if head else "effect"
                add("import", t[j].text[1:-1], i, args=head + names, detail=detail)
        elif x.text == "require" and r.text(i + 1) == "(" and r.kind(i + 2) == "text":
            add("import", r.text(i + 2)[1:-1], i, detail="require")
        elif x.text == "export":
            if r.text(i + 1) == "{" and i + 1 in r.match:
                for a, b in r.split(i + 2, r.match[i + 1]):
                    add("export", r.text(b - 1), a, detail="list")
            else:
                k = i + 1
                while r.text(k) in ("default", "const", "let", "var", "async", "function", "class", "interface", "type", "abstract", "enum"):
                    k += 1
                if r.kind(k) == "name":
                    add("export", r.text(k), i, detail="default" if r.text(i + 1) == "default" else r.text(k - 1) if k > i + 1 else "")
        inner = r.text(i - 1 - (r.text(i - 1) == "async")) in ("=", "(", ",", "=>", "return")  # a function that is a value
        if not inner and (c := _component(r, i)):
            name, props, kind, end = c
            before = {r.text(k) for k in range(max(0, i - 3), i)}
            add("component", name, i, "export" if "export" in before or name in exported else None, props, kind)
            components.append((i, end, name))
        at = r.after_generics(i + 1)
        if r.text(at) == "(" and x.text not in _WORDS and r.text(i - 1) not in ("function", "class") and (at == i + 1 or _HOOK.fullmatch(x.text)):
            held = next((name for a, b, name in reversed(components) if a < i <= b), None)
            if _HOOK.fullmatch(x.text) and r.text(i - 1) != ".":
                add("hook", x.text, i, held, r.arguments(at))
            elif x.text not in ("import", "require") and not (r.text(i - 1) in ("{", "}", ";", "async", "static", "get", "set") and r.text(r.match.get(at, -2) + 1) == "{"):
                add("call", x.text, i, r.text(i - 2) if r.text(i - 1) == "." and r.kind(i - 2) == "name" else None, r.arguments(at))
    return out


def syntax(files: DataFrame) -> DataFrame:
    """Facts of (path, content) files, one row each; a null content has one error fact."""
    kinds = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("owner", pa.string()), ("args", pa.list_(pa.string())), ("detail", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [f for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in ([(p, "error", "FILE_ERROR", 1, None, [], "")] if c is None else facts(p, c))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return files.select("path", "content").mapInArrow(run, FACTS)
