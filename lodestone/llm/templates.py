"""A small template language for chats, compiled to Python closures.

``{{ expression }}`` puts out a value, ``{% for x in list %}``, ``{% if %}`` with
``elif`` and ``else``, ``{% set x = expression %}``, and ``{% generation %}`` around what
a model is to learn; ``{# #}`` is a comment, ``-`` at a tag's edge takes away the white
space beside it. Expressions have literals, names, fields and items of given values,
``+ - * // % ~``, comparisons, ``in``, ``and or not``, ``a if c else b`` and filters.

It is sandboxed: a field is only ever a key of a mapping that was passed in, filters come
from a fixed table, nothing can be called, and loops run over given lists only, so a
template ends. A source is parsed into a syntax tree; names that are known when it is
compiled become constants and what depends on constants only is worked out once; branches
that can't be taken go; the rest becomes nested closures.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """A template that is not well formed, or names what isn't there."""


class Undefined:
    """What a missing field or item is: nothing when put out, false as a condition."""

    def __bool__(self):
        return False

    def __eq__(self, other):
        return isinstance(other, Undefined)

    def __hash__(self):
        return 0

    def __str__(self):
        return ""


MISSING = Undefined()


def shown(x: Any) -> str:
    if x is None or x is MISSING:
        return ""
    return {True: "true", False: "false"}.get(x, str(x)) if isinstance(x, bool) else str(x)


def length(x: Any) -> int:
    return len(x) if isinstance(x, (str, list, tuple, Mapping)) else 0


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: shown(x).strip(),
    "upper": lambda x: shown(x).upper(),
    "lower": lambda x: shown(x).lower(),
    "capitalize": lambda x: shown(x).capitalize(),
    "length": length,
    "string": shown,
    "default": lambda x, other="": other if x is MISSING or x is None else x,
    "replace": lambda x, a, b: shown(x).replace(shown(a), shown(b)),
    "join": lambda x, by="": shown(by).join(map(shown, x)),
    "first": lambda x: x[0] if length(x) else MISSING,
    "last": lambda x: x[-1] if length(x) else MISSING,
}


# --- syntax tree ---


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter of its arguments, all of which are evaluated."""

    f: Callable[..., Any]
    args: tuple


@dataclass(frozen=True)
class Choice:
    """One of two by a condition; ``and`` and ``or`` are of this kind too."""

    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body), the last one's condition may be Const(True)


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key, MISSING)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return MISSING


def _arithmetic(f: Callable[[Any, Any], Any], texts: bool = False) -> Callable[[Any, Any], Any]:
    def run(a, b):
        if all(isinstance(x, int) for x in (a, b)) or (texts and all(isinstance(x, str) for x in (a, b))):
            try:
                return f(a, b)
            except ZeroDivisionError:
                raise TemplateError("division by zero") from None
        raise TemplateError(f"not numbers: {a!r}, {b!r}")

    return run


def _compared(f: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    def run(a, b):
        try:
            return f(a, b)
        except TypeError:
            raise TemplateError(f"can't compare {a!r} and {b!r}") from None

    return run


def _within(a: Any, b: Any) -> bool:
    return shown(a) in b if isinstance(b, str) else a in b if isinstance(b, (list, tuple, Mapping)) else False


COMPARE = {"==": operator.eq, "!=": operator.ne, "<": _compared(operator.lt), "<=": _compared(operator.le), ">": _compared(operator.gt), ">=": _compared(operator.ge), "in": _within}
ADD = {"+": _arithmetic(operator.add, texts=True), "-": _arithmetic(operator.sub), "~": lambda a, b: shown(a) + shown(b)}
MULTIPLY = {"*": _arithmetic(operator.mul), "//": _arithmetic(operator.floordiv), "%": _arithmetic(operator.mod)}
TESTS = {"defined": lambda x: x is not MISSING, "none": lambda x: x is None, "string": lambda x: isinstance(x, str)}
WORDS = {"true": True, "false": False, "none": None}
RESERVED = {*WORDS, "and", "or", "not", "in", "is", "if", "else"}

_TAG = re.compile(r"""(\{\{(?:'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^'"}]|\}(?!\}))*\}\}|\{%(?:'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^'"%]|%(?!\}))*%\}|\{#.*?#\})""", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*%~<>()\[\].,|=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *signs: str) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind in ("sign", "name") and value in signs else None

    def take(self, *signs: str) -> str | None:
        if found := self.peek(*signs):
            self.at += 1
        return found

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} expected")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or value in RESERVED:
            raise TemplateError("a name expected")
        self.at += 1
        return value

    def end(self, node: Any) -> Any:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def whole(self) -> Any:
        node = self.either()
        if self.take("if"):
            test = self.either()
            node = Choice(test, node, self.whole() if self.take("else") else Const(MISSING))
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Choice(node, node, self.both())
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Choice(node, self.negated(), node)
        return node

    def negated(self) -> Any:
        return Apply(operator.not_, (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.summed()
        while True:
            if sign := self.take(*COMPARE):
                node = Apply(COMPARE[sign], (node, self.summed()))
            elif self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                node = Apply(operator.not_, (Apply(_within, (node, self.summed())),))
            elif self.take("is"):
                inverse = self.take("not")
                word = self.take("none") or self.name()
                if word not in TESTS:
                    raise TemplateError(f"no test {word!r}")
                node = Apply(TESTS[word], (node,))
                node = Apply(operator.not_, (node,)) if inverse else node
            else:
                return node

    def summed(self) -> Any:
        node = self.multiplied()
        while sign := self.take(*ADD):
            node = Apply(ADD[sign], (node, self.multiplied()))
        return node

    def multiplied(self) -> Any:
        node = self.filtered()
        while sign := self.take(*MULTIPLY):
            node = Apply(MULTIPLY[sign], (node, self.filtered()))
        return node

    def filtered(self) -> Any:
        node = Apply(ADD["-"], (Const(0), self.atom())) if self.take("-") else self.atom()
        while True:
            if self.take("."):
                node = Item(node, Const(self.name()))
            elif self.take("["):
                node = Item(node, self.whole())
                self.need("]")
            elif self.take("|"):
                word, args = self.name(), []
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.whole())
                        if not self.peek(")"):
                            self.need(",")
                node = Apply(self.filters(word), (node, *args))
            else:
                return node

    table: Mapping[str, Callable[..., Any]] = FILTERS

    def filters(self, word: str) -> Callable[..., Any]:
        if word not in self.table:
            raise TemplateError(f"no filter {word!r}")
        return self.table[word]

    def atom(self) -> Any:
        if self.take("("):
            node = self.whole()
            self.need(")")
            return node
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        self.at += 1
        if kind == "number":
            return Const(int(value))
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            if value in WORDS:
                return Const(WORDS[value])
            if value not in RESERVED:
                return Name(value)
        raise TemplateError(f"a value expected, not {value!r}")


def parse(source: str, filters: Mapping[str, Callable[..., Any]] = FILTERS) -> tuple:
    """The statements of a template."""
    parts = _TAG.split(source)
    for i in range(1, len(parts), 2):
        tag = parts[i]
        if tag[2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if tag[-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    if any(re.search(r"\{\{|\{%|\{#", p) for p in parts[::2]):
        raise TemplateError("a tag is not closed")
    at = 0

    def expression(text: str) -> _Expression:
        e = _Expression(text)
        e.table = filters
        return e

    def body(*until: str) -> tuple[list, str, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part, tag = parts[at], at % 2
            at += 1
            if not tag:
                if part:
                    out.append(Out(Const(part)))
                continue
            if part[1] == "#":
                continue
            inner = part[2:-2].removeprefix("-").removesuffix("-").strip()
            if part[1] == "{":
                e = expression(inner)
                out.append(Out(e.end(e.whole())))
                continue
            word, _, rest = inner.partition(" ")
            if word in until:
                return out, word, rest
            e = expression(rest)
            if word == "for":
                name = e.name()
                e.need("in")
                over = e.end(e.whole())
                out.append(For(name, over, tuple(body("endfor")[0])))
            elif word == "set":
                name = e.name()
                e.need("=")
                out.append(Set(name, e.end(e.whole())))
            elif word == "generation":
                e.end(None)
                out.append(Generation(tuple(body("endgeneration")[0])))
            elif word == "if":
                arms, test = [], e.end(e.whole())
                while True:
                    inside, word, rest = body("elif", "else", "endif") if test != Const(True) or not arms else body("endif")
                    arms.append((test, tuple(inside)))
                    if word == "endif":
                        break
                    e = expression(rest)
                    test = e.end(e.whole()) if word == "elif" else e.end(Const(True))
                out.append(If(tuple(arms)))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if until:
            raise TemplateError(f"{until[-1]!r} is missing")
        return out, "", ""

    return tuple(body()[0])


# --- folding ---


def fold(node: Any, known: Mapping[str, Any]) -> Any:
    """An expression with what depends on known values only worked out."""
    if isinstance(node, Name):
        return Const(known[node.name]) if node.name in known else node
    if isinstance(node, Item):
        of, key = fold(node.of, known), fold(node.key, known)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Choice):
        test = fold(node.test, known)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no, known)
        return Choice(test, fold(node.yes, known), fold(node.no, known))
    if isinstance(node, Apply):
        args = tuple(fold(a, known) for a in node.args)
        return Const(node.f(*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Apply(node.f, args)
    return node


def folded(body: tuple, known: Mapping[str, Any]) -> tuple:
    """Statements with constant parts worked out, dead branches gone and neighbouring texts joined."""
    known, out = dict(known), []
    for node in body:
        if isinstance(node, Out):
            value = fold(node.value, known)
            node = Out(Const(shown(value.value))) if isinstance(value, Const) else Out(value)
        elif isinstance(node, Set):
            value = fold(node.value, known)
            known.pop(node.name, None)
            if isinstance(value, Const):
                known[node.name] = value.value
            node = Set(node.name, value)
        elif isinstance(node, For):
            # What the body sets is set anew in each turn; the loop's own names hide outer ones.
            inner = {k: v for k, v in known.items() if k not in (node.name, "loop")}
            node = For(node.name, fold(node.over, known), folded(node.body, inner))
            if not node.body or (isinstance(node.over, Const) and not node.over.value):
                continue
        elif isinstance(node, Generation):
            node = Generation(folded(node.body, known))
        elif isinstance(node, If):
            arms = []
            for test, inside in node.arms:
                test = fold(test, known)
                if isinstance(test, Const) and not test.value:
                    continue
                arms.append((test, folded(inside, known)))
                if isinstance(test, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                # Only this arm can be taken; a branch has no names of its own.
                out += arms[0][1]
                known = {k: v for k, v in known.items() if k not in assigned(arms[0][1])}
                continue
            if not arms:
                continue
            node = If(tuple(arms))
            for _, inside in node.arms:
                known = {k: v for k, v in known.items() if k not in assigned(inside)}
        out.append(node)
    joined: list = []
    for node in out:
        if isinstance(node, Out) and isinstance(node.value, Const):
            if not node.value.value:
                continue
            if joined and isinstance(joined[-1], Out) and isinstance(joined[-1].value, Const):
                joined[-1] = Out(Const(joined[-1].value.value + node.value.value))
                continue
        joined.append(node)
    return tuple(joined)


def assigned(body: tuple) -> set[str]:
    """Names that statements set in the scope that they stand in."""
    out: set[str] = set()
    for node in body:
        if isinstance(node, Set):
            out.add(node.name)
        elif isinstance(node, Generation):
            out |= assigned(node.body)
        elif isinstance(node, If):
            for _, inside in node.arms:
                out |= assigned(inside)
    return out


def free(node: Any) -> set[str]:
    """Names that a node needs from outside."""
    if isinstance(node, Name):
        return {node.name}
    if isinstance(node, Item):
        return free(node.of) | free(node.key)
    if isinstance(node, Choice):
        return free(node.test) | free(node.yes) | free(node.no)
    if isinstance(node, Apply):
        return set().union(*map(free, node.args))
    if isinstance(node, (Out, Set)):
        return free(node.value)
    if isinstance(node, For):
        return free(node.over) | (free(node.body) - {node.name, "loop"})
    if isinstance(node, Generation):
        return free(node.body)
    if isinstance(node, If):
        return set().union(*(free(t) | free(b) for t, b in node.arms))
    if isinstance(node, tuple):
        need: set[str] = set()
        have: set[str] = set()
        for one in node:
            need |= free(one) - have
            have |= assigned((one,))
        return need
    return set()


# --- closures ---


@dataclass
class Output:
    """Text put out so far, and where what is to be learnt begins and ends in it."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


Value = Callable[[dict], Any]
Step = Callable[[dict, Output], None]


def value_of(node: Any) -> Value:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name, MISSING)
    if isinstance(node, Item):
        of, key = value_of(node.of), value_of(node.key)
        return lambda env: _item(of(env), key(env))
    if isinstance(node, Choice):
        test, yes, no = value_of(node.test), value_of(node.yes), value_of(node.no)
        return lambda env: yes(env) if test(env) else no(env)
    f, args = node.f, [value_of(a) for a in node.args]
    if len(args) == 1:
        only = args[0]
        return lambda env: f(only(env))
    return lambda env: f(*(a(env) for a in args))


def step_of(node: Any) -> Step:
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda env, out: out.add(text)
        value = value_of(node.value)
        return lambda env, out: out.add(shown(value(env)))
    if isinstance(node, Set):
        name, value = node.name, value_of(node.value)

        def put(env, out):
            env[name] = value(env)

        return put
    if isinstance(node, If):
        arms = [(value_of(t), steps_of(b)) for t, b in node.arms]

        def choose(env, out):
            for test, then in arms:
                if test(env):
                    return then(env, out)

        return choose
    if isinstance(node, Generation):
        inside = steps_of(node.body)

        def learn(env, out):
            begin = out.size
            inside(env, out)
            if out.size > begin:
                out.spans.append((begin, out.size))

        return learn
    name, over, inside, counted = node.name, value_of(node.over), steps_of(node.body), "loop" in free(node.body)

    def repeat(env, out):
        rows = over(env)
        if not isinstance(rows, (list, tuple)):
            raise TemplateError("a loop needs a list")
        for i, x in enumerate(rows):
            local = {**env, name: x}
            if counted:
                local["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(rows), "length": len(rows)}
            inside(local, out)

    return repeat


def steps_of(body: tuple) -> Step:
    steps = [step_of(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for step in steps:
            step(env, out)

    return run


class Template:
    """A compiled template over ``messages``; ``constants`` are known when it is compiled."""

    def __init__(self, source: str, constants: Mapping[str, Any] | None = None, filters: Mapping[str, Callable[..., Any]] | None = None):
        known = dict(constants or {})
        self.body = folded(parse(source, {**FILTERS, **(filters or {})}), known)
        # Settings that are constants have been put where they are used.
        self.body = tuple(n for i, n in enumerate(self.body) if not (isinstance(n, Set) and isinstance(n.value, Const) and n.name not in free(self.body[i + 1 :])))
        if unknown := free(self.body) - {"messages"}:
            raise TemplateError(f"unknown names: {', '.join(sorted(unknown))}")
        if nested(self.body):
            raise TemplateError("one generation within another")
        self.steps = steps_of(self.body)
        loops = [n for n in self.body if isinstance(n, For)]
        #: Whether each message is rendered by itself: nothing but one loop whose body knows its message only.
        self.turnwise = len(self.body) == 1 and len(loops) == 1 and loops[0].over == Name("messages") and free(loops[0].body) <= {loops[0].name}
        self.turn = (loops[0].name, steps_of(loops[0].body)) if self.turnwise else None

    def render(self, messages: Sequence[Mapping[str, Any]]) -> Output:
        out = Output()
        self.steps({"messages": list(messages)}, out)
        return out

    def add(self, message: Mapping[str, Any], out: Output) -> None:
        """Render one more message of a turnwise template."""
        name, inside = self.turn
        inside({name: message}, out)


def nested(body: tuple, inside: bool = False) -> bool:
    """Whether a generation stands within another."""
    for node in body:
        if isinstance(node, Generation) and (inside or nested(node.body, True)):
            return True
        if isinstance(node, For) and nested(node.body, inside):
            return True
        if isinstance(node, If) and any(nested(b, inside) for _, b in node.arms):
            return True
    return False
