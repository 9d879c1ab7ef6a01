"""Chat formatting: conversations rendered by a compiled template, with the spans to learn.

``formatted`` renders the turns of each conversation in order. Rows are dealt and sorted
by ranges of (conversation, turn), so a conversation that has a large part of all rows
lies in many tasks; a template that renders each turn by itself (the compiler says so)
never holds more than a part of a conversation. A template that looks at whole
conversations gets each as one list.

Control strings in texts and roles are escaped by a backslash after their first
character, backslashes are doubled; ``unescaped`` is the exact inverse, and no escaped
text holds a control string, nor makes one with what stands beside it.

``read_back`` takes turns and learnt text from the formatted parts and digests them.
A conversation that lies in one part is read where it was rendered; parts of others, of
which there are two a task besides the longest ones, meet by conversation and are read
one after the other, as a digest of a whole conversation must be.

Defined cases: null texts and roles are empty; turns sort with nulls first, equal ones
by role, then text; repeated rows are turns of their own; rows of a null id are one
conversation; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from .templates import Output, Template

#: What marks turns; each begins with a character that none of them holds further on.
CONTROLS = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>")
CHAT = """
{%- for m in messages -%}
  {%- if m.role == 'assistant' -%}
    {%- generation %}{{ m.text | guard }}{% endgeneration -%}
    {{ eos }}
  {%- elif m.role == 'user' -%} [INST]{{ m.text | guard }}[/INST]
  {%- elif m.role == 'system' -%} [SYS]{{ m.text | guard }}[/SYS]
  {%- else -%} [ROLE]{{ m.role | guard }}[/ROLE]{{ m.text | guard }}{{ eos }}
  {%- endif -%}
{%- endfor -%}
"""
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_SPECIAL = re.compile(rf"\\|{_CONTROL.pattern}")
#: A whole turn of CHAT.
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>", re.S)

PART = 1 << 20  # characters after which a part of a conversation ends
_BATCH = 1 << 22  # characters of a batch of parts, about


def escaped(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def chat_template(source: str = CHAT, **constants) -> Template:
    return Template(source, {"eos": "</s>", "bos": "<s>", **constants}, {"guard": lambda x: escaped(x if isinstance(x, str) else "")})


def turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text in the format of CHAT."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a formatted chat")
        kind = m.lastgroup
        yield (unescaped(m["role"]), unescaped(m["other"])) if kind == "other" else (kind, unescaped(m[kind]))
        at = m.end()


SPANS = "array<struct<start: long, end: long>>"
PARTS = f"conv_id long, part long, n_turns long, text string, spans {SPANS}, whole boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def formatted(conversations: DataFrame, source: str = CHAT, **constants) -> DataFrame:
    """(conv_id, part, n_turns, text, spans, whole) of (conv_id, turn, role, text) rows.

    A conversation's text is that of its parts in order, each of whole turns; spans are
    offsets, in code points, into the part. ``whole``: this part is all of it.
    """
    template = chat_template(source, **constants)  # so that a faulty one fails here
    turnwise = template.turnwise
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    rows = cluster.by_position(conversations).select(*(cluster.at(conversations, c).cast(t).alias(c) for c, t in kinds.items()))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    dealt = rows.repartitionByRange("conv_id", "turn", "role") if turnwise else rows.repartition("conv_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number, ready = chat_template(source, **constants), TaskContext.get().partitionId() << 36, []
        size = 0

        def part(key, n: int, out: Output, whole: bool) -> None:
            nonlocal number, size
            ready.append((key, number, n, "".join(out.parts), [{"start": a, "end": b} for a, b in out.spans], whole))
            number, size = number + 1, size + out.size

        def batch() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*ready))
            ready.clear()
            size = 0
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "part", "n_turns", "text", "spans", "whole"])

        started, key, first, many = False, None, True, False
        held, out, n = [], Output(), 0
        for rows_ in it:
            for conv, role, text in zip(*(rows_.column(i).to_pylist() for i in (0, 2, 3))):
                if started and conv != key:
                    if not turnwise:
                        out = own.render(held)
                    # The first and the last conversation of a task may have turns in another one.
                    part(key, n, out, not turnwise or not (first or many))
                    held, out, n, first, many = [], Output(), 0, False, False
                    if size >= _BATCH:
                        yield batch()
                started, key, n = True, conv, n + 1
                if not turnwise:
                    held.append({"role": role, "text": text})
                    continue
                if out.size >= PART:
                    part(key, n - 1, out, False)
                    out, n, many = Output(), 1, True
                    if size >= _BATCH:
                        yield batch()
                own.add({"role": role, "text": text}, out)
        if started:
            if not turnwise:
                out = own.render(held)
            part(key, n, out, not turnwise)
        if ready:
            yield batch()

    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PARTS)


class _Reader:
    """What the parts of one conversation, read in order, say."""

    def __init__(self):
        self.n, self.turns, self.loss, self.loss_chars, self.chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in turns(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for s in spans:
            learnt = unescaped(text[s["start"] : s["end"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.chars += len(text)

    def row(self, key) -> tuple:
        return key, None, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, None, None


READ = f"conv_id long, part long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, text string, spans {SPANS}"


def _read(it: Iterator[pa.RecordBatch], parts: Iterator[tuple], open_too: bool) -> Iterator[pa.RecordBatch]:
    """Digest runs of parts of one conversation; what is not whole is passed on unless ``open_too``."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), _SPANS)
    names = ["conv_id", "part", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "text", "spans"]
    ready, size, key, reader = [], 0, None, None
    for conv, part, whole, text, spans, done in parts:
        if reader is not None and (conv != key or done is not None):
            ready.append(reader.row(key))
            reader = None
        if done is not None:
            ready.append(done)
        elif whole or open_too:
            key, reader = conv, reader or _Reader()
            reader.add(text, spans)
            if whole:
                ready.append(reader.row(key))
                reader = None
        else:
            ready.append((conv, part, None, None, None, None, None, text, spans))
            size += len(text)
        if size >= _BATCH or len(ready) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), types)], names)
            ready, size = [], 0
    if reader is not None:
        ready.append(reader.row(key))
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), types)], names)


def read_back(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the parts of ``formatted`` by CHAT.

    turns_sha256: of role, newline, text, newline of each turn; loss_sha256: of what the
    spans cover; both unescaped.
    """

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conv, part, whole, text, spans, None) for b in it for conv, part, _, text, spans, whole in zip(*(b.column(i).to_pylist() for i in range(6))))
        yield from _read(it, rows, False)

    def far(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r[0], r[1], False, r[7], r[8], r if r[7] is None else None) for b in it for r in zip(*(b.column(i).to_pylist() for i in range(9))))
        yield from _read(it, rows, True)

    once = parts.select("conv_id", "part", "n_turns", "text", "spans", "whole").mapInArrow(near, READ)
    return once.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(far, READ).drop("part", "text", "spans")
