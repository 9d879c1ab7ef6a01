"""Chunks and code blocks as polymorphic table functions, to be called from SQL.

    SELECT * FROM chunk_text(TABLE(documents), 'text', 500)
    SELECT * FROM code_blocks(TABLE(SELECT id, markdown FROM pages), 'markdown', 100)

Each is given any table and the name of its text column; the other columns of a row are
kept beside what is made of its text, with their own types.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import LongType, Row, StringType, StructField, StructType

FENCE = "```"


@dataclass
class Analyzed(AnalyzeResult):
    """The result schema, with what the rows are made by."""

    text: str = ""
    kept: list[str] = field(default_factory=list)
    size: int = 0


def _analyzed(rows: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument | None, default: int, more: list[StructField]) -> Analyzed:
    if not rows.isTable:
        raise ValueError("the first argument must be a TABLE(...)")
    if not isinstance(text.value, str) or text.value not in rows.dataType.names:
        raise ValueError(f"the second argument must name a column of the table: {', '.join(rows.dataType.names)}")
    n = default if size is None else size.value
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError("the third argument must be a whole number, not below 0")
    kept = [f for f in rows.dataType.fields if f.name != text.value]
    if clash := {f.name.lower() for f in kept} & {f.name for f in more}:
        raise ValueError(f"the table already has columns of these names: {', '.join(sorted(clash))}")
    return Analyzed(schema=StructType([*kept, *more]), text=text.value, kept=[f.name for f in kept], size=n)


class ChunkText:
    """One row a chunk: kept columns, chunk_number from 0, content."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument = None) -> Analyzed:
        out = _analyzed(rows, text, size, 5000, [StructField("chunk_number", LongType()), StructField("content", StringType())])
        if out.size < 1:
            raise ValueError("chunks need a size")
        return out

    def __init__(self, how: Analyzed):
        self.how = how

    def eval(self, row: Row, text: str, size: int = 5000) -> Iterator[tuple]:
        from lodestone.operators.ingest import cut_text

        kept = tuple(row[name] for name in self.how.kept)
        for i, piece in enumerate(cut_text(row[self.how.text], self.how.size)):
            yield (*kept, i, piece)


def blocks_of(markdown: str | None, least: int) -> Iterator[tuple[str, str]]:
    """(language, code) of the fenced blocks of a text, in order; fences pair from its start."""
    parts = (markdown or "").split(FENCE)
    for body in parts[1 : len(parts) - 1 : 2]:
        first, newline, rest = body.partition("\n")
        name = first.strip()
        named = bool(newline) and name != "" and " " not in name and len(name) < 20
        code = (rest if named else body).strip()
        if len(code) >= least:
            yield (name if named else "", code)


class CodeBlocks:
    """One row a fenced block of at least so many characters: kept columns, block from 0, language, code."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, least: AnalyzeArgument = None) -> Analyzed:
        return _analyzed(rows, text, least, 1000, [StructField("block", LongType()), StructField("language", StringType()), StructField("code", StringType())])

    def __init__(self, how: Analyzed):
        self.how = how

    def eval(self, row: Row, text: str, least: int = 1000) -> Iterator[tuple]:
        kept = tuple(row[name] for name in self.how.kept)
        for i, (language, code) in enumerate(blocks_of(row[self.how.text], self.how.size)):
            yield (*kept, i, language, code)


def register(spark: SparkSession) -> None:
    """Make ``chunk_text`` and ``code_blocks`` known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, handler in (("chunk_text", ChunkText), ("code_blocks", CodeBlocks)):
        spark.udtf.register(name, udtf(handler))
