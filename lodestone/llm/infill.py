"""Fill-in-middle transformation of whole texts by counted-quantifier patterns.

A text is a sequence of units. ``regexp_count`` says how many; two cut points are drawn
from a hash of the document's id; a pattern of the row's own, whose first group takes
exactly ``unit{a}`` and whose second ``unit{b-a}`` (possessively, so nothing is tried
twice), captures prefix, middle and suffix in one match, and the replacement of that
match is the output. All of it is built-in expressions in one projection: no exchange,
no Python worker.

Defined cases: a null text is an empty one; an empty text, one that holds a marker, and
``plain_percent`` of all others stay as they are (form ``plain``, no lengths); a null id
draws as an empty one; repeated rows give repeated rows; an empty table gives an empty
result; other columns, whatever they are called, play no part and are not returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster

#: What a text can be cut into: any text is a sequence of matches of each.
UNITS = {"char": "(?s:.)", "word": r"(?:\S++\s*+|\s++)", "line": r"(?:[^\n]*+\n|[^\n]++)"}
#: So many units are counted at once; what is left, one by one.
_RUN = 1024


@dataclass(frozen=True)
class Infill:
    """Markers, rates and unit of a transformation."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "char"
    plain_percent: int = 10
    spm_percent: int = 20
    seed: str = "1"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(a != b and a in b for a in marks for b in marks) or not all(marks):
            raise ValueError("markers must be three texts, none within another")
        if any(a[-i:] == b[:i] for a in marks for b in marks for i in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("no marker may end as one begins")
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {sorted(UNITS)}")


def count(text: Column, unit: str) -> Column:
    """Units of a text: runs of 1024, then those of the rest, so that no text becomes a list of its characters."""
    run = f"{unit}{{{_RUN}}}+"
    rest = F.regexp_replace(text, rf"\A(?:{run})*+", "")
    # Anchored where the match before ended, so that a rest too short for a run is not tried from each of its places.
    return (F.regexp_count(text, F.lit(rf"\G{run}")).cast("long") * _RUN + F.regexp_count(rest, F.lit(unit))).cast("long")


def draws(key: Column, seed: str) -> list[Column]:
    """The first four groups of eight digits of the SHA-256 of seed:key, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _quoted(text: str) -> str:
    """A text that stands for itself in a replacement."""
    return re.sub(r"([\\$])", r"\\\1", text)


def transform(docs: DataFrame, how: Infill = Infill(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, n, form, prefix_units, middle_units, output) of each row; n counts units."""
    unit, marks = UNITS[how.unit], (how.prefix, how.suffix, how.middle)
    rows = cluster.texts(docs, id_column, text_column).withColumn("text", F.coalesce("text", F.lit("")))
    h1, h2, h3, h4 = draws(F.col("doc_id"), how.seed)
    plain = F.col("text") == ""
    for m in marks:
        plain = plain | F.col("text").contains(m)
    rows = rows.withColumn("n", count(F.col("text"), unit)).withColumns({"x": h1 % (F.col("n") + 1), "y": h2 % (F.col("n") + 1), "h3": h3, "h4": h4})
    form = F.when(plain | (F.col("h3") % 100 >= 100 - how.plain_percent), "plain").when(F.col("h4") % 100 < how.spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "a": F.least("x", "y"), "m": F.abs(F.col("x") - F.col("y"))})
    pattern = F.concat(F.lit(rf"(?s)\A({unit}{{"), "a", F.lit(rf"}}+)({unit}{{"), "m", F.lit(r"}+)(.*+)\z"))
    p, s, m = map(_quoted, marks)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    out = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    cutup = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cutup, F.col("a")).alias("prefix_units"), F.when(cutup, F.col("m")).alias("middle_units"), out.alias("output"))


def restored(output: Column, form: Column, how: Infill = Infill()) -> Column:
    """The text that an output of ``transform`` was made from, by its form."""
    p, s, m = (re.sub(r"([^\w\s])", r"\\\1", x) for x in (how.prefix, how.suffix, how.middle))
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
