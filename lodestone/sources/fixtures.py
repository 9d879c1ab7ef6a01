"""Source files, catalogs and calls of many projects, as rows that both Spark and SQL can be given.

Every supplier of the given tables is a project: it has each of these rows once, under
its own paths, schemas or numbers (``tagged`` columns), and source files end in a comment
with its name. So what queries read grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

CART = """import { useState, useEffect } from 'react';
import { formatPrice } from '../../../../lib/money';

interface Empty {}

interface LineProps<T> { item: T; total: any }

type Discount = number;

export function subtotal(items: any[], rate?: number): number {
  return items.length * (rate || 1);
}

export const Cart = ({ items, theme, onCheckout }) => {
  const [lines, setLines] = useState([]);
  const socket = io();
  useEffect(() => {
    setInterval(refresh, 1000);
    console.log(lines);
  }, [items]);
  lines.total = 5;
  items.push(1);
  return <ul style={{ margin: 4 }} onClick={() => this.close()}>
    {items.map(renderRow)}
    <Row theme={theme} /><Row theme={theme} /><Row theme={theme} /><Row theme={theme} />
    <img src="x.png">
    <button onClick={onCheckout}/>
    <div dangerouslySetInnerHTML={{ __html: items }} />
  </ul>;
};
subtotal();
subtotal(1, 2, 3);
useCallback(fn);
useMemo(a, b, c);
"""

LEGACY = """// eval(1) in a comment
for (let i = 0; i < 3; i++) { const v = useMemo(() => i, []); }
if (ready) { useEffect(run); }
function helper(x) { return useState(x); }
document.write("<p>");
eval("2 + 2");
node!.remove();
window.addEventListener('resize', draw);
const unusedThing = 1;
import a from './a';
import b from './b';
import c from './c';
import d from './d';
import e from './e';
import f from './f';
"""

CLEAN = """import React from 'react';

export const Label = (props) => <span>{props.text}</span>;
"""

FILES = [("src/Cart.tsx", "typescript", CART), ("src/legacy.js", "javascript", LEGACY), ("src/Label.tsx", "typescript", CLEAN), ("src/empty.ts", "typescript", "")]

PYTHON = [
    ("src/shop/model.py", "import os\nfrom .base import Base\n\n\nclass Item(Base):\n    price: float\n    _hidden: int\n\n    def total(self, n: int = 1, *more: str, tax=None, **rest) -> float:\n        def inner(x):\n            return x\n        return n\n\n    def _private(self):\n        pass\n\n\nasync def load(path):\n    return path\n"),
    ("src/shop/broken.py", "def broken(:\n"),
]

FUNCTIONS = ["report_usage", "check_access", "send_note"]
#: function, name, type, mode, position, default
PARAMS = [
    ("report_usage", "account", "uuid", "IN", 1, None),
    ("report_usage", "period", "period_kind", "IN", 2, None),
    ("report_usage", "detailed", "boolean", "IN", 3, None),
    ("report_usage", "options", "json", "IN", 4, None),
    ("check_access", "account", "uuid", "IN", 1, None),
    ("check_access", "level", "integer", "IN", 2, None),
    ("check_access", "context", "jsonb", "IN", 3, "{}"),
    ("send_note", "at", "timestamp", "IN", 1, None),
    ("send_note", "body", "text", "IN", 2, None),
]
ENUMS = [("period_kind", ["day", "week", "month"])]
_ID = '"123e4567-e89b-12d3-a456-426614174000"'
#: call, function
CALLS = [(1, "report_usage"), (2, "report_usage"), (3, "report_usage"), (4, "check_access"), (5, "send_note"), (6, "no_such"), (7, "check_access")]
#: call, name, JSON value
PROVIDED = [
    (1, "account", _ID), (1, "period", '"week"'), (1, "detailed", "true"), (1, "options", '{"a": 1}'),
    (2, "account", '"nope"'), (2, "period", '"year"'), (2, "detailed", '"maybe"'), (2, "options", "[1]"),
    (3, "account", _ID),
    (4, "account", _ID), (4, "level", "3"), (4, "extra", "1"), (4, "other", "2"),
    (5, "at", '"2024-01-02T03:04:05Z"'), (5, "body", "7"),
    (6, "x", "1"),
    (7, "account", "12"), (7, "level", '"x"'), (7, "context", '"text"'),
]


def quoted(x: object) -> str:
    """An SQL literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(quoted, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)})"


def _literal(x: object, kind) -> Column:
    if x is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, ArrayType):
        return F.array(*(_literal(v, kind.elementType) for v in x)).cast(kind)
    if isinstance(kind, MapType):
        return F.create_map(*(c for k, v in x.items() for c in (F.lit(k), F.lit(v)))).cast(kind)
    return F.lit(x).cast(kind)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows from which much is made, over a few tasks a core but no more than the session shuffles to; a fixed number, as adaptive plans would join small parts again."""
    spark = rows.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(most, max(64, 4 * spark.sparkContext.defaultParallelism)), key)


def over(spark: SparkSession, d: str, rows: list, schema: str, *tagged: str) -> DataFrame:
    """The rows once for each supplier: its texts in tagged columns begin with s<key>/, its numbers with thousands of the key."""
    fields = StructType.fromDDL(schema).fields
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    each = F.array(*(F.struct(*(_literal(x, f.dataType).alias(f.name) for x, f in zip(r, fields))) for r in rows))
    # A supplier is a few bytes that become whole files, so suppliers are dealt out before that: the table itself may be read by one task.
    own = dealt(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("_key"), F.col("s_name").alias("_name")), "_key")
    out = own.select("_key", "_name", F.explode(each).alias("_row")).select("_key", "_name", "_row.*")
    for f in fields:
        if f.name in tagged:
            text = f.dataType.simpleString() == "string"
            tag = F.concat(F.lit("s"), "_key", F.lit("/"), f.name) if text else (F.col(f.name) + 1000 * F.col("_key")).cast(f.dataType)
            out = out.withColumn(f.name, tag)
    if "content" in tagged_texts(fields):
        out = out.withColumn("content", F.concat("content", F.lit("// "), "_name", F.lit("\n")))
    return out.select(*(f.name for f in fields))


def tagged_texts(fields: list) -> list[str]:
    return [f.name for f in fields if f.name == "content" and f.dataType.simpleString() == "string"]


def picked(columns: str, rows: list, *tagged: str) -> str:
    """The columns of ``over`` in SQL, from rows beside the supplier."""
    out = []
    for i, c in enumerate(c.strip() for c in columns.split(",")):
        value = next((r[i] if isinstance(r, tuple) else r for r in rows if (r[i] if isinstance(r, tuple) else r) is not None), "")
        if c in tagged:
            out.append(f"'s' || s_suppkey || '/' || {c}" if isinstance(value, str) else f"{c} + 1000 * s_suppkey")
        elif c == "content":
            out.append("content || '// ' || s_name || chr(10)")
        else:
            out.append(c)
    return ", ".join(out)


def values_over(name: str, columns: str, rows: list, *tagged: str) -> str:
    """``over`` for a WITH clause."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"{name}({columns}) AS (SELECT {picked(columns, rows, *tagged)} FROM supplier, (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({columns}))"


FILE = "path string, language string, content string"


def files(spark: SparkSession, d: str) -> DataFrame:
    return over(spark, d, FILES, FILE, "path")


FILES_SQL = values_over("files", "path, language, content", FILES, "path")


def python_files(spark: SparkSession, d: str) -> DataFrame:
    """PYTHON, where a comment begins with another character."""
    rows = over(spark, d, PYTHON, "path string, content string", "path")
    return rows.withColumn("content", F.regexp_replace("content", "// ([^\n]*)\n$", "# $1\n"))
