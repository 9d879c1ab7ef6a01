"""Database catalogs as tables: lookups over metadata rows, and the session's own catalog as such rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.text_index import literal_parts

# Schemas that hold no user tables.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast")
TABLE = "schema string, name string, rls_enabled boolean, estimated_rows long"
COLUMN = "schema string, table string, name string, data_type string, is_nullable boolean, default_value string, max_length int, ordinal int"


def user_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(~F.col("schema").isin(*SYSTEM_SCHEMAS)).orderBy("schema", "name")


def columns_of(columns: DataFrame) -> DataFrame:
    return columns.orderBy("schema", "table", "ordinal")


def primary_keys(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """(schema, table, column) of primary keys; constraints meet their columns by name alone."""
    return constraints.filter("constraint_type = 'PRIMARY KEY'").select("constraint_name").join(key_columns, "constraint_name").select("schema", "table", "column").distinct()


def foreign_keys(constraints: DataFrame, key_columns: DataFrame, used: DataFrame) -> DataFrame:
    """(schema, table, column, f_schema, f_table, f_column, constraint_name)."""
    fk = constraints.filter("constraint_type = 'FOREIGN KEY'").select("constraint_name")
    target = used.select("constraint_name", F.col("schema").alias("f_schema"), F.col("table").alias("f_table"), F.col("column").alias("f_column"))
    return fk.join(key_columns, "constraint_name").join(target, "constraint_name").select("schema", "table", "column", "f_schema", "f_table", "f_column", "constraint_name")


def enum_values(rows: DataFrame) -> DataFrame:
    """(schema, name, values): labels of (schema, name, label, sort_order) in order."""
    return rows.groupBy("schema", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "label"))), lambda x: x["label"]).alias("values"))


def flags(rows: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Add boolean columns: name=(column, the value that means true)."""
    return rows.withColumns({name: F.coalesce(F.col(column) == value, F.lit(False)) for name, (column, value) in columns.items()})


def indexes_of(indexes: DataFrame) -> DataFrame:
    """(schema, table, name, definition, is_unique, columns) of index definitions (schema, table, name, definition)."""
    inner = F.regexp_extract("definition", r"\(([^()]*)\)", 1)
    columns = F.filter(F.transform(F.split(inner, ","), lambda c: F.trim(c)), lambda c: c != "")
    return indexes.select("schema", "table", "name", "definition", F.upper("definition").startswith("CREATE UNIQUE INDEX").alias("is_unique"), columns.alias("columns"))


def policies_of(tables: DataFrame, policies: DataFrame) -> DataFrame:
    """(schema, table, rls_enabled, policies): row rules of each table in order of their names; none where there are none."""
    rule = F.struct("name", "permissive", "roles", "command", "qualifier", "with_check")
    held = policies.groupBy("schema", "table").agg(F.sort_array(F.collect_list(rule)).alias("policies"))
    rows = tables.select("schema", F.col("name").alias("table"), F.coalesce("rls_enabled", F.lit(False)).alias("rls_enabled")).join(held, ["schema", "table"], "left")
    none = F.array().cast(held.schema["policies"].dataType)
    return rows.withColumn("policies", F.coalesce("policies", none))


def views_of(views: DataFrame) -> DataFrame:
    return views.filter(~F.col("schema").isin(*SYSTEM_SCHEMAS[:2])).select("schema", "name", "definition").orderBy("schema", "name")


def extensions_of(extensions: DataFrame) -> DataFrame:
    return extensions.select("name").distinct().orderBy("name")


def user_schemas(schemas: DataFrame) -> DataFrame:
    return schemas.filter(~F.col("name").isin(*SYSTEM_SCHEMAS)).select("name").distinct().orderBy("name")


#: Lengths of the pieces by which names are looked up; a text is looked up by the longest that it has.
PIECES = (32, 16, 8, 4, 2, 1)


def _pieces(x: Column, size: Column) -> Column:
    """The different texts of so many characters in a text."""
    return F.when(F.length(x) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(x, i, size))))


def function_parameters(routines: DataFrame, parameters: DataFrame) -> DataFrame:
    """(function, name, type, position): parameters whose specific name is LIKE %routine% (its _ and % are wild).

    Of a routine's longest text between wildcards, the piece that the fewest names have is
    looked up by equality, and what it meets is verified by LIKE. A routine of nothing but
    wildcards is held against every name.
    """
    asked = routines.select(F.col("name").alias("function")).filter("function is not null").distinct()
    longest = F.array_max(F.transform(literal_parts(F.col("function"), fold=False, least=1), lambda x: F.struct(F.length(x).alias("n"), x.alias("text"))))
    size = F.coalesce(*(F.when(F.col("longest.n") >= n, n) for n in PIECES))
    asked = asked.withColumn("longest", longest).withColumn("size", size)
    sizes = F.broadcast(asked.select("size").filter("size is not null").distinct())  # a row for each of PIECES at most
    known = parameters.select("specific_name", "name", "type", "position")
    held = known.join(sizes).select(*known.columns, F.explode(_pieces(F.col("specific_name"), F.col("size"))).alias("piece"))
    often = held.groupBy("piece").agg(F.count("*").alias("n"))
    # A piece that no name has: no hits.
    tried = asked.select("function", F.explode(_pieces(F.col("longest.text"), F.col("size"))).alias("piece")).join(often.hint("merge"), "piece", "left")
    rarest = tried.groupBy("function").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("x")).filter("x.n > 0").select("function", F.col("x.piece").alias("piece"))
    like = F.expr("specific_name LIKE concat('%', function, '%')")
    # Sizes of what is exploded are estimated far too small to be broadcast.
    found = held.join(rarest.hint("merge"), "piece").filter(like).drop("piece")
    found = found.unionByName(known.join(asked.filter("size is null").select("function"), like))
    return routines.select(F.col("name").alias("function")).join(found.hint("merge"), "function").select("function", "name", "type", "position")


def widest_tables(columns: DataFrame, k: int = 10) -> DataFrame:
    return columns.groupBy("schema", "table").agg(F.count("*").alias("column_count")).orderBy(F.desc("column_count"), "schema", "table").limit(k)


def most_parameters(parameters: DataFrame, k: int = 10) -> DataFrame:
    return parameters.groupBy("function").agg(F.count("*").alias("param_count")).orderBy(F.desc("param_count"), "function").limit(k)


def table_report(tables: DataFrame, columns: DataFrame, keys: DataFrame, foreign: DataFrame, indexes: DataFrame, policies: DataFrame) -> DataFrame:
    """(schema, table, n_columns, n_keys, n_foreign, n_indexes, n_policies, rls_enabled): each part aggregated before it is joined."""
    out = tables.select("schema", F.col("name").alias("table"), F.coalesce("rls_enabled", F.lit(False)).alias("rls_enabled"))
    for rows, name in ((columns, "n_columns"), (keys, "n_keys"), (foreign, "n_foreign"), (indexes, "n_indexes"), (policies, "n_policies")):
        out = out.join(rows.groupBy("schema", "table").agg(F.count("*").alias(name)), ["schema", "table"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def analysis(parts: dict[str, DataFrame], columns: DataFrame, parameters: DataFrame, k: int = 10) -> DataFrame:
    """(section, name, n): how many of each kind there are, then the widest tables and the functions of most parameters."""
    out = None
    for label, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit("counts").alias("section"), F.lit(label).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    wide = widest_tables(columns, k).select(F.lit("tables").alias("section"), F.concat_ws(".", "schema", "table").alias("name"), F.col("column_count").alias("n"))
    return out.unionByName(wide).unionByName(most_parameters(parameters, k).select(F.lit("functions").alias("section"), F.col("function").alias("name"), F.col("param_count").alias("n")))


def summary(tables: DataFrame, columns: DataFrame, functions: DataFrame, enums: DataFrame) -> DataFrame:
    """(label, n) of each kind of object."""
    out = None
    for label, df in (("tables", tables), ("columns", columns), ("functions", functions), ("enums", enums)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def schema_document(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(schema, document): each schema's tables and columns as one JSON text."""
    cols = columns.groupBy("schema", "table").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name", "data_type", "is_nullable"))), lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("type"), c["is_nullable"].alias("nullable"))).alias("columns"))
    rows = tables.join(cols, (tables.schema == cols.schema) & (tables.name == cols.table), "left").select(tables.schema, "name", "columns")
    return rows.groupBy("schema").agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "columns")))).alias("document"))


def graph_of(tables: DataFrame, columns: DataFrame, fks: DataFrame, project: str = "db") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, dst, kind) of a catalog."""
    tid = F.concat_ws(".", F.lit(project), "schema", "name")
    ctid = F.concat_ws(".", F.lit(project), "schema", "table")
    cid = F.concat_ws(".", ctid, "name")
    nodes = tables.select(tid.alias("id"), F.lit("Table").alias("label")).unionByName(columns.select(cid.alias("id"), F.lit("Column").alias("label")))
    edges = tables.select(F.lit(project).alias("src"), tid.alias("dst"), F.lit("CONTAINS_TABLE").alias("kind"))
    edges = edges.unionByName(columns.select(ctid.alias("src"), cid.alias("dst"), F.lit("HAS_COLUMN").alias("kind")))
    edges = edges.unionByName(fks.select(F.concat_ws(".", F.lit(project), "schema", "table", "column").alias("src"), F.concat_ws(".", F.lit(project), "f_schema", "f_table", "f_column").alias("dst"), F.lit("REFERENCES").alias("kind")))
    return nodes.distinct(), edges.distinct()


def object_graph(views: DataFrame, functions: DataFrame, enums: DataFrame, policies: DataFrame, project: str = "db") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the objects beside tables: views, functions, enums (schema, name) and policies (schema, table, name)."""
    nodes = edges = None
    for rows, label, kind in ((views, "View", "CONTAINS_VIEW"), (functions, "DatabaseFunction", "CONTAINS_FUNCTION"), (enums, "Enum", "CONTAINS_ENUM")):
        node = F.concat_ws(".", F.lit(project), "schema", "name")
        n = rows.select(node.alias("id"), F.lit(label).alias("label"))
        e = rows.select(F.lit(project).alias("src"), node.alias("dst"), F.lit(kind).alias("kind"))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    table = F.concat_ws(".", F.lit(project), "schema", "table")
    node = F.concat_ws(".", table, F.lit("policy"), "name")
    nodes = nodes.unionByName(policies.select(node.alias("id"), F.lit("Policy").alias("label")))
    edges = edges.unionByName(policies.select(table.alias("src"), node.alias("dst"), F.lit("HAS_POLICY").alias("kind")))
    return nodes.distinct(), edges.distinct()


def session_columns(spark: SparkSession, views: dict[str, DataFrame], schema: str = "main") -> DataFrame:
    """Catalog rows of named DataFrames; what is listed is schemas, not data."""
    rows = [(schema, t, f.name, f.dataType.simpleString(), f.nullable, None, None, i) for t, df in views.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, COLUMN)


def existing(spark: SparkSession, names: list[str]) -> list[str]:
    """Those of a few given names that are tables of the session's catalog."""
    return [n for n in names if spark.catalog.tableExists(n)]
