"""Lookups of a code graph made of the given tables: regions are repositories, nations files, customers classes, orders methods, suppliers functions, parts components."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import extract, graph, rules
from lodestone.plans.registry import query, table
from lodestone.sources.fixtures import dealt


def code_graph(spark, d) -> graph.CodeGraph:
    t = lambda n: table(spark, d, n)
    path = lambda c: F.concat(F.lit("n"), c, F.lit(".py"))
    regions = t("region").select("r_regionkey", F.col("r_name").alias("repo"))
    none = spark.createDataFrame([], "class_full_name string, path string, name string, type string, is_exported boolean, args string")
    return graph.CodeGraph(
        repository=t("region").select(F.col("r_name").alias("name")),
        file=t("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(path("n_nationkey").alias("path"), "repo", F.col("n_name").alias("name"), F.col("n_name").alias("module_name"), F.lit(1).alias("line_count")),
        method=t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("class_full_name"), F.col("o_orderpriority").alias("name"), F.array(F.concat(F.lit("key:"), "o_orderkey")).alias("params"), F.col("o_orderstatus").alias("return_type")),
        attribute=t("customer").select(F.col("c_name").alias("class_full_name"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("type")),
        function=t("supplier").select(path("s_nationkey").alias("path"), F.col("s_name").alias("name"), F.lit("").alias("params"), F.lit("").alias("return_type")),
        component=none.select("path", "name", "type", "is_exported"),
        hook=none.select("path", "name", "args"),
        **{"class": t("customer").select(F.col("c_name").alias("full_name"), path("c_nationkey").alias("path"), F.col("c_name").alias("name"))},
    )


FIRST_REGION = "(SELECT min(r_name) FROM region)"


def first(spark, d, name, column):
    return table(spark, d, name).agg(F.min(column)).first()[0]


@query(f"""
SELECT c_name AS name, 'n' || c_nationkey || '.py' AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = {FIRST_REGION} ORDER BY 1, 2 LIMIT 20""")
def graph_classes(spark, d):
    return code_graph(spark, d).command(f"classes {first(spark, d, 'region', 'r_name')}").select("name", "path")


@query("""
WITH one AS (SELECT min(c_name) AS c FROM customer)
SELECT c AS full_name, 'method' AS kind, o_orderpriority AS member, '(key:' || o_orderkey || ') -> ' || o_orderstatus AS detail FROM one JOIN customer ON c_name = c JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT c, 'attribute', 'segment', c_mktsegment FROM one JOIN customer ON c_name = c""")
def graph_class_detail(spark, d):
    return code_graph(spark, d).command(f"class {first(spark, d, 'customer', 'c_name')}")


@query("""
SELECT c_name AS class_full_name, o_orderpriority AS name, 'key:' || o_orderkey AS params FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND c_name = (SELECT min(c_name) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders))""")
def graph_method(spark, d):
    """The methods of the first name, of the first class that has one."""
    g = code_graph(spark, d)
    name = first(spark, d, "orders", "o_orderpriority")
    owner = g.t["method"].filter(F.col("name") == name).agg(F.min("class_full_name")).first()[0]
    return g.command(f"method {name} {owner}").select("class_full_name", "name", F.array_join("params", ",").alias("params"))


@query(f"""
SELECT s_name AS name, 'n' || s_nationkey || '.py' AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = {FIRST_REGION} ORDER BY 1, 2 LIMIT 20""")
def graph_functions(spark, d):
    return code_graph(spark, d).command(f"functions {first(spark, d, 'region', 'r_name')}").select("name", "path")


@query("SELECT c_name AS class_full_name, o_orderpriority AS name, 'key:' || o_orderkey AS params FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(c_name, '7')")
def graph_methods_of_class(spark, d):
    return code_graph(spark, d).methods_of_class("7").select("class_full_name", "name", F.array_join("params", ",").alias("params"))


@query("SELECT c_name AS name, c_name AS full_name FROM customer WHERE contains('n' || c_nationkey || '.py', '1')")
def graph_classes_in_file(spark, d):
    return code_graph(spark, d).classes_in_file("1")


@query("SELECT DISTINCT 'conv/' || conv_id AS path, role AS module FROM conversations WHERE contains(role, 'user')")
def graph_files_importing(spark, d):
    imports = table(spark, d, "conversations").select(F.concat(F.lit("conv/"), "conv_id").alias("path"), F.col("role").alias("module"))
    return code_graph(spark, d).files_importing(imports, "user")


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 1 THEN doc_id + 1 ELSE 1 END AS line, 'Code example for ' || source || chr(10) || chr(10) || 'Summary: Example code showing ' || source AS code_query FROM documents""")
def locations_and_code_queries(spark, d):
    """Line numbers out of three forms of locations, and the enhanced query of each source."""
    kind = F.col("doc_id") % 3
    where = F.when(kind == 0, F.concat(F.lit("at line "), "doc_id", F.lit(":9"))).when(kind == 1, F.concat("source", F.lit(".ts:"), F.col("doc_id") + 1, F.lit(":4"))).otherwise("nowhere")
    return table(spark, d, "documents").select("doc_id", T.line_number(where).alias("line"), T.code_query("source").alias("code_query"))


@query("""SELECT 'p' || p_partkey || '.tsx' AS path, 'Part' || p_partkey AS name FROM part WHERE p_size % 3 <> 0 AND length(p_name || ', ' || p_brand || ', ' || p_type || ', size = ' || p_size || ', price = 0, stock = 1, seller = 2') > 50""")
def missing_memo_components(spark, d):
    """Components, one a part, that take many properties; those of every third size are in memo()."""
    props = F.concat_ws(", ", "p_name", "p_brand", "p_type", F.concat(F.lit("size = "), "p_size"), F.lit("price = 0"), F.lit("stock = 1"), F.lit("seller = 2"))
    head = F.concat(F.lit("const Part"), "p_partkey", F.lit(" = ("), props, F.lit(") => null;\n"))
    content = F.when(F.col("p_size") % 3 == 0, F.concat(head, F.lit("export default memo(Part);\n"))).otherwise(head)
    files = dealt(table(spark, d, "part"), "p_partkey").select(F.concat(F.lit("p"), "p_partkey", F.lit(".tsx")).alias("path"), content.alias("content"))
    return rules.missing_memo(files).select("path", F.col("message").alias("name"))


def shapes(spark, d):
    """A source file for each part; parts are dealt out first, as a small table may be read by one task."""
    part = dealt(table(spark, d, "part"), "p_partkey").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit("")))
    return part.select(F.expr("'p' || p_partkey || '.ts'").alias("path"), F.expr(SHAPE).alias("content"))


SHAPE = """'export interface Part' || p_partkey || ' extends Base, Sized<' || p_brand || '> {' || chr(10) || '  name: string;' || chr(10) || '  size' || CASE WHEN p_size % 2 = 0 THEN '?' ELSE '' END || ': number;' || chr(10) || '  readonly tags: string[]' || chr(10) || '}' || chr(10) || 'type Kind = ' || p_type || ' | null;' || chr(10) || 'type Box = { w: number, h?: number }' || chr(10)"""


@query("""
SELECT 'p' || p_partkey || '.ts' AS path, label, name, extends, definition, properties FROM part, (VALUES ('interface', 1), ('type', 2), ('type', 3)) v(label, i),
  LATERAL (SELECT CASE i WHEN 1 THEN 'Part' || p_partkey WHEN 2 THEN 'Box' ELSE 'Kind' END AS name, CASE i WHEN 1 THEN 'Base, Sized<' || replace(p_brand, '#', '') || '>' END AS extends, CASE i WHEN 3 THEN p_type || ' | null' END AS definition,
  CASE i WHEN 1 THEN 'name:string size' || CASE WHEN p_size % 2 = 0 THEN '?' ELSE '' END || ':number tags:string[]' WHEN 2 THEN 'w:number h?:number' ELSE '' END AS properties) x""")
def declared_type_nodes(spark, d):
    """Interfaces, object types and aliases of a source file for each part."""
    files = shapes(spark, d)
    shown = F.transform("properties", lambda p: F.concat(p["name"], F.when(p["optional"], "?").otherwise(""), F.lit(":"), p["type"]))
    return extract.declared_types(files).select("path", "label", "name", "extends", "definition", F.array_join(shown, " ").alias("properties"))


@query("""
SELECT kind, count(*) AS n FROM part, (SELECT unnest(['DEFINES_INTERFACE', 'DEFINES_TYPE', 'DEFINES_TYPE', 'HAS_PROPERTY', 'HAS_PROPERTY', 'HAS_PROPERTY', 'HAS_PROPERTY', 'HAS_PROPERTY', 'EXTENDS', 'EXTENDS']) AS kind) k GROUP BY kind""")
def declared_type_edges(spark, d):
    files = shapes(spark, d)
    return extract.type_edges(extract.declared_types(files)).groupBy("kind").agg(F.count("*").alias("n"))
