"""Hierarchy and graph queries; region, nation, customer and orders stand for repository, file, class and method."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans.registry import query, table


def hierarchy(spark, d) -> graph.Hierarchy:
    t = lambda n: table(spark, d, n)
    return graph.Hierarchy([
        graph.Level(t("region"), "r_regionkey", None, "r_name"),
        graph.Level(t("nation"), "n_nationkey", "n_regionkey", "n_name"),
        graph.Level(t("customer"), "c_custkey", "c_nationkey", "c_name"),
        graph.Level(t("orders"), "o_orderkey", "o_custkey", "o_orderpriority"),
    ])


@query("SELECT r_name AS name FROM region")
def graph_repos(spark, d):
    return hierarchy(spark, d).roots()


COUNTS = """
SELECT r_regionkey AS root, r_name AS name, count(DISTINCT n_nationkey) AS level1, count(DISTINCT c_custkey) AS level2, count(DISTINCT o_orderkey) AS level3
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey"""


@query(COUNTS + " WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY 1, 2")
def graph_explore(spark, d):
    h = hierarchy(spark, d)
    first = table(spark, d, "region").agg(F.min("r_name").alias("r_name"))
    h.levels[0].rows = h.levels[0].rows.join(F.broadcast(first), "r_name", "left_semi")
    return h.counts()


@query(COUNTS + " GROUP BY 1, 2")
def graph_stats_optional(spark, d):
    return hierarchy(spark, d).counts()


@query("SELECT c_name AS name, c_custkey AS key, count(*) OVER () >= 20 AS limited FROM (SELECT * FROM customer ORDER BY c_name, c_custkey LIMIT 20)")
def graph_children_top20(spark, d):
    return hierarchy(spark, d).children(2)


@query("""
SELECT c_name AS name, c_custkey AS key, count(*) OVER () >= 20 AS limited FROM (
  SELECT c_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY 1, 2 LIMIT 20)""")
def graph_children_of_root(spark, d):
    return hierarchy(spark, d).children(2, "ASIA")


@query("""
WITH one AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7 ORDER BY 1 LIMIT 1)
SELECT c_custkey AS key, c_name AS name, o_orderpriority AS child FROM one LEFT JOIN orders ON o_custkey = c_custkey""")
def graph_node_detail(spark, d):
    return hierarchy(spark, d).detail(2, "7")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '42')")
def graph_search(spark, d):
    return graph.search(table(spark, d, "customer"), "c_name", "42").select("c_custkey", "c_name")


@query("""
SELECT n_nationkey AS key, array_to_string(list_sort(list(DISTINCT c_name))[1:5], ',') AS first_five, count(DISTINCT c_name) AS n
FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def graph_collect_slice(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return graph.first_children(rows, ["n_nationkey"], "c_name").select(F.col("n_nationkey").alias("key"), F.array_join("values", ",").alias("first_five"), "n")


@query("""
SELECT 'nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region""")
def label_counts(spark, d):
    return graph.label_counts({n: table(spark, d, n) for n in ("nation", "customer", "orders", "region")})


@query("""
SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) <= 10""")
def graph_first_files(spark, d):
    rows = table(spark, d, "customer")
    return graph.first_rows(rows, ["c_nationkey"], ["c_name", "c_custkey"]).select("c_nationkey", "c_custkey", "c_name")


@query("""
WITH k AS (SELECT min(r_regionkey) AS r FROM region),
n AS (SELECT * FROM nation WHERE n_regionkey <> (SELECT r FROM k)),
c AS (SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT r FROM k))),
o AS (SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer x JOIN nation y ON x.c_nationkey = y.n_nationkey WHERE x.c_custkey = o.o_custkey AND y.n_regionkey = (SELECT r FROM k)))
SELECT 'region' AS label, count(*) AS n FROM region WHERE r_regionkey <> (SELECT r FROM k) UNION ALL SELECT 'nation', count(*) FROM n
UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'orders', count(*) FROM o""")
def cascade_delete(spark, d):
    h = hierarchy(spark, d)
    left = graph.cascade_delete(h.levels, 0)
    return graph.label_counts(dict(zip(("region", "nation", "customer", "orders"), left)))


@query("""
WITH a AS (SELECT o_custkey AS key, 'first' AS how, arg_min(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT o_custkey AS key, 'second' AS how, arg_min(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.key = b.key""")
def merge_first_wins(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("v"))
    return graph.merge_nodes(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"), ["key"], "seq").select("key", "v")


@query("""
SELECT c_custkey, c_name, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
  (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS n_priorities FROM customer""")
def optional_branches(spark, d):
    o = table(spark, d, "orders")
    branch = lambda v: o.select(F.col("o_custkey").alias("key"), F.col(v).alias("value"))
    return graph.optional_stats(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", {"n_orders": branch("o_orderkey"), "n_priorities": branch("o_orderpriority")})
