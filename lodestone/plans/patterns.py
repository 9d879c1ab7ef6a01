"""Graph patterns; region, nation, customer and orders stand for repository, file, class and method."""

from __future__ import annotations

from lodestone.operators import match
from lodestone.plans.registry import query, table


def graph(spark, d) -> match.Graph:
    t = lambda n: table(spark, d, n)
    g = match.Graph().node("region", t("region"), "r_regionkey").node("nation", t("nation"), "n_nationkey").node("customer", t("customer"), "c_custkey").node("orders", t("orders"), "o_orderkey").node("supplier", t("supplier"), "s_suppkey")
    g = g.edge("HOLDS", "region", "nation", t("nation"), "n_regionkey", "n_nationkey").edge("HAS", "nation", "customer", t("customer"), "c_nationkey", "c_custkey")
    return g.edge("PLACED", "customer", "orders", t("orders"), "o_custkey", "o_orderkey").edge("SERVES", "supplier", "nation", t("supplier"), "s_suppkey", "s_nationkey")


@query("""
SELECT r_name AS region, n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, min(o_orderpriority) AS first_priority
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def pattern_chain(spark, d):
    return match.match(graph(spark, d), "MATCH (r:region)-[:HOLDS]->(n)-[:HAS]->(c)-[:PLACED]->(o) RETURN r.r_name AS region, n.n_name AS nation, count(DISTINCT c) AS customers, count(DISTINCT o) AS orders, min(o.o_orderpriority) AS first_priority")


@query("""
SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
  (SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 1000) AS orders,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers,
  array_to_string((SELECT list_sort(list(DISTINCT s_name)) FROM supplier WHERE s_nationkey = n_nationkey)[1:3], ',') AS first_suppliers
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""")
def pattern_optional_branches(spark, d):
    """Three branches of a nation, each aggregated before it is joined."""
    from pyspark.sql import functions as F

    out = match.match(
        graph(spark, d),
        """MATCH (r:region)-[:HOLDS]->(n:nation) OPTIONAL MATCH (n)-[:HAS]->(c:customer) OPTIONAL MATCH (n)-[:HAS]->(d:customer)-[:PLACED]->(o:orders)
        OPTIONAL MATCH (n)<-[:SERVES]-(s:supplier) WHERE r.r_name <> 'ASIA' AND o.o_totalprice > 1000
        RETURN n.n_name AS nation, count(DISTINCT c) AS customers, count(DISTINCT o) AS orders, count(DISTINCT s) AS suppliers, collect(DISTINCT s.s_name)[0..3] AS first_suppliers""",
    )
    return out.withColumn("first_suppliers", F.nullif(F.array_join("first_suppliers", ","), F.lit("")))


@query("""
SELECT c_name AS customer, o_orderkey AS o, o_orderpriority AS priority FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority LIKE '1%'
WHERE r_name = (SELECT min(r_name) FROM region)""")
def pattern_left_rows(spark, d):
    """Rows of an optional branch beside those without one, from a region that is fixed."""
    first = table(spark, d, "region").agg({"r_name": "min"}).first()[0]
    return match.match(graph(spark, d), f"MATCH (c:customer)<-[:HAS]-(n:nation)<-[:HOLDS]-(r:region {{r_name: '{first}'}}) OPTIONAL MATCH (c)-[:PLACED]->(o:orders) WHERE o.o_orderpriority STARTS WITH '1' RETURN c.c_name AS customer, o, o.o_orderpriority AS priority")
