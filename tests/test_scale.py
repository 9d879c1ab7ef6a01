"""Steps that must not grow faster than what they read, or lie in one task."""

from pyspark.sql import functions as F

from lodestone.operators import catalog, containment, ingest, latent, summaries, text_index
from lodestone.plans import lookups
from lodestone.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_parameters_are_looked_up(spark):
    names = ["get_user", "getXuser_1", "a%b", "100%_x", "Straße_7", "x\\y", "", "ΑΣ", "s1/get_user_all_2", None]
    routines = spark.createDataFrame([(n,) for n in ["get_user", "get_user", "user", "%", "_", "\\%", "ß", "ΑΣ", "x\\\\y", "none_such", "", None]], "name string")
    parameters = spark.createDataFrame([(n, f"p{i}", "t", i) for i, n in enumerate(names)], "specific_name string, name string, type string, position int")
    got = catalog.function_parameters(routines, parameters)
    want = routines.withColumnRenamed("name", "function").join(parameters, F.expr("specific_name LIKE concat('%', function, '%')")).select("function", "name", "type", "position")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # Only routines of nothing but wildcards meet every name.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, specific_name") <= 1 and "piece" in plan


def test_walks_of_more_rows_than_the_guard(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)], "src long, dst long")
    had = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        got = ingest.frontiers_recursive(spark.createDataFrame([(0, 0)], "start long, node long"), edges, 2)
        assert got.count() == 30
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "10"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", had)


def test_files_of_a_small_table_lie_in_many_tasks(spark):
    assert fixtures.files(spark, SF).rdd.getNumPartitions() == 4  # the session's


def test_parts_lie_in_many_tasks(spark):
    assert lookups.shapes(spark, SF).rdd.getNumPartitions() == 4


def broadcast_columns(df):
    """The columns of the files below each broadcast of a plan."""
    found, depth = set(), None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = at if "BroadcastExchange" in line and depth is None else None if depth is not None and at <= depth else depth
        if depth is not None and "FileScan" in line:
            found |= {c.split("#")[0] for c in line.split("[", 1)[1].split("]")[0].split(",")}
    return found


def test_postings_and_counts_are_not_broadcast(spark):
    """As files they look small, whatever they hold."""
    docs = spark.range(200).select("id", F.concat_ws(" ", F.lit("same words"), F.md5(F.col("id").cast("string"))).alias("text"))
    asked = spark.createDataFrame([(1, "same"), (2, "words 0"), (3, "or")], "pattern_id long, pattern string")
    hits = text_index.keyword_hits(text_index.build_keyword_index(docs, ["text"]), asked)
    assert hits.count() >= 400 and not broadcast_columns(hits) & {"ids", "segment", "n", "text"}
    stats = text_index.corpus_statistics(docs, "text")
    queries = asked.select(F.col("pattern_id").alias("query_id"), F.col("pattern").alias("query"))
    found = queries.select("query_id").crossJoin(docs.select("id")).withColumn("rank", F.lit(1))
    scored = text_index.bm25_rerank(stats, queries, found)
    assert scored.count() == 600 and "tf" not in broadcast_columns(scored)


def test_factors_are_not_broadcast(spark):
    docs = spark.range(90).select("id", F.concat_ws(" ", F.lit("a b"), (F.col("id") % 7).cast("string"), (F.col("id") % 11).cast("string")).alias("text"))
    docs = docs.unionByName(docs.filter("id = 3")).unionByName(spark.createDataFrame([(500, None)], "id long, text string"))
    model = latent.fit(docs, "text", k=2, rounds=1)
    embedded = model.embed(docs.distinct(), "text")
    want, got = ({r.id: r.embedding for r in d.collect()} for d in (embedded, model.fitted()))
    assert got.keys() == want.keys() - {500} and all(abs(x - y) < 1e-9 for i in got for x, y in zip(got[i], want[i]))
    assert not broadcast_columns(embedded) & {"idf", "v0"} and not broadcast_columns(model.fitted())


def test_terms_of_common_words_stay_in_their_rows(spark):
    text = [f"alpha beta w{i % 5} w{i % 3} only{i} gamma alpha. one{i} two{i} three{i} four{i}." for i in range(40)]
    docs = spark.createDataFrame([("ab"[i % 2], t) for i, t in enumerate(text)], "source string, text string")
    got = [[tuple(r) for r in summaries.summaries(docs, "source", "text", 5, heavy_words=n).orderBy("source", "rank").collect()] for n in (0, 3, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 10
    graph = summaries.graph_of(summaries.sentences_of(docs, "source", "text"), 4)
    assert graph.light.count() == 0 and graph.lengths.filter("own = square").count() == 40


def test_rows_of_documents_are_not_dealt_out_for_few_filters(spark):
    docs = spark.range(50).select("id", F.to_json(F.struct((F.col("id") % 5).alias("k"), F.lit("x").alias("t"))).alias("doc"))
    asked = docs.select("doc").distinct().withColumn("filter_id", F.xxhash64("doc"))
    hits = containment.contained(docs, "doc", asked, "doc")
    assert hits.count() == 50
    assert not [x for x in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(path" in x]


def test_lists_are_made_once(spark, tmp_path):
    """Dealing by ranges ran the making of all lists a first time for the bounds; a file for each task that made some tells."""
    rows = spark.range(40).select("id", F.concat(F.lit("same text "), F.col("id").cast("string")).alias("text")).repartition(3)
    index = text_index.build_keyword_index(rows, ["text"])
    assert len(index.postings.inputFiles()) == 3
    asked = spark.createDataFrame([(1, "sa"), (2, "SA"), (3, "%"), (4, "1")], "pattern_id long, pattern string")
    found = {r.pattern_id: r.n for r in text_index.keyword_hits(index, asked).groupBy("pattern_id").agg(F.count("*").alias("n")).collect()}
    assert found == {1: 40, 2: 40, 3: 40, 4: 13}
