"""Queries over composed ingest and search: pages that links lead to, stored tables, code examples, full search responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ingest, retrieve
from lodestone.plans.corpus import LINKS, MARKDOWN_SQL, chunk_sql, markdown
from lodestone.plans.registry import query, table
from lodestone.sources import fixtures as X
from lodestone.sources import files as S

HOST = "regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)"
#: From the first page of each site, over links of that site, two hops at most.
REACHED = f"""
l AS ({LINKS}),
e AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/#?]+)', 1) || href ELSE href END AS dst FROM l),
i AS (SELECT src, dst FROM e WHERE {HOST.format('src')} = {HOST.format('dst')}),
s AS (SELECT regexp_replace(min(url), '#.*$', '') AS node FROM pages GROUP BY {HOST.format('url')}),
r AS (SELECT node, 0 AS depth FROM s UNION SELECT i.dst, r.depth + 1 FROM r JOIN i ON i.src = r.node WHERE r.depth < 2),
found AS (SELECT node AS url, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE node IN (SELECT regexp_replace(url, '#.*$', '') FROM pages) GROUP BY node)"""


def starts(spark, d):
    return table(spark, d, "pages").groupBy(T.source_id("url")).agg(F.min("url").alias("url")).select("url")


@query(f"WITH RECURSIVE {REACHED} SELECT url, depth FROM found")
def crawl_reached(spark, d):
    return ingest.reached_pages(table(spark, d, "pages"), starts(spark, d), 3)


STORED = f"""WITH RECURSIVE {REACHED},
p AS (SELECT regexp_replace(url, '#.*$', '') AS url, html, row_number() OVER (PARTITION BY regexp_replace(url, '#.*$', '') ORDER BY md5(html)) AS n FROM pages WHERE regexp_replace(url, '#.*$', '') IN (SELECT url FROM found)),
documents AS (SELECT url AS doc_id, html AS text, url AS source FROM p WHERE n = 1 AND length(html) > 0), """ + chunk_sql(1000).replace("WITH RECURSIVE", "", 1).strip()


def stored(spark, d):
    """Every site's first page is asked for; all are web pages."""
    return ingest.crawl(table(spark, d, "pages"), starts(spark, d), 3, 1000, 100)


@query(STORED + " SELECT doc_id AS url, chunk_number, md5(content) AS digest FROM chunked")
def crawl_stored_chunks(spark, d):
    return stored(spark, d)["crawled_pages"].select("url", "chunk_number", F.md5("content").alias("digest"))


@query(STORED + f""" SELECT count(DISTINCT doc_id) AS pages, count(*) AS chunks, 0 AS code_examples, count(DISTINCT {HOST.format('doc_id')}) AS sources,
  (SELECT string_agg(u, ',' ORDER BY u) FROM (SELECT DISTINCT doc_id AS u FROM chunked ORDER BY u LIMIT 5)) || CASE WHEN count(DISTINCT doc_id) > 5 THEN '...' ELSE '' END AS urls FROM chunked""")
def crawl_stored_report(spark, d):
    return stored(spark, d)["report"]


SITE = [
    ("http://a.org/notes.txt", "plain notes\n```python\n" + "x = 1\n" * 4 + "```\nend"),
    ("http://a.org/sitemap.xml", "<urlset xmlns='u'><url><loc>http://a.org/one</loc></url><url><loc> http://a.org/two </loc></url><url><loc>http://a.org/gone</loc></url></urlset>"),
    ("http://a.org/one", '<a href="/three">x</a><a href="http://b.org/">y</a>'),
    ("http://a.org/two#top", "two"),
    ("http://a.org/three", '<a href="/four">x</a>'),
    ("http://a.org/four", "four"),
    ("http://b.org/", '<a href="/deep#here">z</a>'),
    ("http://b.org/deep", ""),
    ("http://c.org/unasked", "no"),
]
ROUTED = [("http://a.org/notes.txt", "text_file"), ("http://a.org/one", "sitemap"), ("http://a.org/two", "sitemap"), ("http://b.org/", "webpage")]


@query(f"WITH {X.values_over('w', 'p, url, crawl_type', [(0, *r) for r in ROUTED], 'p')} SELECT replace(url, 'http://', 'http://p' || p || '.') AS url, crawl_type FROM w")
def crawl_routes(spark, d):
    """A text file, a sitemap and a web page are asked for; what links leave a site is not followed, empty pages are not kept."""
    own = lambda c: F.replace(c, F.lit("http://"), F.concat(F.lit("http://p"), "p", F.lit("."))).alias(c)  # noqa: E731  the hosts of each project
    pages = X.over(spark, d, [(0, *p) for p in SITE], "p long, url string, html string", "p").select(own("url"), own("html"))
    asked = X.over(spark, d, [(0, u) for u in ("http://a.org/notes.txt", "http://a.org/sitemap.xml", "http://b.org/")], "p long, url string", "p").select(own("url"))
    return ingest.wanted_pages(pages, asked).select("url", "crawl_type")


PATHS = [  # path, size, python, typescript, kept by a whole-tree scan
    ("src/a.py", 10, True, False, True), ("src/deep/er/b.py", 10, True, False, True), ("a.py", 10, False, False, True), ("src/test_a.py", 10, False, False, True),
    ("src/testing.py", 10, False, False, True), ("src/a_test.py", 10, False, False, True), ("src/tests/c.py", 10, False, False, True), ("src/.hidden/d.py", 10, False, False, True),
    ("src/build/e.py", 10, True, False, False), ("src/big.py", 500000, False, False, True), ("src/W.tsx", 10, False, True, True), ("src/W.test.tsx", 10, False, False, True),
    ("src/test.ts", 10, False, False, True), ("src/x.spec.js", 10, False, False, True), ("src/__tests__/y.ts", 10, False, False, True), ("src/vite.config.ts", 10, False, False, True),
    ("src/dist/z.js", 10, False, True, False), ("lib/z.js", 10, False, False, True), ("src/run.log", 1, False, False, False), (".git/config", 1, False, False, False), ("src/.cache", 1, False, False, True), ("src/a.pyc", 1, False, False, False),
]


@query(f"WITH {X.values_over('p', 'id, path, size, python, typescript, kept', [(i, *p) for i, p in enumerate(PATHS)], 'id')} SELECT id, path, python, typescript, kept FROM p")
def source_tree(spark, d):
    rows = X.over(spark, d, [(i, *p[:2]) for i, p in enumerate(PATHS)], "id long, path string, size long", "id")
    return rows.select("id", "path", S.is_python_source(F.col("path"), F.col("size")).alias("python"), S.is_typescript_source(F.col("path"), F.col("size")).alias("typescript"), S.is_kept_file(F.col("path")).alias("kept"))


def code_table(spark, d):
    """Code blocks of conversations with the embeddings of their conversations."""
    blocks = ingest.code_example_table(markdown(spark, d), "conv_id", "markdown", 50)
    rows = ingest.code_store(blocks.withColumn("url", F.concat(F.lit("conv/"), "conv_id"))).select("url", "chunk_number", "content", "summary", "embedded_text")
    rows = rows.withColumn("conv_id", F.substring("url", 6, 20).cast("long")).withColumn("id", F.col("conv_id") * 1000 + F.col("chunk_number"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding", F.concat(F.lit("label"), "label").alias("source"))
    return rows.join(vectors, "conv_id")


CODE_SQL = MARKDOWN_SQL + """,
sp AS (SELECT conv_id, string_split(markdown, '```') AS p FROM md),
bl AS (SELECT conv_id, p, unnest(generate_series(2, len(p) - 1, 2)) AS i FROM sp WHERE len(p) >= 3),
fi AS (SELECT conv_id, i, p[i] AS body, trim(split_part(p[i], chr(10), 1), chr(32) || chr(9) || chr(10)) AS first FROM bl),
co AS (SELECT conv_id, i, regexp_replace(CASE WHEN contains(body, chr(10)) AND first <> '' AND NOT contains(first, ' ') AND length(first) < 20 THEN substr(body, strpos(body, chr(10)) + 1) ELSE body END, '^\\s+|\\s+$', '', 'g') AS content FROM fi),
ex AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS BIGINT) AS chunk_number, content, 'Code example for demonstration purposes.' AS summary FROM co WHERE length(content) >= 50)"""


@query(CODE_SQL + """ SELECT conv_id * 1000 + chunk_number AS id, md5(content || chr(10) || chr(10) || 'Summary: ' || summary) AS embedded FROM ex JOIN embeddings ON vec_id = conv_id""")
def code_examples_stored(spark, d):
    return code_table(spark, d).select("id", F.md5("embedded_text").alias("embedded"))


def ranked_sql(rows: str, words: str, k: int, source: str = "true") -> str:
    """Hybrid search of rows (id, content, summary, embedding, source) and reranking, as SQL."""
    listed = ", ".join(f"'{w}'" for w in words.split())
    return f"""
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id = 0),
t AS (SELECT * FROM {rows} WHERE {source}),
v AS (SELECT id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe) AS similarity, row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe) DESC, id) AS v_rank FROM t, q QUALIFY v_rank <= {2 * k}),
w AS (SELECT id, row_number() OVER (ORDER BY id) AS k_rank FROM t WHERE content ILIKE '%{words}%' OR summary ILIKE '%{words}%' QUALIFY k_rank <= {2 * k}),
m AS (SELECT coalesce(v.id, w.id) AS id, similarity, v_rank, k_rank, CASE WHEN v_rank IS NOT NULL AND k_rank IS NOT NULL THEN 0 WHEN v_rank IS NOT NULL THEN 1 ELSE 2 END AS tier FROM v FULL JOIN w ON v.id = w.id),
o AS (SELECT row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN v_rank ELSE k_rank END, id) AS rank, id, CASE tier WHEN 0 THEN least(1.0, similarity * 1.2) WHEN 1 THEN similarity ELSE 0.5 END AS similarity, CAST(tier AS BIGINT) AS tier FROM m),
h AS (SELECT rank, o.id, round(o.similarity, 6) AS similarity, tier, round(len(list_intersect([{listed}], list_distinct(string_split_regex(lower(content), '[^a-zA-Z0-9_]+')))) / {len(words.split())}.0, 6) AS rerank_score FROM o JOIN t ON t.id = o.id WHERE rank <= {k})"""


def query_vector(spark, d):
    return list(table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first().embedding)



def shown(hits):
    return hits.select("rank", "id", F.round("similarity", 6).alias("similarity"), "tier", F.round("rerank_score", 6).alias("rerank_score"))


@query(CODE_SQL + ", ce AS (SELECT conv_id * 1000 + chunk_number AS id, content, summary, embedding, 'label' || label AS source FROM ex JOIN embeddings ON vec_id = conv_id)," + ranked_sql("ce", "the", 8) + " SELECT * FROM h")
def code_search(spark, d):
    return shown(retrieve.code_search(code_table(spark, d), "the", query_vector(spark, d), 8, reranking=True))


def chunk_table(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", F.lit("").alias("summary"))
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


CHUNKS = "(SELECT doc_id AS id, text AS content, '' AS summary, embedding, source FROM documents JOIN embeddings ON vec_id = doc_id)"


@query("WITH " + ranked_sql(CHUNKS, "and", 10).strip() + " SELECT * FROM h")
def rag_hybrid_reranked(spark, d):
    return shown(retrieve.rag_query(chunk_table(spark, d), "and", query_vector(spark, d), 10, hybrid=True, reranking=True))


@query("WITH " + ranked_sql(CHUNKS, "and", 5, "source = 'src3'").strip() + """
SELECT '{"success":true,"query":"and","source_filter":"src3","search_mode":"hybrid","results":[' || coalesce(string_agg('{"rank":' || rank || ',"id":' || id || ',"tier":' || tier || '}', ',' ORDER BY rank), '') || '],"metadata":{"total_results":' || count(*) || ',"limited":' || (count(*) >= 5) || '}}' AS response FROM h""")
def search_response(spark, d):
    hits = retrieve.rag_query(chunk_table(spark, d), "and", query_vector(spark, d), 5, "src3")
    return retrieve.search_response(hits, "and", ("id", "tier"), "hybrid", "src3", 5)


