"""Queries over pages and documents: URLs, chunks, ingest, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ingest, retrieve
from lodestone.plans.registry import query, table


@query("""
SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ''), url) AS source_id FROM pages""")
def url_source_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.source_id("url").alias("source_id"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def url_defrag(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_url("url").alias("url"))


@query("""
SELECT page_id, CASE WHEN ends_with(url, '.txt') THEN 'text_file'
  WHEN ends_with(url, 'sitemap.xml') OR contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 'sitemap') THEN 'sitemap'
  ELSE 'webpage' END AS route FROM pages""")
def url_route(spark, d):
    return table(spark, d, "pages").select("page_id", T.crawl_route("url").alias("route"))


@query("""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n_pages, CAST(sum(length(html)) AS BIGINT) AS n_chars,
  min(url) AS first_url FROM pages GROUP BY 1""")
def host_page_counts(spark, d):
    return table(spark, d, "pages").groupBy(T.source_id("url").alias("host")).agg(F.count("*").alias("n_pages"), F.sum(F.length("html")).alias("n_chars"), F.min("url").alias("first_url"))


LINKS = """
SELECT DISTINCT url, regexp_replace(href, '#.*$', '') AS href FROM
  (SELECT url, unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)) AS href FROM pages)"""


@query(LINKS)
def links_extract(spark, d):
    return ingest.page_links(table(spark, d, "pages"))


@query(f"""
WITH l AS ({LINKS}),
e AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src,
  CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/#?]+)', 1) || href ELSE href END AS dst FROM l)
SELECT src, count(*) AS n_links, count(DISTINCT regexp_extract(dst, '^[a-z]+://([^/#?]+)', 1)) AS n_hosts FROM e GROUP BY src""")
def page_link_degrees(spark, d):
    e = ingest.page_links(table(spark, d, "pages")).select(T.normalize_url("url").alias("src"), ingest.absolute(F.col("url"), F.col("href")).alias("dst")).distinct()
    return e.groupBy("src").agg(F.count("*").alias("n_links"), F.count_distinct(F.regexp_extract("dst", "^[a-z]+://([^/#?]+)", 1)).alias("n_hosts"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
r AS (SELECT 's' || min(l_suppkey) AS node, 0 AS depth FROM lineitem
  UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node""")
def frontier_bfs(spark, d):
    """Two hops over the whole part-supplier graph."""
    li = table(spark, d, "lineitem")
    one = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    edges = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = li.agg(F.concat(F.lit("s"), F.min("l_suppkey")).alias("node"))
    return ingest.frontier(start, edges, 3)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
r AS (SELECT 's' || min(l_suppkey) AS node, 0 AS depth FROM lineitem
  UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node""")
def frontier_bfs_all(spark, d):
    """The same under the name that it had when the other one left rows out."""
    return frontier_bfs(spark, d)


@query("SELECT page_id AS id, unnest([url, url || '/next']) AS url FROM pages")
def sitemap_locs(spark, d):
    """A sitemap of each page, in a namespace or in none, with two addresses."""
    loc = lambda x: F.concat(F.lit("<url><loc> "), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    space = F.when(F.col("page_id") % 2 == 0, " xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'").otherwise("")
    url = F.col("url")
    xml = F.concat(F.lit("<urlset"), space, F.lit(">"), loc(url), loc(F.concat(url, F.lit("/next"))), F.lit("</urlset>"))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.explode(ingest.sitemap_urls(xml)).alias("url"))


def chunk_sql(size: int) -> str:
    rfind = lambda s: f"CASE WHEN strpos(reverse(w), '{s[::-1]}') = 0 THEN -1 ELSE length(w) - strpos(reverse(w), '{s[::-1]}') - {len(s) - 1} END"
    blank = rfind("\n\n")
    return f"""
WITH RECURSIVE c AS (
  SELECT doc_id, text, source, 0 AS st, 0 AS n, CAST(NULL AS VARCHAR) AS raw, false AS last FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, source, st + cut, n + 1, CASE WHEN done THEN w ELSE substr(w, 1, cut) END, done FROM (
    SELECT *, CASE WHEN f > 0.3 * {size} THEN f WHEN b >= 0 THEN CASE WHEN b > 0.3 * {size} THEN b ELSE {size} END
      WHEN s > 0.3 * {size} THEN s + 1 ELSE {size} END AS cut, st + {size} >= length(text) AS done FROM (
      SELECT *, {rfind("```")} AS f, {blank} AS b, {rfind(". ")} AS s FROM (
        SELECT *, substr(text, st + 1, {size}) AS w FROM c WHERE NOT last)))),
t AS (SELECT doc_id, source, st, last, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS content, n FROM c WHERE n > 0),
chunked AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS BIGINT) AS chunk_number, content
  FROM t WHERE last OR content <> '')"""


def chunked(spark, d, size):
    return ingest.chunk_rows(table(spark, d, "documents").select("doc_id", "source", "text"), "text", size)


@query(chunk_sql(500) + "SELECT doc_id, chunk_number, content FROM chunked")
def chunk_documents(spark, d):
    return chunked(spark, d, 500).select("doc_id", "chunk_number", "content")


@query(chunk_sql(5000) + "SELECT doc_id, chunk_number, md5(content) AS digest, CAST(length(content) AS BIGINT) AS char_count FROM chunked")
def chunk_documents_default(spark, d):
    return chunked(spark, d, 5000).select("doc_id", "chunk_number", F.md5("content").alias("digest"), "char_count")


@query(chunk_sql(1000) + """
SELECT source, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS char_count,
  CAST(sum(len(regexp_extract_all(content, '[^\\s]+'))) AS BIGINT) AS word_count FROM chunked GROUP BY source""")
def chunk_stats(spark, d):
    return chunked(spark, d, 1000).groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum("char_count").alias("char_count"), F.sum("word_count").alias("word_count"))


MARKDOWN_SQL = """
WITH md AS (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN '```text' || chr(10) || text || chr(10) || '```'
  WHEN 'system' THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id)"""


def markdown(spark, d):
    """Conversations as Markdown: system turns are headers, assistant turns fenced blocks."""
    part = F.when(F.col("role") == "assistant", F.concat(F.lit("```text\n"), "text", F.lit("\n```"))).when(F.col("role") == "system", F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("turns"))
    return turns.select("conv_id", F.array_join("turns.part", "\n\n").alias("markdown"))


@query(MARKDOWN_SQL + """
SELECT conv_id, list_aggregate(list_transform(list_zip(regexp_extract_all(markdown, '(?m)^(#+)\\s+(.+)$', 1), regexp_extract_all(markdown, '(?m)^(#+)\\s+(.+)$', 2)),
  lambda x: x[1] || ' ' || x[2]), 'string_agg', '; ') AS headers, CAST(length(markdown) AS BIGINT) AS char_count,
  CAST(len(regexp_extract_all(markdown, '[^\\s]+')) AS BIGINT) AS word_count FROM md
WHERE regexp_matches(markdown, '(?m)^#+\\s+.+$')""")
def chunk_headers(spark, d):
    info = T.section_info("markdown")
    return markdown(spark, d).select("conv_id", info["headers"].alias("headers"), info["char_count"].alias("char_count"), info["word_count"].alias("word_count")).filter("headers <> ''")


def blocks_sql(least: int) -> str:
    return MARKDOWN_SQL + f""",
s AS (SELECT conv_id, string_split(markdown, '```') AS p FROM md),
b AS (SELECT conv_id, p, unnest(generate_series(2, len(p) - 1, 2)) AS i FROM s WHERE len(p) >= 3),
c AS (SELECT conv_id, i, p[i] AS body, trim(split_part(p[i], chr(10), 1), chr(32) || chr(9) || chr(10)) AS first FROM b),
k AS (SELECT conv_id, i, CASE WHEN contains(body, chr(10)) AND first <> '' AND NOT contains(first, ' ') AND length(first) < 20 THEN first ELSE '' END AS language, body FROM c),
r AS (SELECT conv_id, i, language, regexp_replace(CASE WHEN language <> '' THEN substr(body, strpos(body, chr(10)) + 1) ELSE body END, '^\\s+|\\s+$', '', 'g') AS code FROM k)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS BIGINT) AS block, language, code FROM r WHERE length(code) >= {least}"""


def _blocks(spark, d, least):
    return ingest.code_example_table(markdown(spark, d), "conv_id", "markdown", least).select("conv_id", "block", "language", "code")


@query(blocks_sql(0))
def code_blocks(spark, d):
    return _blocks(spark, d, 0)


@query(blocks_sql(300))
def code_blocks_min_len(spark, d):
    return _blocks(spark, d, 300)


@query("""
SELECT source AS source_id, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '[^\\s]+'))) AS BIGINT) AS total_words,
  arg_min(substr(text, 1, 5000), doc_id) AS first_text FROM documents GROUP BY source""")
def source_rollup(spark, d):
    return ingest.source_rollup(table(spark, d, "documents"), "source", T.word_count("text"), "text", "doc_id")


@query("""
SELECT doc_id, text, source FROM documents WHERE doc_id % 2 <> 0
UNION ALL SELECT doc_id, 'new ' || text, source FROM documents WHERE doc_id % 2 = 0""")
def replace_by_key(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    incoming = docs.filter("doc_id % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return ingest.replace_by_key(docs, incoming, "doc_id")


@query("""
WITH o AS (SELECT source AS source_id, CAST(count(*) AS BIGINT) AS total_word_count, 'old' AS summary FROM documents WHERE lang <> 'de' GROUP BY source),
n AS (SELECT source AS source_id, CAST(sum(n_chars) AS BIGINT) AS total_word_count, 'Content from ' || source AS summary FROM documents WHERE lang = 'de' GROUP BY source)
SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.total_word_count, o.total_word_count) AS total_word_count, coalesce(n.summary, o.summary) AS summary
FROM o FULL JOIN n ON o.source_id = n.source_id""")
def upsert_sources(spark, d):
    docs = table(spark, d, "documents")
    old = docs.filter("lang <> 'de'").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("total_word_count")).withColumn("summary", F.lit("old"))
    new = docs.filter("lang = 'de'").groupBy(F.col("source").alias("source_id")).agg(F.sum("n_chars").alias("total_word_count")).withColumn("summary", T.default_source_summary("source_id"))
    return ingest.upsert(old, new, "source_id")


@query("SELECT source AS source_id, CAST(sum(n_chars) AS BIGINT) AS total_chars, 'Content from ' || source AS summary FROM documents GROUP BY source ORDER BY source_id")
def sources_listing(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.sum("n_chars").alias("total_chars")).withColumn("summary", T.truncated_summary(T.default_source_summary("source_id"))).orderBy("source_id")


@query("SELECT conv_id, turn, 'Conversation ' || conv_id || chr(10) || '---' || chr(10) || text AS content FROM conversations WHERE length(text) > 0")
def contextual_text(spark, d):
    c = table(spark, d, "conversations").filter(F.length("text") > 0)
    return c.select("conv_id", "turn", T.contextual_text(F.concat(F.lit("Conversation "), "conv_id"), F.col("text")).alias("content"))


SIM_SQL = """s AS (SELECT e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def similar(spark, d, k, where="true"):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return retrieve.vector_search_by_row(e.filter(where), q, k, id_column="vec_id")


@query(f"WITH {SIM_SQL} SELECT vec_id, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return similar(spark, d, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {SIM_SQL} SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE label = 3 ORDER BY s.similarity DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    return similar(spark, d, 10, "label = 3").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%token%' ORDER BY doc_id LIMIT 20")
def keyword_ilike(spark, d):
    return retrieve.keyword_search(table(spark, d, "documents"), "token", 20, ["text"], "doc_id").select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE (text ILIKE '%apache%' OR source ILIKE '%apache%') AND source = 'src3' ORDER BY doc_id LIMIT 20")
def keyword_ilike_filtered(spark, d):
    rows = table(spark, d, "documents")
    return retrieve.keyword_search(rows, "apache", 20, ["text", "source"], "doc_id", retrieve.metadata_filter("src3")).select("doc_id")


HYBRID_SQL = f"""
WITH {SIM_SQL},
v AS (SELECT vec_id AS id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS v_rank FROM s JOIN documents ON doc_id = vec_id QUALIFY v_rank <= 20),
w AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k_rank FROM documents JOIN embeddings ON doc_id = vec_id WHERE text ILIKE '%that%' QUALIFY k_rank <= 20),
m AS (SELECT coalesce(v.id, w.id) AS id, similarity, v_rank, k_rank, CASE WHEN v_rank IS NOT NULL AND k_rank IS NOT NULL THEN 0 WHEN v_rank IS NOT NULL THEN 1 ELSE 2 END AS tier FROM v FULL JOIN w ON v.id = w.id),
o AS (SELECT row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN v_rank ELSE k_rank END, id) AS rank, id,
  CASE tier WHEN 0 THEN least(1.0, similarity * 1.2) WHEN 1 THEN similarity ELSE 0.5 END AS similarity, CAST(tier AS BIGINT) AS tier FROM m)
SELECT rank, id AS doc_id, round(similarity, 6) AS similarity, tier FROM o WHERE rank <= 10"""


def hybrid(spark, d, k=10):
    docs = table(spark, d, "documents").select("doc_id", "text")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id = 0").select(F.col("embedding").alias("q"))
    near = retrieve.vector_search_by_row(e.join(docs.select("doc_id"), "doc_id", "left_semi"), q, 2 * k, id_column="doc_id")
    v = retrieve.ranked(near.select("doc_id", "similarity"), F.desc("similarity"), F.asc("doc_id"))
    hits = retrieve.keyword_search(docs.join(e.select("doc_id"), "doc_id", "left_semi"), "that", 2 * k, ["text"], "doc_id")
    w = retrieve.ranked(hits.select("doc_id"), F.asc("doc_id"))
    return retrieve.hybrid_merge(v, w, k, "doc_id")


@query(HYBRID_SQL)
def hybrid_topk(spark, d):
    return hybrid(spark, d).select("rank", F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"), "tier")


@query("""
WITH h AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE text ILIKE '%the%' QUALIFY rank <= 20)
SELECT doc_id, rank, round(len(list_intersect(['the', 'and', 'erth'], list_distinct(string_split_regex(lower(text), '[^a-zA-Z0-9_]+')))) / 3.0, 6) AS rerank_score FROM h""")
def rerank_overlap(spark, d):
    hits = retrieve.ranked(retrieve.keyword_search(table(spark, d, "documents"), "the", 20, ["text"], "doc_id"), F.asc("doc_id"))
    return retrieve.rerank(hits, "the and erth", "text").select("doc_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def json_metadata_filter(spark, d):
    k = F.variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", k.alias("k")).filter("k = 7")


@query("""
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_daily(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))




PAGES_SQL = chunk_sql(1000).replace("WITH RECURSIVE c AS", "WITH RECURSIVE documents AS (SELECT page_id AS doc_id, html AS text, url AS source FROM pages), c AS")
HOST = "regexp_extract(source, '^[a-z]+://([^/?#]*)', 1)"


def crawled(spark, d):
    """Pages as they come from a crawl, their HTML standing for Markdown."""
    return ingest.crawled_pages(table(spark, d, "pages").select("url", F.col("html").alias("markdown")), 1000)


@query(PAGES_SQL + f" SELECT source AS url, chunk_number, md5(content) AS digest, {HOST} AS source_id, CAST(length(content) AS BIGINT) AS chunk_size FROM chunked")
def crawl_chunks(spark, d):
    return crawled(spark, d).select("url", "chunk_number", F.md5("content").alias("digest"), "source_id", "metadata.chunk_size")


@query(PAGES_SQL + f" SELECT {HOST} AS source_id, 'Content from ' || {HOST} AS summary, CAST(sum(len(regexp_extract_all(content, '[^\\s]+'))) AS BIGINT) AS total_word_count FROM chunked GROUP BY 1, 2")
def crawl_sources(spark, d):
    return ingest.source_table(crawled(spark, d))


@query(PAGES_SQL + f" SELECT count(DISTINCT source) AS pages, count(*) AS chunks, count(DISTINCT {HOST}) AS sources FROM chunked")
def crawl_report(spark, d):
    return ingest.crawl_summary(crawled(spark, d)).select("pages", "chunks", "sources")


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS s, text, row_number() OVER (ORDER BY s DESC, vec_id) AS rank
  FROM embeddings JOIN documents ON doc_id = vec_id, q QUALIFY rank <= 8),
r AS (SELECT *, round(len(list_intersect(['the', 'and', 'erth'], list_distinct(string_split_regex(lower(text), '[^a-zA-Z0-9_]+')))) / 3.0, 6) AS score FROM v)
SELECT rank, id AS doc_id, round(s, 6) AS similarity, score AS rerank_score FROM r""")
def rag_reranked(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    chunks = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    vector = chunks.filter("id = 0").select("embedding").first()
    out = retrieve.rag_query(chunks, "the and erth", list(vector.embedding), 8, hybrid=False, reranking=True)
    return out.select("rank", F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"), F.round("rerank_score", 6).alias("rerank_score"))
