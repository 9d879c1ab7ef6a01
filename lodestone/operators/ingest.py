"""From pages to chunk, source and code tables; replace-by-key and upsert."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from lodestone.functions import text as T
from lodestone.sources.scratch import kept


def replace_by_key(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Delete the rows of every incoming key, then add the incoming rows."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Update or insert: incoming values replace existing ones, they are not added up."""
    names = [c for c in existing.columns if c != key]
    old, new = existing.alias("old"), incoming.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    return both.select(F.coalesce(f"new.{key}", f"old.{key}").alias(key), *(F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in names))


def first_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Of the rows of a key, the first by the order (MERGE ... ON CREATE SET)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_n = 1").drop("_n")


def cut_text(text: str | None, size: int) -> list[str]:
    """Boundary-aware chunks of one text, stripped.

    A cut prefers the last fence, else the last blank line, else the last sentence end of
    the window, where it lies beyond 30 % of it. A window with a blank line is never cut
    at a sentence. Null and empty texts have no chunks; a remainder that strips to nothing
    is kept as an empty chunk.
    """
    out: list[str] = []
    start, least = 0, 0.3 * size
    while text and start + size < len(text):
        end = start + size
        fence = text.rfind("```", start, end) - start
        blank = text.rfind("\n\n", start, end) - start
        if fence > least:
            end = start + fence
        elif blank >= 0:
            end = start + blank if blank > least else end
        else:
            stop = text.rfind(". ", start, end) - start
            end = start + stop + 1 if stop > least else end
        if piece := text[start:end].strip():
            out.append(piece)
        start = end
    return [*out, text[start:].strip()] if text else out


def chunk_rows(docs: DataFrame, text: str, size: int = 5000) -> DataFrame:
    """One row a chunk: the other columns, chunk_number from 0, content, headers, char_count, word_count.

    The fold goes over Arrow batches, linear in the text; no exchange is needed.
    """
    rest = [c for c in docs.columns if c != text]
    kinds = docs.select(*rest).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                cuts = [cut_text(t, size) for t in part.column(len(rest)).to_pylist()]
                row = pa.array([i for i, c in enumerate(cuts) for _ in c], pa.int64())
                number = pa.array([n for c in cuts for n in range(len(c))], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(len(rest))), number, pa.array([x for c in cuts for x in c], pa.string())], [*rest, "chunk_number", "content"])

    schema = T_.StructType([*kinds.fields, T_.StructField("chunk_number", T_.LongType()), T_.StructField("content", T_.StringType())])
    out = docs.select(*rest, F.col(text).cast("string")).mapInArrow(run, schema)
    info = T.section_info("content")
    return out.select(*rest, "chunk_number", "content", info["headers"].alias("headers"), info["char_count"].alias("char_count"), info["word_count"].alias("word_count"))


def crawled_pages(pages: DataFrame, size: int = 5000, crawl_type: str = "webpage") -> DataFrame:
    """The chunk table of (url, markdown) pages, with typed metadata."""
    rows = chunk_rows(pages.filter(F.length("markdown") > 0).select("url", "markdown"), "markdown", size)
    meta = F.struct("headers", "char_count", "word_count", F.col("chunk_number").alias("chunk_index"), "url", T.source_id("url").alias("source"), F.lit(crawl_type).alias("crawl_type"), F.length("content").cast("long").alias("chunk_size"))
    return rows.select("url", "chunk_number", "content", meta.alias("metadata"), T.source_id("url").alias("source_id"))


def source_table(chunks: DataFrame) -> DataFrame:
    """(source_id, summary, total_word_count): one aggregation; the summary is the offline default."""
    out = chunks.groupBy("source_id").agg(F.sum("metadata.word_count").alias("total_word_count"))
    return out.select("source_id", T.truncated_summary(T.default_source_summary("source_id")).alias("summary"), "total_word_count")


def source_rollup(rows: DataFrame, source: str, words: Column, text: str, order: str) -> DataFrame:
    """Per source: rows, words, and the first 5000 characters of its first text by the order."""
    return rows.groupBy(F.col(source).alias("source_id")).agg(F.count("*").alias("n_docs"), F.sum(words).alias("total_words"), F.min_by(F.substring(text, 1, 5000), order).alias("first_text"))


def code_example_table(docs: DataFrame, key: str, text: str, min_length: int = 1000, compat: bool = False) -> DataFrame:
    blocks = docs.select(key, F.posexplode(T.code_blocks(text, min_length, compat)).alias("block", "b"))
    return blocks.select(key, F.col("block").cast("long").alias("block"), "b.code", "b.language", "b.context_before", "b.context_after", T.full_context(F.col("b.context_before"), F.col("b.code"), F.col("b.context_after")).alias("full_context"))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(url, href) of the anchors of each page, fragments dropped, repeats removed."""
    href = F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit('<a\\s+href="([^"]*)"'), F.lit(1)))).alias("href")
    return pages.select("url", href).select("url", T.normalize_url("href").alias("href")).distinct()


def absolute(url: Column, href: Column) -> Column:
    """A root-relative link in the frame of its page."""
    return F.when(href.startswith("/"), F.concat(F.regexp_extract(url, "^([a-z]+://[^/#?]+)", 1), href)).otherwise(href)


def frontier(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) reached from the starts within max_depth - 1 hops.

    starts: (node); edges: (src, dst).
    """
    return frontiers(starts.select(F.lit(0).alias("start"), "node"), edges, max_depth).select("node", "depth")


def frontiers(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, depth) of what each start reaches within max_depth - 1 hops, for many starts at once.

    starts: (start, node); edges: (src, dst). Each level is one join with the edges and
    one anti-join with what the same start has visited; the loop is over levels, not
    nodes or starts. A level is a table before the next one is made, and so are the
    edges, so no plan holds those before it.
    """
    edges = kept(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    seen = level = kept(starts.select("start", "node").filter("node is not null").distinct().withColumn("depth", F.lit(0).cast("long")), "level")
    for depth in range(1, max_depth):
        step = level.join(edges, level.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        level = kept(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "level")
        seen = seen.unionByName(level)
    return seen


_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def frontiers_recursive(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """``frontiers`` as one recursive query: a single plan, whatever the depth.

    Recursion keeps every simple path, as it can't leave out what it has seen, so it is
    for short walks and graphs of few ways between two nodes; ``frontiers`` does the
    others. How many rows a recursion may have is a guard against walks without end;
    this one ends at ``max_depth``, so the result is made without it, as a table.
    """
    spark = starts.sparkSession
    once = kept(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    first = starts.select("start", "node").filter("node is not null").distinct()
    if max_depth < 2:
        return first.withColumn("depth", F.lit(0).cast("long"))
    walk = """
    WITH RECURSIVE walk(start, node, depth, path) AS (
      SELECT start, node, 0L, array(node) FROM {first}
      UNION ALL
      SELECT /*+ MERGE(e) */ start, dst, depth + 1, array_append(path, dst) FROM walk JOIN {edges} AS e ON src = node WHERE depth < {last} AND NOT array_contains(path, dst))
    SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node"""
    had = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return kept(spark.sql(walk, first=first, edges=once, last=max_depth - 1), "walk")
    finally:
        spark.conf.set(_ROW_LIMIT, had)


def sitemap_urls(xml: Column | str) -> Column:
    """All loc texts of a sitemap, whatever their namespace."""
    return F.transform(F.xpath(xml, F.lit("//*[local-name()='loc']/text()")), lambda x: T.strip(x))


def crawl_summary(chunks: DataFrame, first: int = 5, code: DataFrame | None = None) -> DataFrame:
    """Pages, chunks, code examples, sources and the first URLs of an ingest: one row."""
    counts = chunks.agg(F.count_distinct("url").alias("pages"), F.count("*").alias("chunks"), F.count_distinct("source_id").alias("sources"))
    few = chunks.select("url").distinct().orderBy("url").limit(first).agg(F.array_join(F.sort_array(F.collect_list("url")), ",").alias("few"))  # at most ``first`` rows
    out = counts.crossJoin(F.broadcast(few)).withColumn("urls", F.concat("few", F.when(F.col("pages") > first, "...").otherwise("")))
    n = code.agg(F.count("*").alias("code_examples")) if code is not None else counts.select(F.lit(0).cast("long").alias("code_examples"))
    return out.crossJoin(F.broadcast(n)).select("pages", "chunks", "code_examples", "sources", "urls")


#: Fixed value: the summary of a code example where no model writes one.
CODE_SUMMARY = "Code example for demonstration purposes."


def code_store(examples: DataFrame, summary: Column | None = None, embed=None) -> DataFrame:
    """The code table of (url, block, code, language, ...) rows: what is embedded, its summary and metadata.

    ``summary``: a Column, the constant where none is given; ``embed``: a function from a
    frame and the name of its text column to the frame with ``embedding``.
    """
    text = F.concat("code", F.lit("\n\nSummary: "), "summary")
    rows = examples.withColumn("summary", F.lit(CODE_SUMMARY) if summary is None else summary).withColumn("embedded_text", text)
    meta = F.struct("language", F.length("code").cast("long").alias("char_count"), T.word_count("code").alias("word_count"))
    rows = rows.select("url", F.col("block").alias("chunk_number"), F.col("code").alias("content"), "summary", meta.alias("metadata"), T.source_id("url").alias("source_id"), "embedded_text")
    return embed(rows, "embedded_text") if embed else rows


def reached_pages(pages: DataFrame, start: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, depth) of the pages that links of one site lead to; start: (url), pages: (url, html)."""
    links = page_links(pages)
    edges = links.select(T.normalize_url("url").alias("src"), absolute(F.col("url"), F.col("href")).alias("dst"))
    edges = edges.filter(T.source_id("src") == T.source_id("dst")).distinct()
    seen = frontier(start.select(T.normalize_url("url").alias("node")), edges, max_depth)
    known = pages.select(T.normalize_url("url").alias("node")).distinct()
    return seen.join(known, "node", "left_semi").select(F.col("node").alias("url"), "depth")


def wanted_pages(pages: DataFrame, urls: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, content, crawl_type) for the requested ``urls``, each by its route.

    Text files are taken as they are; a sitemap stands for the pages that it lists; from a
    web page, the links of its site are followed. pages: (url, html). A page that several
    requests lead to is there once, by the first of these routes.
    """
    asked = urls.select("url").distinct().withColumn("route", T.crawl_route("url"))
    body = pages.select(T.normalize_url("url").alias("page"), "html")
    text = asked.filter("route = 'text_file'").join(body, F.col("url") == F.col("page")).select("page", "html", F.lit("text_file").alias("crawl_type"), F.lit(0).alias("turn"))
    maps = asked.filter("route = 'sitemap'").join(body, F.col("url") == F.col("page")).select(F.explode(sitemap_urls("html")).alias("listed"))
    listed = maps.distinct().join(body, F.col("listed") == F.col("page")).select("page", "html", F.lit("sitemap").alias("crawl_type"), F.lit(1).alias("turn"))
    found = reached_pages(pages, asked.filter("route = 'webpage'"), max_depth)
    linked = found.join(body, F.col("url") == F.col("page")).select("page", "html", F.lit("webpage").alias("crawl_type"), F.lit(2).alias("turn"))
    rows = first_wins(text.unionByName(listed).unionByName(linked), ["page"], F.struct("turn", F.md5("html")))
    return rows.filter(F.length("html") > 0).select(F.col("page").alias("url"), F.col("html").alias("content"), "crawl_type")


def crawl(pages: DataFrame, urls: DataFrame, max_depth: int = 3, size: int = 5000, least_code: int = 1000) -> dict[str, DataFrame]:
    """The tables that an ingest of the requested URLs stores: crawled_pages, sources, code_examples, and its report."""
    got = wanted_pages(pages, urls, max_depth)
    chunks = crawled_pages(got.select("url", F.col("content").alias("markdown")), size, "crawl")
    code = code_store(code_example_table(got, "url", "content", least_code))
    return {"crawled_pages": chunks, "sources": source_table(chunks), "code_examples": code, "report": crawl_summary(chunks, code=code)}
