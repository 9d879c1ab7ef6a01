"""Vector, keyword and hybrid retrieval, reranking: each one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import blank_to_null, cosine


def vector_search(rows: DataFrame, query_vector: list[float], k: int, vector: str = "embedding", id_column: str = "id", where: Column | None = None) -> DataFrame:
    """The k rows of highest cosine similarity, ties to the smaller id.

    The query is a literal array, so the plan is a scan, a projection and a
    TakeOrderedAndProject: each task keeps k rows. Zero-norm vectors are left out.
    """
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    if where is not None:
        rows = rows.filter(where)
    return rows.withColumn("similarity", cosine(F.col(vector), q)).filter(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), F.asc(id_column)).limit(k)


def vector_search_by_row(rows: DataFrame, query: DataFrame, k: int, vector: str = "embedding", id_column: str = "id") -> DataFrame:
    """As vector_search, the query vector being the one row of ``query`` (column ``q``)."""
    return rows.crossJoin(F.broadcast(query.limit(1))).withColumn("similarity", cosine(F.col(vector), F.col("q"))).filter(F.col("similarity").isNotNull()).drop("q").orderBy(F.desc("similarity"), F.asc(id_column)).limit(k)


def metadata_filter(source: str | None, column: str = "source") -> Column:
    """Equality on the source; a blank or missing source filters nothing."""
    if source is None or not source.strip():
        return F.lit(True)
    return F.col(column) == source


def keyword_search(rows: DataFrame, q: str, k: int, columns: list[str], id_column: str = "id", where: Column | None = None) -> DataFrame:
    """Rows one of whose columns contains q in any case (its % and _ are wild), by id."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    if where is not None:
        rows = rows.filter(where)
    return rows.filter(hit).orderBy(id_column).limit(k)


def hybrid_merge(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, id_column: str = "id", boost: float = 1.2, keyword_score: float = 0.5) -> DataFrame:
    """Merge ranked hits: in both (keyword order, boosted), vector only, keyword only; k rows.

    Inputs have the id and ``rank``; vector hits also ``similarity``. Both hold at most
    2 k rows. Returns (rank, id, similarity, tier) in that order, not by similarity.
    """
    v = vector_hits.select(F.col(id_column).alias("id"), F.col("rank").alias("v_rank"), "similarity")
    w = keyword_hits.select(F.col(id_column).alias("id"), F.col("rank").alias("k_rank"))
    both = v.join(w, "id", "full_outer")
    tier = F.when(F.col("v_rank").isNotNull() & F.col("k_rank").isNotNull(), 0).when(F.col("v_rank").isNotNull(), 1).otherwise(2)
    score = F.when(F.col("tier") == 0, F.least(F.lit(1.0), F.col("similarity") * boost)).when(F.col("tier") == 1, F.col("similarity")).otherwise(keyword_score)
    place = F.when(F.col("tier") == 1, F.col("v_rank")).otherwise(F.col("k_rank"))
    out = both.withColumn("tier", tier).filter((F.col("tier") != 1) | F.col("id").isNotNull()).withColumns({"score": score, "place": place})
    out = out.orderBy("tier", "place", "id").limit(k)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("tier", "place", "id")).cast("long")).select("rank", "id", F.col("score").alias("similarity"), F.col("tier").cast("long").alias("tier"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank`` from 1 to a result already cut to k rows."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def overlap_score(query: str, text: Column) -> Column:
    """The offline reranking score: share of the query's words among the text's words."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"\s+"), lambda x: x != ""))
    theirs = F.array_distinct(F.split(F.lower(text), r"\W+"))
    return F.size(F.array_intersect(words, theirs)) / F.greatest(F.size(words), F.lit(1))


def rerank(hits: DataFrame, query: str, text: str, k: int | None = None, score: Column | None = None) -> DataFrame:
    """Stable order by descending score of hits that have ``rank``; adds rerank_score."""
    s = overlap_score(query, F.col(text)) if score is None else score
    out = hits.withColumn("rerank_score", s).orderBy(F.desc("rerank_score"), F.asc("rank"))
    return out.limit(k) if k else out


def rag_query(chunks: DataFrame, query: str, query_vector: list[float], k: int = 5, source: str | None = None, hybrid: bool = True, reranking: bool = False, text_columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """Search of a chunk table (id, content, embedding, source): one plan for all modes."""
    where = metadata_filter(source)
    n = 2 * k if hybrid else k
    v = ranked(vector_search(chunks, query_vector, n, where=where).select("id", "similarity"), F.desc("similarity"), F.asc("id"))
    if hybrid:
        w = ranked(keyword_search(chunks, query, n, list(text_columns), where=where).select("id"), F.asc("id"))
        hits = hybrid_merge(v, w, k)
    else:
        hits = v.withColumn("tier", F.lit(1).cast("long")).select("rank", "id", "similarity", "tier")
    out = F.broadcast(hits).join(chunks, "id")  # k rows
    return rerank(out, query, text_columns[0]) if reranking else out.orderBy("rank")


def code_search(code: DataFrame, query: str, query_vector: list[float], k: int = 5, source: str | None = None, reranking: bool = False) -> DataFrame:
    """Search of a code table (id, content, summary, embedding, source): content and summary are looked at for keywords."""
    return rag_query(code, query, query_vector, k, source, hybrid=True, reranking=reranking, text_columns=("content", "summary"))


def search_response(hits: DataFrame, query: str, columns: tuple[str, ...], mode: str = "vector", source: str | None = None, limit: int | None = None) -> DataFrame:
    """(response): one JSON text of a search: query, filter, mode, results in order and how many there are."""
    result = F.struct("rank", *columns)
    rows = hits.agg(F.sort_array(F.collect_list(result)).alias("results"))  # k rows at most
    n = F.size("results")
    meta = F.struct(n.alias("total_results"), (n >= limit if limit else F.lit(False)).alias("limited"))
    body = F.struct(F.lit(True).alias("success"), F.lit(query).alias("query"), F.lit(source).alias("source_filter"), F.lit(mode).alias("search_mode"), "results", meta.alias("metadata"))
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def parameter(x: str | None) -> Column:
    return blank_to_null(F.lit(x))
