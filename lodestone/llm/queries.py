"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_files

    _, docs, _ = token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), add_end=True)


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, scan

    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS[:3]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    _, records, _ = archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op3_arc_to_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query
def op6_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import top_k

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = top_k(rows, rows.filter("id % 50 = 0"), 5, scale=256.0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


ORACLE_SQL["op6_segment_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_duplicates

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return near_duplicates(rows).select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


ORACLE_SQL["op9_pivot_near_duplicates"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.c),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(max(n.n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar

    return similar(table(spark, sf_dir, "documents"), shingle=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL["op1_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, scores, train

    docs = table(spark, sf_dir, "documents")
    scored = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeats

    return repeats(table(spark, sf_dir, "documents"), window=35)


ORACLE_SQL["op10_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(t[i:i + 34], ' ')) AS h FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 34)) AS i FROM w WHERE len(t) >= 35)),
d AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, list(i) AS s FROM g JOIN d USING (h) GROUP BY doc_id),
k AS (SELECT w.doc_id, t, list_distinct(flatten(list_transform(coalesce(s, []), lambda i: generate_series(i, i + 34)))) AS gone FROM w LEFT JOIN c USING (doc_id)),
m AS (SELECT doc_id, t, gone, list_transform(list_filter(list_transform(t, lambda x, j: {'x': x, 'j': j}), lambda e: NOT list_contains(gone, e.j)), lambda e: e.x) AS kept FROM k)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM m
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import restored, transform

    rows = transform(table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    sizes = [F.col(f"{c}_units").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return rows.select("doc_id", "n", "form", *sizes, digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL["op12_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM c),
q AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM q
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, rows.filter("id % 100 = 0"), positives=5, negatives=5, least=(80, 100), scale=256.0)


ORACLE_SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import formatted, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    return read_back(formatted(rows.unionByName(said)))


ORACLE_SQL["op11_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, '(\\|\[/?(SYS|INST|ROLE)\]|</?s>)' AS special FROM c),
l AS (SELECT *, length(text) + len(regexp_extract_all(text, special)) AS text_chars, length(role) + len(regexp_extract_all(role, special)) AS role_chars FROM k)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 11 ELSE role_chars + 17 END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""
