"""Queries written in Spark SQL: table functions, and streams held against tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import tables
from lodestone.plans.corpus import blocks_sql, chunk_sql, markdown
from lodestone.plans.registry import query, table
from lodestone.streaming.newest import sessions


@query(chunk_sql(500) + "SELECT doc_id, source, chunk_number, content FROM chunked")
def chunk_table_function(spark, d):
    """Chunks from SQL, with the columns of the table that are kept."""
    tables.register(spark)
    return spark.sql("SELECT * FROM chunk_text(TABLE(SELECT doc_id, source, text FROM {docs}), 'text', 500)", docs=table(spark, d, "documents"))


@query(blocks_sql(0))
def code_block_table_function(spark, d):
    tables.register(spark)
    return spark.sql("SELECT * FROM code_blocks(TABLE({rows}), 'markdown', 0)", rows=markdown(spark, d))


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, run""")
def event_sessions(spark, d):
    """Runs of a user's events with at most twelve hours between them."""
    return sessions(table(spark, d, "events"), "ts", "user_id", "12 hours").select("key", "start", "end", F.col("n"))
