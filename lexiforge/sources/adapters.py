"""The test tables as corpora: plain SQL that makes (path, text) rows, in Spark's dialect; `text` becomes `content` as UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "SELECT 'documents/' || source || '/' || doc_id || '.txt' AS path, text FROM {documents}"
PAGES = "SELECT 'pages/' || page_id || '.html' AS path, html AS text FROM {pages}"
MODULES = """
SELECT 'geo/region_' || r_regionkey || '.mod' AS path, 'module geo.region_' || r_regionkey || ';' || chr(10) || 'fn region_name' || chr(10) || '  // PRESS-00' || r_regionkey || ' see RFC 000' || r_regionkey || chr(10) AS text FROM {region}
UNION ALL SELECT 'geo/nation_' || n_nationkey || '.mod', 'module geo.nation_' || n_nationkey || ';' || chr(13) || chr(10) || 'use geo.region_' || n_regionkey || ' as r' || chr(10) || 'fn nation_name' || chr(10) || 'fn nation_name' || chr(10) || '// rfcs 00' || right('0' || n_nationkey, 2) || ', PRESS-0' || right('0' || n_nationkey, 2) || chr(10) FROM {nation}
UNION ALL SELECT 'crm/customer_' || c_custkey || '.mod', 'module crm.customer_' || c_custkey || ';' || chr(10) || 'use geo.nation_' || c_nationkey || ' as n' || chr(10) || 'record account.' || lower(c_mktsegment) || chr(10) FROM {customer}
UNION ALL SELECT 'sup/supplier_' || s_suppkey || '.mod', 'module sup.supplier_' || s_suppkey || ';' || chr(10) || 'use geo.nation_' || s_nationkey || chr(10) FROM {supplier}
UNION ALL SELECT 'part/part_' || p_partkey || '.mod', 'module part.part_' || p_partkey || ';' || chr(10) || 'fn 9bad PRESS-001' || chr(10) || 'record size_' || p_size || chr(10) FROM {part}
UNION ALL SELECT 'ord/order_' || o_orderkey || '.mod', 'module ord.order_' || o_orderkey || ';' || chr(10) || 'use crm.customer_' || o_custkey || ' as c' || chr(10) || 'use crm.customer_' || o_custkey || chr(10) FROM {orders}
"""
TURN = "'## ' || role || ' ' || turn || chr(10) || text || chr(10) || 'see [prev](conv/' || (conv_id - 1) || '.md) and [](<>)' || chr(10)"
CONVERSATIONS = f"SELECT 'conv/' || conv_id || '.md' AS path, '# Conversation ' || conv_id || chr(10) || listagg({TURN}, '') WITHIN GROUP (ORDER BY turn, role, text) AS text FROM {{conversations}} GROUP BY conv_id"
#: One 80-byte relation for each event.
FEED = """SELECT event_id AS position, CAST(floor(event_id / 100) AS BIGINT) + 1 AS commit, unhex('4D520100' || '0' || (1 + event_id % 4) || '000000' || hex(lpad(CAST(user_id % 40 AS STRING), 12, '0')) || hex(lpad(CAST(event_id % 50 AS STRING), 12, '0')) || lpad(hex(CAST(floor(event_id / 100) AS BIGINT) + 1), 16, '0') || repeat('00', 32) || lpad(hex(event_id % 3), 16, '0')) AS raw FROM {events}"""
MUTATED = """SELECT CASE WHEN doc_id % 13 = 0 THEN 'documents/moved/' || doc_id || '.txt' ELSE 'documents/' || source || '/' || doc_id || '.txt' END AS path,
CASE WHEN doc_id % 11 = 0 THEN text || ' changed' ELSE text END AS text FROM {documents} WHERE doc_id % 10 <> 3"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables whose names stand in braces."""
    names = {part.split("}")[0] for part in sql.split("{")[1:]}
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def corpus(spark: SparkSession, sf_dir: str, *sqls: str) -> DataFrame:
    """path, content of the given adapters; by default documents, conversations, modules and pages."""
    out = None
    for sql in sqls or (DOCUMENTS, CONVERSATIONS, MODULES, PAGES):
        part = rows(spark, sf_dir, sql)
        out = part if out is None else out.unionByName(part)
    return out.select("path", F.col("text").cast("binary").alias("content"))
