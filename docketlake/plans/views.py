"""The matter tables as views of the driver's tables, for Spark and for SQL.

Reference ids are made null on purpose in places, so that outer joins miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view name -> SQL that both engines read
VIEWS = {
    "clients": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description FROM customer",
    "profiles": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS full_name FROM supplier",
    "user_roles": "SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 4 = 0 THEN 'admin' WHEN s_suppkey % 4 = 1 THEN 'associate' ELSE 'paralegal' END AS role FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey AS user_id, 'partner' AS role FROM supplier WHERE s_suppkey % 3 = 0",
    "matters": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS client_id, concat('Matter ', CAST(o_orderkey AS STRING)) AS name, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE o_orderstatus END AS status, o_orderpriority AS matter_type, CAST(NULL AS STRING) AS sector, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS description, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 10 END AS lead_partner_id, CAST(o_orderdate AS DATE) AS opened_date, o_orderdate AS created_at FROM orders",
    "document_types": "SELECT p_partkey AS id, p_name AS name, p_type AS category FROM part",
    "matter_documents": "SELECT o_orderkey AS id, o_custkey AS matter_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 190 + 1 END AS document_type_id, CASE WHEN o_orderstatus = 'O' THEN 'not_started' WHEN o_orderstatus = 'F' THEN 'finalized' ELSE 'internal_review' END AS status, o_orderdate AS created_at FROM orders",
    "document_versions": "SELECT l_orderkey AS matter_document_id, l_linenumber AS version_number, l_partkey, l_suppkey, l_extendedprice, l_shipdate AS created_at FROM lineitem",
    "vectors": "SELECT vec_id AS id, embedding, label AS document_type_id, CASE WHEN vec_id % 2 = 1 THEN vec_id % 20 END AS matter_id, vec_id % 2 = 0 AS is_precedent FROM embeddings",
    "chunks": "SELECT doc_id AS id, text AS content, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN NULL ELSE concat('precedent/', source, '/', lang, '.docx') END AS storage_path, CASE WHEN doc_id % 3 = 0 THEN concat(source, '.docx') END AS filename, n_chars % 50 AS created_at, doc_id % 150 AS document_type_id, doc_id % 2 = 0 AS is_precedent FROM documents",
    "messages": "SELECT conv_id AS thread_id, turn AS created_at, role, text AS content FROM conversations",
    "matter_tasks": "SELECT event_id AS id, user_id AS matter_id, event_type AS title, CASE WHEN event_id % 6 <> 0 THEN event_id % 12 + 1 END AS assignee_id, ts AS created_at FROM events",
    "matter_notes": "SELECT conv_id * 100 + turn AS id, conv_id AS matter_id, CASE WHEN turn % 4 <> 3 THEN conv_id % 15 + 1 END AS author_id, text AS content FROM conversations",
    "suggestions": "SELECT doc_id AS id, doc_id % 40 AS document_version_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN toxic = 1 THEN 'rejected' ELSE 'pending' END AS status FROM labels",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows; only the tables it reads are opened, each by its path."""
    sql = VIEWS[name]
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" FROM {t}" in sql}
    for t in read:
        sql = sql.replace(f" FROM {t}", f" FROM {{{t}}}")
    return spark.sql(sql, **read)


def duck(sql: str) -> str:
    """SQL over the views for DuckDB: those it names come before it."""
    used = [n for n in VIEWS if f" {n} " in f" {sql} ".replace("\n", " ").replace(",", " ").replace(")", " ")]
    head = ",\n".join(f"{n} AS ({VIEWS[n].replace('AS STRING', 'AS VARCHAR')})" for n in used)
    if not used:
        return sql
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
