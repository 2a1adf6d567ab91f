"""Record tables (messages, documents with curation, decisions, embeddings) from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages; minute is minutes since 2024-01-01."""
    t = table(spark, sf_dir, "conversations")
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), (F.col("conv_id") * 60 + F.col("turn")).alias("minute"), "role", F.col("text").alias("content"),
        F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project"), ((F.col("conv_id") * 7 + F.col("turn")) % 10 + 1).cast("int").alias("importance"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as curated records; provenance from labels (1 verbatim, 0 extracted, none unknown)."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents")
    return d.join(labels, F.col("doc_id") == F.col("of"), "left").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("minute"), F.col("source").alias("project"), F.col("lang").alias("kind"), "text",
        F.when(F.col("quality") == 1, "verbatim").when(F.col("quality") == 0, "extracted").alias("provenance"), (F.col("doc_id") % 10 + 1).cast("int").alias("importance"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("project"), p.alias("decision"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "superseded").otherwise("reverted").alias("status"),
        F.when(p.isin("1-URGENT", "2-HIGH"), "high").when(p == "3-MEDIUM", "medium").when(p == "5-LOW", "low").alias("confidence"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("importance"),
    )


MESSAGES_SQL = "SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id * 60 + turn AS minute, role, text AS content, 'p' || (conv_id % 5) AS project, CAST((conv_id * 7 + turn) % 10 + 1 AS INTEGER) AS importance FROM conversations"
RECORDS_SQL = "SELECT d.doc_id AS id, d.doc_id AS minute, source AS project, lang AS kind, text, CASE quality WHEN 1 THEN 'verbatim' WHEN 0 THEN 'extracted' END AS provenance, CAST(d.doc_id % 10 + 1 AS INTEGER) AS importance FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON d.doc_id = q.doc_id"
DECISIONS_SQL = "SELECT o_orderkey AS id, o_orderdate AS created, 'c' || (o_custkey % 7) AS project, o_orderpriority AS decision, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' ELSE 'reverted' END AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' WHEN o_orderpriority = '5-LOW' THEN 'low' END AS confidence, CAST(o_orderkey % 10 + 1 AS INTEGER) AS importance FROM orders"
