"""Stand-ins of the project graph on the test tables: one string expression in both engines.

A file is a path derived from a part (source file, and a test file for every tenth part), a document or a customer. A log
line is an event: signup starts a task, error stops it, click, view and purchase read, search and modify.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

SOURCE_SQL = "'src/' || lower(replace(p_brand, '#', '_')) || '/' || lower(replace(p_name, ' ', '_')) || '_' || p_partkey || '.py'"
FILES_SQL = f"""
    SELECT {SOURCE_SQL} AS path, p_brand AS concept, CAST(p_size AS BIGINT) AS size FROM part
    UNION ALL SELECT 'tests/test_' || lower(replace(p_name, ' ', '_')) || '_' || p_partkey || '.py', p_brand, CAST(p_size AS BIGINT) FROM part WHERE p_partkey % 10 = 0
    UNION ALL SELECT 'docs/' || source || '/' || lang || '_' || doc_id || '.md', source, n_chars FROM documents
    UNION ALL SELECT 'config/' || lower(c_mktsegment) || '/' || c_custkey || '.json', c_mktsegment, c_custkey FROM customer
"""


def _name():
    return F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), F.col("p_partkey"))


def source_path():
    return F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), _name(), F.lit(".py"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """path, concept, size of the derived tree."""
    part, docs, customer = table(spark, sf, "part"), table(spark, sf, "documents"), table(spark, sf, "customer")
    size = F.col("p_size").cast("long")
    out = part.select(source_path().alias("path"), F.col("p_brand").alias("concept"), size.alias("size"))
    out = out.unionByName(part.filter("p_partkey % 10 = 0").select(F.concat(F.lit("tests/test_"), _name(), F.lit(".py")).alias("path"), F.col("p_brand").alias("concept"), size.alias("size")))
    out = out.unionByName(docs.select(F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id"), F.lit(".md")).alias("path"), F.col("source").alias("concept"), F.col("n_chars").alias("size")))
    return out.unionByName(customer.select(F.concat(F.lit("config/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey"), F.lit(".json")).alias("path"), F.col("c_mktsegment").alias("concept"), F.col("c_custkey").alias("size")))


MARKER_SQL = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' END"
EVENTS_SQL = f"SELECT event_id AS seq, user_id AS session, ts AS created_at, event_type, {MARKER_SQL} AS marker FROM events"


def log(spark: SparkSession, sf: str) -> DataFrame:
    """seq, session, created_at, event_type, marker, task: an error stops the task that its session started last."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.col("ts").alias("created_at"), "event_type")
    e = e.withColumn("marker", F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop"))
    from pyspark.sql.window import Window

    upto = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.last(F.when(F.col("marker") == "start", F.col("seq")), ignorenulls=True).over(upto)
    return e.withColumn("task", F.when(F.col("marker") == "start", F.col("seq")).when(F.col("marker") == "stop", started))
