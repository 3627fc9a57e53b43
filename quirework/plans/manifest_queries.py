"""Queries on append-only logs and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import manifest as M
from ..sources.tables import table

_ORDER = ["ts", "event_id"]


def manifest_latest(spark: SparkSession, folder: str) -> DataFrame:
    return M.latest(table(spark, folder, "events"), "user_id", _ORDER)


def resume_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Customers for whom the last event isn't a purchase or click."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return M.to_do(customers, table(spark, folder, "events"), "user_id", _ORDER, F.col("event_type").isin("purchase", "click"))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return M.summary(table(spark, folder, "events"), "user_id", _ORDER, "event_type", "value")


def run_identity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", M.identity(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("run_id"))


def secret_scrub(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters of runs, of which some are or look like credentials."""
    k = F.col("p_partkey")
    token = F.concat(F.lit("q7"), F.regexp_replace("p_name", " ", "_"), F.lit("_0123456789abcdefghijklmnopqrstuvw"))
    params = F.create_map(F.lit("name"), F.col("p_name"), F.lit("api_key"), F.lit("x"), F.lit("note"), F.when(k % 3 == 0, token).when(k % 3 == 1, F.sha2(F.col("p_name"), 256)).otherwise(F.concat(F.lit("AIza"), F.lit("A" * 24))))
    out = M.scrubbed(params)
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(out)), ",").alias("kept"), out["note"].alias("note"))


def url_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "papers").where("pdf_url is not null").groupBy(M.host_of(F.col("pdf_url")).alias("host")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (manifest_latest, resume_anti_join, run_summary, run_identity, secret_scrub, url_hosts)}

_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)"
SQL = {
    "manifest_latest": f"WITH {_LATEST} SELECT * EXCLUDE (n) FROM l",
    "resume_anti_join": f"WITH {_LATEST} SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l WHERE event_type IN ('purchase', 'click'))",
    "run_summary": f"WITH {_LATEST} SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM l GROUP BY event_type",
    "run_identity": "SELECT o_orderkey, left(sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority)), 24) AS run_id FROM orders",
    "secret_scrub": "SELECT p_partkey, 'name,note' AS kept, CASE WHEN p_partkey % 3 = 1 THEN sha256(p_name) ELSE '[redacted]' END AS note FROM part",
    "url_hosts": r"SELECT lower(regexp_extract(pdf_url, '^[a-z]+://([^/?#]+)', 1)) AS host, count(*) AS n FROM papers WHERE pdf_url IS NOT NULL GROUP BY ALL",
}
