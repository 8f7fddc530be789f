"""Queries about page URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import urls as U

from .registry import query, table

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"


@query(f"SELECT page_id, {HOST} LIKE '%.example.com' OR {HOST} = 'example.com' AS known, starts_with(url, 'https://') AS secure FROM pages")
def q_host_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = U.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", (h.endswith(".example.com") | (h == "example.com")).alias("known"), F.col("url").startswith("https://").alias("secure"))


@query("SELECT p_partkey, url_encode(p_name) AS encoded, octet_length(encode(p_name)) AS bytes, 'retail:v1:' || lower(p_brand) || ':' || CAST(p_size AS VARCHAR) AS key FROM part")
def q_encode_keys_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("retail:v1:"), F.lower("p_brand"), F.lit(":"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", U.encoded(F.col("p_name")).alias("encoded"), F.octet_length("p_name").cast("long").alias("bytes"), key.alias("key"))
