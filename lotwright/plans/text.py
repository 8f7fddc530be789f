"""Queries about titles, descriptions and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import text as T
from lotwright.operators import match

from .registry import query, table


@query("""
SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS tokens FROM part
""")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.compact_tokens(F.col("p_name")).alias("tokens"))


@query("""
WITH t AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS a,
                  list_filter(string_split_regex(lower(p_type || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) AS hits, len(list_distinct(a)) AS total, round(CASE WHEN len(list_distinct(a)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END, 9) AS ratio FROM t
""")
def q_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = match.overlap(T.compact_tokens(F.col("p_name")), T.compact_tokens(F.concat_ws(" ", "p_type", "p_brand")))
    rows = table(spark, sf_dir, "part").select("p_partkey", o.alias("o"))
    return rows.select("p_partkey", F.col("o.hits").cast("long").alias("hits"), F.col("o.total").cast("long").alias("total"), F.round("o.ratio", 9).alias("ratio"))


CLEAN = "trim(regexp_replace(regexp_replace(translate(text, '‘’“”–—' || chr(160), '''''\"\"-- '), '\\r\\n?', chr(10), 'g'), '[\\s' || chr(160) || ']+', ' ', 'g'))"


@query(f"SELECT source, count(*) AS n, CAST(sum(length({CLEAN})) AS BIGINT) AS chars, min(sha256({CLEAN})) AS least FROM documents GROUP BY 1")
def q_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", T.squeezed(T.typographic(F.col("text"))).alias("t"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"), F.min(F.sha2("t", 256)).alias("least"))


def _sql_flags(x: str, patterns: dict[str, str]) -> str:
    fits = ", ".join(f"CASE WHEN regexp_matches({x}, '{p}', 'i') THEN '{name}' END" for name, p in patterns.items())
    return f"list_filter([{fits}], lambda v: v IS NOT NULL)"


#: What stands for condition words in the invented documents.
FLAGS = {"urgent": r"\bes\b", "un": r"\bun\b", "was": r"\bwas\b", "der": r"\bder\b", "junk": r"\$\$\$|%%%|&&&"}


@query(f"SELECT flags, count(*) AS n FROM (SELECT {_sql_flags('text', FLAGS)} AS flags FROM documents) GROUP BY 1")
def q_condition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(T.all_fits(F.col("text"), FLAGS).alias("flags")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part
""")
def q_slug_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("""SELECT c_custkey, '"' || replace(c_name, '"', '""') || '","' || replace(c_mktsegment, '"', '""') || '"' AS line FROM customer""")
def q_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(",", T.csv_cell(F.col("c_name")), T.csv_cell(F.col("c_mktsegment"))).alias("line"))


VISIBLE = (
    "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace("
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<template\\b[^>]*>.*?</template\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'),"
    " '(?s)<!--.*?-->', ' ', 'g'), '(?i)<br\\s*/?>|</(p|div|li|h[1-6]|tr)\\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),"
    " '&nbsp;', ' '), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),"
    " '[\\s' || chr(160) || ']+', ' ', 'g'))"
)


@query(f"SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT page_id, {VISIBLE} AS t FROM pages)")
def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", T.visible_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("""
SELECT page_id, len(h) AS links, list_aggregate(list_transform(h, lambda x: length(x)), 'sum') AS chars FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s+[^>]*?href\\s*=\\s*"([^"]*)"', 1) AS h FROM pages)
""")
def q_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s+[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", links.alias("h"))
    total = F.when(F.size("h") > 0, F.aggregate("h", F.lit(0), lambda n, x: n + F.length(x)))
    return rows.select("page_id", F.size("h").cast("long").alias("links"), total.cast("long").alias("chars"))


@query("SELECT p_partkey, regexp_matches(p_name, '(?i)' || regexp_escape(string_split(p_type, ' ')[1])) AS literal FROM part")
def q_dynamic_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a word of one column occurs in another, as text rather than as a pattern for each row."""
    word = F.split("p_type", " ")[0]
    return table(spark, sf_dir, "part").select("p_partkey", F.contains(F.lower("p_name"), F.lower(word)).alias("literal"))
