"""Queries about REST answers and the proof tiers of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import rest
from lotwright.operators import coverage

from .registry import query, table

_ITEM = """'{"id":' || p_partkey || ',"auction_id":7,"auction_name":"Sale ' || p_size || '","lot_identifier":"' || p_partkey % 50 || '","name":"' || p_name || '","name_with_prefix":"#' || p_partkey % 50 || ' ' || p_name || '","description":"<p>Type: ' || p_type || '</p><strong>Terms of Sale</strong><p>No refunds.</p>"'
  || CASE WHEN p_partkey % 3 = 0 THEN ',"description_without_html":"Plain ' || p_type || ' terms of sale apply"' ELSE '' END || CASE WHEN p_partkey % 4 > 0 THEN ',"api_bidding_state":{"high":{"amount":' || p_size || '.5},"ask_amount":' || (p_size + 5) || ',"accepted_bid_count":' || p_partkey % 4 || '}' ELSE '' END
  || ',"status":"accepting_bids","main_category":"' || p_brand || '","sub_categories":[{"name":"' || p_type || '"},{"name":"' || p_brand || '"}],"location":{"city":"Town","zip":"0' || p_size || '"},"images":[{"sm":"s.jpg","lg":"l' || p_partkey || '.jpg"},{"xl":"x.jpg"},{"sm":"s.jpg","lg":"l' || p_partkey || '.jpg"}],
  "bidding_configuration":{"start_amount":1,"low_estimate":' || p_size || ',"high_estimate":' || p_size * 2 || '},"contact_email":"no@x.yz"}'"""


@query("""
WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'Plain ' || p_type ELSE 'Type: ' || p_type END AS d FROM part)
SELECT '' || p_partkey AS id, '' || p_partkey % 50 AS lot, p_name AS title, 'https://site.example/ui/auctions/7/' || p_partkey AS url, d AS description, CASE WHEN p_partkey % 4 > 0 THEN p_size + 0.5 END::DOUBLE AS current_bid, CASE WHEN p_partkey % 4 > 0 THEN p_size + 5.0 END::DOUBLE AS next_bid,
  CAST(p_size AS DOUBLE) AS estimate_low, p_size * 2.0::DOUBLE AS estimate_high, p_brand || '/' || p_type AS path, 'Town, 0' || p_size AS location, 'l' || p_partkey || '.jpg,x.jpg' AS images,
  '#' || p_partkey % 50 || ' ' || p_name || ' ' || d || CASE WHEN p_partkey % 4 > 0 THEN ' High bid $' || p_size || '.50 ' || p_partkey % 4 || CASE WHEN p_partkey % 4 = 1 THEN ' Bid' ELSE ' Bids' END ELSE '' END || ' accepting bids' AS raw_text FROM p
""")
def q_rest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items of a REST answer: bids, estimates, descriptions up to the terms of sale."""
    items = table(spark, sf_dir, "part").select(F.from_json(F.expr(_ITEM), rest.ITEM).alias("item"))
    rows = items.select(rest.rest_item(F.col("item"), F.lit("https://site.example")).alias("lot")).where("lot IS NOT NULL").select("lot.*")
    return rows.select("id", "lot", "title", "url", "description", "current_bid", "next_bid", "estimate_low", "estimate_high", F.array_join("category_path", "/").alias("path"), "location", F.array_join("images", ",").alias("images"), "raw_text")


_AUCTION = """'{"id":' || s_suppkey || ',"name":"' || s_name || '","simple_description":"<p>Showroom.' || CASE WHEN s_suppkey % 3 = 0 THEN ' Buyer' || chr(39) || 's premium is ' || s_suppkey % 30 || '%.' ELSE '' END || '</p>","terms":"<b>As is.</b>' || CASE WHEN s_suppkey % 3 = 1 THEN ' A buyers premium of 18 % applies.' ELSE '' END
  || '","location":{"street":"1 Main","country":"US"},"items_count":' || s_suppkey % 900 || ',"status":"complete","contact_email":"must@not.example","contact_phone":"555-0100"}'"""


@query("""
SELECT '' || s_suppkey AS auction_id, s_name AS auction_title, '1 Main, US' AS location, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey % 30 || '%' WHEN 1 THEN '18 %' ELSE '' END AS buyer_premium, s_suppkey % 900 AS items, false AS leaks FROM supplier
""")
def q_public_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as auctions: what may be told of them."""
    rows = table(spark, sf_dir, "supplier").select(rest.public_context(F.from_json(F.expr(_AUCTION), rest.AUCTION)).alias("a"))
    return rows.select("a.auction_id", "a.auction_title", "a.location", "a.buyer_premium", "a.items", F.to_json("a").rlike("must@not|555-0100").alias("leaks"))


@query("""
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL ELSE CAST(1000 + page_id % 500 AS INT) END AS total_sales, CASE WHEN page_id % 9 <> 0 THEN 'DefLati,SlrVals,location' END AS ignored, page_id % 9 <> 0 AS has_page, false AS leaks FROM pages
""")
def q_json_fragment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page answers that carry markup and private members: the markup stays, of the others the names."""
    page = F.struct(
        F.format_string("<div><span>1,%03d sales</span></div>", F.col("page_id") % 500).alias("head"), F.col("html").alias("body"), F.lit("<a href='x.php?Page=2'>2</a>").alias("pagination"), F.array(F.lit("private map popup")).alias("location"),
        F.lit("<input value='private-filter'>").alias("SlrVals"), F.lit("40.0000").alias("DefLati"),
    )
    body = F.when(F.col("page_id") % 9 == 0, F.lit("[1, broken")).otherwise(F.to_json(page.withField("head", F.regexp_replace(F.format_string("<div><span>1,%03d sales</span></div>", F.col("page_id") % 500), "1,", "1"))))
    rows = table(spark, sf_dir, "pages").select("page_id", "html", rest.json_fragments(body).alias("p"))
    return rows.select("page_id", "p.total_sales", F.array_join("p.ignored", ",").alias("ignored"), F.coalesce(F.contains("p.html", F.col("html")), F.lit(False)).alias("has_page"), F.coalesce(F.col("p.html").rlike("private map popup|private-filter|40\\.0000"), F.lit(False)).alias("leaks"))


@query("""
WITH o AS (SELECT o_custkey AS s, o_orderkey AS id, o_custkey % 6 AS k FROM orders), c AS (SELECT s, k, count(*) AS n, count(*) FILTER (WHERE k = 1 AND id % 5 = 0) AS gone, count(*) FILTER (WHERE k = 2 AND id % 3 = 0) AS twice FROM o GROUP BY ALL),
r AS (SELECT s, CASE WHEN k IN (3, 4, 5) THEN true ELSE false END AS unknown, gone, twice, s % 4 = 0 AS exhausted, s % 4 = 1 AS settled FROM c)
SELECT CASE WHEN unknown THEN CASE WHEN exhausted THEN 'pagination-exact' WHEN settled THEN 'dom-bottom-settled' ELSE 'unproven' END WHEN gone = 0 AND twice = 0 THEN 'api-exact' ELSE 'unproven' END AS tier,
  CASE WHEN unknown THEN CASE WHEN exhausted OR settled THEN 'complete' ELSE 'expected-total-unknown' END WHEN twice > 0 THEN 'duplicate-identities' WHEN gone > 0 THEN 'count-mismatch' ELSE 'complete' END AS proof, count(*) AS captures FROM r GROUP BY ALL
""")
def q_proof_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as a capture, of which some lack records, repeat ids or do not know their total; by what proves them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("snapshot"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 6).alias("k"))
    enumerated = orders.select("snapshot", "id", F.when((F.col("k") == 2) & (F.col("id") % 3 == 0), 2).otherwise(1).alias("n"))
    hydrated = orders.where("NOT (k = 1 AND id % 5 = 0)").select("snapshot", "id")
    expected = orders.groupBy("snapshot", "k").agg(F.count("*").alias("n")).select("snapshot", F.when(~F.col("k").isin(3, 4, 5), F.col("n")).alias("total"), F.lit("f").alias("start"), F.lit("f").alias("end"))
    s = F.col("snapshot")
    proofs = orders.select("snapshot").distinct().select("snapshot", (s % 4 == 0).alias("exhausted"), (s % 4 == 1).alias("settled"))
    return coverage.proven(coverage.audit(enumerated, hydrated, expected), proofs).groupBy("tier", "proof").agg(F.count("*").alias("captures"))
