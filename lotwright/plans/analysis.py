"""Queries about the wide record of a lot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import analysis
from lotwright.functions import values as V

from .listings import PARTS_SQL, _amount_sql, _AND_SQL, flags, listings, plain
from .registry import query, table

TAX = 7.0


@query(f"""WITH {PARTS_SQL},
e AS (SELECT id, description, regexp_matches(coalesce(description, '') || ' ', '{V.CAD[0]}') OR regexp_matches(coalesce(description, '') || ' ', '{V.CAD[1]}') AS cad,
  len({flags(plain('title'), {str(k): p for k, (w, p, _) in enumerate(V.MIXED) if w == 'title'})}) > 0 OR regexp_matches({plain('description')}, '{V.MIXED[3][1]}', 'i') AS mixed, {plain(_AND_SQL('title', 'description'))} AS h FROM listings),
f AS (SELECT id, cad, mixed, coalesce({', '.join(_amount_sql(f"regexp_extract(h, '{p}', 1)") for p in V.RETAIL)}) AS stated, (id % 3 = 2 OR mixed) AND id % 5 <> 0 AS review,
  CASE WHEN id % 3 <> 0 THEN id % 50 + 1.0 ELSE id % 40 END AS hammer, CASE WHEN id % 7 < 5 THEN id % 7 * 5.0 WHEN id % 7 = 5 THEN 12.5 ELSE 15.0 END AS pct, CASE WHEN id % 4 = 0 THEN id % 90 + 10.5 END AS resale FROM e),
g AS (SELECT *, CASE WHEN NOT cad THEN hammer + hammer * pct / 100 + (hammer + hammer * pct / 100) * {TAX} / 100 END AS total FROM f),
r AS (SELECT *, total / nullif(stated, 0) AS a, total / nullif(resale, 0) AS b FROM g)
SELECT id, CASE WHEN cad THEN 'CAD' ELSE 'USD' END AS currency, mixed, review AS needs_quantity, pct::DOUBLE AS premium_pct, hammer::DOUBLE AS hammer, round(total, 6) AS total, stated AS stated_retail,
  round(CASE WHEN resale IS NOT NULL THEN greatest(0.0, resale * (1 - 13.25 / 100) - 0.30) END, 6) AS ebay_net, CASE WHEN a IS NULL THEN 'na' WHEN a < 0.5 THEN 'green' WHEN a < 0.65 THEN 'yellow' WHEN a < 0.75 THEN 'orange' ELSE 'red' END AS amazon_indicator,
  CASE WHEN b IS NULL THEN 'na' WHEN b < 0.5 THEN 'green' WHEN b < 0.65 THEN 'yellow' WHEN b < 0.75 THEN 'orange' ELSE 'red' END AS ebay_indicator, NOT cad AND NOT mixed AND NOT review AS eligible FROM r
""")
def q_analysis_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis record of every part as a lot; identity and condition are in it, their SQL is in queries of their own."""
    i, none = F.col("id"), F.lit(None)
    lots = listings(spark, sf_dir).select(
        "id", "title", F.lit("").alias("lead"), "description", none.cast("string").alias("estimate"), F.when(i % 3 == 2, 2.0).alias("quantity"), F.when(i % 3 != 0, i % 50 + 1.0).alias("next_bid"), (i % 40).cast("double").alias("current_bid"),
        (i % 7).alias("auction_id"), F.when(i % 7 == 5, "12.5% online").alias("buyer_premium"), F.col("description").alias("raw_text"),
    )
    stored = lots.where("id % 4 = 0 OR id % 5 = 0").select("id", F.when(i % 4 == 0, i % 90 + 10.5).alias("resale"), F.when(i % 5 == 0, 1.0).alias("confirmed_quantity"), none.cast("string").alias("query_override"))
    premiums = spark.range(5).select(F.col("id").alias("auction_id"), (F.col("id") * 5.0).alias("pct"))
    rows = analysis.analysed(lots, stored, premiums, F.lit(TAX))
    return rows.select(
        "id", "currency", "mixed.mixed", "needs_quantity", "premium_pct", "hammer", F.round("all_in.total", 6).alias("total"), "stated_retail", F.round("ebay_net", 6).alias("ebay_net"), "amazon_indicator", "ebay_indicator", "eligible",
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name END AS c_name, NULL AS c_acctbal, left(c_mktsegment, 5) AS segment FROM customer")
def q_private_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without what is private: no name without a balance, no balance, segments cut."""
    rows = analysis.masked(table(spark, sf_dir, "customer"), ["c_phone", "c_address"], opted_in=False)
    return rows.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("c_name"), F.lit(None).cast("int").alias("c_acctbal"), F.left("c_mktsegment", F.lit(5)).alias("segment"))
