"""Queries about costs, indicators, bids and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import money as M

from .registry import query, table


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lots: hammer, tax and the market value of their part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    lots = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cost = M.all_in(F.col("l_extendedprice"), F.lit(15.0), F.col("l_tax") * 100)["total"]
    market = F.col("p_retailprice") * F.greatest(F.lit(1.0), F.col("l_quantity"))
    return lots.withColumns({"cost": cost, "market": market})


PRICED = """
priced AS (
  SELECT *, l_extendedprice + l_extendedprice * 15.0 / 100 + (l_extendedprice + l_extendedprice * 15.0 / 100) * (l_tax * 100) / 100 AS cost,
         p_retailprice * greatest(1.0, l_quantity) AS market
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


@query(f"""
WITH {PRICED}
SELECT CASE WHEN market <= 0 THEN 'na' WHEN cost / market < 0.5 THEN 'green' WHEN cost / market < 0.65 THEN 'yellow'
            WHEN cost / market < 0.75 THEN 'orange' ELSE 'red' END AS band,
       count(*) AS lots, round(min(cost / market), 9) AS least, round(max(cost / market), 9) AS most
FROM priced GROUP BY ALL
""")
def q_all_in_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.ratio(F.col("cost"), F.col("market"))
    rows = _priced(spark, sf_dir).select(r.alias("r")).withColumn("band", M.band(F.col("r")))
    return rows.groupBy("band").agg(F.count("*").alias("lots"), F.round(F.min("r"), 9).alias("least"), F.round(F.max("r"), 9).alias("most"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS hammer, l_tax * 100 AS tax FROM lineitem),
p AS (SELECT *, CAST(floor(hammer * 15.0 / 100 + 0.5) AS BIGINT) AS premium FROM c),
t AS (SELECT *, CAST(floor((hammer + premium) * tax / 100 + 0.5) AS BIGINT) AS taxed FROM p)
SELECT l_linenumber, count(*) AS lots, CAST(sum(hammer + premium + taxed) AS BIGINT) AS total_cents, max(hammer + premium + taxed) AS most_cents FROM t GROUP BY 1
""")
def q_all_in_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", M.cents(F.col("l_extendedprice")).alias("h"), (F.col("l_tax") * 100).alias("t"))
    rows = rows.select("l_linenumber", M.all_in_cents(F.col("h"), F.lit(15.0), F.col("t")).alias("c"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("lots"), F.sum("c").alias("total_cents"), F.max("c").alias("most_cents"))


@query("""
WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS budget FROM orders),
e AS (SELECT *, CAST(floor(budget / ((1 + 15.0 / 100) * (1 + 8.25 / 100))) AS BIGINT) AS g FROM b),
k AS (SELECT *, unnest(generate_series(greatest(g - 3, 0), greatest(g + 3, 0))) AS h FROM e),
p AS (SELECT *, CAST(floor(h * 15.0 / 100 + 0.5) AS BIGINT) AS premium FROM k)
SELECT o_orderkey, budget, max(h) FILTER (WHERE h + premium + CAST(floor((h + premium) * 8.25 / 100 + 0.5) AS BIGINT) <= budget) AS max_bid
FROM p GROUP BY 1, 2
""")
def q_max_bid_for_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", M.cents(F.col("o_totalprice")).alias("budget"))
    return rows.withColumn("max_bid", M.max_bid_cents(F.col("budget"), F.lit(15.0), F.lit(8.25)))


@query(f"""
WITH {PRICED}, n AS (
  SELECT l_returnflag, greatest(0.0, market * (1 - 13.25 / 100) - 0.30) - cost AS profit, cost FROM priced)
SELECT l_returnflag, CASE WHEN cost <> 0 AND profit / cost >= 0.5 THEN 'positive' WHEN profit < 0 THEN 'negative' ELSE 'neutral' END AS roi,
       count(*) AS lots, round(sum(profit), 2) AS profit FROM n GROUP BY ALL
""")
def q_profit_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _priced(spark, sf_dir).withColumn("p", M.net_resale(F.col("market")) - F.col("cost"))
    rows = rows.withColumn("roi", M.roi_class(F.col("p"), F.col("cost")))
    return rows.groupBy("l_returnflag", "roi").agg(F.count("*").alias("lots"), F.round(F.sum("p"), 2).alias("profit"))


@query(f"""
WITH {PRICED}, s AS (
  SELECT p.*, CASE o_orderstatus WHEN 'F' THEN 'Winning' WHEN 'O' THEN 'Outbid' ELSE 'Watching' END AS status
  FROM priced p JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'parts_only'
            WHEN status = 'Winning' THEN CASE WHEN market <= 0 THEN 'manual' WHEN cost > market THEN 'winning_above_retail' ELSE 'hold' END
            WHEN market <= 0 THEN 'manual'
            WHEN status = 'Outbid' THEN CASE WHEN l_extendedprice > market * 0.6 THEN 'let_go' ELSE 'raise' END
            WHEN l_extendedprice > market * 0.6 THEN 'at_ceiling' ELSE 'under_ceiling' END AS verdict, count(*) AS lots
FROM s GROUP BY 1
""")
def q_account_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = _priced(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "Winning").when(F.col("o_orderstatus") == "O", "Outbid").otherwise("Watching")
    parts = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    kind = M.verdict(parts, status, F.col("l_extendedprice"), F.col("cost"), F.col("market") * 0.6, F.col("market"))
    return rows.groupBy(kind.alias("verdict")).agg(F.count("*").alias("lots"))


@query("""
SELECT l_linenumber, count(*) AS lots, round(sum(CASE WHEN n > 0 THEN n WHEN c >= 0 THEN c END), 2) AS hammer,
       count(*) FILTER (WHERE NOT (n > 0) OR n IS NULL) AS from_current
FROM (SELECT l_linenumber, CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS n, l_extendedprice - l_discount * 1000 AS c FROM lineitem) GROUP BY 1
""")
def q_hammer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice")).alias("n"), (F.col("l_extendedprice") - F.col("l_discount") * 1000).alias("c")
    )
    return rows.groupBy("l_linenumber").agg(
        F.count("*").alias("lots"), F.round(F.sum(M.hammer(F.col("n"), F.col("c"))), 2).alias("hammer"), F.count_if(F.coalesce(~(F.col("n") > 0), F.lit(True))).alias("from_current")
    )


@query("""
SELECT l_orderkey, l_linenumber, round(max(CASE WHEN l_discount > 0.05 THEN l_extendedprice * l_discount WHEN l_returnflag = 'R' THEN coalesce(NULL, l_extendedprice)
       ELSE l_quantity END), 6) AS current_bid FROM lineitem GROUP BY ALL
""")
def q_current_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    realized = F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice") * F.col("l_discount")).otherwise(0.0)
    high = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    bid = M.current_bid(realized, high, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max(bid), 6).alias("current_bid"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 10.0
       WHEN s_suppkey IS NOT NULL AND o_orderkey % 60 <= 30 THEN CAST(s_nationkey AS DOUBLE)
       WHEN o_orderstatus = 'F' THEN 18.0 ELSE 15.0 END AS premium_pct
FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey
""")
def q_premium_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("parsed"))
    rows = table(spark, sf_dir, "orders").join(sellers, F.col("o_custkey") == F.col("s_suppkey"), "left")
    user = F.when(F.col("o_orderpriority") == "1-URGENT", 10.0)
    page = F.when(F.col("o_orderstatus") == "F", 18.0)
    return rows.select("o_orderkey", M.premium_pct(user, F.col("parsed"), F.col("o_orderkey") % 60, page).alias("premium_pct"))


@query(f"""
WITH {PRICED}
SELECT l_linestatus, round(sum(market * (1 - 0.1325) - cost), 2) AS profit_if_won_now, round(sum(market * 0.65 / (1.15 * (1 + l_tax))), 2) AS recommended_max_bid,
       round(sum(market * (1 - 0.1325) - market * 0.65), 2) AS profit_at_recommended_max_bid FROM priced GROUP BY 1
""")
def q_brief_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, target = F.col("market") * (1 - 0.1325), F.col("market") * 0.65
    return _priced(spark, sf_dir).groupBy("l_linestatus").agg(
        F.round(F.sum(net - F.col("cost")), 2).alias("profit_if_won_now"),
        F.round(F.sum(target / (1.15 * (1 + F.col("l_tax")))), 2).alias("recommended_max_bid"),
        F.round(F.sum(net - target), 2).alias("profit_at_recommended_max_bid"),
    )


@query("""
SELECT CASE WHEN m IS NULL THEN 'none' WHEN l_quantity < m THEN 'under' WHEN l_quantity = m THEN 'at' ELSE 'over' END AS label, count(*) AS lots
FROM (SELECT l_quantity, CASE WHEN l_returnflag <> 'A' THEN CAST(l_linenumber * 7 AS DOUBLE) END AS m FROM lineitem) GROUP BY 1
""")
def q_max_bid_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("l_returnflag") != "A", (F.col("l_linenumber") * 7).cast("double"))
    return table(spark, sf_dir, "lineitem").groupBy(M.max_bid_label(F.col("l_quantity"), limit).alias("label")).agg(F.count("*").alias("lots"))


@query("""
SELECT p_partkey, CAST(nullif(replace(regexp_extract(t, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', ''), '') AS DOUBLE) AS price
FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'call for price' ELSE 'Est. $' || CAST(p_size AS VARCHAR) || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.50 USD' END AS t FROM part)
""")
def q_money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Est. $"), F.col("p_size").cast("string"), F.lit(","), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".50 USD"))
    text = F.when(F.col("p_size") % 5 == 0, "call for price").otherwise(text)
    return table(spark, sf_dir, "part").select("p_partkey", M.money_text(text).alias("price"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '--' ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || format('{:,}', abs(v) // 100) || '.' || lpad(CAST(abs(v) % 100 AS VARCHAR), 2, '0') END AS label
FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer)
""")
def q_usd_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.usd(amount).alias("label"))


@query("""
SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal >= 0) AS valid, count(*) FILTER (WHERE c_acctbal < 0) AS rejected, round(sum(c_acctbal) FILTER (WHERE c_acctbal >= 0), 2) AS total
FROM customer GROUP BY 1
""")
def q_domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = M.money_or_null(F.col("c_acctbal"))
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", amount.alias("a"))
    return rows.groupBy("c_mktsegment").agg(F.count("a").alias("valid"), F.count_if(F.col("a").isNull()).alias("rejected"), F.round(F.sum("a"), 2).alias("total"))
