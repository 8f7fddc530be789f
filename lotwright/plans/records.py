"""Queries about records as they are read and kept: lots, jobs, settings, provider state, orders of lists, private data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import jobs as J
from lotwright.functions import lots as L
from lotwright.functions import urls as U
from lotwright.functions import values as V
from lotwright.operators import keyed, sequences

from .registry import query, spread, table

#: A raw record of every part, as the JSON text that a lot scan lands; every fiftieth has no id.
RAW = """to_json(named_struct(
 'id', IF(p_partkey % 50 = 49, NULL, p_partkey), 'lotNumber', IF(p_partkey % 7 = 0, NULL, concat('L ', p_size)), 'saleOrder', p_size, 'lead', IF(p_partkey % 11 = 0, NULL, concat('  ', p_name, '  x ')), 'title', p_name,
 'description', IF(p_partkey % 13 = 0, NULL, concat('<p>First &amp; ', p_type, '</p><ul><li>one</li><li>two  three</li></ul>Condition: NEW<br>Make: ', p_brand)),
 'featuredPicture', IF(p_partkey % 3 = 0, NULL, named_struct('fullSizeLocation', concat('/img/', p_partkey))),
 'pictures', array(named_struct('fullSizeLocation', concat('/img/', p_partkey), 'thumbnailLocation', 't1', 'url', CAST(NULL AS STRING)), named_struct('fullSizeLocation', CAST(NULL AS STRING), 'thumbnailLocation', '', 'url', concat('u', p_size))),
 'category', array(named_struct('fullCategory', p_type, 'categoryName', p_brand), named_struct('fullCategory', p_type, 'categoryName', 'All')),
 'lotState', named_struct('highBid', IF(p_partkey % 4 = 0, NULL, p_retailprice), 'priceRealized', CASE p_partkey % 5 WHEN 0 THEN 0.0D WHEN 1 THEN p_retailprice * 2 END, 'price', CAST(p_size AS DOUBLE), 'nextBid', p_retailprice + 1, 'bidCount', p_size,
  'productUrl', CASE p_partkey % 6 WHEN 1 THEN '/lot/9' WHEN 2 THEN 'https://o.example/x' WHEN 3 THEN '' WHEN 4 THEN 'more' END, 'status', IF(p_partkey % 2 = 0, ' Open ', NULL), 'priceRealizedMessage', 'sold'),
 'auction', named_struct('id', p_size, 'eventName', p_brand, 'eventCity', 'Town', 'eventState', '', 'eventZip', ' 08817 ', 'buyerPremiumRate', '15.0'), 'quantity', 2, 'watchNotes', 'mine'))"""


@query("""
WITH r AS (SELECT *, p_partkey % 13 <> 0 AS d, 'First & ' || p_type || chr(10) || '- one' || chr(10) || '- two three' || chr(10) || 'Condition: NEW' || chr(10) || 'Make: ' || p_brand AS t, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'L ' || p_size END AS lot,
  CASE WHEN p_partkey % 11 = 0 THEN p_name ELSE p_name || ' x' END AS title, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Open' ELSE 'sold' END AS status FROM part WHERE p_partkey % 50 <> 49)
SELECT 'api' AS source, 'catalog' AS page_kind, id, id AS event_item_id, '' AS item_id, lot, title, title AS lead, '' AS estimate,
  CASE p_partkey % 6 WHEN 1 THEN 'https://site.example/lot/9' WHEN 2 THEN 'https://o.example/x' WHEN 4 THEN 'https://site.example/catalog/7/more' ELSE 'https://site.example/lot/' || id END AS url,
  '/img/' || id AS image, ['/img/' || id, 't1', 'u' || p_size] AS images, CASE WHEN d THEN t ELSE '' END AS description, CASE WHEN d THEN '<p>First &amp; ' || p_type || '</p><ul><li>one</li><li>two  three</li></ul>Condition: NEW<br>Make: ' || p_brand ELSE '' END AS description_html,
  p_type AS category, [p_type, p_brand, 'All'] AS categories, CASE WHEN p_partkey % 5 = 1 THEN p_retailprice * 2 WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS current_bid, p_retailprice + 1 AS next_bid, CAST(p_size AS DOUBLE) AS bid_count,
  status, '' AS time_left, 2.0::DOUBLE AS quantity, false AS shipping_offered, CAST(p_size AS VARCHAR) AS auction_id, p_brand AS auction_title, 'Town, 08817' AS location, '15.0' AS buyer_premium, 'mine' AS watch_notes,
  lot || ' | ' || title || CASE WHEN d THEN ' | ' || t ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN ' | Open' ELSE '' END AS raw_text, CASE WHEN d THEN 'NEW' END AS condition, CASE WHEN d THEN p_brand END AS make, d AS has_description, 3 AS image_count
FROM r
""")
def q_lot_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.from_json(F.expr(RAW), L.RAW_LOT).alias("raw")).where(L.lot_number(F.col("raw")) != "")
    raw = raw.select("raw", L.description_text(L.markup_of(F.col("raw"))).alias("text"))
    lots = raw.select(L.normalised_lot(F.col("raw"), F.lit("catalog"), F.lit("https://site.example/catalog/7/all?q=1"), F.lit("7"), F.col("text")).alias("lot")).select("lot.*")
    fields = F.col("description_fields")
    return lots.select("*", fields["Condition"].alias("condition"), fields["Make"].alias("make"), "audit.*").drop("description_fields", "audit")


STATES_SQL = "[" + ", ".join(f"'{s}'" for s in [*V.STATE_TAX, "ZZ"]) + "]"
RATES_SQL = "(VALUES " + ", ".join(f"('{s}', {r}::DOUBLE)" for s, r in V.STATE_TAX.items()) + ") AS t(state, rate)"
N_STATES = len(V.STATE_TAX) + 2


@query(f"""
WITH c AS (SELECT c_custkey, list_extract({STATES_SQL}, CAST(c_custkey % {N_STATES} + 1 AS INT)) AS state, c_custkey % 10 = 0 AS exempt, CASE WHEN c_custkey % 9 = 1 THEN '4.25' WHEN c_custkey % 9 = 2 THEN 'none' END AS o FROM customer)
SELECT c_custkey, state, CASE WHEN exempt THEN 0.0 ELSE coalesce(TRY_CAST(o AS DOUBLE), rate, 0.0) END AS tax FROM c LEFT JOIN {RATES_SQL} USING (state)
""")
def q_tax_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's sales tax: exempt, overridden, by state, or none for no or an unknown state."""
    state = F.try_element_at(F.array(*map(F.lit, [*V.STATE_TAX, "ZZ"])), (F.col("c_custkey") % N_STATES + 1).cast("int"))
    override = F.when(F.col("c_custkey") % 9 == 1, "4.25").when(F.col("c_custkey") % 9 == 2, "none")
    return table(spark, sf_dir, "customer").select("c_custkey", state.alias("state"), J.effective_tax(F.col("c_custkey") % 10 == 0, override, state).alias("tax"))


#: A job and a page of every customer; the items are the customer's orders.
JOBS_SQL = """j AS (SELECT c_custkey, ['completed', 'failed', 'enumerating'][CAST(CASE WHEN c_custkey % 4 = 3 THEN 1 + c_nationkey % 2 ELSE 0 END AS INT) + 1] AS phase, CASE WHEN c_custkey % 8 = 2 THEN 'b' ELSE 'a' END AS own,
  ['catalog', 'pastbids', 'search', 'pastwatchlist'][CAST(c_nationkey % 4 AS INT) + 1] AS kind, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE 'g' || c_nationkey % 2 END AS scope,
  coalesce(n, 0) + CASE WHEN c_custkey % 16 = 5 THEN 1 ELSE 0 END AS total, coalesce(n, 0) AS n, coalesce(ids, 0) AS ids, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE coalesce(n, 0) END AS visible
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT o_totalprice > 0) AS ids FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    items = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct(F.col("o_totalprice") > 0).alias("ids"))
    rows = table(spark, sf_dir, "customer").join(items, F.col("o_custkey") == F.col("c_custkey"), "left").fillna(0, ["n", "ids"])
    c, k = F.col("c_custkey"), F.col("c_nationkey")
    job = F.struct(
        F.when(c % 8 == 2, "b").otherwise("a").alias("fingerprint"), pick(["completed", "failed", "enumerating"], F.when(c % 4 == 3, 1 + k % 2).otherwise(0)).alias("phase"),
        F.when(c % 3 == 0, F.lit(None)).when(c % 3 == 1, "").otherwise(F.concat(F.lit("g"), (k % 2).cast("string"))).alias("scope_id"), (F.col("n") + F.when(c % 16 == 5, 1).otherwise(0)).alias("expected_total"),
    )
    page = F.struct(F.lit("a").alias("fingerprint"), pick(["catalog", "pastbids", "search", "pastwatchlist"], k % 4).alias("kind"), F.when(c % 5 != 0, F.col("n")).alias("visible_total"))
    return rows.select("c_custkey", "n", "ids", job.alias("job"), page.alias("page"))


@query(f"""WITH {JOBS_SQL} SELECT c_custkey, n, CASE WHEN phase <> 'completed' THEN 'phase' WHEN own <> 'a' THEN 'fingerprint'
  WHEN CASE WHEN kind IN ('pastbids', 'pastwatchlist') THEN coalesce(scope, '') = '' ELSE scope IS NOT NULL END THEN 'scope' WHEN total <> n THEN 'count' WHEN ids <> n THEN 'unique' END AS refusal FROM j""")
def q_export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a customer's capture may not be exported; orders of one sign count as one id, so most are not unique."""
    return _jobs(spark, sf_dir).select("c_custkey", "n", J.refusal(F.col("job"), F.col("page"), F.col("n"), F.col("ids")).alias("refusal"))


@query(f"""WITH {JOBS_SQL} SELECT c_custkey, own = 'a' AND CASE WHEN kind IN ('pastbids', 'pastwatchlist') THEN coalesce(scope = 'g1', false) ELSE scope IS NULL AND NOT (phase = 'completed' AND visible IS NOT NULL AND total <> visible) END AS fits FROM j""")
def q_job_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("c_custkey", J.matches(F.col("job"), F.col("page"), F.lit("g1")).alias("fits"))


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'much' ELSE CAST(c_nationkey * 5 - 10 AS VARCHAR) END AS pct, CASE WHEN c_mktsegment = 'BUILDING' THEN 'true' WHEN c_mktsegment = 'MACHINERY' THEN 'false' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'maybe' END AS f, CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE ' Town ' END AS t FROM customer)
SELECT c_custkey, NULL::VARCHAR AS "stateCode", NULL::DOUBLE AS "taxPctOverride", coalesce(f = 'true', true) AND f IS DISTINCT FROM 'maybe' OR f = 'maybe' AS "taxOnPremium", coalesce(TRY_CAST(pct AS DOUBLE), 13.25) AS "ebayFeePct", 30.0::DOUBLE AS "ebayFeeFixedCents", true AS "catalogChips", false AS "nativeWatchSync",
  coalesce(f = 'true', false) AS "taxExempt", false AS "debugMode", false AS "includePrivateWatchNotes", true AS "amazonAutoLookup", least(95.0, greatest(1.0, coalesce(TRY_CAST(pct AS DOUBLE), 50.0))) AS "retailTargetPct", least(95.0, greatest(1.0, coalesce(TRY_CAST(pct AS DOUBLE), 25.0))) AS "retailWarningPct",
  CASE WHEN trim(t) = '' THEN 'Edison, NJ' ELSE trim(t) END AS "originLabel", '08817' AS "originZip", least(500.0, greatest(1.0, coalesce(TRY_CAST(pct AS DOUBLE) * 10, 100.0))) AS "radiusMiles", trim(t) AS "customInstructions" FROM s
""")
def q_settings_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings of every customer from stored text, of which some is missing, unusable or out of range."""
    pct = F.when(F.col("c_custkey") % 5 == 1, F.lit("much")).when(F.col("c_custkey") % 5 > 1, (F.col("c_nationkey") * 5 - 10).cast("string"))
    flag = F.when(F.col("c_mktsegment") == "BUILDING", "true").when(F.col("c_mktsegment") == "MACHINERY", "false").when(F.col("c_mktsegment") == "AUTOMOBILE", "maybe")
    town = F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(" Town ")
    stored = {"ebayFeePct": pct, "retailTargetPct": pct, "retailWarningPct": pct, "radiusMiles": F.concat(pct, F.when(pct != "much", F.lit("0"))), "taxOnPremium": flag, "taxExempt": flag, "originLabel": town, "customInstructions": town}
    stored = F.create_map(*(x for n, v in stored.items() for x in (F.lit(n), v)))
    return table(spark, sf_dir, "customer").select("c_custkey", stored.alias("s")).select("c_custkey", J.settings(F.col("s")).alias("x")).select("c_custkey", "x.*")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END AS next_allowed_at, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 0 END AS consecutive_failures, c_mktsegment AS last_status, 0::BIGINT AS updated_at FROM customer")
def q_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.create_map(F.lit("nextAllowedAt"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_nationkey").cast("string")), F.lit("consecutiveFailures"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise("x"), F.lit("lastStatus"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", J.throttle(stored).alias("x")).select("c_custkey", "x.*")


@query("""
WITH n AS (SELECT c_custkey, c_mktsegment || ' ' || c_custkey % 1000 || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'a' END AS lot FROM customer)
SELECT c_custkey, lower(regexp_extract(lot, '^[^0-9]*')) || lpad(regexp_extract(lot, '([0-9]+)'), 20, '0') || regexp_extract(lot, '[0-9]+(.*)$', 1) AS key FROM n
""")
def q_natural_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lot = F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 1000).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("a"))
    return table(spark, sf_dir, "customer").select("c_custkey", J.natural(lot).alias("key"))


#: Watched lots: users' events, whose value is when they end; every seventh has no end.
WATCH_SQL = "w AS (SELECT event_id AS lot_id, user_id, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value * 1000000) AS BIGINT) END AS ends_at, event_id % 11 AS added_at, event_type = 'error' AS stale FROM events)"


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") * 1_000_000).cast("long"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("lot_id"), "user_id", ends.alias("ends_at"), (F.col("event_id") % 11).alias("added_at"), (F.col("event_type") == "error").alias("stale"))


@query(f"WITH {WATCH_SQL} SELECT lot_id, ends_at, added_at FROM w ORDER BY ends_at NULLS LAST, added_at NULLS LAST, lot_id LIMIT 500")
def q_watch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the watchlist."""
    return _watched(spark, sf_dir).orderBy(*J.watch_order()).limit(500).select("lot_id", "ends_at", "added_at")


@query(f"WITH {WATCH_SQL} SELECT lot_id, ends_at FROM w WHERE NOT stale AND ends_at > 20000000 AND ends_at <= 20000000 + 86400000 ORDER BY ends_at, lot_id LIMIT 10")
def q_refresh_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.due(_watched(spark, sf_dir), F.lit(20_000_000)).select("lot_id", "ends_at")


@query("SELECT user_id, arg_max(event_id, (CAST(json_extract(props, '$.k') AS BIGINT), ts, event_id)) AS hit FROM events GROUP BY 1")
def q_cache_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a key's cached answers the one with most evidence, of these the latest."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.from_json("props", "k bigint")["k"].alias("evidence"), "ts")
    return keyed.best(rows, ["user_id"], F.struct("evidence", "ts", "event_id")).select("user_id", F.col("event_id").alias("hit"))


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4, o_orderkey) AS pos, o_orderkey AS id FROM orders")
def q_pages_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a customer's orders one after the other, whatever order they were landed in."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 4).alias("page"), F.col("o_orderkey").alias("id"))
    return sequences.numbered(rows, ["o_custkey"], ["page", "id"], "pos", F.col("page")).select("o_custkey", "pos", "id")  # a page is a piece


_SCRUBBED_SQL = "text"
for _p, _by in J.PRIVATE_TEXT:
    _SCRUBBED_SQL = f"regexp_replace({_SCRUBBED_SQL}, '{_p.replace(chr(39), chr(39) * 2)}', '{_by}', 'g')"


@query(f"SELECT doc_id, sha256({_SCRUBBED_SQL}) AS digest, {_SCRUBBED_SQL} <> text AS private FROM documents")
def q_pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without private data, and whether it held any."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", J.scrubbed(F.col("text")).alias("clean"))
    return rows.select("doc_id", F.sha2("clean", 256).alias("digest"), (F.col("clean") != F.col("text")).alias("private"))


@query(f"""WITH w AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || CASE WHEN contains(url, '?') THEN '' ELSE '?a=1&buyer_email=x' END ELSE url END AS url FROM pages),
p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(regexp_extract(x, '^[^=]*'), '(?i)^(?:utm_.*|ref|fbclid|gclid|mc_.*|session(?:id)?)$|email|phone|name|address|buyer|user')) AS q FROM w)
SELECT page_id, regexp_extract(url, '^[^?#]*') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p""")
def q_redirect_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every page's link leads: half of them are wrapped in a redirect first."""
    inner = F.concat("url", F.when(F.contains("url", F.lit("?")), "").otherwise("?a=1&buyer_email=x"))
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://r.example/go?k=1&u="), U.encoded(inner))).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", U.unwrapped(wrapped).alias("url"))
    return rows.select("page_id", U.canonical_link(F.col("url")).alias("canonical"))
