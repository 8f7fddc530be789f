"""Queries about what leaves the library: diagnostics, briefs, links, keys, partial exports; and about stores of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import guards as G
from lotwright.functions import listing as L
from lotwright.functions import retail as R
from lotwright.functions import values as V
from lotwright.operators import stores

from .listings import PARTS_SQL, flags, listings, plain
from .registry import query, spread, table

JOB_PHASES = ["completed", "failed", "stale", "enumerating"]


@query(f"""
WITH j AS (SELECT o_orderkey, list_extract({JOB_PHASES}, CAST(o_orderkey % 4 + 1 AS INT)) AS phase, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'api-total-drift' END AS code, o_orderpriority FROM orders)
SELECT o_orderkey, phase, CASE WHEN phase IN ('failed', 'stale') THEN CASE WHEN code = '' THEN repeat(o_orderpriority, 40)[:300] ELSE code END ELSE '' END AS reason, 2000 AS url_chars, 1000 AS ids, 100 AS failures, 500 AS failure_chars FROM j
""")
def q_diagnostic_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of jobs (orders) with more of everything than one may tell."""
    k = F.col("o_orderkey")
    phase = F.element_at(F.array(*map(F.lit, JOB_PHASES)), (k % 4 + 1).cast("int"))
    job = F.struct(
        F.repeat(F.lit("u"), 3000).alias("source_url"), F.lit("f").alias("fingerprint"), phase.alias("phase"), F.when(k % 3 == 0, "").otherwise("api-total-drift").alias("error_code"),
        F.repeat("o_orderpriority", 40).alias("message"), F.lit(3).alias("expected_total"), F.lit(2).alias("enumerated"), F.lit(None).cast("int").alias("hydrated"), F.col("o_custkey").alias("contact"),
    )
    told = G.diagnostic(job, {"missing": F.sequence(F.lit(1), F.lit(1200))}, F.array_repeat(F.repeat(F.lit("x"), 600), 120))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey").select(k, told.alias("d"))
    length = lambda x: F.length(x).cast("int")
    return rows.select("o_orderkey", "d.phase", "d.reason", length("d.source_url").alias("url_chars"), F.size("d.missing").alias("ids"), F.size("d.failures").alias("failures"), length(F.col("d.failures")[0]).alias("failure_chars"))


_HEAD = "\n\n".join(f"## {title}\n{body}" for title, body in G.SECTIONS.items()).replace("'", "''")


@query(f"""
WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '## Instructions' || chr(10) || c_mktsegment ELSE '' END AS own FROM customer)
SELECT c_custkey, replace(replace(replace(replace('{_HEAD}', '{{records}}', '1'), '{{expected}}', CAST(c_custkey AS VARCHAR)), '{{origin}}', 'Town 08817'), '{{miles}}', '100') || own
  || chr(10) || chr(10) || '## Data' || chr(10) || '```json' || chr(10) || '{{"name":"' || c_name || '"}}' || chr(10) || '```' AS brief FROM c
""")
def q_llm_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief for each customer's record."""
    own = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_mktsegment")))
    text = G.brief(F.lit(1), F.col("c_custkey"), F.lit("Town 08817"), F.lit(100), own, F.struct(F.col("c_name").alias("name")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("brief"))


_LINK = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://') WHEN 2 THEN 'https://example.com.evil.test/' || page_id WHEN 3 THEN 'javascript:alert(1)' ELSE 'HTTPS://Lots.Example.com:443/' || page_id END"


@query(f"""
WITH p AS (SELECT page_id, {_LINK} AS link FROM pages), h AS (SELECT *, link ILIKE 'https://_%' AS tls, lower(regexp_extract(link, '://([^/?#:]*)', 1)) AS host FROM p)
SELECT page_id, CASE WHEN tls THEN link ELSE '#' END AS external, CASE WHEN tls AND (host = 'example.com' OR host LIKE '%.example.com') THEN link ELSE '/' END AS on_site FROM h
""")
def q_safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as they may be shown."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_LINK} AS link")
    return rows.select("page_id", G.safe_link(F.col("link")).alias("external"), G.safe_link(F.col("link"), "example.com", "/").alias("on_site"))


@query("""
SELECT p_partkey, 'amazon-us:provider-v7:' || lower(p_name || ' ' || p_brand) AS provider, 'amazon-us:3:' || lower(p_name || '|' || p_brand || '||' || p_type || '|{"size":["' || p_size || '"]}|' || p_size || 'gb') AS identity FROM part
""")
def q_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which answers about parts are kept."""
    size = F.col("p_size").cast("string")
    provider = G.provider_key(F.concat(F.lit("  "), F.col("p_name"), F.lit(" \n "), F.col("p_brand")))
    parts = [F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type")]
    identity = G.identity_key(parts, F.struct(F.array(size).alias("size")), F.array(F.concat(size, F.lit("GB"))), F.lit(3))
    return table(spark, sf_dir, "part").select("p_partkey", provider.alias("provider"), identity.alias("identity"))


CONTROLS = [("Search catalog", "/catalog/1"), ("View Catalog", ""), ("Enter catalog now", "/x"), ("The catalog", "/catalog/7"), ("Go", "/livecatalog/7"), ("Show more", ""), ("Watch more lots", ""), ("more lots", "")]


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'View Catalog' WHEN 1 THEN 'Enter catalog now' WHEN 2 THEN 'The catalog' ELSE 'Go' END AS entry, CASE page_id % 4 WHEN 0 THEN 120 WHEN 1 THEN 110 WHEN 2 THEN 80 ELSE 70 END AS score,
  CASE WHEN page_id % 2 = 0 THEN 'Show more' ELSE 'more lots' END AS more FROM pages
""")
def q_control_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page's controls the likeliest way into the catalog, and to more of the list; fewer controls the higher the page's remainder."""
    k = F.col("page_id")
    controls = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.lit(href).alias("href")) for i, (label, href) in enumerate(CONTROLS)))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(controls).alias("c")).select("page_id", "c.*")
    rows = rows.where(~((F.col("pos") >= 1) & (F.col("pos") <= k % 4)) & ~((k % 2 == 1) & (F.col("pos") == 5)))
    rows = rows.withColumns({"entry": G.entry_score(F.col("label"), F.col("href"), F.lit("7")), "more": G.more_score(F.col("label"))})
    top = lambda score: F.max_by("label", F.when(F.col(score) > 0, F.struct(score, -F.col("pos"))))
    return rows.groupBy("page_id").agg(top("entry").alias("entry"), F.max("entry").alias("score"), top("more").alias("more"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'source-mismatch' WHEN count(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') > 0 THEN 'source-mismatch' END AS fault FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def q_source_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's orders may be exported from the page of one source; urgent ones come from another, some contexts as well."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderpriority") == "1-URGENT", "Market Place").otherwise(" eBay ").alias("s"))
    sources = rows.groupBy("c_custkey").agg(F.collect_set("s").alias("s"))  # two values at most
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(sources, "c_custkey", "left")
    fault = G.source_fault(F.coalesce("s", F.array().cast("array<string>")), F.when(F.col("c_custkey") % 3 == 0, "market").otherwise("eBay"), F.lit("ebay"))
    return rows.select("c_custkey", fault.alias("fault"))


@query("""
SELECT l_orderkey, top AS expected, items, list_filter(range(1, top + 1), lambda x: NOT list_contains(ids, x)) AS missing, items = top AND len(ids) = top AS complete, NOT (items = top AND len(ids) = top) AS partial
FROM (SELECT l_orderkey, max(CAST(l_linenumber AS BIGINT)) AS top, count(*) AS items, list_distinct(list(CAST(l_linenumber AS BIGINT))) AS ids FROM lineitem GROUP BY 1)
""")
def q_partial_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captures that should hold every line number up to their highest."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("id"))
    expected = items.groupBy("l_orderkey").agg(F.max("id").alias("top")).select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))).alias("id"))
    gone = stores.missing_ids(expected, items, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("id")).alias("missing"))
    rows = stores.partial_export(expected, items, "l_orderkey").drop("missing").join(gone, "l_orderkey", "left")
    return rows.select("l_orderkey", "expected", "items", F.coalesce("missing", F.array().cast("array<bigint>")).alias("missing"), "complete", "partial")


@query("""
WITH p AS (SELECT 'max-plan-v2:example.com:auction:' || user_id AS plan, event_type AS lot, value AS max, event_id AS seq FROM events), o AS (SELECT plan, lot, arg_min(max, seq) AS max, false AS migrated FROM p GROUP BY ALL),
l AS (SELECT (SELECT arg_min(plan, seq) FROM p) AS plan, lot, max FROM (SELECT p_brand AS lot, max(p_retailprice) AS max FROM part GROUP BY 1 UNION ALL SELECT 'view', 1.0))
SELECT * FROM o UNION ALL SELECT plan, lot, max, true FROM l WHERE (plan, lot) NOT IN (SELECT (plan, lot) FROM o)
""")
def q_plan_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of users by the kinds of their events; an old plan of brands, and one lot that may be there already, is taken over once."""
    plans = table(spark, sf_dir, "events").select(G.plan_key(F.lit("example.com"), F.col("user_id")).alias("plan"), F.col("event_type").alias("lot"), F.col("value").alias("max"), F.col("event_id").alias("at"))
    legacy = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("lot")).agg(F.max("p_retailprice").alias("max")).union(spark.range(1).select(F.lit("view"), F.lit(1.0)))
    return stores.migrated_plans(plans, legacy)


@query("""
SELECT 'Lot:' || o_orderkey AS ref, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, c_name AS auction FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def q_ref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of JSON objects: pages of up to 100 references to lots (orders), which refer to auctions (customers)."""
    key = lambda kind, x: F.concat(F.lit(kind + ":"), F.col(x).cast("string"))
    ref = lambda x: F.struct(x.alias("__ref"))
    orders = table(spark, sf_dir, "orders")
    pages = orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("page")).agg(F.collect_list(ref(key("Lot", "o_orderkey"))).alias("results"))
    roots = pages.select(key("Page", "page").alias("key"), F.to_json(F.struct("results")).alias("body"))
    lots = orders.select(key("Lot", "o_orderkey").alias("key"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), ref(key("Auction", "o_custkey")).alias("auction"))).alias("body"))
    auctions = table(spark, sf_dir, "customer").select(key("Auction", "c_custkey").alias("key"), F.to_json(F.struct(F.col("c_name").alias("title"))).alias("body"))
    return stores.referenced(roots.union(lots).union(auctions), roots, {"id": "$.id", "status": "$.status", "auction": "auction:$.title"})


@query("""
WITH s AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'purchase') AS r, max(value) FILTER (WHERE event_type = 'signup') AS m FROM events GROUP BY 1), w AS (SELECT user_id, CAST(floor(max(value) * 100) AS BIGINT) AS c FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT c_custkey, coalesce(r, c / 100) AS resale, coalesce(m, (c + 100) / 100) AS max_bid FROM customer LEFT JOIN s ON s.user_id = c_custkey LEFT JOIN w ON w.user_id = c_custkey
""")
def q_state_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lots: purchases and sign-ups give their stored state, views the watchlist's."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    stored = events.groupBy("c_custkey").agg(of("purchase").alias("resale"), of("signup").alias("max_bid"))
    watched = events.where("event_type = 'view'").groupBy("c_custkey").agg(F.floor(F.max("value") * 100).alias("resale_cents")).withColumn("max_bid_cents", F.col("resale_cents") + 100)
    return stores.stored_state(table(spark, sf_dir, "customer").select("c_custkey"), stored, watched, "c_custkey")


@query("""
WITH r AS (SELECT l_partkey, l_orderkey * 8 + l_linenumber AS place, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) AS rn FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem))
SELECT l_partkey, max(place) FILTER (WHERE rn = 2) AS repeated_at, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 1
""")
def q_first_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that come up again, in the order in which they first do."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber").distinct().select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return stores.first_repeats(rows, "l_partkey", "at")


@query(f"""WITH {PARTS_SQL},
e AS (SELECT id, regexp_matches(coalesce(description, '') || ' ', '{V.CAD[0]}') OR regexp_matches(coalesce(description, '') || ' ', '{V.CAD[1]}') AS cad,
  len({flags(plain('title'), {str(k): p for k, (w, p, _) in enumerate(V.MIXED) if w == 'title'})}) > 0 OR regexp_matches({plain('description')}, '{V.MIXED[3][1]}', 'i') AS mixed FROM listings),
f AS (SELECT *, NOT cad AND NOT mixed AND id % 3 <> 2 AS eligible FROM e)
SELECT CASE WHEN cad THEN -1 ELSE id // 25 END AS page, count(*) AS total, count(*) FILTER (WHERE mixed) AS mixed_lots, count(*) FILTER (WHERE mixed OR id % 3 = 2) AS quantity_review, count(*) FILTER (WHERE NOT eligible) AS analyzed,
  count(*) FILTER (WHERE eligible AND id % 4 = 0) AS matched, count(*) - count(*) FILTER (WHERE eligible AND id % 4 = 0) AS unmatched, bool_and(cad) AS unsupported FROM f GROUP BY 1
""")
def q_analysis_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an analysis as it begins (what is not looked up counts as analysed), by page of listings; those in Canadian dollars are a page of their own."""
    rows = listings(spark, sf_dir).select("id", L.comparison_currency(F.col("description"), F.lit(None).cast("string")).alias("currency"), L.mixed_lot(F.col("title"), F.col("description"))["mixed"].alias("mixed"), L.research_query(F.col("title")).alias("phrase"))
    rows = rows.withColumn("review", L.needs_quantity(F.when(F.col("id") % 3 == 2, 2.0), F.col("mixed"), F.lit(None).cast("double")))
    rows = rows.withColumn("eligible", R.eligible(F.col("currency"), F.col("mixed"), F.col("review"), F.col("phrase")))
    cad, matched = F.col("currency") == "CAD", F.count_if(F.col("eligible") & (F.col("id") % 4 == 0))
    return rows.groupBy(F.when(cad, -1).otherwise(F.floor(F.col("id") / 25)).alias("page")).agg(
        F.count("*").alias("total"), F.count_if("mixed").alias("mixed_lots"), F.count_if("review").alias("quantity_review"), F.count_if(~F.col("eligible")).alias("analyzed"), matched.alias("matched"), (F.count("*") - matched).alias("unmatched"), F.bool_and(cad).alias("unsupported")
    )
