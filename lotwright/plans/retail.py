"""Queries about retail lookups: eligibility, candidates, requests, answers, phases of jobs; and lots' own pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import identity as I
from lotwright.functions import listing as L
from lotwright.functions import money as M
from lotwright.functions import retail as R
from lotwright.functions import values as V
from lotwright.operators import sequences
from lotwright.sources import detail

from .listings import PARTS_SQL, flags, listings, plain
from .registry import query, spread, table


@query(f"""WITH {PARTS_SQL},
e AS (SELECT id, regexp_matches(coalesce(description, '') || ' ', '{V.CAD[0]}') OR regexp_matches(coalesce(description, '') || ' ', '{V.CAD[1]}') AS cad,
  len({flags(plain('title'), {str(k): p for k, (w, p, _) in enumerate(V.MIXED) if w == 'title'})}) > 0 OR regexp_matches({plain('description')}, '{V.MIXED[3][1]}', 'i') AS mixed,
  CASE WHEN id % 4 <> 0 THEN CAST(id % 3 AS DOUBLE) END AS quantity, CASE WHEN id % 5 = 0 THEN 2.0 END AS confirmed FROM listings)
SELECT id, CASE WHEN cad THEN 'CAD' ELSE 'USD' END AS currency, mixed, (coalesce(quantity, 0) > 1 OR mixed) AND confirmed IS NULL AS needs_quantity, NOT cad AND NOT mixed AND NOT ((coalesce(quantity, 0) > 1 OR mixed) AND confirmed IS NULL) AS eligible FROM e
""")
def q_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts' listings a price is looked up for."""
    quantity, confirmed = F.when(F.col("id") % 4 != 0, (F.col("id") % 3).cast("double")), F.when(F.col("id") % 5 == 0, 2.0)
    rows = listings(spark, sf_dir).select("id", L.comparison_currency(F.col("description"), F.lit(None).cast("string")).alias("currency"), L.mixed_lot(F.col("title"), F.col("description"))["mixed"].alias("mixed"), L.research_query(F.col("title")).alias("phrase"), quantity.alias("q"), confirmed.alias("c"))
    rows = rows.withColumn("needs_quantity", L.needs_quantity(F.col("q"), F.col("mixed"), F.col("c")))
    return rows.select("id", "currency", "mixed", "needs_quantity", R.eligible(F.col("currency"), F.col("mixed"), F.col("needs_quantity"), F.col("phrase")).alias("eligible"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, NOT (l_returnflag = 'R') AND NOT (l_linestatus = 'F') AND l_extendedprice >= CASE WHEN p_retailprice * l_quantity > 0 THEN p_retailprice * l_quantity * 0.3 ELSE 0 END AS taken, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")
def q_candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidates: returned ones stand for sponsored, finished ones for used, the part's price times the quantity for the stated retail price."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    offer = F.struct((F.col("l_returnflag") == "R").alias("sponsored"), (F.col("l_linestatus") == "F").alias("used"), F.col("l_extendedprice").alias("price"))
    taken = R.takes_part(offer, F.col("p_retailprice") * F.col("l_quantity"))
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey", taken.alias("taken")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT p_partkey, unnest(generate_series(0, 39)) AS k, p_name, p_retailprice, p_size FROM part)
SELECT p_partkey, count(*) AS n, CAST(sum(length(left(trim(repeat(p_name || ' ', 20 + k)), 500))) AS BIGINT) AS chars, count(*) FILTER (WHERE k % 5 = 1) AS priceless
FROM o WHERE k < 30 AND k % 7 <> 3 AND k % 5 <> 2 GROUP BY 1
""")
def q_candidate_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty offers for every part, of which some have a bad key or price; the first thirty are looked at and cut."""
    key = lambda k: F.when(k % 7 == 3, F.lit("short")).otherwise(F.concat(F.lit("b0"), F.lpad(k.cast("string"), 8, "0")))
    price = lambda k: F.when(k % 5 == 1, F.lit(None)).when(k % 5 == 2, F.lit(-1.0)).otherwise(F.col("p_retailprice"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    offers = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.struct(key(k).alias("key"), F.repeat(F.concat("p_name", F.lit(" ")), 20 + k).alias("title"), none.alias("match_text"), price(k).cast("double").alias("price"), no.alias("used"), no.alias("sponsored")))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", R.sanitised(offers).alias("o"))
    chars = F.aggregate("o", F.lit(0).cast("long"), lambda a, o: a + F.length(o["title"]))
    return rows.select("p_partkey", F.size("o").cast("long").alias("n"), chars.alias("chars"), F.size(F.filter("o", lambda o: o["price"].isNull())).cast("long").alias("priceless"))


@query()
def q_identity_revalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's identity read again from its name; tested to change nothing that is within its limits."""
    rows = R.revalidated(I.identified(listings(spark, sf_dir), "title", "description"), "identity")
    return rows.select("id", "checked.name", "checked.kind", "checked.model", "checked.capacities", "checked.seriesSignatures", "checked.tokens", (F.col("checked")["kind"].eqNullSafe(F.col("identity")["kind"])).alias("same"))


@query("""
SELECT page_id, CASE WHEN page_id % 6 = 0 OR html IS NULL AND false THEN 'non-html' WHEN octet_length(encode(html)) > 5000000 THEN 'too-large' WHEN page_id % 6 = 1 THEN 'challenge' END AS refused, page_id % 4 < 2 AS reusable FROM pages
""")
def q_ingest_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which landed pages are read, and which answers may be used again."""
    kind = F.when(F.col("page_id") % 6 == 0, "application/json").otherwise("text/HTML; charset=utf-8")
    body = F.when(F.col("page_id") % 6 == 1, F.concat(F.coalesce("html", F.lit("")), F.lit("Robot Check"))).otherwise(F.col("html"))
    status = F.element_at(F.array(*map(F.lit, ("ok", "no_results", "blocked", "error"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", R.admitted(kind, body).alias("refused"), R.reusable(status).alias("reusable"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 - 1 < 1 THEN 'page' WHEN o_custkey % 120 NOT BETWEEN 1 AND 100 THEN 'size' WHEN o_orderkey % 5 = 1 OR o_orderkey % 5 = 2 THEN 'ids' WHEN o_orderkey % 5 = 3 THEN 'bytes' END AS fault FROM orders
""")
def q_request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    ids = F.when(k == 1, F.sequence(F.lit(1), F.lit(101))).when(k == 2, F.array(F.lit(1), F.lit(None).cast("int"))).when(k == 4, F.array(F.lit(1)))
    body = F.when(k == 3, F.repeat(F.lit("é"), 90_001)).otherwise("{}")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.request_fault(F.col("o_orderkey") % 7 - 1, F.col("o_custkey") % 120, ids, body).alias("fault"))


_PHASES = list(R.PHASES)
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a in R.PHASES for b in {*R.PHASES[a], *(() if a in R.ENDS else ("stopping", "stopped", "failed", "stale")), *(("queued",) if a in R.ENDS else ())})


@query(f"""
WITH p AS (SELECT user_id, event_id, list_extract([{', '.join(f"'{x}'" for x in _PHASES)}], CAST((event_id * 7 + CAST(floor(value) AS BIGINT)) % 10 + 1 AS INT)) AS phase FROM events),
l AS (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM p)
SELECT before, phase, count(*) AS n, CASE WHEN before IS NULL THEN phase IN ('idle', 'queued') ELSE (before, phase) IN (SELECT (a, b) FROM (VALUES {_ALLOWED}) AS v(a, b)) END AS allowed FROM l GROUP BY ALL
""")
def q_phase_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of jobs (users) by their events, and whether each may follow the one before."""
    phase = F.element_at(F.array(*map(F.lit, _PHASES)), ((F.col("event_id") * 7 + F.floor("value").cast("long")) % 10 + 1).cast("int"))
    rows = sequences.transitions(table(spark, sf_dir, "events").select("user_id", "event_id", phase.alias("phase")), ["user_id"], ["event_id"], "phase", sequences.blocks("event_id"))
    return rows.groupBy("before", "phase").agg(F.count("*").alias("n")).withColumn("allowed", R.may_follow(F.col("before"), F.col("phase")))


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'call for price' WHEN p_size % 5 = 1 THEN 'net -' || p_size || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.50' ELSE 'lot ' || p_size || ' at $1,' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.25 usd' END AS t FROM part)
SELECT p_partkey, TRY_CAST(nullif(regexp_extract(replace(t, ',', ''), '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS signed, TRY_CAST(nullif(regexp_extract(replace(t, ',', ''), '\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS unsigned,
  TRY_CAST(nullif(regexp_extract(replace(t, ',', ''), '(?i)(\\d+(?:\\.\\d+)?)\\s*USD\\b', 1), '') AS DOUBLE) AS usd FROM t
""")
def q_first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    text = F.when(F.col("p_size") % 5 == 0, "call for price").when(F.col("p_size") % 5 == 1, F.concat(F.lit("net -"), F.col("p_size").cast("string"), F.lit(","), rest, F.lit(".50")))
    text = text.otherwise(F.concat(F.lit("lot "), F.col("p_size").cast("string"), F.lit(" at $1,"), rest, F.lit(".25 usd")))
    return table(spark, sf_dir, "part").select("p_partkey", M.first_number(text, signed=True).alias("signed"), M.first_number(text).alias("unsigned"), M.usd_number(text).alias("usd"))


#: What a lot's page has beside the landed page's own markup; every fifth page has no table.
_DETAIL = """concat('<meta property="og:image" content="/og.jpg"><style>.x{}</style><div hidden>High Bid: $1</div>', IF(page_id % 5 = 0, '', concat('<table><tr><th>Lot #:</th><td>', page_id, 'A</td></tr><tr><th>Lead</th><td>Lead &amp; ', page_id,
 '</td></tr><tr><th>Description</th><td>Some <b>text</b></td></tr><tr><th>Quantity</th><td>', page_id % 3, '</td></tr></table>')), '<div class="gallery"><img src="/a.jpg"><img data-src="https://i.example/logo.png"></div><h1>Heading</h1><p>High Bid: $1,2', page_id % 10, '.50 - 3 Bids - 1d 2h 3m</p>', coalesce(html, ''))"""


@query("""
SELECT page_id, CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id || 'A' END AS lot, CASE WHEN page_id % 5 = 0 THEN 'Heading' ELSE 'Lead & ' || page_id END AS lead, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Some text' END AS description,
  ['https://site.example/og.jpg', 'https://site.example/a.jpg'] AS images, CAST('12' || page_id % 10 || '.50' AS DOUBLE) AS current_bid, '1d 2h 3m' AS time_left, CASE WHEN page_id % 5 <> 0 AND page_id % 3 > 0 THEN CAST(page_id % 3 AS DOUBLE) END AS quantity FROM pages
""")
def q_html_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a lot's own page, with the lot's table, pictures and bid before its markup."""
    url = F.concat(F.lit("https://site.example/lot/"), F.col("page_id").cast("string"), F.lit("/x"))
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.expr(_DETAIL).alias("html"))
    found = detail.lot_details(rows, "html", "url", ["page_id"])
    return found.select("page_id", "id", F.when(F.col("page_id") % 5 != 0, F.col("lot")).alias("lot"), "lead", "description", "images", "current_bid", "time_left", "quantity")
