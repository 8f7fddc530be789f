"""Queries about a catalogue's page URLs: every page's host and parameters under one of the paths below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import routes as R

from .registry import query, table

PATHS = [
    "/catalog/765226/example", "/livecatalog/752334/example/", "/lots/40198/computers", "/newjersey/lots/40196/electronics", "/newjersey/catalog/765226/example", "/newjersey/livecatalog/752334/example", "/lot/123/example", "/newjersey/lot/123/example",
    "/account/watchlist", "/newjersey/account/watchlist", "/account/currentbids?status=WINNING", "/account/currentbids?status=outbid", "/account/currentbids", "/account/pastbidsm", "/account/pastwatchlist", "/catalog/x", "/", "//lots//",
    "/a/b/Lots?status=open,%20closed&status=OPEN&isArchive=on&q=two+words&zip=08817&s=time%20left", "/catalog/7?filter=my_archived&countryname=usa&miles=10&shippingoffered=1", "/account/profile", "/lots?countryname=France&apage=3&B=2&b=1&zip=1&miles=5",
]
SITE = "example.com"
#: A page's address with the path in place of its own; the page's parameters come after the path's.
URL_SQL = f"""u AS (SELECT page_id, h || p || CASE WHEN q = '' THEN '' WHEN contains(p, '?') THEN '&' || q ELSE '?' || q END AS url FROM (
  SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*') AS h, regexp_extract(url, '\\?([^#]*)', 1) AS q, list_extract([{', '.join(f"'{p}'" for p in PATHS)}], CAST(page_id % {len(PATHS)} + 1 AS INT)) AS p FROM pages)),
d AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, coalesce(nullif(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS path,
  list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: struct_pack(k := url_decode(replace(regexp_extract(p, '^[^=]*'), '+', ' ')), v := url_decode(replace(regexp_extract(p, '=(.*)$', 1), '+', ' ')))) AS ps FROM u)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("page_id") % len(PATHS) + 1).cast("int"))
    own = F.regexp_extract("url", r"\?([^#]*)", 1)
    joined = F.when(own == "", "").when(F.contains(path, F.lit("?")), F.concat(F.lit("&"), own)).otherwise(F.concat(F.lit("?"), own))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0), path, joined).alias("url"))
    return rows.withColumn("route", R.route(F.col("url"), SITE))


_FIRST = lambda name: f"coalesce(list_filter(ps, lambda p: p.k = '{name}')[1].v, '')"
#: Routes step by step: parts, where the telling ones are, and the kind that the first of them gives.
ROUTE_SQL = f"""{URL_SQL},
p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, upper(trim({_FIRST('status')})) AS st FROM d),
w AS (SELECT *, list_transform(parts, lambda x: lower(x)) AS low FROM p),
i AS (SELECT *, coalesce(list_position(low, 'account'), 0) AS a, coalesce(list_position(list_transform(low, lambda x: x IN ('catalog', 'livecatalog')), true), 0) AS c, coalesce(list_position(low, 'lots'), 0) AS s, coalesce(list_position(low, 'lot'), 0) AS l FROM w),
j AS (SELECT *, CASE WHEN NOT (host = '{SITE}' OR ends_with(host, '.{SITE}')) THEN 'host' WHEN a > 0 AND low[a + 1] = 'watchlist' THEN 'watchlist' WHEN a > 0 AND low[a + 1] = 'currentbids' AND st IN ('WINNING', 'OUTBID') THEN 'currentbids-' || lower(st)
   WHEN a > 0 AND low[a + 1] = 'currentbids' THEN 'current' WHEN a > 0 AND low[a + 1] = 'pastbidsm' THEN 'pastbids' WHEN a > 0 AND low[a + 1] = 'pastwatchlist' THEN 'pastwatchlist' WHEN c > 0 THEN low[c]
   WHEN low[1] = 'lot' OR (low[1] IS DISTINCT FROM 'lots' AND s <= 1 AND l > 1) THEN 'lot' WHEN low[1] = 'lots' OR s > 1 THEN 'search' ELSE 'none' END AS k FROM i),
r AS (SELECT *, CASE WHEN k IN ('host', 'current', 'none') THEN 'unsupported' ELSE k END AS kind, CASE WHEN k IN ('host', 'none') THEN 0 WHEN a > 0 AND k NOT IN ('catalog', 'livecatalog', 'lot', 'search') THEN a WHEN k IN ('catalog', 'livecatalog') THEN c WHEN k = 'search' AND s > 1 AND low[1] <> 'lots' THEN s WHEN k = 'lot' AND low[1] <> 'lot' THEN l ELSE 0 END AS b FROM j),
f AS (SELECT *, CASE WHEN kind IN ('catalog', 'livecatalog') AND regexp_matches(parts[c + 1], '^\\d+$') THEN parts[c + 1] END AS auction_id, CASE WHEN kind = 'search' AND regexp_matches(parts[s + 1], '^\\d+$') THEN parts[s + 1] END AS category_id,
   CASE WHEN b > 1 THEN array_to_string(parts[1:b - 1], '/') END AS state_prefix, CASE WHEN b > 1 AND kind IN ('catalog', 'livecatalog', 'lot', 'search') THEN 2 ELSE 0 END AS site_type FROM r)"""


@query(f"""WITH {ROUTE_SQL}
SELECT page_id, kind, kind <> 'unsupported' AS supported, path, auction_id, category_id, state_prefix, site_type, CASE WHEN k LIKE 'currentbids%' THEN st END AS status,
       CASE k WHEN 'host' THEN 'unsupported host' WHEN 'none' THEN 'unsupported route' WHEN 'current' THEN 'current bids requires WINNING or OUTBID status' ELSE CASE WHEN kind IN ('catalog', 'livecatalog') AND auction_id IS NULL THEN 'missing ' || kind || ' auction id' END END AS reason FROM f""")
def q_url_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("route")
    return _pages(spark, sf_dir).select("page_id", *(r[n].alias(n) for n in ("kind", "supported", "path", "auction_id", "category_id", "state_prefix", "site_type", "status", "reason")))


@query(f"""WITH {ROUTE_SQL}
SELECT page_id, CAST(to_json(struct_pack(host := host, path := path, kind := kind, "auctionId" := auction_id, "categoryId" := category_id,
  filters := list_transform(list_sort(list_transform(list_filter(ps, lambda p: lower(p.k) <> 'apage'), lambda p: struct_pack(a := lower(p.k), b := lower(p.v), k := p.k, v := p.v))), lambda p: [p.k, p.v]))) AS VARCHAR) AS fingerprint FROM f""")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", R.canonical(F.col("url"), F.col("route")).alias("fingerprint"))


_STATUS_SQL = """CASE WHEN len(list_filter(flatten(list_transform(list_filter(ps, lambda p: p.k = 'status'), lambda p: string_split(p.v, ','))), lambda v: trim(v) <> '')) = 0
  THEN CASE kind WHEN 'catalog' THEN ['ALL'] WHEN 'livecatalog' THEN ['OPEN'] ELSE ['OPEN', 'UPCOMING'] END
  ELSE list_filter(flatten(list_transform(list_filter(ps, lambda p: p.k = 'status'), lambda p: list_transform(string_split(p.v, ','), lambda v: upper(trim(v))))), lambda v: v <> '') END"""
_UNIQUE = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"  # noqa: E731  in order of first occurrence
_ON = lambda name: f"regexp_matches({_FIRST(name)}, '^(1|true|yes|on)$', 'i')"
_ARCHIVED = f"{_ON('archive')} OR {_ON('isArchive')} OR regexp_matches({_FIRST('filter')}, '(?:^|[-_])archived?(?:$|[-_])', 'i')"
_SORT = lambda x: f"coalesce(nullif(regexp_replace(upper(trim({x})), '[^A-Z0-9_]', '_', 'g'), ''), 'LOT_NUMBER')"
_OWN = lambda name: f"nullif(trim({_FIRST(name)}), '')"
_COUNTRY = f"CASE WHEN regexp_matches({_OWN('countryname')}, '^(?:united states(?: of america)?|usa|us)$', 'i') THEN 'USA' WHEN regexp_matches({_OWN('countryname')}, '^(?:canada|can)$', 'i') THEN 'CAN' ELSE {_OWN('countryname')} END"


@query(f"WITH {ROUTE_SQL}, s AS (SELECT *, {_STATUS_SQL} AS sv FROM f) SELECT page_id, {_UNIQUE('sv')} AS statuses, {_ARCHIVED} AS archived, {_ON('shippingoffered')} AS shipping FROM s")
def q_status_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf_dir).select("page_id", R.statuses(url, F.col("route")["kind"]).alias("statuses"), R.archived(url).alias("archived"), R.is_on(url, "shippingoffered").alias("shipping"))


@query(f"""WITH {ROUTE_SQL}, s AS (SELECT *, {_STATUS_SQL} AS sv FROM f)
SELECT page_id, {_OWN('q')} AS query, TRY_CAST(auction_id AS DOUBLE) AS auction_id, TRY_CAST(category_id AS DOUBLE) AS category_id, {_COUNTRY} AS country, {_OWN('zip')} AS zip,
  CASE WHEN {_OWN('zip')} IS NOT NULL THEN coalesce(TRY_CAST(nullif({_FIRST('miles')}, '') AS DOUBLE), 50.0) END AS radius, CAST(greatest(1, page_id % 5) AS INT) AS page, CAST(greatest(1, least(100, coalesce(nullif(page_id % 130 - 5, 0), 100))) AS INT) AS size,
  {_ON('shippingoffered')} AS shipping, {_SORT(f"coalesce(nullif({_FIRST('s')}, ''), CASE WHEN kind = 'catalog' THEN 'LOT_NUMBER' ELSE 'NO_ORDER' END)")} AS sort_order, {_UNIQUE('sv')} AS status, site_type FROM s""")
def q_search_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = R.search_request(F.col("url"), F.col("route"), F.col("page_id") % 5, F.col("page_id") % 130 - 5)
    return _pages(spark, sf_dir).select("page_id", request.alias("x")).select("page_id", "x.*")


@query(f"""WITH {ROUTE_SQL}, s AS (SELECT *, page_id % 3 = 0 AS h, {_STATUS_SQL} AS sv FROM f), t AS (SELECT *, {_UNIQUE('sv')} AS st2 FROM s)
SELECT page_id, CASE WHEN NOT h THEN TRY_CAST(auction_id AS DOUBLE) END AS auction_id, 1 AS page_number, 100 AS page_length, CASE WHEN NOT h THEN TRY_CAST(category_id AS DOUBLE) END AS category, CASE WHEN NOT h THEN {_OWN('q')} END AS search_text,
  CASE WHEN NOT h THEN {_OWN('zip')} END AS zip, CASE WHEN NOT h THEN TRY_CAST(nullif({_FIRST('miles')}, '') AS DOUBLE) END AS miles, NOT h AND {_ON('shippingoffered')} AS shipping_offered, CASE WHEN NOT h THEN {_OWN('countryname')} END AS country_name,
  CASE WHEN h OR len(st2) <> 1 THEN 'ALL' ELSE st2[1] END AS status, {_SORT(_FIRST('s'))} AS sort_order, CASE WHEN NOT h THEN upper({_OWN('filter')}) END AS filter, {_ARCHIVED} AS is_archive, CASE WHEN h THEN [page_id, page_id + 1] END AS ids FROM t""")
def q_page_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page reads records by id, the others scan."""
    ids = F.when(F.col("page_id") % 3 == 0, F.array("page_id", F.col("page_id") + 1))
    return _pages(spark, sf_dir).select("page_id", R.page_variables(F.col("url"), F.col("route"), F.lit(1), F.lit(100), ids).alias("x")).select("page_id", "x.*")


@query(f"WITH {URL_SQL} SELECT page_id, list_transform(list_sort(list_transform(ps, lambda p: struct_pack(a := lower(p.k), b := lower(p.v), k := p.k, v := p.v))), lambda p: p.k || '=' || p.v) AS sorted FROM d")
def q_param_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_sort(F.transform(R.decoded(F.col("url")), lambda p: F.struct(F.lower(p["k"]).alias("a"), F.lower(p["v"]).alias("b"), p["k"].alias("k"), p["v"].alias("v"))))
    return _pages(spark, sf_dir).select("page_id", F.transform(order, lambda p: F.concat(p["k"], F.lit("="), p["v"])).alias("sorted"))
