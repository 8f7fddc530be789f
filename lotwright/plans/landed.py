"""Queries over landed pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.sources import markup, paged, tiles
from lotwright.sources.shared import shared_root
from lotwright.streaming import watch

from .registry import landed, query, table

#: What a page of a catalogue, its counter, a page of retail results, and a page of the lot scan hold, by page_id.
TILES = """'<h2>Won</h2><div data-lot-id="' || page_id || '"><h3>Drill &amp; ' || page_id || '</h3><a href="/lot/' || page_id || '">see</a> High bid: $1,04' || page_id % 10 || '.00</div><h2>Lost</h2><div data-lot-id="x' || page_id || '"><h3>Saw</h3></div>'"""
STATE = "CASE page_id % 3 WHEN 0 THEN '<p>Showing 1 to 24 of 1,' || (100 + page_id % 900) || ' lots</p>' WHEN 1 THEN '<p>No lots found</p>' ELSE '' END"
_KEY = "lpad('' || page_id, 9, '0')"
RESULTS = f"""'<div data-key="B' || {_KEY} || '"><h2>Acme TV</h2>Sponsored<span class="price">$10</span></div><div data-key="B' || {_KEY} || '"><h2>Acme TV</h2><span class="price">$30.50</span></div><div data-key="C' || {_KEY} || '"><h2>Acme TV renewed</h2>'
  || CASE WHEN page_id % 2 = 0 THEN '<span class="price">$7</span>' ELSE '' END || '</div><div data-key="bad"><h2>x</h2></div>'"""
BODY = """'{"source":"' || coalesce(url, '') || '","pageNumber":' || page_id || ',"totalCount":5,"noExactMatches":' || CASE WHEN page_id % 5 = 0 THEN 'true' ELSE 'false' END || CASE WHEN page_id % 4 = 1 THEN ',"filteredCount":' || page_id % 7 ELSE '' END
  || ',"results":[{"id":' || page_id * 2 || ',"title":"Lot 0","highBid":1.5},{"id":' || (page_id * 2 + 1) || ',"title":"Lot 1"}]}'"""


#: Two groups, each from its heading element to the next one; tiles named by their id, their link and an element inside; a lot's second tile.
GROUPED = """'<app-watched-auction-header><div class="listing-box-title"><a href="/catalog/' || page_id || '/a"><strong>Sale A</strong></a><a href="https://maps.google.com/maps?q=x">Town, NJ</a> | July 1</div></app-watched-auction-header><p>Showing 1 to 2 of ' || (40 + page_id) || ' lots</p>
<app-lot-tile id="lot-a' || page_id || '"><a href="/lot/5/x">Lot 7B | Drill &amp; bits</a> High Bid: $1,040.50 3 Bids Outbid</app-lot-tile><div data-event-item-id="5"><a href="/lot/' || page_id || '/saw"><b>Saw</b></a><i hidden>Won</i></div>
<app-watched-auction-header><div class="listing-box-title"><a href="/catalog/9' || page_id || '"><strong>Sale B</strong></a></div></app-watched-auction-header><app-lot-tile id="lot-a' || page_id || '"><h3>again</h3></app-lot-tile><div data-event-item-id="z"><p data-event-item-id="q' || page_id || '">Rug, shipping</p></div>'"""


def _as_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is, as a catalogue's."""
    return table(spark, sf_dir, "pages").select("page_id", "html", "url", F.lit("catalog").alias("kind"), F.lit("").alias("grp"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")


@landed("""
SELECT page_id, CAST(pos AS INT) AS pos, id, lot, title, 'https://site.example' || path AS url, bid AS current_bid, CAST(bids AS INT) AS bid_count, status, shipping,
       CASE WHEN page_id % 3 = 0 THEN CASE pos WHEN 2 THEN '9' || page_id ELSE '' || page_id END END AS auction_id, CASE WHEN page_id % 3 = 0 THEN CASE pos WHEN 2 THEN 'Sale B' ELSE 'Sale A' END END AS auction_title,
       CASE WHEN page_id % 3 = 0 THEN CASE pos WHEN 2 THEN '' ELSE 'Town, NJ' END END AS location
FROM pages, LATERAL (VALUES (0, 'a' || page_id, '7B', 'Drill & bits', '/lot/5/x', 1040.5, 3, 'Outbid', false), (1, '' || page_id, '' || page_id, 'Saw', '/lot/' || page_id || '/saw', NULL, NULL, '', false),
  (2, 'q' || page_id, 'q' || page_id, 'Lot q' || page_id, '/lot/q' || page_id, NULL, NULL, '', true)) AS v(pos, id, lot, title, path, bid, bids, status, shipping) WHERE pos < 2 OR page_id % 3 <> 1
""", {"page_id": "page_id", "html": f"{GROUPED} || coalesce(html, '')", "url": "'https://site.example/page'", "kind": "CASE page_id % 3 WHEN 0 THEN 'watchlist' WHEN 1 THEN 'pastbids' ELSE 'catalog' END", "grp": "'' || page_id"}, _as_catalogues)  # fmt: skip
def q_account_lots(rows: DataFrame) -> DataFrame:
    """Lots of account and catalogue pages by their element tree, those of account pages with their group."""
    return tiles.account_lots(rows, "html", "url", "kind", "grp", ["page_id"]).drop("images", "next_bid", "time_left", "raw")


@landed("""
SELECT page_id, 0 AS pos, '' || page_id AS id, 'Sale A' AS title, 'https://site.example/catalog/' || page_id || '/a' AS catalog_url, 'Town, NJ' AS location, 'July 1' AS dated, CAST(40 + page_id AS INT) AS expected, 2 AS visible FROM pages
UNION ALL SELECT page_id, 1, '9' || page_id, 'Sale B', 'https://site.example/catalog/9' || page_id, '', '', 3, 3 FROM pages
""", {"page_id": "page_id", "html": f"{GROUPED} || coalesce(html, '')", "url": "'https://site.example/page'"}, _as_catalogues)  # fmt: skip
def q_auction_groups(rows: DataFrame) -> DataFrame:
    """Auction groups of a page, with the lots that each says it has and shows."""
    return tiles.auction_groups(rows, "html", "url", ["page_id"])


@landed(f"""
SELECT page_id, 1 AS pos, CAST(page_id AS VARCHAR) AS id, 'Drill & ' || page_id AS title, '/lot/' || page_id AS url, CAST('104' || page_id % 10 AS DOUBLE) AS bid FROM pages UNION ALL SELECT page_id, 2, 'x' || page_id, 'Saw', NULL, NULL FROM pages
""", {"page_id": "page_id", "html": f"coalesce(html, '') || {TILES}"}, _pages)
def q_html_tiles(rows: DataFrame) -> DataFrame:
    return markup.lot_tiles(rows, "html", ["page_id"])


@landed("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 END AS first, CASE WHEN page_id % 3 = 0 THEN 24 END AS last, CASE WHEN page_id % 3 = 0 THEN CAST(1100 + page_id % 900 AS INT) END AS total, page_id % 3 = 1 AS none FROM pages
""", {"page_id": "page_id", "html": f"coalesce(html, '') || {STATE}"}, _pages)
def q_page_state(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", markup.page_state(F.col("html")).alias("s")).select("page_id", "s.*")


@landed("""
SELECT page_id, 'B' || lpad('' || page_id, 9, '0') AS key, 'Acme TV' AS title, 30.5::DOUBLE AS price, false AS sponsored, false AS used FROM pages
UNION ALL SELECT page_id, 'C' || lpad('' || page_id, 9, '0'), 'Acme TV renewed', CASE WHEN page_id % 2 = 0 THEN 7.0 END, false, true FROM pages
""", {"page_id": "page_id", "html": f"coalesce(html, '') || {RESULTS}"}, _pages)
def q_html_candidates(rows: DataFrame) -> DataFrame:
    return markup.candidates(rows, "html", ["page_id"])


@landed("""
SELECT CAST(page_id AS INT) AS page, CAST(pos AS INT) AS pos, CASE WHEN page_id % 4 = 1 THEN page_id % 7 ELSE 5 END AS total, page_id * 2 + pos AS id, 'Lot ' || pos AS title, CASE WHEN pos = 0 THEN 1.5 END AS bid
FROM pages, (VALUES (0), (1)) AS v(pos) WHERE page_id % 5 <> 0
""", {"body": BODY}, lambda spark, sf_dir: table(spark, sf_dir, "pages").select(F.col("html").alias("body")))
def q_json_pages(rows: DataFrame) -> DataFrame:
    return paged.page_rows(rows, "body")


@query("""
WITH e AS (
  SELECT user_id AS lot_id, epoch_us(ts) // 1000 AS ms, event_id AS seq, event_type = 'click' AS ask, event_type = 'error' AS miss, value, event_id - event_id % 5 * 400 AS revision, CASE WHEN event_id % 7 = 0 THEN 'b' ELSE 'a' END AS fp,
         CAST(floor((epoch_us(ts) // 1000 - CASE WHEN event_type = 'click' THEN 0 ELSE event_id % 4 * 86400000 END) / 518400000) AS BIGINT) AS gen
  FROM events
), w AS (
  SELECT max(ms) - 600000 AS mark FROM e
), p AS (
  SELECT *, max(CASE WHEN ask THEN gen END) OVER (PARTITION BY lot_id ORDER BY ms, seq) AS cur FROM e, w WHERE ms < mark
), g AS (
  SELECT lot_id, gen AS cur, arg_min(fp, struct_pack(ms := ms, seq := seq)) AS cur_fp FROM p WHERE ask AND gen = cur GROUP BY ALL
), a AS (
  SELECT *, gen IS NOT DISTINCT FROM cur AND fp IS NOT DISTINCT FROM cur_fp AS fits FROM p LEFT JOIN g USING (lot_id, cur) WHERE NOT ask
), f AS (
  SELECT *, max(CASE WHEN NOT miss THEN revision END) OVER (PARTITION BY lot_id ORDER BY ms, seq) AS top FROM a WHERE fits
), s AS (
  SELECT *, sum(CASE WHEN NOT miss AND revision = top THEN 1 ELSE 0 END) OVER (PARTITION BY lot_id ORDER BY ms, seq) AS news FROM f
), m AS (
  SELECT lot_id, ms, row_number() OVER (PARTITION BY lot_id, news ORDER BY ms, seq) AS n FROM s WHERE miss
), t AS (
  SELECT *, lag(value > 80) OVER o AS before, lead(ms) OVER o AS later FROM s WHERE NOT miss AND revision >= top WINDOW o AS (PARTITION BY lot_id ORDER BY ms, seq)
), d AS (
  SELECT lot_id, k, min(due) AS due FROM (SELECT lot_id, k, greatest(ms + 1000, ms + 1200000 - 60000 * k) AS due, later, mark FROM t, (VALUES (15), (2)) AS v(k)) WHERE due < mark AND (later IS NULL OR due < later) GROUP BY ALL
)
SELECT lot_id, 'late' AS kind, ms AS at_ms FROM a WHERE NOT fits
UNION ALL SELECT lot_id, 'late', ms FROM f WHERE NOT miss AND revision < top
UNION ALL SELECT lot_id, 'stale', ms FROM m WHERE n = 2
UNION ALL SELECT lot_id, 'over_max', ms FROM t WHERE value > 80 AND NOT coalesce(before, false)
UNION ALL SELECT lot_id, 'alarm_' || k, due FROM d
""")
def stream_watch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watchlist stream over all events, against windows over those that the last watermark has passed."""
    return watch.alerts_of_events(spark, sf_dir, shared_root(spark))
