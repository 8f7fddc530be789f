"""Queries about captures: groups, embedded records, page scopes, stored state, listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import jobs as J
from lotwright.functions import listing as L
from lotwright.operators import sequences
from lotwright.sources import embedded, markup

from .landed import TILES
from .registry import landed, query, table

#: What a store of nested records, a page with script literals, an answer with a fragment, a listing table and linked data hold, by page_id.
STORE = """CASE page_id % 8 WHEN 0 THEN 'broken {' WHEN 1 THEN '{"a":{"b":[{"portalChildren":[12,"' || page_id || '","x",12]}]},"portalChildren":"56, ' || (page_id + 100000) || '"}'
  WHEN 2 THEN '{"x":"{' || chr(92) || '"portalChildren' || chr(92) || '":[1]}","y":[{"PORTALCHILDREN":" 5 ,' || page_id || ',-3"}]}' WHEN 3 THEN '{"a":{"a":{"a":{"a":{"a":{"a":{"portalChildren":[' || page_id || ']}}}}}}}'
  WHEN 4 THEN '{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"portalChildren":[' || page_id || ']}}}}}}},"z":[[[{"portalChildren":[7]}]]]}' WHEN 5 THEN '{"portalChildren":{"portalChildren":[' || page_id || ']}}'
  WHEN 6 THEN '[{"k":[1,"2"],"portalChildren":[1,"2","x",null,' || page_id || ',[4]]},[{"portalChildren":[' || (page_id + 1) || ']}]]' ELSE '{"portalChildren":' || page_id || ',"z":{"portalchildren":"7,8, 9x,"}}' END"""
SCRIPT = """'<script>lots.push(new Lot({id:' || page_id || ',title:\'\'Lamp\'\',bid:12.50}));lots.push(new Lot({id:9' || page_id || ',title:\'\'Desk\'\'}));</script><div data-lot-id="' || page_id || '"><h3>lamp</h3></div><div data-lot-id="m' || page_id || '"><h3>Rug</h3>Bid: $4</div>'"""
FRAGMENT = r"""'{"ok":true,"email":"x@y.zz","source":"' || coalesce(url, '') || '","html":"<div data-lot-id=\\"' || page_id || '\\"><h3>Vase</h3></div><div data-lot-id=\\"y' || page_id || '\\"><h3>Bowl &amp; dish</h3></div>"}'"""
LISTING = "'<table><tr><th>Item</th><th>Status</th><th>Price</th></tr><tr><td>A' || page_id || '</td><td>Active</td><td>$5</td></tr><tr><td>B2</td><td>Ended</td><td>$1,20' || page_id % 10 || '</td></tr></table>'"
LINKED = """'<script type="application/ld+json">{"@type":"Product","name":"a"}</script><script type="application/ld+json">{"@type":"Product","name":"b' || page_id || '","sku":"9"}</script>'"""

def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))


@landed("SELECT page_id, CAST(page_id AS VARCHAR) AS id, 'Won' AS grp FROM pages UNION ALL SELECT page_id, 'x' || page_id, 'Lost' FROM pages", {"page_id": "page_id", "html": f"coalesce(html, '') || {TILES}"}, _pages)
def q_html_groups(rows: DataFrame) -> DataFrame:
    """Tiles with the heading that they stand under: the last one before them on the page."""
    parts = markup.slices(rows, "html", r"<(?:h2>|div\b[^>]*\bdata-lot-id\s*=)", ["page_id"])
    parts = parts.select("page_id", "pos", markup.inner_text(F.col("block"), r"^<h2>(.*?)</h2>").alias("heading"), F.nullif(F.regexp_extract("block", r'data-lot-id="(\w+)"', 1), F.lit("")).alias("id"))
    placed = sequences.under_headers(parts, ["page_id"], ["pos"], F.col("heading").isNotNull(), F.col("heading"), "grp")
    return placed.where("id IS NOT NULL").select("page_id", "id", "grp")


@landed(f"""
WITH RECURSIVE s AS (
  SELECT page_id AS id, TRY_CAST({STORE} AS JSON) AS j FROM pages
), w AS (
  SELECT id, 0 AS depth, j FROM s WHERE json_type(j) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT id, depth + 1, e.v FROM (
    SELECT id, depth, unnest(CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: struct_pack(k := k, v := json_extract(j, '$."' || k || '"')))
      ELSE list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda i: struct_pack(k := '', v := json_extract(j, '$[' || i || ']'))) END) AS e FROM w
  ) WHERE lower(e.k) <> 'portalchildren' AND json_type(e.v) IN ('OBJECT', 'ARRAY') AND depth < 6
), h AS (
  SELECT id, json_extract(j, '$."' || k || '"') AS v FROM (SELECT id, j, unnest(json_keys(j)) AS k FROM w WHERE json_type(j) = 'OBJECT') WHERE lower(k) = 'portalchildren'
), t AS (
  SELECT id, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: json_extract_string(v, '$[' || i || ']')) ELSE string_split(json_extract_string(v, '$'), ',') END) AS x FROM h
)
SELECT DISTINCT id, trim(x) AS child FROM t WHERE regexp_full_match(x, '\\s*[0-9]+\\s*')
""", {"id": "page_id", "html": f"""coalesce(html, '') || '<script id="page-state" type="application/json">' || {STORE} || '</script>'"""}, lambda spark, sf_dir: table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"))
def q_embedded_json_bfs(rows: DataFrame) -> DataFrame:
    """Ids below a key of the JSON that a page carries, at most six levels down."""
    stores = rows.select("id", embedded.script_json(F.col("html"), "page-state").alias("body"))
    return embedded.children(stores, "body", ["id"]).select("id", "child")


def _url_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part of each page's URL, as text that may be a number."""
    end = F.substring_index("url", "/", -1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), end.alias("r"), end.alias("q"))


@landed("""
SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN page_id + 0.5 WHEN 3 THEN 0.0 END AS resale, CAST(CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN least(500, page_id + 1) ELSE 1 END AS INT) AS quantity FROM pages
""", {"id": "page_id", "r": "CASE page_id % 4 WHEN 0 THEN page_id || '.5' WHEN 1 THEN '' WHEN 2 THEN 'n/a' ELSE '0' END", "q": "CASE page_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '' || (page_id + 1) ELSE NULL END"}, _url_ends)
def q_state_normalize(rows: DataFrame) -> DataFrame:
    """Stored text to numbers."""
    return rows.select("id", J.stored_amount(F.col("r")).alias("resale"), J.stored_quantity(F.col("q")).alias("quantity"))


@landed("SELECT page_id AS id, CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 40 <= 30 THEN greatest(15.0, page_id % 40) ELSE 15.0 END::DOUBLE AS rate FROM pages", {
    "id": "page_id", "t": "coalesce(html, '') || '. ' || CASE WHEN page_id % 6 = 0 THEN 'Sales tax 8%. Premium 45%' ELSE 'A buyer''s premium of 15% online, ' || page_id % 40 || '% on site. 29% off today.' END"
}, _texts)
def q_max_rate(rows: DataFrame) -> DataFrame:
    """The buyer's premium that a text states."""
    return rows.select("id", L.stated_premium(F.col("t")).alias("rate"))


@query("""
WITH k AS (SELECT page_id, regexp_replace(regexp_replace(split_part(url, '#', 1), '([?&])page=[^&]*&?', '\\1'), '[?&]$', '') AS scope FROM pages)
SELECT scope, count(*) AS pages FROM k GROUP BY 1
""")
def q_page_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of equal filters: URLs that differ in the page parameter and the fragment only."""
    bare = F.regexp_replace(F.regexp_replace(F.substring_index("url", "#", 1), "([?&])page=[^&]*&?", "$1"), "[?&]$", "")
    return table(spark, sf_dir, "pages").groupBy(bare.alias("scope")).agg(F.count("*").alias("pages"))


@landed("SELECT page_id, CAST(page_id AS VARCHAR) AS id, 'Lamp' AS title, 12.5::DOUBLE AS bid FROM pages UNION ALL SELECT page_id, '9' || page_id, 'Desk', NULL FROM pages UNION ALL SELECT page_id, 'm' || page_id, 'Rug', 4.0 FROM pages", {"page_id": "page_id", "html": f"coalesce(html, '') || {SCRIPT}"}, _pages)
def q_script_literals(rows: DataFrame) -> DataFrame:
    """Records of script literals joined with those of the markup; the script's title counts, the markup fills gaps."""
    literals = rows.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"new Lot\((\{[^}]*\})\)"), F.lit(1))).alias("x"))
    pick = lambda p: F.nullif(F.regexp_extract("x", p, 1), F.lit(""))
    own = literals.select("page_id", pick(r"\bid:\s*(\d+)").alias("id"), pick(r"title:\s*'([^']*)'").alias("title"), pick(r"bid:\s*([\d.]+)").try_cast("double").alias("bid"))
    tiles = markup.lot_tiles(rows, "html", ["page_id"]).select("page_id", "id", F.col("title").alias("t2"), F.col("bid").alias("b2"))
    return own.join(tiles, ["page_id", "id"], "full").select("page_id", "id", F.coalesce("title", "t2").alias("title"), F.coalesce("bid", "b2").alias("bid"))


@landed("SELECT page_id, CAST(page_id AS VARCHAR) AS id, 'Vase' AS title FROM pages UNION ALL SELECT page_id, 'y' || page_id, 'Bowl & dish' FROM pages", {"page_id": "page_id", "html": FRAGMENT}, _pages)
def q_json_fragment(rows: DataFrame) -> DataFrame:
    pages = rows.select("page_id", F.get_json_object("html", "$.html").alias("html"))
    return markup.lot_tiles(pages, "html", ["page_id"]).select("page_id", "id", "title")


@landed("SELECT page_id, 'A' || page_id AS item, 'Active' AS status, '$5' AS price FROM pages UNION ALL SELECT page_id, 'B2', 'Ended', '$1,20' || page_id % 10 FROM pages", {"page_id": "page_id", "html": f"coalesce(html, '') || {LISTING}"}, _pages)
def q_listing_snapshot(rows: DataFrame) -> DataFrame:
    """Cells of a table by the name of their column, wherever the column stands."""
    lines = F.regexp_extract_all("html", F.lit(r"(?is)<tr>(.*?)</tr>"), F.lit(1))
    cells = lambda x: F.regexp_extract_all(x, F.lit(r"(?is)<t[hd]>(.*?)</t[hd]>"), F.lit(1))
    rows = rows.select("page_id", cells(F.get(lines, F.lit(0))).alias("head"), F.explode(F.slice(F.transform(lines, cells), 2, F.size(lines))).alias("cells"))
    cell = lambda k: F.get("cells", (F.array_position(F.transform("head", lambda h: F.lower(h)), k) - 1).cast("int"))
    return rows.select("page_id", *(cell(k).alias(k) for k in ("item", "status", "price")))


@landed("SELECT page_id AS p, 'b' || page_id AS name, '9' AS sku, 3 AS fields FROM pages", {"p": "page_id", "html": f"coalesce(html, '') || {LINKED}"}, lambda spark, sf_dir: table(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), "html"))
def q_jsonld_richest(rows: DataFrame) -> DataFrame:
    return markup.json_ld(rows, "html", ["p"])


def _first_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each document as title, the others as description."""
    parts = F.split("text", r"(?<=[.!?])\s", 2)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.get(parts, F.lit(0)).alias("title"), F.get(parts, F.lit(1)).alias("description"))


@landed("SELECT page_id AS id, page_id % 3 <> page_id % 2 AND page_id % 5 <> 0 AS conflict FROM pages", {
    "id": "page_id", "title": "'Shirt size ' || CASE page_id % 3 WHEN 0 THEN 'XL' WHEN 1 THEN 'M' ELSE 's' END", "description": "coalesce(html, '') || ' ' || CASE WHEN page_id % 5 = 0 THEN 'cotton' ELSE 'Size: ' || CASE page_id % 2 WHEN 0 THEN 'xl' ELSE 'M' END || ', cotton' END"
}, _first_and_rest)
def q_size_conflict(rows: DataFrame) -> DataFrame:
    """Whether title and description name different sizes."""
    return rows.select("id", L.size_conflict(F.col("title"), F.col("description")).alias("conflict"))


@query("""
SELECT 'urgent' AS kind, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'all', count(*) FROM orders
""")
def q_late_materialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n(orders.where("o_orderpriority = '1-URGENT'"), "urgent").union(n(orders, "all"))
