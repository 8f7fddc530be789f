"""Queries about proofs: photo manifests, listings read to their end, category trees, identities, requests, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.operators import containment, hierarchy, pager, photos, quarantine

from .registry import query, table


@query("""
WITH f AS (
  SELECT doc_id, doc_id // 12 AS listing, doc_id % 12 AS position, CASE WHEN doc_id % 29 = 28 THEN doc_id - 1 ELSE doc_id END AS of, text FROM documents
), m AS (
  SELECT f.listing, f.position, CASE WHEN f.doc_id % 37 = 0 THEN '../' || f.of || '.jpg' ELSE 'archive/' || f.of || CASE WHEN f.doc_id % 41 = 5 THEN '-lost' ELSE '' END || '.jpg' END AS path,
         CASE WHEN f.doc_id % 31 = 3 THEN sha256('other') ELSE sha256(d.text) END AS sha256, strlen(d.text) + CASE WHEN f.doc_id % 43 = 7 THEN 1 ELSE 0 END AS bytes, CASE WHEN f.listing % 9 = 4 THEN 20 ELSE 12 END AS expected, d.text AS own
  FROM f LEFT JOIN documents d ON d.doc_id = f.of
), r AS (
  SELECT *, CASE WHEN path LIKE '../%' THEN 'path' WHEN path LIKE '%-lost.jpg' OR own IS NULL THEN 'missing' WHEN bytes <> strlen(own) THEN 'bytes' WHEN sha256 <> sha256(own) THEN 'hash'
    WHEN row_number() OVER (PARTITION BY listing, sha256 ORDER BY position) > 1 THEN 'duplicate' END AS reason FROM m
), l AS (
  SELECT listing, count(*) AS photos, CAST(max(expected) AS BIGINT) AS expected, coalesce(arg_min(reason, position) FILTER (WHERE reason IS NOT NULL), CASE WHEN count(*) <> max(expected) THEN 'incomplete' END) AS reason FROM r GROUP BY listing
)
SELECT *, reason IS NULL AS valid, CASE WHEN reason IS NULL THEN least(photos, 10) ELSE 0 END AS uploads, reason IS NULL AND photos > 10 AS capped FROM l
""")
def q_photo_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archived files in listings of twelve: some manifests name another path, size, hash or file, some say that there are more."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    files = photos.digests(docs.select(F.concat(F.lit("archive/"), i, F.lit(".jpg")).alias("path"), F.encode("text", "utf-8").alias("content")))
    of = F.when(i % 29 == 28, i - 1).otherwise(i)
    own = files.select(F.regexp_extract("path", r"(-?\d+)", 1).cast("long").alias("of"), "own_sha256", "own_bytes")
    rows = docs.select(i, of.alias("of")).join(own, "of", "left")
    name = F.when(i % 37 == 0, F.concat(F.lit("../"), F.col("of"), F.lit(".jpg"))).otherwise(F.concat(F.lit("archive/"), F.col("of"), F.when(i % 41 == 5, "-lost").otherwise(""), F.lit(".jpg")))
    listing = F.floor(i / 12)
    manifest = rows.select(
        listing.alias("listing"), (i % 12).alias("position"), name.alias("path"), F.when(i % 31 == 3, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("own_sha256")).alias("sha256"),
        (F.col("own_bytes") + F.when(i % 43 == 7, 1).otherwise(0)).alias("bytes"), F.when(listing % 9 == 4, 20).otherwise(12).alias("expected"),
    )
    return photos.listings(photos.checked(manifest, files))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a listing of pages of two, some not landed; each page links to the next one, every third back to the first, the first one also to the fifth."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("scope")).agg(F.count("*").alias("n"))
    pages = orders.select("scope", "n", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / 2).cast("int"))).alias("page")).where("NOT (scope % 7 = 3 AND page = 4) AND NOT (scope % 11 = 5 AND page * 2 >= n)")
    last, p = F.ceil(F.col("n") / 2).cast("int"), F.col("page")
    links = F.array_compact(F.array(F.when((p < last) & ~((F.col("scope") % 13 == 2) & (p == 3)), p + 1), F.when(p % 3 == 0, F.lit(1)), F.when((p == 1) & (last >= 5), F.lit(5))))
    return pages.select("scope", "page", links.alias("links"), F.least(F.lit(2), F.col("n") - 2 * (p - 1)).alias("items"), F.when(F.col("scope") % 2 == 0, F.col("n") + 50).otherwise(F.col("n")).alias("total"))


@query("""
WITH RECURSIVE o AS (
  SELECT o_custkey AS scope, count(*) AS n, CAST(ceil(count(*) / 2.0) AS BIGINT) AS pages FROM orders GROUP BY 1
), p AS (
  SELECT scope, n, page, pages AS top FROM (SELECT scope, n, pages, unnest(range(1, pages + 1)) AS page FROM o) WHERE NOT (scope % 7 = 3 AND page = 4) AND NOT (scope % 11 = 5 AND page * 2 >= n)
), l AS (
  SELECT scope, page, page + 1 AS "to" FROM p WHERE page < top AND NOT (scope % 13 = 2 AND page = 3) UNION ALL SELECT scope, page, 1 FROM p WHERE page % 3 = 0 UNION ALL SELECT scope, page, 5 FROM p WHERE page = 1 AND top >= 5
), x AS (
  SELECT scope, page, min("to") AS nxt FROM l WHERE "to" > page GROUP BY ALL
), w AS (
  SELECT scope, page FROM p WHERE page = 1 UNION ALL SELECT w.scope, p.page FROM w JOIN x ON x.scope = w.scope AND x.page = w.page JOIN p ON p.scope = x.scope AND p.page = x.nxt
), e AS (
  SELECT w.scope, max(w.page) AS last, count(*) AS pages, sum(least(2, n - 2 * (w.page - 1))) AS items FROM w JOIN p ON p.scope = w.scope AND p.page = w.page GROUP BY 1
), a AS (
  SELECT DISTINCT scope, "to" AS page FROM l JOIN w USING (scope, page) UNION SELECT scope, unnest(range(1, last + 1)) FROM e
), g AS (
  SELECT scope, count(*) AS missing FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.scope = a.scope AND p.page = a.page) GROUP BY 1
), u AS (
  SELECT scope, count(*) AS unlinked FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.scope = p.scope AND w.page = p.page) GROUP BY 1
)
SELECT s.scope, CAST(last AS INT) AS last, coalesce(pages, 0) AS pages, CAST(coalesce(items, 0) AS BIGINT) AS items, coalesce(missing, 0) AS missing, coalesce(unlinked, 0) AS unlinked,
       coalesce(pages > 0 AND n + CASE WHEN s.scope % 2 = 0 THEN 50 ELSE 0 END > items, false) AS broader, coalesce(pages, 0) > 0 AND coalesce(missing, 0) = 0 AS proven,
       CASE WHEN coalesce(pages, 0) = 0 THEN 'no-first-page' WHEN coalesce(missing, 0) = 0 THEN 'deterministic-pagination-exhausted' ELSE 'missing-page' END AS reason
FROM (SELECT DISTINCT scope, n FROM p) s LEFT JOIN e USING (scope) LEFT JOIN g USING (scope) LEFT JOIN u USING (scope)
""")
def q_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's listing was read to its end."""
    return pager.exhaustion(_pages(spark, sf_dir))


@query("""
WITH RECURSIVE l AS (
  SELECT DISTINCT p_name AS child, split_part(p_name, ' ', 2) AS parent FROM part UNION SELECT split_part(p_name, ' ', 2), left(split_part(p_name, ' ', 2), 1) FROM part
  UNION SELECT p_brand, 'Brand#' || CASE WHEN b % 10 = 5 THEN b - 4 WHEN b = 20 THEN 99 ELSE b + 1 END FROM (SELECT DISTINCT p_brand, CAST(split_part(p_brand, '#', 2) AS INT) AS b FROM part)
), s AS (
  SELECT child, min(parent) AS parent FROM l GROUP BY 1
), n AS (
  SELECT child AS node FROM s UNION SELECT parent FROM s
), w AS (
  SELECT node, node AS up, 0 AS depth FROM n UNION ALL SELECT w.node, s.parent, depth + 1 FROM w JOIN s ON s.child = w.up WHERE depth < 200
), e AS (
  SELECT node, arg_max(up, depth) AS root, max(depth) AS depth FROM w GROUP BY 1
)
SELECT node, CASE WHEN depth < 200 THEN root END AS root, CAST(CASE WHEN depth < 200 THEN depth END AS BIGINT) AS depth, depth >= 200 AS cyclic FROM e
""")
def q_category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts below their kind and its initial; brands as chains, of which one ends in a brand that there is not and the others run in circles."""
    return hierarchy.placed(_links(table(spark, sf_dir, "part")))


def _links(part: DataFrame) -> DataFrame:
    kind, n = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    to = F.when(n % 10 == 5, n - 4).when(n == 20, 99).otherwise(n + 1)
    links = part.select(F.col("p_name").alias("child"), kind.alias("parent")).union(part.select(kind, F.left(kind, F.lit(1))))
    return links.union(part.select("p_brand", F.concat(F.lit("Brand#"), to))).distinct()


@query("""
SELECT p_name AS ancestor, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT split_part(p_name, ' ', 2), count(*) FROM part GROUP BY 1 UNION ALL SELECT left(split_part(p_name, ' ', 2), 1), count(*) FROM part GROUP BY 1
""")
def q_category_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at or below each category."""
    part = table(spark, sf_dir, "part")
    return hierarchy.rolled_up(part, _links(part), "p_name")


@query("""
WITH r AS (
  SELECT l_suppkey AS account, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS asset, l_suppkey + CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END AS wanted_account, l_partkey + CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END AS wanted_asset FROM lineitem
), j AS (
  SELECT account || ':' || asset AS id, asset IS NULL AS gone, coalesce(account <> wanted_account, false) OR coalesce(asset <> wanted_asset, false) AS other FROM r
)
SELECT id, concat_ws(',', CASE WHEN gone THEN 'asset-identity-missing' END, CASE WHEN other THEN 'asset-identity-mismatch' END) AS reasons, count(*) AS n FROM j GROUP BY ALL
""")
def q_composite_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as records of an account's asset against what was asked for: accepted ones, and rejected ones with their reasons."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("account"), F.when(c("l_linenumber") != 7, c("l_partkey")).alias("asset"),
        (c("l_suppkey") + F.when(c("l_orderkey") % 17 == 0, 1).otherwise(0)).alias("wanted_account"), (c("l_partkey") + F.when(c("l_partkey") % 19 == 0, 1).otherwise(0)).alias("wanted_asset"),
    )
    accepted, rejected = quarantine.separated(rows, quarantine.identity_faults(c("account"), c("asset"), c("wanted_account"), c("wanted_asset")))
    both = accepted.withColumn("reasons", F.lit("")).unionByName(rejected.withColumn("reasons", F.array_join("reasons", ",")))
    return both.groupBy(quarantine.composite_id(c("account"), c("asset")).alias("id"), "reasons").agg(F.count("*").alias("n"))


@query("SELECT min(event_id) AS first, count(*) AS n FROM events GROUP BY user_id % 100, event_type, event_id % 5 = 0")
def q_request_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that differ in page, session and the order of members only have one fingerprint."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 100).alias("zip"), F.when(F.col("event_id") % 5 == 0, "7529").otherwise("").alias("seller"))
    page, session = F.format_string('"page":%d', F.col("event_id") % 40), F.format_string('"sessionId":"s%d"', F.col("event_id"))
    rest = F.format_string('"zipcode":"%d","accountIds":[%s],"searchText":"%s"', "zip", "seller", "event_type")
    back = F.format_string('"searchText":"%s","accountIds":[%s],"zipcode":"%d"', "event_type", "seller", "zip")
    body = F.concat(F.lit("{"), F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", page, session, rest)).otherwise(F.concat_ws(", ", back, page)), F.lit("}"))
    return rows.groupBy(quarantine.request_fingerprint(body).alias("f")).agg(F.min("event_id").alias("first"), F.count("*").alias("n")).drop("f")


@query(r"""
WITH s AS (
  SELECT item_id AS scope, unnest(list_distinct(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:2], ' ')), '[\p{L}\p{N}]+'))) AS term FROM benchmark
), d AS (
  SELECT doc_id AS id, doc_id % 40 AS scope, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents
), m AS (
  SELECT scope, id, count(*) FILTER (WHERE NOT list_contains(w, term)) AS missing FROM d JOIN s USING (scope) GROUP BY ALL
), c AS (
  SELECT scope, count(DISTINCT id) AS rows FROM d GROUP BY 1
)
SELECT scope, coalesce(any_value(c.rows), 0) AS rows, count(*) FILTER (WHERE missing > 0) AS unmatched, CASE WHEN count(*) FILTER (WHERE missing > 0) > 0 THEN 'filtered-search-results-do-not-match-query' END AS reason
FROM (SELECT DISTINCT item_id AS scope FROM benchmark) LEFT JOIN m USING (scope) LEFT JOIN c USING (scope) GROUP BY scope
""")
def q_filter_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each benchmark item as a search that returned every fortieth document."""
    searches = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("scope"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("phrase"))
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("scope"), F.col("doc_id").alias("id"), "text")
    return containment.refusals(rows, searches)
