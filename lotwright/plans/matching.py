"""Queries about complete captures, one row per key, positions and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwright.functions.lots import merged_visible
from lotwright.operators import coverage, keyed, match, sequences

from .registry import query, table


@query("""
WITH e AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS snapshot, o_orderkey AS id FROM orders),
h AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS snapshot, l_orderkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT snapshot, id, count(*) AS a FROM e GROUP BY ALL), b AS (SELECT snapshot, id, count(*) AS b FROM h GROUP BY ALL),
c AS (SELECT snapshot, coalesce(sum(a), 0) AS enumerated, count(a) AS enumerated_ids, coalesce(sum(b), 0) AS hydrated, count(b) AS hydrated_ids, count(*) FILTER (WHERE a > 1) AS duplicates,
             count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a IS NULL) AS unexpected FROM a FULL JOIN b USING (snapshot, id) GROUP BY 1),
x AS (SELECT snapshot, count(*) AS n, CAST(snapshot AS INT) % 9 AS k FROM e GROUP BY 1),
f AS (SELECT snapshot, CASE WHEN k = 6 THEN NULL WHEN k = 8 THEN n + 1 ELSE n END AS total, k, n FROM x)
SELECT snapshot, total, CAST(enumerated AS BIGINT) AS enumerated, enumerated_ids, CAST(hydrated AS BIGINT) AS hydrated, hydrated_ids, duplicates, missing, unexpected,
       CASE WHEN k = 0 THEN 'route-fingerprint-changed' WHEN k = 1 THEN 'user-stop' WHEN k = 2 THEN 'api-page-failure' WHEN k = 3 THEN 'api-hydration-failure' WHEN k = 4 THEN 'api-total-drift' WHEN k = 5 THEN 'api-visible-total-mismatch'
            WHEN total IS NULL THEN 'api-total-missing' WHEN duplicates > 0 THEN 'api-duplicate-ids' WHEN enumerated_ids <> total THEN 'api-enumeration-count-mismatch' WHEN missing > 0 THEN 'api-missing-hydration'
            WHEN unexpected > 0 THEN 'api-unexpected-hydration' WHEN hydrated_ids <> total THEN 'api-hydration-count-mismatch' END AS reason, reason IS NULL AS complete
FROM f JOIN c USING (snapshot)
""")
def q_coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a year against those that lines are found for; each year states other facts about its capture."""
    year = F.year("o_orderdate").cast("string").alias("snapshot")
    orders = table(spark, sf_dir, "orders").select(year, F.col("o_orderkey").alias("id"))
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))  # before the join
    lines = counted.join(orders, F.col("l_orderkey") == F.col("id")).select("snapshot", "id", "n")
    k = F.col("snapshot").cast("int") % 9
    stated = orders.groupBy("snapshot").agg(F.count("*").alias("n"))
    stated = stated.select(
        "snapshot", F.when(k == 6, F.lit(None)).when(k == 8, F.col("n") + 1).otherwise(F.col("n")).alias("total"), F.lit("a").alias("start"), F.when(k == 0, "b").otherwise("a").alias("end"), (k == 1).alias("stopped"),
        F.when(k == 2, 1).otherwise(0).alias("failed_pages"), F.when(k == 3, 1).otherwise(0).alias("failed_batches"), F.when(k == 4, 1).otherwise(0).alias("drifted"), F.when(k == 5, F.lit(0)).cast("long").alias("visible_total"),
    )
    return coverage.audit(orders, lines, stated)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def q_unexpected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_semi_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS total FROM events GROUP BY ALL),
f AS (SELECT event_type, arg_min(total, day) AS first_total FROM d GROUP BY 1)
SELECT event_type, first_total, count(*) FILTER (WHERE total <> first_total) AS drifted, count(*) AS days FROM d JOIN f USING (event_type) GROUP BY ALL
""")
def q_total_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("total"))
    firsts = days.groupBy("event_type").agg(F.min_by("total", "day").alias("first_total"))
    return days.join(firsts, "event_type").groupBy("event_type", "first_total").agg(F.count_if(F.col("total") != F.col("first_total")).alias("drifted"), F.count("*").alias("days"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, l_quantity * (1 - l_discount) / 10 AS score FROM lineitem WHERE l_returnflag <> 'R'),
t AS (SELECT *, max(score) OVER (PARTITION BY l_orderkey) AS top FROM s WHERE score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY price, score DESC, l_linenumber, l_partkey) AS rn FROM t WHERE score >= top - 1.5)
SELECT l_orderkey, l_linenumber, l_partkey, price, round(score, 9) AS score FROM k WHERE rn = 1
""")
def q_best_match_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * (1 - F.col("l_discount")) / 10).alias("score"))
    chosen = match.band_choice(rows, "l_orderkey", "score", "price", ["l_linenumber", "l_partkey"], 1.5)
    return chosen.withColumn("score", F.round("score", 9))


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R', l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1
""")
def q_best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = F.struct(F.col("l_returnflag") == "R", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")
    return keyed.first(rows, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q_latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return keyed.best(rows, ["user_id"], F.struct("ts", "event_id"))


@query("""
SELECT user_id, event_type, revision, event_id FROM (
  SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS revision, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def q_newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").cast("long").alias("revision"), "event_id")
    return keyed.best(rows, ["user_id", "event_type"], F.struct("revision", "event_id"))


@query("""
WITH j AS (SELECT user_id, max(ts) AS updated FROM events GROUP BY 1), k AS (SELECT user_id FROM j ORDER BY updated DESC, user_id DESC LIMIT 20)
SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM k)
""")
def q_retention_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    jobs = rows.groupBy("user_id").agg(F.max("ts").alias("updated"))
    return keyed.keep_newest(jobs, rows, "user_id", "updated", 20)[1].select("event_id", "user_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def q_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return keyed.first(rows, ["user_id", "event_type"], F.col("event_id"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events
""")
def q_group_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sequences.under_headers(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "header", sequences.spans("ts")).select("event_id", "user_id", "header")


@query("""
WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM events)
SELECT event_id, user_id, failures, failures >= 2 AS stale FROM (
  SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM i)
""")
def q_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sequences.failure_runs(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", piece=sequences.spans("ts")).select("event_id", "user_id", "failures", "stale")


@query("""
WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS s, CAST(l_linenumber AS BIGINT) AS e FROM lineitem GROUP BY ALL),
w AS (SELECT l_orderkey, s - lag(e) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS st FROM r)
SELECT l_orderkey, count(*) AS ranges, count(*) FILTER (WHERE st > 1) AS gaps, count(*) FILTER (WHERE st < 1) AS overlaps, coalesce(bool_and(st = 1), true) AS exact FROM w GROUP BY 1
""")
def q_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    ranges = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("s"), n.alias("e")).distinct()
    return sequences.contiguous(ranges, ["l_orderkey"], "s", "e")


@query("""
WITH h AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, max(l_linestatus) AS status FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN total IS NULL OR o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN o_totalprice WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE total END AS price, CASE WHEN o_orderkey % 5 = 0 OR status IS NULL THEN CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE o_orderstatus END ELSE status END AS status, total IS NOT NULL AS hydrated
FROM orders LEFT JOIN h ON o_orderkey = l_orderkey
""")
def q_merge_visible_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_linestatus").alias("s"))
    rows = table(spark, sf_dir, "orders").join(h, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    shown = F.struct(F.col("o_totalprice").alias("current_bid"), F.when(F.col("o_orderstatus") == "F", "Closed").otherwise(F.col("o_orderstatus")).alias("status"), F.lit("").alias("raw_text"))
    record = F.when(F.col("total").isNotNull(), F.struct(F.when(k % 4 == 0, 0.0).otherwise(F.col("total")).alias("current_bid"), F.when(k % 5 == 0, "").otherwise(F.col("s")).alias("status")))
    merged = rows.select(k, merged_visible(shown, record).alias("m"))
    return merged.select(k, F.col("m.current_bid").alias("price"), "m.status", "m.hydrated")


@query("""
SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS event_type, arg_max(value, event_id) FILTER (WHERE value > 50) AS value, max(event_id) AS event_id FROM events GROUP BY 1
""")
def q_last_writer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), F.when(F.col("value") > 50, F.col("value")).alias("value"), "event_id"
    )
    return keyed.merged(rows, "user_id", "event_id")


@query("""
SELECT 'union' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'distinct', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'less', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'more', count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer)
""")
def q_set_union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    bag = c.select("c_nationkey").union(s.select("s_nationkey"))
    ids, others = c.select("c_custkey"), s.select("s_suppkey")
    return n(bag, "union").union(n(bag.distinct(), "distinct")).union(n(ids.subtract(others), "less")).union(n(others.subtract(ids), "more"))


@query("""
SELECT o_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_suppkey % 4, 0), o_custkey) AS party, CAST(o_orderkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS line_id
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'
""")
def q_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    rows = orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    party = F.coalesce(F.nullif(F.col("l_suppkey") % 4, F.lit(0)), F.col("o_custkey"))
    return rows.select("o_orderkey", "l_linenumber", "l_partkey", party.alias("party"), F.concat_ws(":", "o_orderkey", "l_partkey", "l_linenumber").alias("line_id"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN count(*) > 1 THEN 'review-' ELSE '' END || left(sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 16) AS derived, count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber
""")
def q_derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    digest = F.left(F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256), F.lit(16))
    return rows.select("l_orderkey", "l_linenumber", F.concat(F.when(F.col("n") > 1, "review-").otherwise(""), digest).alias("derived"), "n")


@query("""
WITH m AS (SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM m)
SELECT source, count(*) AS unlabelled, count(*) FILTER (WHERE rn <= 10) AS taken, count(*) FILTER (WHERE rn > 10) AS deferred, max(doc_id) FILTER (WHERE rn <= 10) AS last_taken FROM r GROUP BY 1
""")
def q_bounded_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten unlabelled documents of each source, in order of id, are taken now; the rest are counted."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = rows.withColumn("rn", place).where("rn <= 10").groupBy("source").agg(F.count("*").alias("taken"), F.max("doc_id").alias("last_taken"))  # top-k per group: cut before the shuffle
    sizes = rows.groupBy("source").agg(F.count("*").alias("unlabelled"))
    return sizes.join(first, "source").select("source", "unlabelled", "taken", (F.col("unlabelled") - F.col("taken")).alias("deferred"), "last_taken")


@query("SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 20")
def q_topk_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20).select("l_orderkey", "l_linenumber")
