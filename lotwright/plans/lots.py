"""Queries about lots as wide records: normalising, joining user state, analysis counters, jobs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import money as M
from lotwright.operators import keyed, match, sequences

from .registry import query, table


@query("""
WITH v AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS images FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), d AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS images, max(l_shipdate) AS ends FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT v.l_orderkey, list_sort(list_distinct(list_concat(v.images, coalesce(d.images, [])))) AS images, len(list_filter(v.images, lambda x: NOT list_contains(coalesce(d.images, []), x))) AS only_visible FROM v LEFT JOIN d ON v.l_orderkey = d.l_orderkey
""")
def q_detail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    of = lambda cond, name: rows.where(cond).groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias(name))
    both = of("l_linenumber <= 2", "a").join(of("l_linenumber > 1", "b"), "l_orderkey", "left")
    b = F.coalesce("b", F.array().cast("array<bigint>"))
    return both.select("l_orderkey", F.array_sort(F.array_union("a", b)).alias("images"), F.size(F.array_except("a", b)).cast("long").alias("only_visible"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - p_size AS score FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > p_size)
SELECT l_orderkey, count(*) AS hits, max(score) AS best FROM s GROUP BY 1
""")
def q_theta_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).where(F.col("l_quantity") > F.col("p_size"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("hits"), F.max(F.col("l_quantity") - F.col("p_size")).alias("best"))


@query("""
WITH b AS (SELECT l_orderkey, arg_min(l_partkey, struct_pack(a := l_extendedprice, b := l_linenumber, c := l_partkey)) AS auto FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS chosen FROM orders)
SELECT o_orderkey, coalesce(chosen, auto) AS part, CASE WHEN chosen IS NOT NULL THEN 100 WHEN auto IS NOT NULL THEN 50 END AS score FROM o LEFT JOIN b ON o_orderkey = l_orderkey
""")
def q_override_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_extendedprice", "l_linenumber", "l_partkey")).alias("auto"))
    rows = table(spark, sf_dir, "orders").join(auto, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("chosen", F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")))
    rows = rows.select("o_orderkey", match.overridden(F.col("chosen"), F.col("auto"), 50).alias("m"))
    return rows.select("o_orderkey", F.col("m.key").alias("part"), "m.score")


@query("""
WITH k AS (SELECT p_partkey, [p_brand] AS b, string_split(p_type, ' ') AS t FROM part), e AS (SELECT a.p_partkey, a.b AS eb, a.t AS et, c.b AS ab, c.t AS ac FROM k a JOIN k c ON c.p_partkey = a.p_partkey + 1)
SELECT p_partkey, list_filter([CASE WHEN len(list_intersect(eb, ab)) = 0 THEN 'brand' END, CASE WHEN len(list_intersect(et, ac)) = 0 THEN 'type' END], lambda x: x IS NOT NULL) AS conflicts,
 len(list_intersect(eb, ab)) * 2 + len(list_intersect(et, ac)) AS matched FROM e
""")
def q_attribute_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand").alias("b"), F.split("p_type", " ").alias("t"))
    other = rows.select((F.col("p_partkey") - 1).alias("k"), F.col("b").alias("b2"), F.col("t").alias("t2"))
    found = match.attribute_sets({"brand": F.col("b"), "type": F.col("t")}, {"brand": F.col("b2"), "type": F.col("t2")}, ("brand",))
    out = rows.join(other, F.col("p_partkey") == F.col("k")).select("p_partkey", found.alias("f"))
    return out.select("p_partkey", "f.conflicts", F.col("f.matched").cast("long").alias("matched"))


@query("""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
SELECT p_partkey, CAST(i AS INT) AS i, token, coalesce(lag(token, 2) OVER w || ' ', '') || coalesce(lag(token) OVER w, '') AS before, coalesce(lead(token) OVER w, '') AS after FROM t WINDOW w AS (PARTITION BY p_partkey ORDER BY i)
""")
def q_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with the two before and the one after, by slices of the array: no shuffle."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("t"))
    rows = rows.select("p_partkey", "t", F.posexplode("t").alias("p", "token"))
    at = lambda k: F.try_element_at("t", F.when(F.col("p") + 1 + k > 0, F.col("p") + 1 + k))
    before = F.concat(F.coalesce(F.concat(at(-2), F.lit(" ")), F.lit("")), F.coalesce(at(-1), F.lit("")))
    return rows.select("p_partkey", (F.col("p") + 1).alias("i"), "token", before.alias("before"), F.coalesce(at(1), F.lit("")).alias("after"))


@query("""
WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id END AS url, CASE WHEN event_id % 2 = 0 THEN 'e' || (event_id % 50) END AS id, event_type FROM events)
SELECT coalesce(url, id, 'lot') AS key, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM r GROUP BY 1
""")
def q_keyed_merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    own = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")))
    rows = table(spark, sf_dir, "events").select(F.coalesce(url, own, F.lit("lot")).alias("key"), "event_id", "event_type")
    return keyed.best(rows, ["key"], F.col("event_id"))


@query("""
SELECT CAST(floor((o_orderkey - 1) / 100) AS BIGINT) AS page, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(*) = 100 AS whole FROM orders GROUP BY 1
""")
def q_paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.floor((F.col("o_orderkey") - 1) / 100).cast("long").alias("page")
    return table(spark, sf_dir, "orders").groupBy(page).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"), (F.count("*") == 100).alias("whole"))


@query("""
WITH i AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS pos, o_orderpriority FROM orders WHERE o_orderstatus = 'P'),
h AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1)
SELECT o_orderpriority, pos, o_orderkey, lines, total FROM i JOIN h ON l_orderkey = o_orderkey
""")
def q_id_scan_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority")
    ids = sequences.numbered(ids, ["o_orderpriority"], ["o_orderkey"], "pos", sequences.blocks("o_orderkey"))
    records = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return ids.join(records, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", "pos", "o_orderkey", "lines", "total")


@query("""
SELECT kind, count(*) AS n, round(sum(gross), 2) AS gross, round(sum(abs(fee)), 2) AS fees, round(sum(gross - abs(fee)), 2) AS net
FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'refund' WHEN 'A' THEN 'sale' ELSE 'pending' END AS kind, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS gross, -l_extendedprice * l_discount AS fee FROM lineitem) GROUP BY 1
""")
def q_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(M.transaction(F.col("l_returnflag"), F.col("l_extendedprice"), -F.col("l_extendedprice") * F.col("l_discount")).alias("t"))
    total = lambda c: F.round(F.sum(f"t.{c}"), 2)
    return rows.groupBy("t.kind").agg(F.count("*").alias("n"), total("gross").alias("gross"), total("fee").alias("fees"), total("net").alias("net"))


@query("""
WITH s AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, count(*) AS writes FROM events GROUP BY ALL)
SELECT c_custkey, event_type, value, coalesce(writes, 0) AS writes FROM customer LEFT JOIN s ON user_id = c_custkey
""")
def q_job_store_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads: what the store holds under the key of every customer; a key without an entry gives one row of nulls."""
    wanted = table(spark, sf_dir, "customer").select("c_custkey")
    stored = q_job_store_full(spark, sf_dir)
    return wanted.join(stored, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "event_type", "value", F.coalesce("writes", F.lit(0)).alias("writes"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, count(*) AS writes FROM events GROUP BY ALL")
def q_job_store_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full read beside q_job_store_reads: latest values and writes of all users."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.count("*").alias("writes"))


@query("""
SELECT c_custkey, '{"context":{"schemaVersion":1},"item":{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}}' AS payload FROM customer
""")
def q_export_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.to_json(F.struct(F.struct(F.lit(1).alias("schemaVersion")).alias("context"), F.struct("c_name", "c_mktsegment").alias("item"))).alias("payload"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * (1 - l_discount) / 10 AS score FROM lineitem)
SELECT CASE WHEN score >= 3 THEN 'matched' WHEN score > 0 THEN 'low_confidence' ELSE 'no_match' END AS status, count(*) AS n, round(min(score), 9) AS least FROM s GROUP BY 1
""")
def q_lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * (1 - F.col("l_discount")) / 10).alias("s"))
    status = F.when(F.col("s") >= 3, "matched").when(F.col("s") > 0, "low_confidence").otherwise("no_match")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.round(F.min("s"), 9).alias("least"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'pickup_only' WHEN p_type LIKE '%STEEL%' THEN 'available' ELSE 'unknown' END AS shipping FROM part")
def q_shipping_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(t.rlike("BRASS"), "pickup_only").when(t.rlike("STEEL"), "available").otherwise("unknown").alias("shipping"))


@query(f"""
WITH m AS (SELECT p_partkey, p_retailprice AS price, CASE WHEN p_size % 3 = 0 THEN 'matched' ELSE 'no_match' END AS status, p_size % 4 AS q FROM part)
SELECT status, count(*) AS n, round(sum(CASE WHEN status = 'matched' AND price > 0 THEN price * greatest(1, q) END), 2) AS trusted FROM m GROUP BY 1
""")
def q_trusted_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_size") % 3 == 0, "matched").otherwise("no_match")
    rows = table(spark, sf_dir, "part").select(status.alias("status"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 4).alias("q"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(M.market_value(F.col("status"), F.col("price"), F.col("q"))), 2).alias("trusted"))
