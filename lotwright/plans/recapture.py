"""Queries about captures that are read again: short pages, changing snapshots, refreshes of a watchlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.operators import changelog, retry, sequences
from lotwright.sources import batches, paged
from lotwright.sources.shared import shared_path
from lotwright.streaming import refresh

from .registry import query, table

PAGE = 20


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at the orders of each month, in pages: every fourth month is whole at once, the others lack some orders once, twice or always.

    In even years later pages of the first attempt state another total, in every third month it repeats some orders.
    """
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_orderkey").alias("id"))
    orders = sequences.numbered(orders, ["snapshot"], ["id"], "pos", sequences.blocks("id"))
    totals = orders.groupBy(F.col("snapshot").alias("s")).agg(F.count("*").alias("total"))
    rows = orders.join(totals, F.col("snapshot") == F.col("s")).withColumn("page", F.floor((F.col("pos") - 1) / PAGE).cast("int") + 1).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
    gone = (F.col("id") % 9 == 0) & (F.col("attempt") <= F.col("m") % 4)
    twice = (F.col("attempt") == 1) & (F.col("m") % 3 == 0) & (F.col("id") % 50 == 0)
    times = F.when(gone, F.array().cast("array<bigint>")).when(twice, F.array("id", "id")).otherwise(F.array("id"))
    stated = F.col("total") + F.when((F.col("attempt") == 1) & (F.col("y") % 2 == 0) & (F.col("page") > 1), 1).otherwise(0)
    return rows.groupBy("snapshot", "attempt", "page").agg(F.max(stated).alias("total"), F.flatten(F.collect_list(times)).alias("ids"))  # a page's ids


_ANSWERS_SQL = f"""
o AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS snapshot, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey AS id,
         (row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1) // {PAGE} + 1 AS page, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS total FROM orders
), r AS (
  SELECT snapshot, attempt, page, total + CASE WHEN attempt = 1 AND y % 2 = 0 AND page > 1 THEN 1 ELSE 0 END AS total,
         CASE WHEN id % 9 = 0 AND attempt <= m % 4 THEN 0 WHEN attempt = 1 AND m % 3 = 0 AND id % 50 = 0 THEN 2 ELSE 1 END AS times
  FROM o, (VALUES (1), (2), (3)) AS v(attempt)
)"""


def _read(answers: DataFrame) -> retry.Read:
    """Answers as they would have landed: a folder for each attempt, of which a read takes one."""
    spark, path = answers.sparkSession, shared_path(answers.sparkSession, "answers")
    answers.write.partitionBy("attempt").parquet(path)
    answers = spark.read.schema(answers.schema).parquet(path)
    return lambda wanted, attempt: answers.where(F.col("attempt") == attempt).join(wanted, [c for c in ("snapshot", "page") if c in wanted.columns], "left_semi")


@query(f"""
WITH RECURSIVE {_ANSWERS_SQL}, p AS (
  SELECT snapshot, attempt, page, CAST(sum(times) AS BIGINT) AS n, least({PAGE}, t - (page - 1) * {PAGE}) AS expected
  FROM r JOIN (SELECT snapshot, count(*) AS t FROM o GROUP BY 1) USING (snapshot) GROUP BY snapshot, attempt, page, t
), w AS (
  SELECT snapshot, page, attempt, n, expected FROM p WHERE attempt = 1
  UNION ALL SELECT snapshot, page, p.attempt, p.n, p.expected FROM w JOIN p USING (snapshot, page) WHERE p.attempt = w.attempt + 1 AND w.n <> w.expected
)
SELECT snapshot, page, CAST(max(expected) AS INT) AS expected, max(attempt) AS attempt, CAST(arg_max(n, attempt) AS INT) AS n, arg_max(n, attempt) = max(expected) AS complete FROM w GROUP BY snapshot, page
""")
def q_short_page_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a month's orders, each read again until it has as many ids as it should, three times at most."""
    totals = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot")).agg(F.count("*").alias("total"))
    return retry.covered_pages(_read(_answers(spark, sf_dir)), retry.expected_on_page(totals, PAGE)).drop("ids")


@query(f"""
WITH RECURSIVE {_ANSWERS_SQL}, f AS (
  SELECT snapshot, attempt, arg_min(total, page) AS total FROM r GROUP BY ALL
), d AS (
  SELECT snapshot, attempt, count(DISTINCT page) FILTER (WHERE r.total <> f.total) AS drifted, f.total, CAST(sum(times) AS BIGINT) AS enumerated, count(*) FILTER (WHERE times > 0) AS ids, count(*) FILTER (WHERE times > 1) AS duplicates
  FROM r JOIN f USING (snapshot, attempt) GROUP BY snapshot, attempt, f.total
), a AS (
  SELECT *, CASE WHEN drifted > 0 THEN 'api-total-drift' WHEN duplicates > 0 THEN 'api-duplicate-ids' WHEN ids <> total THEN 'api-enumeration-count-mismatch' END AS reason FROM d
), w AS (
  SELECT snapshot, attempt, reason FROM a WHERE attempt = 1
  UNION ALL SELECT snapshot, a.attempt, a.reason FROM w JOIN a USING (snapshot) WHERE a.attempt = w.attempt + 1 AND w.reason IS NOT NULL
), l AS (
  SELECT snapshot, max(attempt) AS attempt FROM w GROUP BY 1
)
SELECT snapshot, attempt, total, enumerated, duplicates, reason, reason IS NULL AS complete FROM l JOIN a USING (snapshot, attempt)
""")
def q_snapshot_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders, each captured again until its audit passes, three times at most."""
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"))
    _, report = retry.complete_snapshots(_read(_answers(spark, sf_dir)), months)
    return report.select("snapshot", "attempt", "total", "enumerated", "duplicates", "reason", "complete")


ROUNDS, ROUND_MS, START_MS = 5, 518_400_000, 1_704_067_200_000


@query(f"""
WITH RECURSIVE l AS (
  SELECT user_id AS lot_id, (row_number() OVER (ORDER BY user_id) - 1) // 100 AS batch FROM (SELECT DISTINCT user_id FROM events)
), a AS (
  SELECT user_id AS lot_id, (epoch_us(ts) // 1000 - {START_MS}) // {ROUND_MS} AS round, arg_max(struct_pack(v := value, s := CASE WHEN event_id % 5 <> 0 THEN event_id % 9000 END), event_id) AS x FROM events WHERE event_type = 'purchase' GROUP BY ALL
), r AS (
  SELECT 0 AS round, lot_id, batch, CAST(NULL AS BIGINT) AS bid_cents, CAST(NULL AS BIGINT) AS ends_ms, CAST(NULL AS BIGINT) AS refreshed_ms, 0 AS failures, false AS notified, false AS alert FROM l
  UNION ALL
  SELECT round + 1, lot_id, batch, coalesce(bid, bid_cents), coalesce(ends, ends_ms), CASE WHEN got THEN now ELSE refreshed_ms END, CASE WHEN got THEN 0 ELSE failures + 1 END,
         notified OR coalesce(got AND bid > 6000, false), coalesce(got AND NOT notified AND bid > 6000, false)
  FROM (
    SELECT r.*, {START_MS} + CAST(r.round + 1 AS BIGINT) * {ROUND_MS} AS now, x IS NOT NULL AND (batch + r.round) % 4 <> 0 AS got, CASE WHEN (batch + r.round) % 4 <> 0 THEN CAST(round(x.v * 100) AS BIGINT) END AS bid,
           CASE WHEN (batch + r.round) % 4 <> 0 THEN {START_MS} + CAST(r.round + 1 AS BIGINT) * {ROUND_MS} + x.s * 1000 END AS ends
    FROM r LEFT JOIN a ON a.lot_id = r.lot_id AND a.round = r.round WHERE r.round < {ROUNDS}
  )
)
SELECT lot_id, bid_cents, ends_ms, refreshed_ms, CAST(failures AS INT) AS failures, failures >= 2 AS stale, notified, alert FROM r WHERE round = {ROUNDS}
""")
def stream_watch_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five refreshes of all users' lots, each a micro-batch: a purchase answers, every fourth request fails."""
    events = table(spark, sf_dir, "events")
    lots = events.select(F.col("user_id").alias("lot_id")).distinct()
    store = refresh.Store(spark, shared_path(spark, "watched"))
    store.create(lots.withColumn("max_cents", F.lit(6000).cast("long")))
    number = F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - START_MS) / ROUND_MS)
    answers = events.where("event_type = 'purchase'").select(F.col("user_id").alias("lot_id"), F.col("value").alias("high_bid"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 9000).cast("double").alias("seconds_left"), F.col("event_id").alias("place"), F.lit(None).cast("long").alias("batch"), number.alias("round"))
    asked = refresh.batched(lots).select("batch").distinct().withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))))
    none = {"lot_id": "long", "high_bid": "double", "seconds_left": "double", "place": "long"}
    failed = asked.where("(batch + round) % 4 = 0").select(*(F.lit(None).cast(t).alias(n) for n, t in none.items()), "batch", F.col("round").cast("long").alias("round"))
    rows = answers.union(failed).withColumn("at_ms", F.lit(START_MS) + (F.col("round") + 1) * ROUND_MS)
    path = shared_path(spark, "answers")
    for k in range(ROUNDS):  # one file for each refresh, in the order in which they come
        rows.where(F.col("round") == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return refresh.run_to_end(stream, store).drop("max_cents")


@query("""
WITH c AS (
  SELECT user_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, CASE WHEN event_type <> 'click' THEN value END AS value, CASE WHEN event_type <> 'view' THEN props END AS props FROM events
), r AS (
  SELECT user_id, max(seq) AS last, max(seq) FILTER (WHERE op <> 'update') AS reset, arg_max(op, seq) FILTER (WHERE op <> 'update') AS op FROM c GROUP BY 1
)
SELECT user_id, last AS seq, arg_max(c.value, c.seq) FILTER (WHERE c.value IS NOT NULL) AS value, arg_max(c.props, c.seq) FILTER (WHERE c.props IS NOT NULL) AS props
FROM r JOIN c USING (user_id) WHERE r.op = 'insert' AND c.seq >= r.reset GROUP BY user_id, last
""")
def q_message_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after all events: a signup inserts, an error deletes, others update; merged in three parts that overlap."""
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    changes = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("op"), F.when(F.col("event_type") != "click", F.col("value")).alias("value"), F.when(F.col("event_type") != "view", F.col("props")).alias("props"))
    path, buckets = shared_path(spark, "store"), 8
    changelog.create(path, changes.select("user_id", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("deleted"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props")).distinct(), "user_id", buckets)
    n = changes.agg(F.max("seq")).first()[0] or 0
    for a, b in ((0, n // 2), (n // 4, 3 * n // 4), (n // 2, n)):
        changelog.merge(path, changes.where(F.col("seq").between(a, b)), "user_id", buckets)
    return changelog.live(path, spark)


@query("""
WITH p AS (SELECT o_orderkey AS id, 1 + (o_orderkey % 40) AS page, o_orderpriority AS title, row_number() OVER (PARTITION BY o_orderkey % 40 ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderkey % 40) AS total FROM orders)
SELECT CAST(page AS INT) AS page, CAST(pos AS INT) AS pos, CAST(total AS BIGINT) AS total, id, title FROM p WHERE page BETWEEN 3 AND 7 AND id > 1000 AND title LIKE '%HIGH'
""")
def q_pushed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages of orders: a filter on the page opens five of forty, one on the id is applied as they are read, one on the title after."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40 + 1).cast("int").alias("page"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")).alias("r"))
    pages = orders.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("results"))  # what one page holds
    bodies = pages.select("page", F.to_json(F.struct(F.col("page").alias("pageNumber"), F.size("results").alias("totalCount"), "results")).alias("body"))
    path = shared_path(spark, "landed")
    bodies.repartition("page").write.partitionBy("page").text(path)
    rows = paged.read_landed(spark, path, 40, layout="folders")
    return rows.where(F.col("page").between(3, 7) & (F.col("id") > 1000) & F.col("title").endswith("HIGH"))


@query("""
SELECT DISTINCT 'c_custkey,c_name,c_acctbal' AS line FROM customer
UNION ALL SELECT '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || CAST(CAST(c_acctbal * 100 AS BIGINT) AS VARCHAR) || '"' FROM customer
""")
def q_quoted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file that the sink for quoted text has written."""
    path = shared_path(spark, "quoted")
    batches.write_quoted(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round(F.col("c_acctbal") * 100).cast("long").alias("c_acctbal")), path)
    return spark.read.option("lineSep", "\r\n").text(path).distinct().withColumnRenamed("value", "line")


@query("""
SELECT lower(substr(o_orderpriority, 3, 3)) AS job, o_orderkey AS id FROM orders WHERE o_orderpriority NOT LIKE '1%' OR o_orderkey % 3 = 0
UNION ALL SELECT lower(substr(o_orderpriority, 3, 3)), -o_orderkey FROM orders WHERE o_orderpriority LIKE '5%' AND o_orderkey % 4 = 0
""")
def q_keyed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches by priority; one priority is replaced by a third of it, another one gets more rows."""
    job = F.lower(F.substring("o_orderpriority", 3, 3)).alias("job")
    orders, path = table(spark, sf_dir, "orders"), shared_path(spark, "batches")
    batches.put_batches(orders.select(job, F.col("o_orderkey").alias("id")), path, "job")
    batches.put_batches(orders.where("o_orderpriority LIKE '1%' AND o_orderkey % 3 = 0").select(job, F.col("o_orderkey").alias("id")), path, "job", replace=True)
    batches.put_batches(orders.where("o_orderpriority LIKE '5%' AND o_orderkey % 4 = 0").select(job, (-F.col("o_orderkey")).alias("id")), path, "job")
    return batches.read_batches(spark, path, "job", "id long")
