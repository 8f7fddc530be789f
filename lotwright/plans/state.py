"""Queries about keyed state, timers, caches and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import times as X
from lotwright.operators import keyed, sequences, state

from .registry import query, table

#: The moment that stands for now: an hour before the last event.
NOW = "(SELECT max((epoch_us(ts) // 1000)) - 3600000 FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", X.epoch_ms(F.col("ts")))


def _now(rows: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(rows.agg((F.max("ms") - 3_600_000).alias("now"))))  # one row


@query(f"""
WITH e AS (SELECT event_id, (epoch_us(ts) // 1000) AS ms, {NOW} AS now FROM events WHERE event_type = 'view')
SELECT event_id, k AS minutes, greatest(now + 1000, ms - k * 60000) AS at FROM e, (SELECT unnest([15, 2]) AS k) WHERE ms > now
""")
def q_alarm_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _now(_events(spark, sf_dir)).where("event_type = 'view' AND ms > now")
    rows = rows.withColumn("minutes", F.explode(F.array(*map(F.lit, X.ALARMS))))
    return rows.select("event_id", "minutes", X.alarm_at(F.col("now"), F.col("ms"), F.col("minutes")).alias("at"))


@query(f"SELECT event_type, count(*) FILTER (WHERE (epoch_us(ts) // 1000) > {NOW} AND (epoch_us(ts) // 1000) <= {NOW} + 3600000) AS soon FROM events GROUP BY 1")
def q_ending_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _now(_events(spark, sf_dir)).groupBy("event_type").agg(F.count_if((F.col("ms") > F.col("now")) & (F.col("ms") <= F.col("now") + 3_600_000)).alias("soon"))


LIFE = "CASE event_type WHEN 'view' THEN 43200000 WHEN 'click' THEN 900000 WHEN 'error' THEN 300000 ELSE 120000 END"
STATUS = {"view": "ok", "click": "no_results", "error": "blocked"}


def _status() -> F.Column:
    return F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STATUS.items()), F.lit("other"))


@query(f"SELECT event_type, count(*) FILTER (WHERE (epoch_us(ts) // 1000) + {LIFE} > {NOW}) AS live, count(*) AS stored FROM events WHERE (epoch_us(ts) // 1000) <= {NOW} GROUP BY 1")
def q_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _now(_events(spark, sf_dir)).where("ms <= now")
    return rows.groupBy("event_type").agg(F.count_if(F.col("ms") + X.lifetime(_status()) > F.col("now")).alias("live"), F.count("*").alias("stored"))


@query("""
WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM events),
r AS (SELECT event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM i)
SELECT event_id, CAST(least(120000, greatest(2000, 5000 * power(2, least(5, n - 1)))) AS BIGINT) AS wait_ms FROM r WHERE event_type = 'error'
""")
def q_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequences.failure_runs(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", piece=sequences.spans("ts"))
    return runs.where("event_type = 'error'").select("event_id", X.backoff(F.col("failures"), F.lit(2000)).alias("wait_ms"))


@query("""
WITH q AS (SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 6 AS batch FROM events),
b AS (SELECT user_id, batch, count(*) AS items, bool_and(event_type = 'view') AS cached FROM q GROUP BY ALL)
SELECT user_id, batch, items, cached, CAST(sum(CASE WHEN cached THEN 0 ELSE 350 END) OVER (PARTITION BY user_id ORDER BY batch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paced_ms FROM b
""")
def q_queue_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.numbered(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "place", sequences.blocks("event_id"))
    rows = rows.withColumn("batch", F.floor((F.col("place") - 1) / 6).cast("long"))
    rows = rows.groupBy("user_id", "batch").agg(F.count("*").alias("items"), F.bool_and(F.col("event_type") == "view").alias("cached"))
    return sequences.running(rows, ["user_id"], ["batch"], "sum", F.when(F.col("cached"), 0).otherwise(350), "paced_ms", sequences.blocks("batch"))


@query("""
SELECT event_id, CASE WHEN d <= 0 THEN 'Ended' WHEN m >= 1440 THEN (m // 1440) || 'd ' || ((m % 1440) // 60) || 'h' WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS label
FROM (SELECT event_id, CAST((value - 20) * 3600000 AS BIGINT) AS d, CAST(floor(CAST((value - 20) * 3600000 AS BIGINT) / 60000) AS BIGINT) AS m FROM events)
""")
def q_countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.round((F.col("value") - 20) * 3_600_000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", X.countdown(left).alias("label"))


@query("""
SELECT event_id, CAST(d * 86400000 + m * 60000 AS BIGINT) AS ms FROM (SELECT event_id, event_id % 5 AS d, event_id % 59 AS m FROM events)
""")
def q_duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("event_id") % 5).cast("string"), F.lit("d "), (F.col("event_id") % 59).cast("string"), F.lit("m left"))
    return table(spark, sf_dir, "events").select("event_id", X.duration_ms(text).alias("ms"))


@query("""
SELECT event_id, CASE WHEN a IS NULL THEN r WHEN abs(a - r) > 300000 THEN r ELSE a END AS at, a IS NULL OR abs(a - r) > 300000 AS approximate
FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (epoch_us(ts) // 1000) END AS a, (epoch_us(ts) // 1000) + (event_id % 13) * 60000 AS r FROM events)
""")
def q_end_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    end = X.end_time(F.when(F.col("event_id") % 7 != 0, F.col("ms")), F.col("ms") + (F.col("event_id") % 13) * 60_000)
    return rows.select("event_id", end.alias("e")).select("event_id", "e.at", "e.approximate")


@query("""
SELECT event_id, user_id, value > 80 AND NOT coalesce(lag(value > 80) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS alert FROM events
""")
def q_over_max_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.edges(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("value") > 80, piece=sequences.spans("ts")).select("event_id", "user_id", "alert")


@query("""
SELECT event_id, user_id FROM (SELECT event_id, user_id, floor(value) AS v, max(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE top IS NULL OR v >= top
""")
def q_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").alias("v"))
    return state.accepted(rows, ["user_id"], ["event_id"], "v", sequences.blocks("event_id")).select("event_id", "user_id")


@query("""
WITH f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS fresh FROM events)
SELECT event_id, user_id, fresh, count(*) OVER w = 4 AND sum(CAST(fresh AS INT)) OVER w = 0 AS settled FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
""")
def q_settled_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return state.settled(rows, ["user_id"], ["event_id"], "event_type", 4, sequences.blocks("event_id")).select("event_id", "user_id", "fresh", "settled")


@query("""
WITH o AS (SELECT *, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) > 600000 THEN 1 ELSE 0 END AS opens FROM events),
b AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id ROWS UNBOUNDED PRECEDING) AS burst FROM o)
SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS n, max(event_id) AS fires FROM b GROUP BY ALL
""")
def q_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.islands(_events(spark, sf_dir), ["user_id"], ["ms", "event_id"], F.lit(600_000), sequences.spans("ts"))
    return rows.groupBy("user_id", "burst").agg(F.count("*").alias("n"), F.max("event_id").alias("fires"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS joined FROM events GROUP BY ALL")
def q_inflight_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("joined"))


@query("""
WITH r AS (SELECT user_id, arg_max(value, event_id) AS v, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1), w AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT w.user_id, coalesce(v, -1) AS value, CASE WHEN event_id IS NULL THEN n ELSE 0 END AS failures FROM w LEFT JOIN r USING (user_id)
""")
def q_refresh_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    got = keyed.best(rows.where("event_type = 'purchase'"), ["user_id"], F.col("event_id"), ["value", "event_id"])
    watched = rows.groupBy("user_id").agg(F.count("*").alias("n")).join(got, "user_id", "left")
    return watched.select("user_id", F.coalesce("value", F.lit(-1.0)).alias("value"), F.when(F.col("event_id").isNull(), F.col("n")).otherwise(0).alias("failures"))
