"""Audit, security, usage and rate queries over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import timeline as T
from lectern.plans.registry import Tables, query


def _risk() -> Column:
    return F.when(F.col("value") < 30, "low").when(F.col("value") < 60, "medium").when(F.col("value") < 80, "high").otherwise("critical")


@query("""
SELECT coalesce(event_type, 'all') AS event_type, coalesce(CAST(user_id % 4 AS VARCHAR), 'all') AS tier, count(*) AS n
FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), (event_type, user_id % 4), ())
""")
def audit_stats_grouping_sets(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("user_id") % 4).cast("string").alias("tier"))
    return rows.cube("event_type", "tier").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("tier", F.lit("all")).alias("tier"), "n")


@query("""
SELECT event_type, CASE WHEN value < 30 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 80 THEN 'high' ELSE 'critical' END AS risk, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2
""")
def risk_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", _risk().alias("risk")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("""
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS logins, count(*) FILTER (WHERE event_type = 'error') AS failed,
  strftime(max(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS last_login, count(*) FILTER (WHERE event_type = 'error') >= 10 AS suspicious,
  array_to_string(list_slice(list(event_id ORDER BY ts DESC, event_id DESC), 1, 10), ',') AS recent
FROM events GROUP BY user_id
""")
def user_activity_summary(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    failed = F.count_if(kind == "error")
    recent = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    # ten rows of a user reach the list, however many the user has
    latest = t.events.select("user_id", "ts", "event_id").withColumn("r", F.row_number().over(recent)).where("r <= 10")
    listed = latest.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("recent"))
    counts = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(kind == "purchase").alias("logins"), failed.alias("failed"),
        F.date_format(F.max(F.when(kind == "purchase", F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_login"), (failed >= 10).alias("suspicious"),
    )
    return counts.join(listed, "user_id")


@query("""
SELECT count(*) FILTER (WHERE event_type = 'error') AS failed_logins, count(*) FILTER (WHERE event_type = 'error' AND value > 90) AS lockouts, count(DISTINCT user_id) AS users,
  count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS failing_users, round(count(*) FILTER (WHERE event_type = 'error') * 1.0 / greatest(count(*), 1), 4) AS failure_rate,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events GROUP BY CAST(ts AS DATE)
""")
def security_metrics_distinct(t: Tables) -> DataFrame:
    bad = F.col("event_type") == "error"
    return t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count_if(bad).alias("failed_logins"), F.count_if(bad & (F.col("value") > 90)).alias("lockouts"), F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.when(bad, F.col("user_id"))).alias("failing_users"), F.round(F.count_if(bad) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("failure_rate"),
    )


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1
""")
def hourly_buckets(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    recent = t.events.select("ts", "user_id").crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("interval 7 days"))
    return recent.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 10
""")
def top_users(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("""
SELECT event_type, CAST(user_id % 3 AS BIGINT) AS model, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(round(sum(CAST(value AS DECIMAL(18,6))), 2) AS DOUBLE) AS cost, count(*) AS requests,
  CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*), 8) AS mean_cost, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0) AS cache_hits
FROM events GROUP BY 1, 2, 3
""")
def usage_report_by_day(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select("event_type", (F.col("user_id") % 3).alias("model"), F.to_date("ts").cast("string").alias("day"), F.col("value").cast("decimal(18,6)").alias("value"), k.alias("k"))
    return rows.groupBy("event_type", "model", "day").agg(
        F.round(F.sum("value"), 2).cast("double").alias("cost"), F.count(F.lit(1)).alias("requests"), F.sum("k").alias("tokens"), F.round(F.sum("value").cast("double") / F.count(F.lit(1)), 8).alias("mean_cost"), F.count_if(F.col("k") % 2 == 0).alias("cache_hits")
    )


@query("""
WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM events), w AS (SELECT *, s - s % 3600 AS window_start FROM e)
SELECT event_id, user_id, window_start, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS number, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) <= 2 AS allowed FROM w
""")
def fixed_window_rate_limit(t: Tables) -> DataFrame:
    return T.fixed_window(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["ts", "event_id"], 2, 3600).drop("ts")


@query("""
WITH s AS (SELECT *, CASE WHEN epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER w > 21600 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS attempts, max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) AS seconds FROM g GROUP BY user_id, session
""")
def session_gap_attempts(t: Tables) -> DataFrame:
    s = T.sessions(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["ts", "event_id"], 21600)
    at = T.seconds(F.col("ts"))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("attempts"), (F.max(at) - F.min(at)).alias("seconds"))


@query("""
WITH a AS (SELECT * FROM events WHERE event_type = 'error'),
s AS (SELECT *, CASE WHEN epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 864000 THEN 1 ELSE 0 END AS f FROM a),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS k FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lockout FROM n WHERE k % 5 = 0)
SELECT user_id, event_id, lockout, CAST(list_extract([5, 15, 30, 60, 120, 360, 720, 1440], least(lockout, 8)) AS BIGINT) AS minutes FROM l
""")
def progressive_lockouts(t: Tables) -> DataFrame:
    failed = t.events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    return T.lockouts(failed, "user_id", "ts", ["ts", "event_id"], gap=864000).select("user_id", "event_id", "lockout", "minutes")


@query("""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS used_day, count(*) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS used_month,
  CASE WHEN count(*) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) > 3 THEN 'day' WHEN count(*) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) > 40 THEN 'month' END AS violated FROM events
""")
def calendar_quotas(t: Tables) -> DataFrame:
    used = lambda unit: F.count(F.lit(1)).over(Window.partitionBy("user_id", F.date_trunc(unit, "ts")).orderBy("ts", "event_id"))
    rows = t.events.select("event_id", "user_id", used("day").alias("used_day"), used("month").alias("used_month"))
    return rows.withColumn("violated", F.when(F.col("used_day") > 3, "day").when(F.col("used_month") > 40, "month"))


@query("""
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT user_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
k AS (SELECT user_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM r)
SELECT k.user_id, CAST(CAST(k.day AS DATE) AS VARCHAR) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k LEFT JOIN d ON k.user_id = d.user_id AND k.day = d.day
""")
def daily_keys_zero_filled(t: Tables) -> DataFrame:
    days = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    keys = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", T.day_keys(F.col("a"), F.col("b")).alias("d"))
    return keys.join(days, ["user_id", "d"], "left").select("user_id", F.col("d").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda a, x: 0.9 * a + 0.1 * x), 4) AS average FROM o
""")
def moving_average_by_user(t: Tables) -> DataFrame:
    """Seeded with the first value: the k-th latest one weighs 0.1 * 0.9**(k - 1), the first one 0.9**(n - 1); summed by rank, no list is held."""
    by = Window.partitionBy("user_id")
    ranked = t.events.select("user_id", "value", F.row_number().over(by.orderBy(F.desc("ts"), F.desc("event_id"))).alias("k"), F.row_number().over(by.orderBy("ts", "event_id")).alias("first"))
    weight = F.pow(F.lit(0.9), F.col("k") - 1) * F.when(F.col("first") == 1, 1.0).otherwise(0.1)
    return ranked.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 4).alias("average"))


@query("""
SELECT event_id, user_id, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER w, 0) AS BIGINT) AS cents, count(*) OVER w AS n, count(*) FILTER (WHERE event_type = 'error') OVER w AS errors,
  coalesce(abs(value - avg(value) OVER w) > 2 * stddev_pop(value) OVER w, false) AS outlier
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)
""")
def behaviour_profile_anomaly(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-100, -1)
    mean, sigma = F.avg("value").over(w), F.stddev_pop("value").over(w)
    return t.events.select(
        "event_id", "user_id", F.coalesce(F.sum(F.round(F.col("value") * 100).cast("long")).over(w), F.lit(0)).alias("cents"), F.count(F.lit(1)).over(w).alias("n"),
        F.count(F.when(F.col("event_type") == "error", 1)).over(w).alias("errors"), F.coalesce(F.abs(F.col("value") - mean) > 2 * sigma, F.lit(False)).alias("outlier"),
    )


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS carried, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS change
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def progress_carry_forward(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = F.when(F.col("event_type") == "view", F.col("value"))
    return t.events.select("event_id", "user_id", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("carried"), F.round(F.col("value") - F.lag("value").over(w), 4).alias("change"))


@query("""
WITH l AS (SELECT user_id, event_id AS locked_by, ts FROM events WHERE event_type = 'error')
SELECT e.event_id, e.user_id, coalesce(l.locked_by, -1) AS locked_by FROM events e ASOF LEFT JOIN (SELECT user_id, max(locked_by) AS locked_by, ts FROM l GROUP BY user_id, ts) l ON e.user_id = l.user_id AND e.ts >= l.ts WHERE e.event_type = 'view'
""")
def lockout_status_asof(t: Tables) -> DataFrame:
    """The latest lock at or before each view: locks and views in one sorted pass instead of a range join."""
    rows = t.events.where(F.col("event_type").isin("error", "view")).select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    lock = F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).over(w)
    return rows.withColumn("lock", lock).where("event_type = 'view'").select("event_id", "user_id", F.coalesce("lock.event_id", F.lit(-1)).alias("locked_by"))


@query("""
SELECT user_id, event_type, round(max_by(value, ts) - min_by(value, ts), 4) AS improvement, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT ts) = count(*)
""")
def improvement_first_to_last(t: Tables) -> DataFrame:
    out = t.events.groupBy("user_id", "event_type").agg(F.round(F.max_by("value", "ts") - F.min_by("value", "ts"), 4).alias("improvement"), F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("d"))
    return out.where("n >= 2 and d = n").drop("d")


@query("""
SELECT event_id, least(300.0, 5 * power(2, CAST(json_extract(props, '$.k') AS BIGINT) % 10)) AS delay, least(300.0, 30 * power(2, CAST(json_extract(props, '$.k') AS BIGINT) % 10)) AS export_delay FROM events
""")
def retry_delays(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return t.events.select("event_id", T.retry_delay(k, 5).alias("delay"), T.retry_delay(k, 30).alias("export_delay"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS engines_hit, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'clean' WHEN count(*) FILTER (WHERE event_type = 'error') = count(*) THEN 'infected' ELSE 'suspicious' END AS verdict,
 round(CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 1.0 ELSE count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*) END, 4) AS confidence FROM events GROUP BY user_id
""")
def verdict_vote(t: Tables) -> DataFrame:
    hit, n = F.count_if(F.col("event_type") == "error"), F.count(F.lit(1))
    return t.events.groupBy("user_id").agg(hit.alias("engines_hit"), F.when(hit == 0, "clean").when(hit == n, "infected").otherwise("suspicious").alias("verdict"), F.round(F.when(hit == 0, 1.0).otherwise(hit / n), 4).alias("confidence"))


@query("""
WITH w AS (SELECT *, CASE event_type WHEN 'error' THEN 0.9 WHEN 'signup' THEN 0.7 WHEN 'purchase' THEN 0.5 ELSE 0.3 END AS weight FROM events)
SELECT user_id, round(sum(value * weight) / sum(weight), 4) AS score, CASE WHEN sum(value * weight) / sum(weight) >= 60 THEN 'high' WHEN sum(value * weight) / sum(weight) >= 40 THEN 'medium' ELSE 'low' END AS severity FROM w GROUP BY user_id
""")
def weighted_threat_score(t: Tables) -> DataFrame:
    weights = t.spark.createDataFrame([("error", 0.9), ("signup", 0.7), ("purchase", 0.5), ("view", 0.3), ("click", 0.3)], "event_type string, weight double")
    score = F.sum(F.col("value") * F.col("weight")) / F.sum("weight")
    return t.events.join(F.broadcast(weights), "event_type").groupBy("user_id").agg(F.round(score, 4).alias("score"), F.when(score >= 60, "high").when(score >= 40, "medium").otherwise("low").alias("severity"))


_BY_TURN = "e AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_RECENT = "list_filter(r.acc, lambda x: x > e.tm - 86400)"
_LEVEL = "least(3.0, r.level + (e.tm - r.tm) * 3 / 86400)"
TOKEN_BUCKET_SQL = f"""
WITH RECURSIVE {_BY_TURN}, r AS (SELECT user_id, k, event_id, true AS allowed, CAST(2 AS DOUBLE) AS level, tm FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.event_id, {_LEVEL} >= 1, CASE WHEN {_LEVEL} >= 1 THEN {_LEVEL} - 1 ELSE {_LEVEL} END, e.tm FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, user_id, allowed FROM r
"""


@query(f"""
WITH RECURSIVE {_BY_TURN}, r AS (SELECT user_id, k, event_id, true AS allowed, [tm] AS acc FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.event_id, len({_RECENT}) < 3, CASE WHEN len({_RECENT}) < 3 THEN list_append({_RECENT}, e.tm) ELSE {_RECENT} END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, user_id, allowed FROM r
""")
def sliding_window_rate_limit(t: Tables) -> DataFrame:
    return T.sliding_window(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["ts", "event_id"], 3, 86400).drop("ts")


@query(TOKEN_BUCKET_SQL)
def token_bucket_rate_limit(t: Tables) -> DataFrame:
    return T.token_bucket(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["ts", "event_id"], 3, 86400).drop("ts")


@query(f"""
WITH RECURSIVE {_BY_TURN}, r AS (SELECT user_id, k, event_id, true AS allowed, tm AS last FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.event_id, e.tm - r.last >= 43200, CASE WHEN e.tm - r.last >= 43200 THEN e.tm ELSE r.last END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, user_id, allowed FROM r
""")
def progress_update_gate(t: Tables) -> DataFrame:
    return T.rate_gate(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["ts", "event_id"], 1 / 43200).drop("ts")
