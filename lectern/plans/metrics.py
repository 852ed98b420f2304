"""Metrics, reports and state over events, orders and labels: one pass each, counts combined before they move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.registry import Tables, query




def _text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _with_last(df: DataFrame, ts: str = "ts", name: str = "now") -> DataFrame:
    """Adds the newest time of the table: one broadcast row, in place of a clock."""
    return df.crossJoin(F.broadcast(df.agg(F.max(ts).alias(name))))


@query("SELECT event_type AS prompt, count(*) AS n, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*), 6) AS mean_feedback FROM events GROUP BY 1")
def prompt_feedback_means(t: Tables) -> DataFrame:
    """The mean that an incremental update of each prompt arrives at."""
    cents = F.round(F.col("value") * 100).cast("long")
    return t.events.groupBy(F.col("event_type").alias("prompt")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(cents) / F.count(F.lit(1)), 6).alias("mean_feedback"))


@query("""
WITH i AS (SELECT d.lang AS dimension, CASE WHEN d.n_chars < 500 THEN 'too short' WHEN d.n_chars > 5000 THEN 'too long' ELSE 'unclear' END AS description, CASE WHEN l.toxic = 1 THEN 'critical' ELSE 'minor' END AS severity, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0)
SELECT dimension, description, count(*) AS n, arg_min(severity, doc_id) AS severity FROM i GROUP BY 1, 2 ORDER BY n DESC, dimension, description LIMIT 10
""")
def common_issues(t: Tables) -> DataFrame:
    """The ten most frequent issues, with the severity of the first one seen."""
    text = F.when(F.col("n_chars") < 500, "too short").when(F.col("n_chars") > 5000, "too long").otherwise("unclear")
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.where("quality = 0").select("doc_id", "toxic"), "doc_id")
    rows = rows.select(F.col("lang").alias("dimension"), text.alias("description"), F.when(F.col("toxic") == 1, "critical").otherwise("minor").alias("severity"), "doc_id")
    return rows.groupBy("dimension", "description").agg(F.count(F.lit(1)).alias("n"), F.min_by("severity", "doc_id").alias("severity")).orderBy(F.desc("n"), "dimension", "description").limit(10)


@query("""
WITH s AS (SELECT d.doc_id, unnest(list_concat(CASE WHEN n_chars BETWEEN 500 AND 3000 THEN ['length'] ELSE [] END, CASE WHEN contains(text, chr(10)) THEN ['paragraphs'] ELSE [] END, CASE WHEN regexp_matches(text, '[0-9]') THEN ['figures'] ELSE [] END, CASE WHEN NOT contains(text, '!') THEN ['calm'] ELSE [] END)) AS strength FROM documents d JOIN labels USING (doc_id) WHERE quality = 1)
SELECT strength, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, strength LIMIT 5
""")
def best_practices(t: Tables) -> DataFrame:
    """Strengths of the good documents, the most frequent ones first."""
    text = F.col("text")
    strengths = F.array_compact(F.array(F.when(F.col("n_chars").between(500, 3000), "length"), F.when(text.contains("\n"), "paragraphs"), F.when(text.rlike("[0-9]"), "figures"), F.when(~text.contains("!"), "calm")))
    good = t.documents.select("doc_id", strengths.alias("s")).join(t.labels.where("quality = 1").select("doc_id"), "doc_id")
    return good.select(F.explode("s").alias("strength")).groupBy("strength").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "strength").limit(5)


@query("""
WITH c AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS v, ts, event_id FROM events), u AS (SELECT user_id, count(*) AS n, arg_max(v, (ts, event_id)) - arg_min(v, (ts, event_id)) AS gain FROM c GROUP BY user_id HAVING count(*) >= 2)
SELECT count(*) AS users, round(CAST(sum(gain) AS DOUBLE) / count(*) / 100, 6) AS rate, count(*) FILTER (WHERE gain > 0) AS improved FROM u
""")
def improvement_rate(t: Tables) -> DataFrame:
    """Last less first score of each key with two or more, then the mean over the keys."""
    at, cents = F.struct("ts", "event_id"), F.round(F.col("value") * 100).cast("long")
    gains = t.events.select("user_id", at.alias("at"), cents.alias("v")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max_by("v", "at") - F.min_by("v", "at")).alias("gain")).where("n >= 2")
    return gains.agg(F.count(F.lit(1)).alias("users"), F.round(F.sum("gain") / F.count(F.lit(1)) / 100, 6).alias("rate"), F.count_if(F.col("gain") > 0).alias("improved"))


@query("""
WITH m AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderstatus AS status, count(*) AS files, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS size, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(now) AS DATE)) AS oldest_days,
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS temporary, count(*) FILTER (WHERE o_orderdate >= now - INTERVAL 30 DAY) AS recent FROM orders, m GROUP BY 1
""")
def lifecycle_metrics(t: Tables) -> DataFrame:
    """Files by status: number, size, age of the oldest, temporary and recent ones."""
    rows = _with_last(t.orders.select("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "o_orderdate")
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.round("o_totalprice").cast("long")).alias("size"), F.datediff(F.max("now"), F.min("o_orderdate")).cast("long").alias("oldest_days"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("temporary"), F.count_if(F.col("o_orderdate") >= F.col("now") - F.expr("INTERVAL 30 DAYS")).alias("recent"),
    )


@query("""
SELECT count(*) AS backups, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 1.0 / greatest(count(*), 1), 6) AS success_rate,
  CAST(sum(CAST(round(o_totalprice) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS size, round(CAST(sum(CAST(round(o_totalprice) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / greatest(count(*) FILTER (WHERE o_orderstatus = 'F'), 1), 4) AS mean_size,
  strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last, o_orderpriority AS strategy FROM orders GROUP BY o_orderpriority
""")
def backup_metrics(t: Tables) -> DataFrame:
    done, size = F.col("o_orderstatus") == "F", F.round("o_totalprice").cast("long")
    held = F.sum(F.when(done, size))
    return t.orders.groupBy(F.col("o_orderpriority").alias("strategy")).agg(
        F.count(F.lit(1)).alias("backups"), F.count_if(done).alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.round(F.count_if(done) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("success_rate"),
        held.alias("size"), F.round(held / F.greatest(F.count_if(done), F.lit(1)), 4).alias("mean_size"), _text(F.min("o_orderdate")).alias("first"), _text(F.max("o_orderdate")).alias("last"),
    )


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts DESC, event_id DESC) AS k FROM events), a AS (SELECT user_id % 4 AS store, count(*) AS operations, count(*) FILTER (WHERE k <= 100 AND event_type = 'error') AS errors, count(*) FILTER (WHERE k <= 1000 AND event_type = 'view') AS hits,
  least(count(*), 1000) AS looked, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE k <= 100) AS BIGINT) AS cents FROM r GROUP BY 1)
SELECT store, operations, errors, round(hits * 1.0 / looked, 6) AS hit_rate, round(cents / 10000.0, 6) AS latency, CASE WHEN errors > 30 THEN 'critical' WHEN hits * 1.0 / looked < 0.195 OR cents > 550000 THEN 'degraded' ELSE 'healthy' END AS health FROM a
""")
def storage_health(t: Tables) -> DataFrame:
    """Errors and latency of the last hundred operations of each store, hit rate of the last thousand, and a verdict."""
    k = F.row_number().over(Window.partitionBy("store").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = t.events.select((F.col("user_id") % 4).alias("store"), "ts", "event_id", "event_type", "value").withColumn("k", k)
    cents = F.sum(F.when(F.col("k") <= 100, F.round(F.col("value") * 100).cast("long")))
    a = rows.groupBy("store").agg(F.count(F.lit(1)).alias("operations"), F.count_if((F.col("k") <= 100) & (F.col("event_type") == "error")).alias("errors"), F.count_if((F.col("k") <= 1000) & (F.col("event_type") == "view")).alias("hits"), F.least(F.count(F.lit(1)), F.lit(1000)).alias("looked"), cents.alias("cents"))
    rate = F.col("hits") / F.col("looked")
    health = F.when(F.col("errors") > 30, "critical").when((rate < 0.195) | (F.col("cents") > 550000), "degraded").otherwise("healthy")
    return a.select("store", "operations", "errors", F.round(rate, 6).alias("hit_rate"), F.round(F.col("cents") / 10000, 6).alias("latency"), health.alias("health"))


@query("""
SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' ELSE 'reason' END AS kind, coalesce(o_orderstatus, o_orderpriority) AS name, count(*) AS files, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS size, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))
""")
def quarantine_stats(t: Tables) -> DataFrame:
    """Counts by status and by reason, with size and time range, in one pass."""
    o = t.orders
    sets = o.groupingSets([[o.o_orderstatus], [o.o_orderpriority]], o.o_orderstatus, o.o_orderpriority)
    rows = sets.agg(F.grouping("o_orderstatus").alias("g"), F.count(F.lit(1)).alias("files"), F.sum(F.round("o_totalprice").cast("long")).alias("size"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return rows.select(F.when(F.col("g") == 0, "status").otherwise("reason").alias("kind"), F.coalesce("o_orderstatus", "o_orderpriority").alias("name"), "files", "size", F.date_format("a", "yyyy-MM-dd").alias("first"), F.date_format("b", "yyyy-MM-dd").alias("last"))


@query("""
WITH e AS (SELECT substr(md5(event_type || '|' || (user_id % 6)), 1, 8) AS query, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR * 7)
SELECT query, count(*) AS n, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 6) AS latency FROM e GROUP BY 1 ORDER BY n DESC, query LIMIT 10
""")
def search_metrics(t: Tables) -> DataFrame:
    """The most frequent queries of the last week by the hash of their text, with their mean latency."""
    recent = _with_last(t.events.select("event_type", "user_id", "value", "ts")).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 168 HOURS"))
    key = F.substring(F.md5(F.concat_ws("|", "event_type", (F.col("user_id") % 6).cast("string"))), 1, 8)
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return recent.groupBy(key.alias("query")).agg(F.count(F.lit(1)).alias("n"), F.round(cents / F.count(F.lit(1)) / 100, 6).alias("latency")).orderBy(F.desc("n"), "query").limit(10)


_SOURCES = [("signature", 0.8), ("heuristic", 0.6), ("machine_learning", 0.8), ("behavioral", 0.5), ("threat_intelligence", 0.9)]
_TYPES = [("ransomware", 1.3), ("trojan", 1.1), ("malware", 1.0), ("adware", 0.7), ("unknown", 0.5)]


@query("""
WITH i AS (SELECT l_orderkey AS file, CASE l_linenumber % 5 WHEN 0 THEN 8 WHEN 1 THEN 6 WHEN 2 THEN 8 WHEN 3 THEN 5 ELSE 9 END AS weight, CAST(l_quantity AS BIGINT) AS confidence FROM lineitem WHERE l_returnflag = 'R'),
s AS (SELECT file, least(1.0, CAST(sum(weight * confidence) AS DOUBLE) / (50 * sum(weight))) AS confidence FROM i GROUP BY file), r AS (SELECT file, confidence, least(1.0, confidence * CASE file % 5 WHEN 0 THEN 1.3 WHEN 1 THEN 1.1 WHEN 2 THEN 1.0 WHEN 3 THEN 0.7 ELSE 0.5 END) AS risk FROM s)
SELECT file, round(confidence, 9) AS confidence, round(risk, 9) AS risk, CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS severity FROM r
""")
def threat_risk_scores(t: Tables) -> DataFrame:
    """Confidences of indicators weighted by their source, times a factor of the threat's type; severity by the risk."""
    source = F.col("l_linenumber") % len(_SOURCES)
    weight = F.element_at(F.array(*(F.lit(round(10 * w)) for _, w in _SOURCES)), source.cast("int") + 1)
    factor = F.element_at(F.array(*(F.lit(w) for _, w in _TYPES)), (F.col("file") % len(_TYPES)).cast("int") + 1)
    rows = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), weight.alias("w"), F.col("l_quantity").cast("long").alias("c"))
    scored = rows.groupBy("file").agg(F.least(F.lit(1.0), F.sum(F.col("w") * F.col("c")) / (50 * F.sum("w"))).alias("confidence")).withColumn("risk", F.least(F.lit(1.0), F.col("confidence") * factor))
    severity = F.when(F.col("risk") >= 0.8, "critical").when(F.col("risk") >= 0.6, "high").when(F.col("risk") >= 0.3, "medium").otherwise("low")
    return scored.select("file", F.round("confidence", 9).alias("confidence"), F.round("risk", 9).alias("risk"), severity.alias("severity"))


@query("""
WITH v AS (SELECT l_orderkey AS file, count(*) AS engines, count(*) FILTER (WHERE l_returnflag = 'R') AS hits, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN lower('Threat-' || (l_partkey % 9)) END) AS threats FROM lineitem GROUP BY 1)
SELECT file, engines, hits, threats, CASE WHEN hits = 0 THEN 'clean' WHEN hits = engines THEN 'infected' ELSE 'suspicious' END AS status,
  round(CASE WHEN hits = 0 THEN 1.0 WHEN hits = engines THEN least(0.9, hits * 1.0 / engines) ELSE hits * 0.5 / engines END, 6) AS confidence FROM v
""")
def scan_verdicts(t: Tables) -> DataFrame:
    """Verdicts of several engines for each file, their confidence, and the distinct threats whatever the case of their names."""
    hit = F.col("l_returnflag") == "R"
    name = F.lower(F.concat(F.lit("Threat-"), (F.col("l_partkey") % 9).cast("string")))
    v = t.lineitem.groupBy(F.col("l_orderkey").alias("file")).agg(F.count(F.lit(1)).alias("engines"), F.count_if(hit).alias("hits"), F.count_distinct(F.when(hit, name)).alias("threats"))
    share = F.col("hits") / F.col("engines")
    status = F.when(F.col("hits") == 0, "clean").when(F.col("hits") == F.col("engines"), "infected").otherwise("suspicious")
    confidence = F.when(F.col("hits") == 0, 1.0).when(F.col("hits") == F.col("engines"), F.least(F.lit(0.9), share)).otherwise(share * 0.5)
    return v.select("file", "engines", "hits", "threats", status.alias("status"), F.round(confidence, 6).alias("confidence"))


@query("""
WITH i AS (SELECT s_suppkey AS source, sha256('doc-' || (s_suppkey * 3)) AS hash FROM supplier), f AS (SELECT doc_id, sha256('doc-' || doc_id) AS hash FROM documents)
SELECT f.doc_id, count(*) AS matches, min(source) AS first_source, 0.9::DOUBLE AS confidence FROM f JOIN i USING (hash) GROUP BY f.doc_id
""")
def threat_intel_matches(t: Tables) -> DataFrame:
    """Files whose hash a list of known threats has: all matches count, the first source names the threat."""
    known = t.supplier.select(F.col("s_suppkey").alias("source"), F.sha2(F.concat(F.lit("doc-"), (F.col("s_suppkey") * 3).cast("string")), 256).alias("hash"))
    files = t.documents.select("doc_id", F.sha2(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), 256).alias("hash"))
    return files.join(known, "hash").groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.min("source").alias("first_source"), F.lit(0.9).alias("confidence"))


@query("""
WITH j AS (SELECT event_type AS kind, count(*) FILTER (WHERE value >= 10) AS done, count(*) FILTER (WHERE value < 5) AS failed, count(*) FILTER (WHERE value >= 5 AND value < 10) AS remaining, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE value >= 10) AS BIGINT) AS cents FROM events GROUP BY 1)
SELECT kind, done, failed, remaining, round(cents / 100.0 / greatest(done, 1), 4) AS mean_seconds, round(remaining * cents / 100.0 / greatest(done, 1), 2) AS eta FROM j
""")
def generation_metrics(t: Tables) -> DataFrame:
    """Done and failed slides, their mean time, and what is left times that mean."""
    v = F.col("value")
    j = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count_if(v >= 10).alias("done"), F.count_if(v < 5).alias("failed"), F.count_if((v >= 5) & (v < 10)).alias("remaining"), F.sum(F.when(v >= 10, F.round(v * 100).cast("long"))).alias("cents"))
    mean = F.col("cents") / 100 / F.greatest("done", F.lit(1))
    return j.select("kind", "done", "failed", "remaining", F.round(mean, 4).alias("mean_seconds"), F.round(F.col("remaining") * F.col("cents") / 100 / F.greatest("done", F.lit(1)), 2).alias("eta"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type = 'click') AS misses, round(CASE WHEN count(*) FILTER (WHERE event_type IN ('view', 'click')) = 0 THEN 0 ELSE count(*) FILTER (WHERE event_type = 'view') * 1.0 / count(*) FILTER (WHERE event_type IN ('view', 'click')) END, 6) AS rate FROM events GROUP BY user_id")
def cache_hit_rates(t: Tables) -> DataFrame:
    hits, misses = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
    return t.events.groupBy("user_id").agg(hits.alias("hits"), misses.alias("misses"), F.round(F.when(hits + misses == 0, 0.0).otherwise(hits / F.nullif(hits + misses, F.lit(0))), 6).alias("rate"))


@query("""
WITH l AS (SELECT user_id % 2 AS deck, event_type AS dimension, arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) AS score FROM events GROUP BY 1, 2)
SELECT a.dimension, a.score AS first_score, b.score AS second_score, b.score - a.score AS difference, CASE WHEN a.score > b.score THEN 'first' WHEN b.score > a.score THEN 'second' ELSE 'tie' END AS better FROM l a JOIN l b USING (dimension) WHERE a.deck = 0 AND b.deck = 1
""")
def compare_latest_reports(t: Tables) -> DataFrame:
    """The latest scores of two decks, dimension by dimension."""
    rows = t.events.select((F.col("user_id") % 2).alias("deck"), F.col("event_type").alias("dimension"), F.struct("ts", "event_id").alias("at"), F.round(F.col("value") * 100).cast("long").alias("v"))
    latest = lambda k: F.max_by(F.when(F.col("deck") == k, F.col("v")), F.when(F.col("deck") == k, F.col("at")))
    both = rows.groupBy("dimension").agg(latest(0).alias("first_score"), latest(1).alias("second_score")).dropna()
    a, b = F.col("first_score"), F.col("second_score")
    return both.select("dimension", a, b, (b - a).alias("difference"), F.when(a > b, "first").when(b > a, "second").otherwise("tie").alias("better"))


@query("""
WITH w AS (SELECT CASE event_type WHEN 'view' THEN 1.5 WHEN 'click' THEN 1.3 WHEN 'error' THEN 0.8 ELSE 1.0 END AS weight, event_type, user_id, CAST(round(value * 100) AS BIGINT) AS v FROM events), d AS (SELECT user_id, event_type, weight, CAST(sum(v) AS DOUBLE) / count(*) / 10000 AS score FROM w GROUP BY 1, 2, 3),
o AS (SELECT user_id, sum(score * weight) / sum(weight) AS overall FROM d GROUP BY 1) SELECT user_id, round(overall, 6) AS overall, CASE WHEN overall >= 0.9 THEN 'excellent' WHEN overall >= 0.8 THEN 'good' WHEN overall >= 0.6 THEN 'satisfactory' WHEN overall >= 0.4 THEN 'needs_improvement' ELSE 'poor' END AS level FROM o
""")
def weighted_quality_overall(t: Tables) -> DataFrame:
    """Scores by dimension, weighted by the dimension: coherence 1.5, citations 1.3, timing 0.8, others 1."""
    weight = F.when(F.col("event_type") == "view", 1.5).when(F.col("event_type") == "click", 1.3).when(F.col("event_type") == "error", 0.8).otherwise(1.0)
    scores = t.events.groupBy("user_id", "event_type").agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count(F.lit(1)) / 10000).alias("score")).withColumn("w", weight)
    out = scores.groupBy("user_id").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("overall"))
    level = F.when(F.col("overall") >= 0.9, "excellent").when(F.col("overall") >= 0.8, "good").when(F.col("overall") >= 0.6, "satisfactory").when(F.col("overall") >= 0.4, "needs_improvement").otherwise("poor")
    return out.select("user_id", F.round("overall", 6).alias("overall"), level.alias("level"))


@query("""
WITH e AS (SELECT event_type AS provider, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY), s AS (SELECT provider, CAST(sum(cents) AS BIGINT) AS spent FROM e GROUP BY 1)
SELECT provider, spent, CASE WHEN spent >= 0.9 * 10500000 THEN 'critical' WHEN spent >= 0.75 * 10500000 THEN 'high' ELSE 'ok' END AS alert FROM s
""")
def budget_alerts_of_the_month(t: Tables) -> DataFrame:
    """Costs of the last thirty days against a budget: 90 % is critical, 75 % high."""
    recent = _with_last(t.events.select("event_type", "ts", "value")).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 30 DAYS"))
    spent = recent.groupBy(F.col("event_type").alias("provider")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("spent"))
    return spent.withColumn("alert", F.when(F.col("spent") >= 0.9 * 10500000, "critical").when(F.col("spent") >= 0.75 * 10500000, "high").otherwise("ok"))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id, event_type AS counter, ts, event_id, CASE WHEN epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 172800 THEN 1 ELSE 0 END AS lapsed FROM events),
g AS (SELECT *, sum(lapsed) OVER (PARTITION BY user_id, counter ORDER BY ts, event_id) AS life FROM c), l AS (SELECT user_id, counter, life, count(*) AS n, max(ts) AS last FROM g GROUP BY 1, 2, 3)
SELECT user_id, counter, n FROM l, m WHERE epoch_us(now) // 1000000 - epoch_us(last) // 1000000 <= 172800
""")
def live_counters(t: Tables) -> DataFrame:
    """Counters with a time to live of two days that each increment renews: what the live ones stand at."""
    w = Window.partitionBy("user_id", "counter").orderBy("ts", "event_id")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = t.events.select("user_id", F.col("event_type").alias("counter"), "ts", "event_id", at.alias("s"))
    lives = rows.withColumn("life", F.sum(F.when(F.col("s") - F.lag("s").over(w) > 172800, 1).otherwise(0)).over(w))
    counts = lives.groupBy("user_id", "counter", "life").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("last"))
    now = rows.agg(F.max("s").alias("now"))
    return counts.crossJoin(F.broadcast(now)).where(F.col("now") - F.col("last") <= 172800).select("user_id", "counter", "n")


@query("""
WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events), d AS (SELECT event_id, event_type AS queue, ts + (event_id % 5) * INTERVAL 1 DAY AS due FROM events) SELECT queue, count(*) FILTER (WHERE due <= now) AS moved, count(*) FILTER (WHERE due > now) AS waiting, min(event_id) FILTER (WHERE due > now) AS first_waiting FROM d, m GROUP BY queue
""")
def due_delayed_tasks(t: Tables) -> DataFrame:
    """Delayed tasks that are due move to their queue."""
    now = t.events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    due = (F.col("ts").cast("timestamp") + F.make_dt_interval(days=(F.col("event_id") % 5).cast("int"))).cast("timestamp_ntz")
    rows = t.events.select(F.col("event_type").alias("queue"), "event_id", due.alias("due")).crossJoin(F.broadcast(now))
    late = F.col("due") <= F.col("now")
    return rows.groupBy("queue").agg(F.count_if(late).alias("moved"), F.count_if(~late).alias("waiting"), F.min(F.when(~late, F.col("event_id"))).alias("first_waiting"))


@query("""
WITH m AS (SELECT epoch_us(max(ts)) // 1000000 AS now FROM events), l AS (SELECT user_id, max(epoch_us(ts) // 1000000) AS ping FROM events GROUP BY 1)
SELECT user_id, now - ping AS idle, CASE WHEN now - ping > 2 * 21600 THEN 'stale' WHEN now - ping > 21600 THEN 'ping' ELSE 'alive' END AS state, now - ping > 300 AS closed FROM l, m
""")
def connection_heartbeats(t: Tables) -> DataFrame:
    """Connections by the time since their last ping: pinged beyond one interval, stale beyond two; sockets close after five minutes."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    last = t.events.groupBy("user_id").agg(F.max(s).alias("ping"))
    idle = F.col("now") - F.col("ping")
    both = last.crossJoin(F.broadcast(last.agg(F.max("ping").alias("now"))))
    return both.select("user_id", idle.alias("idle"), F.when(idle > 2 * 21600, "stale").when(idle > 21600, "ping").otherwise("alive").alias("state"), (idle > 300).alias("closed"))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, event_id, ts + (1 + event_id % 3) * INTERVAL 1 DAY AS ends FROM events WHERE event_type = 'signup'), r AS (SELECT DISTINCT event_id FROM events WHERE event_type = 'signup' AND value > 80)
SELECT user_id, count(*) AS live, max(event_id) AS newest FROM s, m WHERE ends > now AND event_id NOT IN (SELECT event_id FROM r) GROUP BY user_id
""")
def active_sessions(t: Tables) -> DataFrame:
    """Sessions of each user that have neither ended nor been revoked."""
    now = t.events.agg(F.max("ts").alias("now"))
    made = t.events.where("event_type = 'signup'")
    ends = (F.col("ts").cast("timestamp") + F.make_dt_interval(days=(1 + F.col("event_id") % 3).cast("int"))).cast("timestamp_ntz")
    live = made.select("user_id", "event_id", ends.alias("ends")).join(made.where("value > 80").select("event_id").distinct(), "event_id", "left_anti")
    return live.crossJoin(F.broadcast(now)).where("ends > now").groupBy("user_id").agg(F.count(F.lit(1)).alias("live"), F.max("event_id").alias("newest"))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events), s AS (SELECT event_type AS provider, CASE WHEN event_id % 2 = 0 THEN 'login' ELSE 'link' END AS action, ts + INTERVAL 10 DAY < now AS expired FROM events, m)
SELECT provider, action, count(*) AS total, count(*) FILTER (WHERE expired) AS expired FROM s GROUP BY GROUPING SETS ((), (provider), (action), (provider, action))
""")
def state_key_stats(t: Tables) -> DataFrame:
    """Live and expired keys in all, by provider, by action and by both, in one pass."""
    rows = _with_last(t.events.select(F.col("event_type").alias("provider"), F.when(F.col("event_id") % 2 == 0, "login").otherwise("link").alias("action"), "ts"))
    rows = rows.select("provider", "action", (F.col("ts") + F.expr("INTERVAL 10 DAYS") < F.col("now")).alias("gone"))
    return rows.cube("provider", "action").agg(F.count(F.lit(1)).alias("total"), F.count_if("gone").alias("expired"))


@query("""
SELECT 'events' AS source, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'listeners', count(DISTINCT user_id) FROM events
""")
def state_sizes(t: Tables) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    parts = [t.events.agg(n), t.documents.agg(n), t.conversations.agg(n), t.events.agg(F.count_distinct("user_id").alias("n"))]
    named = [p.select(F.lit(k).alias("source"), "n") for p, k in zip(parts, ("events", "documents", "conversations", "listeners"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query("""
WITH s AS (SELECT * FROM (VALUES (1, 'validate'), (2, 'extract'), (3, 'analyse'), (4, 'enrich'), (5, 'index'), (6, 'notify')) v(no, stage)), j AS (SELECT o_orderkey AS job, 1 + o_orderkey % 6 AS reached FROM orders)
SELECT stage, count(*) FILTER (WHERE no < reached) AS done, count(*) FILTER (WHERE no = reached) AS ready, count(*) FILTER (WHERE no > reached) AS blocked FROM j, s GROUP BY stage
""")
def linear_pipeline_progress(t: Tables) -> DataFrame:
    """Six stages in a line: a stage is ready once the one before it is done. The stages are a fixed list, exploded in place."""
    stages = ["validate", "extract", "analyse", "enrich", "index", "notify"]
    rows = t.orders.select((1 + F.col("o_orderkey") % 6).alias("reached"), F.posexplode(F.array(*map(F.lit, stages))).alias("no", "stage")).withColumn("no", F.col("no") + 1)
    by = lambda c: F.count_if(c)
    return rows.groupBy("stage").agg(by(F.col("no") < F.col("reached")).alias("done"), by(F.col("no") == F.col("reached")).alias("ready"), by(F.col("no") > F.col("reached")).alias("blocked"))


@query("""
WITH j AS (SELECT l_orderkey AS job, count(*) AS slides, l_orderkey % 4 AS f, (l_orderkey // 4) % 4 AS q FROM lineitem GROUP BY l_orderkey)
SELECT job, slides, round((CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 5.0 ELSE 3.0 END + slides * CASE f WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 ELSE 0.4 END) * CASE q WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 ELSE 2.0 END, 4)::DOUBLE AS seconds FROM j
""")
def export_time_estimates(t: Tables) -> DataFrame:
    """Base seconds and seconds for each slide by format (pptx, pdf, beamer, google), times a factor of the quality."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), c.cast("int") + 1)
    jobs = t.lineitem.groupBy(F.col("l_orderkey").alias("job")).agg(F.count(F.lit(1)).alias("slides"))
    kind, quality = F.col("job") % 4, F.expr("job div 4") % 4
    return jobs.select("job", "slides", F.round((pick([1.0, 2.0, 5.0, 3.0], kind) + F.col("slides") * pick([0.2, 0.3, 0.5, 0.4], kind)) * pick([0.7, 1.0, 1.5, 2.0], quality), 4).alias("seconds"))


@query("""
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '+00''00''' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^D:[0-9]{8}') THEN substr(raw, 3, 4) || '-' || substr(raw, 7, 2) || '-' || substr(raw, 9, 2) END AS day FROM d
""")
def pdf_dates(t: Tables) -> DataFrame:
    """Dates like D:20240131123000: the day, null where there is none."""
    raw = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+00'00'")))
    return t.orders.select("o_orderkey", F.to_date(F.try_to_timestamp(F.substring(F.nullif(F.regexp_extract(raw, "^D:([0-9]{8})", 1), F.lit("")), 1, 8), F.lit("yyyyMMdd"))).cast("string").alias("day"))


@query("""
WITH a AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'), l AS (SELECT user_id, ts AS locked, ts + INTERVAL 360 MINUTE AS locked_until FROM a WHERE k % 5 = 0)
SELECT e.event_id, EXISTS (SELECT 1 FROM l WHERE l.user_id = e.user_id AND l.locked <= e.ts AND e.ts <= l.locked_until) AS locked FROM events e WHERE e.event_type = 'purchase'
""")
def lockout_status_until(t: Tables) -> DataFrame:
    """Whether an account is locked when it is used: the latest lock before it, up to its end. One sort by user and time."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    locks = t.events.where("event_type = 'error'").select("user_id", "ts", "event_id").withColumn("k", k).where("k % 5 = 0").select("user_id", "ts", F.lit(None).cast("long").alias("event_id"), F.col("ts").alias("lock"))
    uses = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.lit(None).cast("timestamp_ntz").alias("lock"))
    order = Window.partitionBy("user_id").orderBy("ts", F.col("event_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = locks.unionByName(uses).withColumn("latest", F.last("lock", ignorenulls=True).over(order)).where("event_id is not null")
    return both.select("event_id", F.coalesce(F.col("ts") <= F.col("latest") + F.expr("INTERVAL 360 MINUTES"), F.lit(False)).alias("locked"))


@query("""
WITH k AS (SELECT unnest(['user:' || user_id, 'type:' || event_type, 'day:' || CAST(CAST(ts AS DATE) AS VARCHAR), 'severity:' || CASE event_type WHEN 'error' THEN 'warning' ELSE 'info' END, 'ip:' || (user_id % 10)]) AS key, event_id FROM events)
SELECT key, count(*) AS entries, min(event_id) AS first, max(event_id) AS last FROM k GROUP BY key
""")
def audit_secondary_indexes(t: Tables) -> DataFrame:
    """The five indexes that each logged event is entered in, built in one pass."""
    severity = F.when(F.col("event_type") == "error", "warning").otherwise("info")
    keys = F.array(*(F.concat(F.lit(f"{n}:"), c.cast("string")) for n, c in (("user", F.col("user_id")), ("type", F.col("event_type")), ("day", F.to_date("ts")), ("severity", severity), ("ip", F.col("user_id") % 10))))
    return t.events.select("event_id", F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("entries"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
