"""Lookups, keyed filters and plain writes of the repositories, as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import relational as R
from lectern.plans.registry import Tables, query


@query("SELECT o_orderkey, o_custkey, o_orderstatus, count(*) OVER () AS matches FROM orders WHERE o_orderkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    """Get by id: no row or one; the filter reaches the scan."""
    found = R.matching(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), o_orderkey=7)
    return R.with_total(found, found).withColumnRenamed("total", "matches")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(trim(c_name)) = lower(trim(' CUSTOMER#000000042 '))")
def casefolded_lookup(t: Tables) -> DataFrame:
    """A user by e-mail or name, whatever the case and the blanks around it."""
    return t.customer.where(F.lower(F.trim("c_name")) == F.lower(F.trim(F.lit(" CUSTOMER#000000042 ")))).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = (SELECT min(p_name) FROM part WHERE p_size = 10)")
def unique_token_lookup(t: Tables) -> DataFrame:
    """A row by a unique, nullable token (share token, verification token, template name)."""
    token = t.part.where("p_size = 10").agg(F.min("p_name").alias("token"))
    return t.part.join(F.broadcast(token), F.col("p_name") == F.col("token")).select("p_partkey", "p_name", "p_brand")


@query("SELECT conv_id, turn, role, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role <> 'system'")
def visible_children_in_order(t: Tables) -> DataFrame:
    """The children of every parent without the hidden ones, in their order."""
    rows = t.conversations.where("role <> 'system'")
    return rows.select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n_chars"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations WHERE conv_id IN (1, 2, 3) AND turn = 1 AND role IN ('user', 'assistant')")
def composite_key_lookup(t: Tables) -> DataFrame:
    return R.matching(t.conversations, conv_id=[1, 2, 3], turn=1, role=["user", "assistant"]).select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n_chars"))


@query("""
SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND event_type IN ('error', 'signup', 'purchase')
ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5
""")
def audit_query_page(t: Tables) -> DataFrame:
    """Audit events of the last day by type, newest first; the offset counts matches, not raw lines."""
    last = t.events.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    found = R.matching(t.events, event_type=["error", "signup", "purchase"]).join(F.broadcast(last), F.col("ts") >= F.col("since"))
    return R.page(found.select("event_id", "user_id", "event_type", "ts"), [F.desc("ts"), F.desc("event_id")], 5, 20).select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""
SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'view') WHERE n <= 3
""")
def latest_access_by_user(t: Tables) -> DataFrame:
    """The newest entries of each user: access logs, jobs and files are read like this."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.where("event_type = 'view'").select("user_id", "event_id", F.row_number().over(newest).alias("n")).where("n <= 3")


@query("""
SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#13') AND p_size >= 10 AND p_size < 30 AND p_type IS NOT NULL ORDER BY p_size DESC, p_partkey LIMIT 100
""")
def compiled_search_filters(t: Tables) -> DataFrame:
    """Filters by shape: a list is an IN, a range has bounds, {exists} asks for a value, a scalar is an equality; a page has 100 rows at most."""
    wanted = {"p_brand": ["Brand#1", "Brand#2", "Brand#13"], "p_size": {"gte": 10, "lt": 30}, "p_type": {"exists": True}}
    return R.compiled(t.part, wanted, limit=500, order=[F.desc("p_size"), F.col("p_partkey")]).select("p_partkey", "p_brand", "p_size")


@query("""
WITH g AS (SELECT DISTINCT p_brand AS action, p_size % 5 AS resource, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 END AS scope FROM part), r AS (SELECT p_partkey, p_brand AS action, p_size % 5 AS resource, p_partkey % 4 AS scope FROM part)
SELECT p_partkey, EXISTS (SELECT 1 FROM g WHERE g.action = r.action AND g.resource = r.resource AND (g.scope IS NULL OR g.scope = r.scope)) AS allowed FROM r
""")
def permission_matches(t: Tables) -> DataFrame:
    """A permission without a scope matches every scope; action and resource must be equal."""
    grants = t.part.select(F.col("p_brand").alias("action"), (F.col("p_size") % 5).alias("resource"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 4).alias("scope")).distinct()
    asked = t.part.select("p_partkey", F.col("p_brand").alias("action"), (F.col("p_size") % 5).alias("resource"), (F.col("p_partkey") % 4).alias("scope"))
    # one row for each action and resource, with its scopes: a small list, however many requests there are
    held = grants.groupBy("action", "resource").agg(F.collect_set("scope").alias("scopes"), F.bool_or(F.col("scope").isNull()).alias("any_scope"))
    both = asked.join(held, ["action", "resource"], "left")
    return both.select("p_partkey", F.coalesce(F.col("any_scope") | F.array_contains("scopes", F.col("scope")), F.lit(False)).alias("allowed"))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 4 * 86400 * 5 END AS ttl, ts, now FROM events, m)
SELECT event_id, ttl, ttl > 0 AND epoch_us(now) // 1000000 - epoch_us(ts) // 1000000 > ttl AS expired FROM e
""")
def cache_expiry(t: Tables) -> DataFrame:
    """Entries past their time to live; zero or less never expires."""
    from lectern.functions.security import expired

    last = t.events.agg(F.max("ts").alias("now"))
    ttl = (F.col("event_id") % 4 * 86400 * 5).alias("ttl")
    rows = t.events.select("event_id", "ts", ttl).crossJoin(F.broadcast(last))
    return rows.select("event_id", "ttl", expired(F.col("ts").cast("timestamp"), F.col("ttl"), F.col("now").cast("timestamp")).alias("expired"))


@query("""
WITH n AS (SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 99, 'NOWHERE'), u AS (SELECT id, CASE WHEN id = 2 THEN 'RENAMED' ELSE name END AS name FROM n) SELECT id, name FROM u WHERE id <> 3
""")
def insert_update_delete(t: Tables) -> DataFrame:
    """A row is added, one is changed by id, one is deleted: each as a transform of the whole table."""
    rows = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    added = rows.unionByName(rows.sparkSession.createDataFrame([(99, "NOWHERE")], "id int, name string"))
    return added.withColumn("name", F.when(F.col("id") == 2, "RENAMED").otherwise(F.col("name"))).where("id <> 3")


@query("""
SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 <> 0 THEN turn END, row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS slide_number FROM conversations
""")
def bulk_insert_with_ordinals(t: Tables) -> DataFrame:
    """Rows that come without an ordinal get their place in the list."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return t.conversations.select("conv_id", "turn", F.coalesce(F.when(F.col("turn") % 3 != 0, F.col("turn")), place).alias("slide_number"))


@query("SELECT l_partkey AS reference, count(DISTINCT l_linenumber) AS usage_count, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS slides FROM lineitem GROUP BY l_partkey")
def reference_usage(t: Tables) -> DataFrame:
    """How many slides use each reference, and which: a set of at most seven line numbers."""
    used = F.collect_set("l_linenumber")
    return t.lineitem.groupBy(F.col("l_partkey").alias("reference")).agg(F.size(used).cast("long").alias("usage_count"), F.array_join(F.array_sort(used), ",").alias("slides"))


@query("""
WITH e AS (SELECT user_id % 7 AS job, event_id, ts, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status, value FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
SELECT job, arg_max(status, (ts, event_id)) AS status, strftime(min(ts) FILTER (WHERE status = 'processing'), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) FILTER (WHERE status = 'completed'), '%Y-%m-%d %H:%M:%S') AS completed,
  count(*) FILTER (WHERE status = 'failed') AS failures, CASE WHEN arg_max(status, (ts, event_id)) = 'failed' THEN 'error ' || CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) END AS error FROM e GROUP BY job
""")
def job_state_from_transitions(t: Tables) -> DataFrame:
    """Start, completion and failure of jobs as events; the state is the latest of them, with the error of a failed one."""
    status = F.when(F.col("event_type") == "signup", "processing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    rows = t.events.where(F.col("event_type").isin("signup", "purchase", "error")).select((F.col("user_id") % 7).alias("job"), "event_id", "ts", status.alias("s"))
    last = F.max(F.struct("ts", "event_id", "s"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    out = rows.groupBy("job").agg(last.alias("last"), F.min(F.when(F.col("s") == "processing", F.col("ts"))).alias("a"), F.max(F.when(F.col("s") == "completed", F.col("ts"))).alias("b"), F.count_if(F.col("s") == "failed").alias("failures"))
    error = F.when(F.col("last.s") == "failed", F.concat(F.lit("error "), F.col("last.event_id").cast("string")))
    return out.select("job", F.col("last.s").alias("status"), text("a").alias("started"), text("b").alias("completed"), "failures", error.alias("error"))


@query("""
WITH e AS (SELECT user_id, event_type AS step, event_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS progress FROM events), l AS (SELECT user_id, step, arg_max(progress, (ts, event_id)) AS progress, min((ts, event_id)) AS first FROM e GROUP BY 1, 2)
SELECT user_id, string_agg(step || '=' || progress, ';' ORDER BY first) AS steps, count(*) AS n FROM l GROUP BY user_id
""")
def step_progress_upsert(t: Tables) -> DataFrame:
    """Each update changes the step of its name or appends it: the latest progress, in the order of the first updates."""
    rows = t.events.select("user_id", F.col("event_type").alias("step"), "event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("progress"))
    at = F.struct("ts", "event_id")
    steps = rows.groupBy("user_id", "step").agg(F.max_by("progress", at).alias("progress"), F.min(at).alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "step", "progress"))), lambda x: F.concat(x["step"], F.lit("="), x["progress"].cast("string")))
    return steps.groupBy("user_id").agg(F.array_join(listed, ";").alias("steps"), F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT user_id, event_type AS provider, event_id, ts, value FROM events WHERE event_type IN ('click', 'view', 'signup')), u AS (SELECT user_id, max(ts) AS gone FROM events WHERE event_type = 'error' GROUP BY 1),
k AS (SELECT user_id, provider, arg_max(event_id, (ts, event_id)) AS provider_id, CAST(floor(epoch_us(max(ts)) / 1000000) AS BIGINT) + 3600 AS expires FROM l GROUP BY 1, 2)
SELECT user_id, provider, provider_id, expires FROM k WHERE NOT (provider = 'click' AND EXISTS (SELECT 1 FROM u WHERE u.user_id = k.user_id))
""")
def linked_providers(t: Tables) -> DataFrame:
    """Accounts linked by (user, provider): the latest link and token expiry win, and unlinked ones go."""
    links = t.events.where(F.col("event_type").isin("click", "view", "signup")).groupBy("user_id", F.col("event_type").alias("provider"))
    kept = links.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("provider_id"), (F.unix_timestamp(F.max("ts").cast("timestamp")) + 3600).alias("expires"))
    gone = t.events.where("event_type = 'error'").select("user_id", F.lit("click").alias("provider")).distinct()
    return kept.join(gone, ["user_id", "provider"], "left_anti").select("user_id", "provider", "provider_id", "expires")


@query("""
WITH i AS (SELECT n_name AS name, n_regionkey AS template_region FROM nation), u AS (SELECT c.c_custkey, n.n_name AS institution, c.c_acctbal > 5000 AS premium FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
t AS (SELECT p_partkey, p_size % 25 AS region_no, p_brand FROM part WHERE p_size < 4)
SELECT u.c_custkey, count(t.p_partkey) AS templates FROM u JOIN i ON u.institution = i.name LEFT JOIN t ON t.region_no = i.template_region OR (t.p_brand = 'Brand#1' AND u.premium) GROUP BY 1
""")
def templates_of_users(t: Tables) -> DataFrame:
    """Institution by name, then the templates of that institution or the premium ones: equal keys are counted before the join."""
    users = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("institution"), (F.col("c_acctbal") > 5000).alias("premium"))
    regions = t.nation.select(F.col("n_name").alias("institution"), F.col("n_regionkey").alias("region_no"))
    own = (F.col("p_size") % 25).alias("region_no")
    per_region = t.part.where("p_size < 4").groupBy(own).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_brand") == "Brand#1").alias("both"))
    premium = t.part.where("p_size < 4 and p_brand = 'Brand#1'").agg(F.count(F.lit(1)).alias("all_premium"))
    both = users.join(F.broadcast(regions), "institution").join(F.broadcast(per_region), "region_no", "left").crossJoin(F.broadcast(premium)).na.fill(0, ["n", "both"])
    return both.select("c_custkey", (F.col("n") + F.when(F.col("premium"), F.col("all_premium") - F.col("both")).otherwise(0)).alias("templates"))


@query("""
SELECT conv_id, '{"id":' || conv_id || ',"slides":[' || string_agg('{"n":' || turn || ',"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) || ']}' AS document FROM conversations GROUP BY conv_id
""")
def export_json_documents(t: Tables) -> DataFrame:
    """A deck as one JSON document, its slides in order, without notes and animations."""
    slide = F.struct(F.col("turn").alias("n"), "role", F.char_length("text").alias("chars"), F.lit("fade").alias("animations"), F.lit("note").alias("notes")).dropFields("animations", "notes")
    deck = t.conversations.select("conv_id", slide.alias("s")).groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("slides"))
    return deck.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), "slides")).alias("document"))


@query("""
WITH f AS (SELECT * FROM (VALUES ('json', 1.0), ('csv', 0.5), ('html', 2.0)) v(format, factor)) SELECT o_orderstatus AS status, format, count(*) AS documents, CAST(sum(floor(o_totalprice * factor)) AS BIGINT) AS bytes FROM orders, f GROUP BY 1, 2
""")
def export_formats_fan_out(t: Tables) -> DataFrame:
    """One table, several formats: each row goes to each of a short fixed list, exploded in place."""
    formats = F.array(*(F.struct(F.lit(n).alias("format"), F.lit(x).alias("factor")) for n, x in (("json", 1.0), ("csv", 0.5), ("html", 2.0))))
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), "o_totalprice", F.explode(formats).alias("f"))
    return rows.groupBy("status", F.col("f.format").alias("format")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.floor(F.col("o_totalprice") * F.col("f.factor"))).cast("long").alias("bytes"))


@query("""
WITH s AS (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1) SELECT event_type, printf('%.2f', n / 7.0) AS score, '"' || event_type || '",' || printf('%.2f', n / 7.0) AS csv, first FROM s
""")
def export_metrics_text(t: Tables) -> DataFrame:
    """Metrics as CSV lines with two decimals."""
    rows = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    score = F.format_string("%.2f", F.col("n") / 7.0)
    return rows.select("event_type", score.alias("score"), F.concat(F.lit('"'), "event_type", F.lit('",'), score).alias("csv"), "first")


@query("""
WITH k AS (SELECT 'd:' || CAST(CAST(ts AS DATE) AS VARCHAR) AS key, event_id FROM events UNION ALL SELECT 't:' || event_type, event_id FROM events UNION ALL SELECT 'u:' || (user_id % 5), event_id FROM events),
d AS (SELECT event_id FROM k WHERE key IN ('d:2024-01-10', 'd:2024-01-11', 'd:2024-01-12')), a AS (SELECT event_id FROM k WHERE key = 't:error'), b AS (SELECT event_id FROM k WHERE key = 'u:2')
SELECT event_id FROM d INTERSECT SELECT event_id FROM a INTERSECT SELECT event_id FROM b ORDER BY event_id DESC LIMIT 50
""")
def index_set_intersection(t: Tables) -> DataFrame:
    """Logs by index sets: the days of a range are united first, then all sets are intersected, newest first."""
    ids = lambda c: t.events.where(c).select("event_id")
    days = ids(F.to_date("ts").between("2024-01-10", "2024-01-12"))
    return days.intersect(ids(F.col("event_type") == "error")).intersect(ids(F.col("user_id") % 5 == 2)).orderBy(F.desc("event_id")).limit(50)


@query("""
WITH t AS (SELECT p_partkey, [p_brand, p_type, 'size-' || (p_size % 10)] AS tags FROM part) SELECT p_partkey, list_has_any(tags, ['Brand#1', 'size-3']) AS invalid FROM t
""")
def invalidated_by_tags(t: Tables) -> DataFrame:
    """Cache entries that have one of the given tags."""
    tags = F.array("p_brand", "p_type", F.concat(F.lit("size-"), (F.col("p_size") % 10).cast("string")))
    return t.part.select("p_partkey", F.arrays_overlap(tags, F.array(F.lit("Brand#1"), F.lit("size-3"))).alias("invalid"))
