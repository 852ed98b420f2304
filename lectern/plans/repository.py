"""Repository queries over orders (jobs), parts (templates), customers (users) and conversations (slides)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import relational as R
from lectern.plans.registry import Tables, query


@query("""
SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS total
FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 50 OFFSET 100
""")
def paged_jobs_with_total(t: Tables) -> DataFrame:
    jobs = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    return R.with_total(R.page(jobs, [F.col("o_orderkey")], 100, 50), jobs)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 200 ORDER BY o_orderkey LIMIT 25")
def keyset_page(t: Tables) -> DataFrame:
    return R.after_key(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 200, 25)


@query("""
SELECT p_partkey, p_name, p_brand, p_retailprice FROM part
WHERE (lower(p_name) LIKE '%a%' OR lower(p_type) LIKE '%brass%') AND p_size >= 5 AND p_size < 40 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#12', 'Brand#21')
""")
def template_search_like(t: Tables) -> DataFrame:
    brands = ["Brand#11", "Brand#22", "Brand#33", "Brand#12", "Brand#21"]
    return R.matching(R.search(t.part, "a", ["p_name", "p_type"]), p_size=(5, 40), p_brand=brands).unionByName(R.matching(R.search(t.part, "brass", ["p_type"]), p_size=(5, 40), p_brand=brands)).dropDuplicates(["p_partkey"]).select("p_partkey", "p_name", "p_brand", "p_retailprice").where(F.lower("p_name").contains("a") | F.lower("p_type").contains("brass"))


@query("""
SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_size = 10
ORDER BY p_brand DESC, p_retailprice DESC, p_partkey LIMIT 20
""")
def active_templates_multi_key_sort(t: Tables) -> DataFrame:
    found = R.matching(t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice"), p_size=10, p_brand=None)
    return found.orderBy(F.desc("p_brand"), F.desc("p_retailprice"), "p_partkey").limit(20)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%customer%1%'")
def optional_filters_ilike(t: Tables) -> DataFrame:
    return R.matching(t.customer, c_mktsegment="BUILDING").where(F.col("c_name").ilike("%customer%1%")).select("c_custkey", "c_name", "c_acctbal")


@query("""
SELECT c_custkey,
  coalesce(c_mktsegment = 'BUILDING', false) AS eq, coalesce(c_mktsegment <> 'BUILDING', false) AS ne,
  coalesce(c_nationkey IN (1, 2, 3), false) AS inn, coalesce(c_nationkey NOT IN (1, 2, 3), false) AS nin,
  coalesce(contains(c_name, '7'), false) AS con, coalesce(starts_with(c_name, 'Cust'), false) AS sta, coalesce(ends_with(c_name, '9'), false) AS en,
  coalesce(c_acctbal > 100, false) AS gt, coalesce(c_acctbal < 100, false) AS lt, coalesce(c_acctbal BETWEEN 0 AND 500, false) AS bet,
  coalesce(regexp_matches(c_mktsegment, '^(?:[A-F]+)'), false) AS rx
FROM customer
""")
def policy_conditions(t: Tables) -> DataFrame:
    c = F.col
    return t.customer.select(
        "c_custkey",
        R.condition(c("c_mktsegment"), "equals", "BUILDING").alias("eq"),
        R.condition(c("c_mktsegment"), "not_equals", "BUILDING").alias("ne"),
        R.condition(c("c_nationkey"), "in", [1, 2, 3]).alias("inn"),
        R.condition(c("c_nationkey"), "not_in", [1, 2, 3]).alias("nin"),
        R.condition(c("c_name"), "contains", "7").alias("con"),
        R.condition(c("c_name"), "starts_with", "Cust").alias("sta"),
        R.condition(c("c_name"), "ends_with", "9").alias("en"),
        R.condition(c("c_acctbal"), "greater_than", 100).alias("gt"),
        R.condition(c("c_acctbal"), "less_than", 100).alias("lt"),
        R.condition(c("c_acctbal"), "between", (0, 500)).alias("bet"),
        R.condition(c("c_mktsegment"), "regex", "[A-F]+").alias("rx"),
    )


@query("""
SELECT p_type, count(*) FILTER (WHERE starts_with(p_type, 'S')) AS prefix_hits, count(*) FILTER (WHERE ends_with(p_type, 'L')) AS suffix_hits, count(*) AS any_hits
FROM part GROUP BY p_type
""")
def wildcard_policies(t: Tables) -> DataFrame:
    v = F.col("p_type")
    return t.part.groupBy("p_type").agg(F.count_if(R.wildcard(v, "S*")).alias("prefix_hits"), F.count_if(R.wildcard(v, "*L")).alias("suffix_hits"), F.count_if(R.wildcard(v, "*")).alias("any_hits"))


@query("""
WITH x AS (SELECT *, (SELECT max(o_orderdate) FROM orders) AS as_of FROM orders),
d AS (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), CAST(as_of AS DATE)) AS age,
  CASE o_orderpriority WHEN '1-URGENT' THEN 365 WHEN '2-HIGH' THEN 730 ELSE 1095 END AS retention FROM x)
SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' AND age > 180 THEN 1 ELSE 0 END) AS BIGINT) AS to_archive,
  CAST(sum(CASE WHEN o_orderstatus = 'F' AND age > retention THEN 1 ELSE 0 END) AS BIGINT) AS to_soft_delete,
  CAST(sum(CASE WHEN o_orderstatus = 'O' AND age > retention + 30 THEN 1 ELSE 0 END) AS BIGINT) AS to_purge, round(sum(CASE WHEN o_orderstatus = 'F' AND age > retention THEN o_totalprice ELSE 0 END), 2) AS freed
FROM d GROUP BY o_orderpriority
""")
def retention_cleanup(t: Tables) -> DataFrame:
    spark = t.spark
    policy = spark.createDataFrame([("1-URGENT", 365), ("2-HIGH", 730)], "o_orderpriority string, days int")
    as_of = t.orders.agg(F.max("o_orderdate").alias("as_of"))
    d = t.orders.join(F.broadcast(policy), "o_orderpriority", "left").withColumn("days", F.coalesce("days", F.lit(1095))).crossJoin(F.broadcast(as_of))
    age, active, deleted = F.date_diff("as_of", "o_orderdate"), F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    due = active & (age > F.col("days"))
    return d.groupBy("o_orderpriority").agg(
        F.count_if(active & (age > 180)).alias("to_archive"),
        F.count_if(due).alias("to_soft_delete"),
        F.count_if(deleted & (age > F.col("days") + 30)).alias("to_purge"),
        F.round(F.sum(F.when(due, F.col("o_totalprice")).otherwise(0.0)), 2).alias("freed"),
    )


@query("""
SELECT p.p_brand, count(*) AS joined_rows, count(DISTINCT l.l_orderkey) AS distinct_orders
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY p.p_brand
""")
def tag_join_distinct_total(t: Tables) -> DataFrame:
    tags = t.part.where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = t.lineitem.select("l_orderkey", "l_partkey").join(tags, "l_partkey")
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("joined_rows"), F.count_distinct("l_orderkey").alias("distinct_orders"))


@query("""
SELECT o_orderkey, o_custkey FROM orders o WHERE o_custkey = 7 OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = 3)
""")
def owner_or_author_semi_join(t: Tables) -> DataFrame:
    authors = t.lineitem.where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = t.orders.select("o_orderkey", "o_custkey")
    return orders.where("o_custkey = 7").unionByName(orders.where("o_custkey <> 7").join(authors, "o_orderkey", "left_semi"))


@query("""
SELECT o.o_orderkey, c.c_name, n.n_name,
  (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_lines,
  coalesce((SELECT string_agg(CAST(l.l_linenumber AS VARCHAR) || ':' || CAST(l.l_partkey AS VARCHAR), ',' ORDER BY l.l_linenumber, l.l_partkey) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey), '') AS lines
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def full_entity_with_children(t: Tables) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(item)).alias("items"))
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    users = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name")
    out = t.orders.select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").join(users, "o_custkey", "left")
    return out.select("o_orderkey", "c_name", "n_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(shown, F.lit("")).alias("lines"))


@query("""
SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
""")
def unused_references_anti(t: Tables) -> DataFrame:
    cited = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.unmatched(t.customer.select("c_custkey", "c_name"), cited, ["c_custkey"])


@query("""
SELECT o_orderpriority, count(*) AS cited, count(p_partkey) AS resolved, count(*) - count(p_partkey) AS unresolved
FROM orders LEFT JOIN part ON o_custkey = p_partkey AND p_size > 25 GROUP BY o_orderpriority
""")
def citation_resolution_report(t: Tables) -> DataFrame:
    known = t.part.where("p_size > 25").select(F.col("p_partkey"))
    both = t.orders.select("o_orderpriority", "o_custkey").join(known, F.col("o_custkey") == F.col("p_partkey"), "left")
    return both.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("cited"), F.count("p_partkey").alias("resolved"), (F.count(F.lit(1)) - F.count("p_partkey")).alias("unresolved"))


@query("""
WITH new AS (SELECT * FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value > 50) WHERE n = 1),
old AS (SELECT * FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1)
SELECT coalesce(new.user_id, old.user_id) AS user_id, coalesce(new.event_type, old.event_type) AS event_type, coalesce(new.value, old.value) AS value
FROM old FULL JOIN new ON old.user_id = new.user_id AND old.event_type = new.event_type
""")
def upsert_latest_wins(t: Tables) -> DataFrame:
    keys = ["user_id", "event_type"]
    rows = t.events.select(*keys, "value", "ts", "event_id")
    old = R.latest(rows, keys, [F.asc("ts"), F.asc("event_id")])
    new = R.latest(rows.where("value > 50"), keys, [F.desc("ts"), F.desc("event_id")])
    return R.upsert(old, new, keys).select(*keys, "value")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER w AS version_number, coalesce(lag(o_orderkey) OVER w, -1) AS parent_id, lead(o_orderkey) OVER w IS NULL AS is_current
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def version_numbering(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return R.versioned(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").drop("o_orderdate").na.fill(-1, ["parent_id"])


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 2
""")
def keep_newest_versions(t: Tables) -> DataFrame:
    return R.newest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).drop("o_orderdate")


@query("""
SELECT conv_id, CASE WHEN turn >= 2 THEN turn + 1 ELSE turn END AS turn, text FROM conversations
UNION ALL SELECT conv_id, CAST(2 AS BIGINT), text || ' (Copy)' FROM conversations WHERE turn = 1
""")
def duplicate_slide(t: Tables) -> DataFrame:
    return R.duplicated(t.conversations.select("conv_id", "turn", "text"), "turn", 1, 2, "text")


@query("SELECT conv_id, CASE WHEN turn >= 2 THEN turn - 1 ELSE turn END AS turn, text FROM conversations WHERE turn <> 1")
def delete_slide_and_close_gap(t: Tables) -> DataFrame:
    return R.removed(t.conversations.select("conv_id", "turn", "text"), "turn", 1)


@query("""
WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) - 1 AS p FROM conversations)
SELECT c.conv_id, coalesce(o.p, c.turn) AS turn, c.role FROM conversations c LEFT JOIN o ON c.conv_id = o.conv_id AND c.turn = o.turn
""")
def reorder_slides(t: Tables) -> DataFrame:
    key = F.concat_ws("/", "conv_id", "turn")
    w = Window.partitionBy("conv_id").orderBy("role", "turn")
    order = t.conversations.select(key.alias("id"), (F.row_number().over(w) - 1).cast("long").alias("position"))
    return R.reordered(t.conversations.select("conv_id", "turn", "role"), key, "turn", order)


@query("""
SELECT c.conv_id, coalesce(n, 0) AS slide_count FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id) s USING (conv_id)
""")
def update_slide_count(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") != "system").alias("slide_count"))


@query("""
SELECT conv_id, count(*) AS slides, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE role = 'user') AS user_slides,
  count(*) FILTER (WHERE role = 'assistant') AS assistant_slides, round(coalesce(sum(length(text)), 0) / 15.0 / 60, 4) AS minutes
FROM conversations GROUP BY conv_id
""")
def slide_statistics(t: Tables) -> DataFrame:
    n = F.sum(F.length("text"))
    return t.conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("slides"), n.alias("chars"), F.count_if(F.col("role") == "user").alias("user_slides"), F.count_if(F.col("role") == "assistant").alias("assistant_slides"), F.round(F.coalesce(n, F.lit(0)) / 15.0 / 60, 4).alias("minutes")
    )


@query("""
SELECT conv_id, string_agg('## ' || CAST(turn AS VARCHAR) || ' ' || role || chr(10) || text, chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id
""")
def export_markdown(t: Tables) -> DataFrame:
    slide = F.struct("turn", "role", "text")
    shown = lambda x: F.concat(F.lit("## "), x["turn"].cast("string"), F.lit(" "), x["role"], F.lit("\n"), x["text"])
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(slide)), shown), "\n").alias("markdown"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def job_status_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT s AS o_orderstatus, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) o ON s = o_orderstatus
""")
def queue_metrics_zero_filled(t: Tables) -> DataFrame:
    return R.zero_filled(job_status_counts(t), "o_orderstatus", ["F", "O", "P", "X"])


@query("""
WITH j AS (SELECT o.o_orderpriority, o.o_orderstatus, date_diff('day', CAST(o.o_orderdate AS DATE), CAST(max(l.l_shipdate) AS DATE)) AS d FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey, o.o_orderpriority, o.o_orderstatus, o.o_orderdate)
SELECT o_orderpriority, count(*) AS jobs, round(avg(d) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean_days, min(d) FILTER (WHERE o_orderstatus = 'F') AS min_days, max(d) FILTER (WHERE o_orderstatus = 'F') AS max_days,
  round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(count(*), 1), 4) AS success_rate FROM j GROUP BY o_orderpriority
""")
def job_duration_stats(t: Tables) -> DataFrame:
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("done"))
    jobs = t.orders.join(shipped, "o_orderkey").withColumn("d", F.date_diff("done", "o_orderdate").cast("long"))
    done = F.when(F.col("o_orderstatus") == "F", F.col("d"))
    return jobs.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("jobs"), F.round(F.avg(done), 4).alias("mean_days"), F.min(done).alias("min_days"), F.max(done).alias("max_days"), F.round(100.0 * F.count(done) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("success_rate")
    )


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 30")
def pending_jobs_topk(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderpriority").limit(30)


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) FILTER (WHERE o_orderstatus = 'P') AS processing, round(avg(o_totalprice), 1) AS mean_progress FROM orders GROUP BY 1
""")
def batch_status_pivot(t: Tables) -> DataFrame:
    named = t.orders.withColumn("state", F.create_map(F.lit("F"), F.lit("completed"), F.lit("O"), F.lit("queued"), F.lit("P"), F.lit("processing"))[F.col("o_orderstatus")])
    counts = named.groupBy("o_orderpriority").pivot("state", ["completed", "queued", "processing"]).count().na.fill(0)
    return counts.join(t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 1).alias("mean_progress")), "o_orderpriority")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS child, c_custkey // 4 AS parent FROM customer WHERE c_custkey // 4 > 0),
c AS (SELECT child, parent, 1 AS depth FROM e UNION ALL SELECT c.child, e.parent, depth + 1 FROM c JOIN e ON c.parent = e.child)
SELECT child, parent, min(depth) AS depth FROM c GROUP BY child, parent
""")
def role_hierarchy_closure(t: Tables) -> DataFrame:
    edges = t.customer.select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 4").alias("parent")).where("parent > 0")
    return R.closure(edges)


@query("""
SELECT o_orderkey FROM orders o WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_custkey = o.o_custkey AND d.o_orderkey < o.o_orderkey AND d.o_orderstatus <> 'F')
""")
def ready_tasks(t: Tables) -> DataFrame:
    """Tasks all of whose earlier ones (same user) are done."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    open_ = (F.col("o_orderstatus") != "F").cast("int")
    return t.orders.withColumn("waiting", F.coalesce(F.sum(open_).over(w), F.lit(0))).where((open_ == 1) & (F.col("waiting") == 0)).select("o_orderkey")


@query("""
SELECT r_name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT n_nationkey) AS nations, round(count(DISTINCT n_nationkey) * 1.0 / count(*), 4) AS diversity
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def reference_diversity(t: Tables) -> DataFrame:
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.supplier.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name").agg(F.count_distinct("s_suppkey").alias("suppliers"), F.count_distinct("n_nationkey").alias("nations"), F.round(F.count_distinct("n_nationkey") / F.count(F.lit(1)), 4).alias("diversity"))


@query("""
SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice / (p_size + 0.01) DESC, p_partkey) AS n FROM part WHERE p_retailprice > 100) WHERE n = 1
""")
def best_provider_argmax(t: Tables) -> DataFrame:
    score = F.struct((F.col("p_retailprice") / (F.col("p_size") + 0.01)).alias("s"), (-F.col("p_partkey")).alias("k"))
    return t.part.where("p_retailprice > 100").groupBy("p_brand").agg(F.max_by("p_partkey", score).alias("p_partkey"))


@query("""
SELECT s_nationkey, round(sum(s_acctbal), 2) AS spent, CASE WHEN sum(s_acctbal) >= 0.9 * 50000 THEN 'critical' WHEN sum(s_acctbal) >= 0.75 * 50000 THEN 'high' ELSE 'none' END AS alert FROM supplier GROUP BY s_nationkey
""")
def budget_alerts(t: Tables) -> DataFrame:
    spent = F.sum("s_acctbal")
    return t.supplier.groupBy("s_nationkey").agg(F.round(spent, 2).alias("spent"), F.when(spent >= 45000, "critical").when(spent >= 37500, "high").otherwise("none").alias("alert"))


@query("""
WITH r AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, round(max(n) * 1.0 / sum(n), 4) AS modal_share, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY c_nationkey
""")
def formatting_consistency_modal_share(t: Tables) -> DataFrame:
    kinds = t.customer.groupBy("c_nationkey", "c_mktsegment").count()
    return kinds.groupBy("c_nationkey").agg(F.round(F.max("count") / F.sum("count"), 4).alias("modal_share"), F.sum("count").alias("n"))


@query("""
SELECT p_partkey, CASE WHEN b < 1024 THEN CAST(CAST(floor(b) AS BIGINT) AS VARCHAR) || ' bytes' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024, 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round(b / 1048576, 1)) ELSE printf('%.1f GB', round(b / 1073741824, 1)) END AS size
FROM (SELECT p_partkey, p_retailprice * power(10, p_size % 7) AS b FROM part)
""")
def file_size_text(t: Tables) -> DataFrame:
    from lectern.functions.text import file_size

    return t.part.select("p_partkey", file_size(F.col("p_retailprice") * F.pow(F.lit(10.0), F.col("p_size") % 7)).alias("size"))


@query("""
SELECT e.vec_id, e.label, round(sqrt(list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 4) AS distance
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p WHERE e.vec_id <> 0 ORDER BY distance, vec_id LIMIT 10
""")
def embedding_knn_l2(t: Tables) -> DataFrame:
    from lectern.operators.vectors import nearest

    return nearest(t.embeddings, "vec_id", "embedding", 0, 10).select("vec_id", "label", "distance")
