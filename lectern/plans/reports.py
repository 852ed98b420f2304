"""Report, search and queue queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import relational as R
from lectern.operators import reports
from lectern.plans.registry import Tables, query


@query("""
WITH l AS (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem), u AS (UNPIVOT l ON l_quantity, l_discount, l_tax INTO NAME dimension VALUE v)
SELECT l_returnflag, dimension, round(avg(v), 4) AS mean, min(v) AS low, max(v) AS high, count(v) AS n FROM u GROUP BY 1, 2
""")
def dimension_averages(t: Tables) -> DataFrame:
    out = reports.dimension_report(t.lineitem, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])
    return out.withColumn("mean", F.round("mean", 4))


@query("""
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
p AS (SELECT o_custkey, max(CASE WHEN n = 1 THEN o_totalprice END) AS latest, max(CASE WHEN n = 2 THEN o_totalprice END) AS previous FROM r WHERE n <= 2 GROUP BY 1)
SELECT o_custkey, latest, previous, CASE WHEN previous IS NULL THEN 'new' WHEN latest > previous THEN 'up' WHEN latest < previous THEN 'down' ELSE 'same' END AS direction FROM p
""")
def quality_trend(t: Tables) -> DataFrame:
    return reports.trend(t.orders.select("o_custkey", "o_totalprice", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


@query("""
SELECT value, "inner" FROM (SELECT DISTINCT p_type AS value, NOT starts_with(lower(p_type), 's') AS "inner" FROM part WHERE contains(lower(p_type), 's')) ORDER BY "inner", value LIMIT 10
""")
def search_suggestions(t: Tables) -> DataFrame:
    return reports.suggestions(t.part, "p_type", "s", 10)


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS tok FROM documents)
SELECT doc_id, len(list_filter(tok, lambda x: levenshtein(x, 'that') <= 1)) AS hits FROM w WHERE len(list_filter(tok, lambda x: levenshtein(x, 'that') <= 1)) > 0
""")
def fuzzy_search(t: Tables) -> DataFrame:
    return reports.fuzzy(t.documents.select("doc_id", "text"), "text", "that").select("doc_id", "hits")


@query(r"""
WITH w AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x = 'the')) AS a, len(list_filter(regexp_split_to_array(lower(role), '[^\p{L}]+'), lambda x: x = 'the')) AS b FROM conversations)
SELECT conv_id, turn, CAST(greatest(1.0 * a, 3.0 * b) AS DOUBLE) AS rank FROM w WHERE greatest(1.0 * a, 3.0 * b) > 0 ORDER BY rank DESC, conv_id, turn LIMIT 25
""")
def multi_field_rank(t: Tables) -> DataFrame:
    ranked = t.conversations.withColumn("rank", reports.weighted_rank({"text": 1.0, "role": 3.0}, "the")).where("rank > 0")
    return ranked.orderBy(F.desc("rank"), "conv_id", "turn").select("conv_id", "turn", "rank").limit(25)


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'
ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 ELSE 0 END, o_orderdate, o_orderkey LIMIT 15
""")
def priority_queue_pop(t: Tables) -> DataFrame:
    ranks = ["2-HIGH", "1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return reports.next_in_queue(t.orders.where("o_orderstatus <> 'F'"), "o_orderpriority", ranks, ["o_orderdate", "o_orderkey"], 15).select("o_orderkey", "o_orderpriority")


@query("""
WITH s AS (SELECT conv_id, turn, role, last_value(CASE role WHEN 'user' THEN 1 WHEN 'system' THEN 0 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i FROM conversations)
SELECT conv_id, turn FROM s WHERE i = 1 AND role = 'assistant'
""")
def elements_after_heading(t: Tables) -> DataFrame:
    role = F.col("role")
    return reports.after_heading(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", role == "user", role == "system").select("conv_id", "turn")


@query("""
SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean_last_100 FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 100 GROUP BY 1
""")
def mean_of_last_hundred(t: Tables) -> DataFrame:
    last = R.newest(t.orders.select("o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey"), "o_orderpriority", [F.desc("o_orderdate"), F.desc("o_orderkey")], 100)
    return last.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("mean_last_100"))


@query("""
WITH k AS (SELECT *, CAST(floor(s_acctbal / 100000) AS BIGINT) AS k FROM supplier), n AS (SELECT s_nationkey, k, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, k) AS r FROM k GROUP BY s_nationkey, k)
SELECT k.s_nationkey, min(n.k) AS modal_class, round(avg(s_acctbal), 4) AS mean_balance, avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0 END) > 0.5 AS mostly_positive FROM k JOIN n ON k.s_nationkey = n.s_nationkey AND r = 1 GROUP BY k.s_nationkey
""")
def representative_style(t: Tables) -> DataFrame:
    k = F.floor(F.col("s_acctbal") / 100000).cast("long")
    return t.supplier.groupBy("s_nationkey").agg(F.mode(k, deterministic=True).alias("modal_class"), F.round(F.avg("s_acctbal"), 4).alias("mean_balance"), (F.avg(F.when(F.col("s_acctbal") > 0, 1.0).otherwise(0.0)) > 0.5).alias("mostly_positive"))


@query("""
SELECT lang, count(*) AS reports, round(avg(quality), 4) AS mean_quality, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS poor,
  round(avg(n_chars) FILTER (WHERE quality = 1) - avg(n_chars) FILTER (WHERE quality = 0), 4) AS length_gap FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def aggregated_quality_report(t: Tables) -> DataFrame:
    both = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    good, poor = F.col("quality") == 1, F.col("quality") == 0
    gap = F.avg(F.when(good, F.col("n_chars"))) - F.avg(F.when(poor, F.col("n_chars")))
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("reports"), F.round(F.avg("quality"), 4).alias("mean_quality"), F.count_if(good).alias("good"), F.count_if(poor).alias("poor"), F.round(gap, 4).alias("length_gap"))


@query("""
WITH c AS (SELECT doc_id, source, lang, n_chars, dense_rank() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT source, doc_id, n_chars, r AS place FROM c WHERE r <= 3
""")
def longest_per_source(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t.documents.select("source", "doc_id", "n_chars").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s),
r AS (SELECT doc_id, i, x, 2 * (CASE WHEN contains(lower(x), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(x), 'password') THEN 1 ELSE 0 END) + CASE WHEN regexp_matches(x, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN i = 1 THEN 1 ELSE 0 END AS score FROM e)
SELECT doc_id, i AS ord, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS n FROM r) WHERE n <= 2 AND score > 0
""")
def important_sentences(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(X.sentences(X.text_of("text"))).alias("i", "x"))
    low = F.lower("x")
    score = 2 * (low.contains("license").cast("int") + low.contains("password").cast("int")) + F.col("x").rlike("[0-9]").cast("int") + (F.col("i") == 0).cast("int")
    ranked = rows.select("doc_id", (F.col("i") + 1).cast("long").alias("ord"), score.alias("score"))
    return R.newest(ranked, "doc_id", [F.desc("score"), F.asc("ord")], 2).where("score > 0")


@query("""
SELECT conv_id, '<section>' || string_agg('<h2>' || role || '</h2><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY turn, role, text) || '</section>' AS html FROM conversations WHERE role <> 'system' GROUP BY conv_id
""")
def export_html_without_notes(t: Tables) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    slide = lambda x: F.concat(F.lit("<h2>"), x["role"], F.lit("</h2><p>"), safe(x["text"]), F.lit("</p>"))
    decks = t.conversations.where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    return decks.select("conv_id", F.concat(F.lit("<section>"), F.array_join(F.transform("s", slide), ""), F.lit("</section>")).alias("html"))


@query("""
SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END) AS BIGINT) AS counter, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_accessed FROM events GROUP BY user_id
""")
def counters_from_deltas(t: Tables) -> DataFrame:
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(0)
    return t.events.groupBy("user_id").agg(F.sum(delta).alias("counter"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_accessed"))


@query("""
SELECT r_name, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus <> 'F') AS remaining, bool_and(o_totalprice > 0) AS all_valid, bool_or(o_orderpriority = '1-URGENT') AS any_urgent
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def batch_authorisation(t: Tables) -> DataFrame:
    places = F.broadcast(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
    users = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    rows = t.orders.join(users, F.col("o_custkey") == F.col("c_custkey"))
    done = F.col("o_orderstatus") == "F"
    return rows.groupBy("r_name").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("remaining"), F.bool_and(F.col("o_totalprice") > 0).alias("all_valid"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))
