"""Security, hierarchy and scheduling queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import dealt
from lectern.functions import academic, security
from lectern.functions import text as X
from lectern.operators import deck, layout
from lectern.operators import timeline as T
from lectern.plans import papers  # noqa: F401  (its SQL is used here)
from lectern.plans.registry import ORACLES, Tables, query


def _case(text: str, cases: list[tuple[str, list[str]]], other: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, '{p}')" for p in parts) + f" THEN '{label}'" for label, parts in cases)
    return f"CASE {whens} ELSE {other} END"


_ATTACKS = [
    ("sql_injection", ["union select", "drop table", "insert into", "delete from", "update set", "--", "/*", "*/", "xp_", "sp_"]),
    ("xss", ["<script", "javascript:", "onerror=", "onload=", "onclick=", "onmouseover=", "<iframe", "<object", "<embed"]),
    ("path_traversal", ["../", "..%2f", "..%5c"]),
]


@query(f"SELECT coalesce({_case('lower(html)', _ATTACKS, 'NULL')}, 'none') AS attack, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def request_threats(t: Tables) -> DataFrame:
    return t.pages.groupBy(F.coalesce(security.request_threat(F.col("html")), F.lit("none")).alias("attack")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


_SUSPECT = " + ".join(f"CASE WHEN contains(lower(html), '{s}') THEN 1 ELSE 0 END" for s in ["eval(", "exec(", "system(", "shell_exec", "cmd.exe", "powershell", "base64_decode", "gzinflate", "str_rot13", "createobject", "wscript.shell", "microsoft.xmlhttp"])


@query(f"SELECT page_id, round(least(1.0, 0.2 * ({_SUSPECT})), 4)::DOUBLE AS suspicion FROM pages")
def suspicious_strings(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.round(security.suspicion(F.col("html")), 4).alias("suspicion"))


@query("""
SELECT c_custkey, CASE WHEN length(c_name) < 12 THEN 'length' WHEN NOT regexp_matches(c_name, '[A-Z]') THEN 'upper' WHEN NOT regexp_matches(c_name, '[a-z]') THEN 'lower' WHEN NOT regexp_matches(c_name, '[0-9]') THEN 'digit' WHEN NOT regexp_matches(c_name, '[^A-Za-z0-9]') THEN 'special' END AS problem FROM customer
""")
def password_checks(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", security.password_problem(F.col("c_name")).alias("problem"))


@query(r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[a-z]+')) AS email FROM documents)
SELECT lower(string_split(email, '@')[2]) AS domain, count(*) AS n, count(DISTINCT doc_id) AS documents FROM e GROUP BY 1
""")
def email_domains(t: Tables) -> DataFrame:
    found = t.documents.where(F.col("text").contains("@")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[a-z]+"), F.lit(0))).alias("email"))
    return found.groupBy(security.domain(F.col("email")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


_LEVEL = "CASE {0}.role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END"


@query(f"""
SELECT c.conv_id, c.turn, {_LEVEL.format('c')} AS level, coalesce((SELECT max(p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND {_LEVEL.format('p')} < {_LEVEL.format('c')}), -1) AS parent FROM conversations c
""")
def section_hierarchy(t: Tables) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    rows = t.conversations.select("conv_id", "turn", level.alias("level"))
    return layout.parents(rows.withColumn("id", F.col("turn")), "conv_id", "turn", "level", "id", 3).drop("id").na.fill(-1, ["parent"])


@query(f"""
WITH l AS (SELECT conv_id, turn, {_LEVEL.format('conversations')} AS level FROM conversations), p AS (SELECT *, lag(level, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM l) SELECT conv_id, turn, level FROM p WHERE level > b + 1
""")
def skipped_heading_levels(t: Tables) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return layout.skipped_levels(t.conversations.select("conv_id", "turn", level.alias("level")), "conv_id", "turn", "level")


@query("""
WITH RECURSIVE d AS (SELECT c_custkey AS task, 0 AS level FROM customer WHERE c_custkey // 4 = 0 UNION ALL SELECT c.c_custkey, d.level + 1 FROM customer c JOIN d ON c.c_custkey // 4 = d.task WHERE c.c_custkey // 4 > 0)
SELECT task, level FROM d
""")
def dependency_levels(t: Tables) -> DataFrame:
    tasks = t.customer.select(F.col("c_custkey").alias("task"))
    edges = t.customer.select(F.col("c_custkey").alias("task"), F.expr("c_custkey div 4").alias("needs")).where("needs > 0")
    return layout.dependency_levels(tasks, edges)


@query(rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents),
c AS (SELECT doc_id, len(list_filter(l, lambda x: x <> '')) AS bullets, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS nw, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS tok FROM l),
v AS (SELECT doc_id, unnest(list_concat(CASE WHEN bullets > 5 THEN ['text.bullet_count'] ELSE [] END, CASE WHEN nw > 100 THEN ['text.density'] ELSE [] END,
  CASE WHEN nw > 50 AND NOT list_has_any(tok, ['furthermore', 'moreover', 'consequently', 'therefore', 'thus', 'hence', 'accordingly', 'nevertheless', 'nonetheless', 'however', 'conversely', 'alternatively', 'similarly', 'likewise', 'specifically', 'particularly', 'notably', 'significantly', 'importantly', 'additionally']) THEN ['tone.transitions'] ELSE [] END)) AS rule_id FROM c)
SELECT rule_id, count(*) AS n FROM v GROUP BY rule_id
""")
def deck_rules_on_lines(t: Tables) -> DataFrame:
    """Each line of a document as a bullet of one slide."""
    bullet = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.struct(x.alias("text")))
    content = F.to_json(F.struct(F.array(F.struct(F.lit("bullets").alias("type"), bullet.alias("items"))).alias("body")))
    slides = dealt(t.documents.select("doc_id", "text")).select("doc_id", content.alias("content"))
    found = deck.rules().violations(deck.parsed(slides), ["doc_id"], only=["text.bullet_count", "text.density", "tone.transitions"])
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag, round(100 * (sum(CASE WHEN k THEN w ELSE 0 END)) / sum(w), 4) AS completeness FROM (SELECT l_returnflag, l_linenumber AS s, bool_or(l_quantity > 49) AS k, CASE WHEN l_linenumber <= 2 THEN 20 ELSE 10 END AS w FROM lineitem GROUP BY 1, 2) GROUP BY l_returnflag
""")
def weighted_completeness(t: Tables) -> DataFrame:
    parts = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.bool_or(F.col("l_quantity") > 49).alias("k")).withColumn("w", F.when(F.col("l_linenumber") <= 2, 20).otherwise(10))
    return parts.groupBy("l_returnflag").agg(F.round(100 * F.sum(F.when(F.col("k"), F.col("w")).otherwise(0)) / F.sum("w"), 4).alias("completeness"))


@query(ORACLES["abstract_scores"])
def abstract_quality(t: Tables) -> DataFrame:
    """Every document scored as if it were an abstract."""
    s = t.documents.select("doc_id", academic.abstract_scores(F.col("text")).alias("s"))
    return s.select("doc_id", *(F.round(F.col(f"s.{c}"), 4).alias(c) for c in ("completeness", "conciseness", "clarity", "structure")))


@query("""
WITH RECURSIVE q AS (SELECT event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(floor(value * 10) AS BIGINT) AS tokens FROM events), e AS (SELECT *, event_type || '/' || day AS key, row_number() OVER (PARTITION BY event_type, day ORDER BY tokens, event_id) AS k FROM q),
r AS (SELECT event_id, event_type, day, tokens, key, k, CAST(0 AS BIGINT) AS batch, 1 AS n, tokens AS held FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.event_type, e.day, e.tokens, e.key, e.k, CASE WHEN r.n = 10 OR r.held + e.tokens > 4000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n = 10 OR r.held + e.tokens > 4000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n = 10 OR r.held + e.tokens > 4000 THEN e.tokens ELSE r.held + e.tokens END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT event_id, event_type, day, tokens, key, batch FROM r
""")
def request_batches(t: Tables) -> DataFrame:
    """Requests of one type and day packed greedily into batches of at most ten and 4000 tokens, the heaviest first."""
    rows = t.events.select("event_id", "event_type", F.to_date("ts").cast("string").alias("day"), F.floor(F.col("value") * 10).cast("long").alias("tokens"))
    return T.packed(rows.withColumn("key", F.concat_ws("/", "event_type", "day")), "key", ["tokens", "event_id"], "tokens", 10, 4000)
