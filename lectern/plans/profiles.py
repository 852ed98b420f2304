"""Behaviour, coverage, transitions of sections, institutions and audit exports on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import institutions
from lectern.functions import papers as P
from lectern.operators import profiles
from lectern.plans.references import _SQL as _SQL_REFERENCES
from lectern.plans.references import papers as entries
from lectern.plans.registry import Tables, query
from lectern.plans.structure import _SQL_LINES, papers


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 9 = 0 THEN -value ELSE value END AS size, extract(hour FROM ts) AS h FROM events),
n AS (SELECT *, row_number() OVER w AS place, 1 + coalesce(count(*) FILTER (WHERE size > 0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, coalesce(avg(size) FILTER (WHERE size > 0) OVER r, 0) AS mean, coalesce(stddev_pop(size) FILTER (WHERE size > 0) OVER r, 0) AS dev, min(place) OVER (PARTITION BY user_id, h) = place AS new_hour, min(place) OVER (PARTITION BY user_id, event_type) = place AS new_type FROM n WINDOW r AS (PARTITION BY user_id ORDER BY x RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING)),
f AS (SELECT event_id, user_id, place > 1 AND new_hour AS unseen_hour, place > 1 AND new_type AS unseen_type, place > 1 AND abs(size - mean) > 2 * dev AS odd_size FROM s)
SELECT *, round(least(1.0, CASE WHEN unseen_hour THEN 0.3 ELSE 0 END + CASE WHEN unseen_type THEN 0.4 ELSE 0 END + CASE WHEN odd_size THEN 0.3 ELSE 0 END), 2)::DOUBLE AS score FROM f""")
def behaviour_scores(t: Tables) -> DataFrame:
    """Each event against what its user did before: hour, type and size; some events have no positive size."""
    size = F.when(F.col("event_id") % 9 == 0, -F.col("value")).otherwise(F.col("value"))
    told = profiles.behaviour_scores(t.events.select("event_id", "user_id", "ts", "event_type", "value"), "user_id", ["ts", "event_id"], F.hour("ts"), F.col("event_type"), size)
    return told.select("event_id", "user_id", "unseen_hour", "unseen_type", "odd_size", "score")


@query(f"""WITH {_SQL_REFERENCES}, d AS (SELECT l_orderkey AS doc, CASE WHEN l_linenumber <> 4 THEN year END AS year, CASE WHEN l_linenumber <> 2 THEN venue ELSE '' END AS venue FROM lineitem JOIN r ON l_partkey = r.id),
k AS (SELECT doc, year // 10 * 10 AS decade, count(*) AS k FROM d WHERE year IS NOT NULL GROUP BY ALL), l AS (SELECT doc, string_agg(decade || 's:' || k, ',' ORDER BY decade) AS decades FROM k GROUP BY doc),
c AS (SELECT doc, count(*) AS n, count(*) FILTER (WHERE year >= 2019) AS recent, count(DISTINCT nullif(venue, '')) AS venues, count(*) FILTER (WHERE year < 2014) > 0.5 * count(year) AS many_old FROM d GROUP BY doc)
SELECT doc, n, recent, venues, coalesce(decades, '') AS decades, many_old, venues < 3 AND n > 5 AS few_venues, round(0.5 + CASE WHEN recent > 0.3 * n THEN 0.2 ELSE 0 END + CASE WHEN venues >= 3 THEN 0.2 ELSE 0 END + CASE WHEN n >= 10 THEN 0.1 ELSE 0 END, 2)::DOUBLE AS score FROM c LEFT JOIN l USING (doc)""")
def reference_coverage(t: Tables) -> DataFrame:
    """How well each order's parts, as references, cover a topic: recent ones, venues, decades; some lack the year or the venue."""
    line = F.col("l_linenumber")
    d = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id"), line).join(entries(t).select("id", "year", "venue"), "id")
    d = d.select("doc", F.when(line != 4, F.col("year")).alias("year"), F.when(line != 2, F.col("venue")).otherwise("").alias("venue"))
    return profiles.reference_coverage(d, "doc", 2024)


_LINKED = " OR ".join(f"contains(lower(p), '{w}')" for w in profiles.LINKS)


@query(rf"""WITH {_SQL_LINES}, f AS (SELECT doc_id, no, title, coalesce(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\S'))[1], '') AS p FROM e WHERE no > 1)
SELECT doc_id, no, title, len(regexp_extract_all(p, '\S+')) AS n_words FROM f WHERE len(regexp_extract_all(p, '\S+')) > 10 AND NOT ({_LINKED})""")
def abrupt_sections(t: Tables) -> DataFrame:
    """Sections that begin with a longer paragraph and no phrase that links them to the section before."""
    found = papers(t).select("doc_id", F.explode(profiles.abrupt(P.sections(F.col("text")))).alias("s"))
    return found.select("doc_id", "s.no", "s.title", "s.n_words")


_FRONT = ["", "mail.", "cs.", "www.", "students."]
_BODY = ["{}-tech", "uni-{}", "poly", "inst_of_{}", "{}college", "mit"]
_END = [".edu", ".ac.uk", ".org", ".edu.au", ".ac.jp", ".ac.in", ".com"]


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


@query(f"""WITH d AS (SELECT c_custkey, {_FRONT}[1 + CAST(c_custkey % 5 AS INT)] || replace({_BODY}[1 + CAST(c_custkey % 6 AS INT)], '{{}}', lower(c_mktsegment)) || {_END}[1 + CAST(c_custkey % 7 AS INT)] AS domain FROM customer),
b AS (SELECT *, regexp_replace(domain, '\\.(edu|ac\\.uk|edu\\.au|edu\\.cn|ac\\.jp|edu\\.br|edu\\.mx|ac\\.in)$', '') AS bare FROM d),
l AS (SELECT *, list_filter(string_split(bare, '.'), lambda x: length(x) > 3 AND NOT list_contains(['mail', 'email', 'smtp', 'www'], x)) AS ls FROM b),
w AS (SELECT *, list_filter(string_split(replace(replace(CASE WHEN contains(bare, '.') AND len(ls) > 0 THEN ls[len(ls)] ELSE bare END, '-', ' '), '_', ' '), ' '), lambda x: x <> '') AS ws FROM l),
n AS (SELECT c_custkey, domain, array_to_string(list_transform(ws, lambda x: CASE x WHEN 'uni' THEN 'University' WHEN 'univ' THEN 'University' WHEN 'tech' THEN 'Technology' WHEN 'inst' THEN 'Institute' WHEN 'coll' THEN 'College' WHEN 'acad' THEN 'Academy' WHEN 'poly' THEN 'Polytechnic' ELSE array_to_string(list_transform(string_split(x, '.'), lambda y: upper(y[1]) || y[2:]), '.') END), ' ') AS name FROM w)
SELECT c_custkey, domain, CASE WHEN regexp_matches(lower(name), 'university|college|institute|academy|school|center') THEN name ELSE name || ' University' END AS institution FROM n""")
def institution_names(t: Tables) -> DataFrame:
    """The institution behind each customer's domain, of many shapes: services, several labels, abbreviations, other endings."""
    k = F.col("c_custkey")
    domain = F.concat(_pick(_FRONT, k % 5), F.replace(_pick(_BODY, k % 6), F.lit("{}"), F.lower("c_mktsegment")), _pick(_END, k % 7))
    return t.customer.select("c_custkey", domain.alias("domain")).withColumn("institution", institutions.institution_name(F.col("domain")))


_FRAMEWORKS = [["gdpr", "soc2"], ["hipaa"], ["gdpr"], [], ["soc2", "iso27001", "gdpr"]]


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, ts, {_FRAMEWORKS}[1 + CAST(event_id % 5 AS INT)] AS frameworks FROM events), m AS (SELECT max(ts) AS latest FROM events)
SELECT event_id, '{{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","frameworks":["' || array_to_string(frameworks, '","') || '"]}}' AS line FROM e, m WHERE ts BETWEEN latest - INTERVAL 10 DAY AND latest AND list_contains(frameworks, 'gdpr')""")
def audit_export_lines(t: Tables) -> DataFrame:
    """The last ten days of events that one framework covers, as the lines of an export."""
    which = F.element_at(F.array(*(F.array(*map(F.lit, f)).cast("array<string>") for f in _FRAMEWORKS)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = t.events.withColumn("frameworks", which).crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("latest"))))
    start = F.col("latest") - F.expr("INTERVAL 10 DAYS")
    return profiles.audit_lines(rows, ["event_id", "user_id", "event_type", "ts", "frameworks"], "ts", start, F.col("latest"), "gdpr")
