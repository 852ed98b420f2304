"""Slide-quality and rule queries over conversations (a conversation is a deck, a turn a slide)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.arrow import dealt
from lectern.operators import rules, scoring, slides
from lectern.operators.matching import best_overlap
from lectern.plans.documents import _STOP, _listed
from lectern.plans.registry import Tables, query

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
_CONNECT = "['however', 'therefore', 'furthermore', 'moreover', 'nevertheless', 'consequently', 'additionally', 'similarly', 'finally', 'meanwhile', 'subsequently', 'thus', 'hence']"
_SECONDS = f"CAST(floor(15 + {_WORDS} / 130 * 60 + CASE WHEN role = 'assistant' THEN 10 ELSE 0 END + 3) AS BIGINT)"


def _timed(t: Tables) -> DataFrame:
    n = F.size(X.words(X.text_of("text")))
    return t.conversations.select("conv_id", "turn", "role", slides.seconds_of(n, F.when(F.col("role") == "assistant", 10).otherwise(0)).alias("seconds"))


@query(f"""
WITH t AS (SELECT conv_id, turn, {_TOK} AS a FROM conversations), p AS (SELECT *, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t),
q AS (SELECT conv_id, CASE WHEN list_has_any(list_slice(b, 1, 10), {_CONNECT}) THEN 0.4 ELSE 0 END + 0.6 * CASE WHEN least(len(list_distinct(a)), len(list_distinct(b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) * 1.0 / least(len(list_distinct(a)), len(list_distinct(b))) END AS q FROM p WHERE b IS NOT NULL)
SELECT conv_id, count(*) AS pairs, round(avg(q), 4) AS flow, count(*) FILTER (WHERE q < 0.4) AS weak FROM q GROUP BY conv_id
""")
def adjacent_turn_flow(t: Tables) -> DataFrame:
    return slides.flow(t.conversations, "conv_id", "turn", "text")


@query(rf"""
WITH t AS (SELECT conv_id, turn, list_filter({_TOK}, lambda x: length(x) >= 4 AND NOT list_contains({_listed(_STOP)}, x)) AS a FROM conversations),
n AS (SELECT conv_id, term, count(*) AS n FROM (SELECT conv_id, unnest(a) AS term FROM t) GROUP BY 1, 2),
k AS (SELECT conv_id, list(term) AS top FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) AS r FROM n) WHERE r <= 10 GROUP BY conv_id)
SELECT t.conv_id, round(avg(len(list_intersect(list_distinct(a), top)) * 1.0 / len(top)), 4) AS coherence FROM t JOIN k USING (conv_id) GROUP BY t.conv_id
""")
def topic_coherence(t: Tables) -> DataFrame:
    top = scoring.keywords(t.conversations, ["conv_id"], "text", 10).select("conv_id", "term")
    size = top.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"))
    turns = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    used = t.conversations.select("conv_id", "turn", "role", F.explode(F.array_distinct(X.tokens(X.text_of("text")))).alias("term"))
    hits = used.join(top, ["conv_id", "term"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(size, "conv_id").join(turns, "conv_id").select("conv_id", F.round(F.col("hits") / F.col("k") / F.col("turns"), 4).alias("coherence"))


@query(r"""
WITH v AS (SELECT conv_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '[.,!?;:]', '', 'g'), '\s+'), lambda x: length(x) > 3)) AS v FROM conversations),
n AS (SELECT conv_id, lower(v) AS base, v, count(*) AS n FROM v GROUP BY 1, 2, 3)
SELECT conv_id, base, count(*) AS variants, list(v ORDER BY n DESC, v)[1] AS preferred FROM n GROUP BY 1, 2 HAVING count(*) > 1
""")
def terminology_variants(t: Tables) -> DataFrame:
    return slides.variants(t.conversations, "conv_id", "text")


@query(f"""
WITH t AS (SELECT conv_id, {_SECONDS} AS s FROM conversations), w AS (SELECT *, avg(s) OVER (PARTITION BY conv_id) AS m, stddev_samp(s) OVER (PARTITION BY conv_id) AS d FROM t)
SELECT conv_id, count(*) AS slides, CAST(sum(s) AS BIGINT) AS total, round(CASE WHEN count(*) < 3 THEN 1.0 ELSE first(d) / first(m) END, 4) AS variation, count(*) FILTER (WHERE abs(s - m) > 2 * d) AS outliers FROM w GROUP BY conv_id
""")
def timing_distribution_cv(t: Tables) -> DataFrame:
    return slides.timing(_timed(t), "conv_id", "seconds")


@query(f"""
WITH t AS (SELECT conv_id, turn, {_SECONDS} AS s FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) // 3 AS n FROM t),
m AS (SELECT conv_id, n, CASE WHEN n > 0 THEN least(2, i // n) END AS third, avg(s) AS m FROM n GROUP BY 1, 2, 3)
SELECT conv_id, round(CASE WHEN max(n) < 2 THEN 0.8 ELSE greatest(0.0, 1 - var_samp(m) / power(avg(m), 2)) END, 4) AS pacing FROM m GROUP BY conv_id
""")
def pacing_by_thirds(t: Tables) -> DataFrame:
    return slides.thirds(_timed(t), "conv_id", "turn", "seconds")


@query(f"""
WITH t AS (SELECT conv_id, sum({_SECONDS}) / 60.0 AS minutes, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, round(minutes, 4) AS minutes, round(greatest(0.0, 1 - abs(minutes - n) / n), 4) AS fit, n < floor(minutes / 1.2) OR n > ceil(minutes / 0.8) AS count_off FROM t
""")
def total_timing(t: Tables) -> DataFrame:
    s = _timed(t).groupBy("conv_id").agg((F.sum("seconds") / 60).alias("m"), F.count(F.lit(1)).alias("n"))
    return s.select("conv_id", F.round("m", 4).alias("minutes"), F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("m") - F.col("n")) / F.col("n")), 4).alias("fit"), ((F.col("n") < F.floor(F.col("m") / 1.2)) | (F.col("n") > F.ceil(F.col("m") / 0.8))).alias("count_off"))


@query("""
WITH t AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
SELECT conv_id, round(1 - count(*) FILTER (WHERE (role = 'user' AND next = 'user') OR (role = 'assistant' AND next = 'assistant') OR next = 'system') * 1.0 / count(*), 4) AS order_score FROM t WHERE next IS NOT NULL GROUP BY conv_id
""")
def role_transition_order(t: Tables) -> DataFrame:
    pairs = slides.adjacent(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", "role").where(F.col("_next").isNotNull())
    bad = ((F.col("role") == F.col("_next")) & F.col("role").isin("user", "assistant")) | (F.col("_next") == "system")
    return pairs.groupBy("conv_id").agg(F.round(1 - F.count_if(bad) / F.count(F.lit(1)), 4).alias("order_score"))


@query(f"""
WITH d AS (SELECT conv_id, turn, least(1.0, {_WORDS} / 100) AS density FROM conversations), l AS (SELECT *, lag(density) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM d)
SELECT conv_id, round(avg(density), 7) AS mean_density, round(max(density) - min(density), 4) AS spread, round(coalesce(avg(CASE WHEN p IS NULL THEN NULL WHEN abs(density - p) < 0.3 THEN 1.0 WHEN abs(density - p) < 0.5 THEN 0.7 ELSE 0.3 END), 1.0), 7) AS transition_pacing, round(1 - least(1.0, 2 * abs(avg(density) - 0.65)), 7) AS balance FROM l GROUP BY conv_id
""")
def content_density(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t.conversations.select("conv_id", "turn", F.least(F.lit(1.0), F.size(X.words(X.text_of("text"))) / 100).alias("density")).withColumn("p", F.lag("density").over(w))
    change = F.abs(F.col("density") - F.col("p"))
    step = F.when(F.col("p").isNull(), None).when(change < 0.3, 1.0).when(change < 0.5, 0.7).otherwise(0.3)
    mean = F.avg("density")
    return d.groupBy("conv_id").agg(F.round(mean, 7).alias("mean_density"), F.round(F.max("density") - F.min("density"), 4).alias("spread"), F.round(F.coalesce(F.avg(step), F.lit(1.0)), 7).alias("transition_pacing"), F.round(1 - F.least(F.lit(1.0), 2 * F.abs(mean - 0.65)), 7).alias("balance"))


@query(rf"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS ns FROM documents),
b AS (SELECT *, len(words) AS nw, CAST(coalesce(list_sum(list_transform(list_transform(words, lambda x: regexp_replace(lower(x), '[!-/:-@\[-`{{-~]', '', 'g')), lambda x: CASE WHEN x = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') THEN 1 ELSE 0 END) END)), 0) AS BIGINT) AS sy FROM w),
g AS (SELECT *, greatest(0, 0.39 * CASE WHEN ns = 0 THEN 0 ELSE nw / ns END + 11.8 * CASE WHEN nw = 0 THEN 0 ELSE sy / nw END - 15.59) AS grade FROM b),
v AS (SELECT doc_id, unnest(list_concat(
 CASE WHEN nw > 100 THEN [['text.density', 'warning']] ELSE [] END, CASE WHEN length(string_split(text, chr(10))[1]) > 60 THEN [['text.title_length', 'warning']] ELSE [] END,
 CASE WHEN grade > 16 THEN [['text.readability', 'info']] ELSE [] END, CASE WHEN len(string_split(text, chr(10))) > 5 THEN [['text.bullets', 'warning']] ELSE [] END, CASE WHEN nw / 130 * 60 > 120 THEN [['time.slide', 'warning']] ELSE [] END,
 CASE WHEN len(list_filter(['a lot of', 'lots of', 'kind of', 'sort of', 'pretty much', 'really', 'stuff', 'things', 'gonna', 'wanna', 'can''t', 'won''t', 'don''t', 'isn''t', 'aren''t', 'wasn''t', 'weren''t', 'hasn''t', 'haven''t', 'shouldn''t', 'wouldn''t', 'couldn''t', 'didn''t', 'doesn''t', 'let''s', 'that''s', 'what''s', 'here''s', 'there''s', 'where''s', 'how''s', 'who''s', 'it''s', 'you''re', 'they''re', 'we''re',
   'awesome', 'cool', 'guys', 'etc.', 'e.g.', 'i.e.', 'basically', 'obviously', 'actually', 'anyway', 'anyways', 'plus', 'tons of', 'huge', 'tiny', 'big', 'good', 'bad', 'nice', 'okay', 'ok'], lambda p: contains(lower(text), p))) > 0 THEN [['tone.informal', 'warning']] ELSE [] END,
 CASE WHEN regexp_matches(lower(text), '(studies|findings|results) (show|indicate|suggest|demonstrate)|(research|data|evidence) (shows|indicates|suggests|demonstrates)|according to|analysis (shows|indicates|reveals)|[0-9]+\s*%|statistics|survey|study|report|published|discovered|found that|proven|demonstrated')
   AND NOT regexp_matches(text, '\([A-Z][a-zA-Z]+(\s+(et\s+al\.?|and|&)\s+[A-Z][a-zA-Z]+)*,?\s+[0-9]{{4}}\)|\[[A-Z][a-zA-Z]+(\s+(et\s+al\.?|and|&)\s+[A-Z][a-zA-Z]+)*,?\s+[0-9]{{4}}\]|\[[0-9]+\]|\([0-9]+\)|<sup>[0-9]+</sup>|\^[0-9]+') THEN [['cite.claim', 'warning']] ELSE [] END,
 CASE WHEN nw > 50 AND len(list_filter(words, lambda x: list_contains(['furthermore', 'moreover', 'consequently', 'therefore', 'thus', 'hence', 'accordingly', 'nevertheless', 'nonetheless', 'however', 'conversely', 'alternatively', 'similarly', 'likewise', 'specifically', 'particularly', 'notably', 'significantly', 'importantly', 'additionally'], lower(x)))) = 0 THEN [['tone.transitions', 'info']] ELSE [] END,
 CASE WHEN len(list_filter(words, lambda x: list_contains(['very', 'really', 'quite', 'rather', 'somewhat'], lower(x)))) > 0 THEN [['tone.vague', 'info']] ELSE [] END)) AS x FROM g)
SELECT x[1] AS rule_id, x[2] AS severity, count(*) AS n, min(doc_id) AS first_doc FROM v GROUP BY 1, 2
""")
def rule_violations_summary(t: Tables) -> DataFrame:
    d = scoring.readability(scoring.counted(dealt(t.documents.select("doc_id", "text"))))
    found = rules.slide_rules().violations(d, ["doc_id"], "conference")
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("""
WITH p AS (SELECT p_partkey, p_size * 5 % 256 AS r, p_partkey % 256 AS g, CAST(floor(p_retailprice) AS BIGINT) % 256 AS b FROM part),
l AS (SELECT p_partkey, list_transform([r, g, b], lambda c: CASE WHEN c / 255 <= 0.03928 THEN c / 255 / 12.92 ELSE power((c / 255 + 0.055) / 1.055, 2.4) END) AS x FROM p)
SELECT p_partkey, round(1.05 / (0.2126 * x[1] + 0.7152 * x[2] + 0.0722 * x[3] + 0.05), 4) AS contrast, 1.05 / (0.2126 * x[1] + 0.7152 * x[2] + 0.0722 * x[3] + 0.05) < 4.5 AS broken FROM l
""")
def color_contrast_rule(t: Tables) -> DataFrame:
    rgb = (F.col("p_size") * 5 % 256, F.col("p_partkey") % 256, F.floor("p_retailprice") % 256)
    white = (F.lit(255), F.lit(255), F.lit(255))
    c = rules.contrast(rgb, white)
    return t.part.select("p_partkey", F.round(c, 4).alias("contrast"), (c < 4.5).alias("broken"))


@query(f"""
WITH t AS (SELECT d.doc_id, {_TOK} AS a FROM documents d), b AS (SELECT item_id, list_distinct({_TOK}) AS b FROM benchmark)
SELECT item_id, doc_id, overlap FROM (SELECT item_id, doc_id, round(len(list_intersect(a, b)) * 1.0 / len(b), 4) AS overlap, row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect(a, b)) DESC, doc_id) AS n FROM t, b) WHERE n = 1
""")
def best_matching_document(t: Tables) -> DataFrame:
    """The document that shares most distinct tokens with each benchmark item; frequent tokens are not joined."""
    terms = X.tokens(X.text_of("text")).alias("terms")
    best = best_overlap(t.benchmark.select(F.col("item_id").alias("item"), terms), t.documents.select(F.col("doc_id").alias("id"), terms))
    return best.select(F.col("item").alias("item_id"), F.col("id").alias("doc_id"), F.round(F.col("n") / F.col("k"), 4).alias("overlap"))


@query("""
SELECT lang, quality, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality
""")
def quality_by_language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.sum("toxic").alias("toxic"))


@query("""
WITH p AS (SELECT e.vec_id, e.label, e.embedding, p.embedding AS probe FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) p),
c AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, probe), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) * sqrt(list_sum(list_transform(probe, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))) AS s FROM p)
SELECT label, count(*) AS n, round(max(s), 4) AS best, round(avg(s), 4) AS mean_similarity FROM c WHERE vec_id <> 1 GROUP BY label
""")
def similarity_by_label(t: Tables) -> DataFrame:
    from lectern.operators.vectors import cosine

    probe = t.embeddings.where("vec_id = 1").limit(1).select(F.col("embedding").alias("probe"))
    scored = t.embeddings.where("vec_id <> 1").crossJoin(F.broadcast(probe)).withColumn("s", cosine(F.col("embedding"), F.col("probe")))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("s"), 4).alias("best"), F.round(F.avg("s"), 4).alias("mean_similarity"))
