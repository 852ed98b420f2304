"""Searches on a positional index, LaTeX trees, cycles of a hierarchy, and places that stand near each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import dealt
from lectern.functions.text import rounded
from lectern.plans.registry import Tables, query

_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"


@query(rf"""
WITH d AS (SELECT doc_id, 'text' AS field, {_WORDS.format('text')} AS w FROM documents UNION ALL SELECT doc_id, 'lang', {_WORDS.format('lang')} FROM documents),
f AS (SELECT field, count(*) AS n_docs, avg(len(w)) AS mean FROM d GROUP BY field),
a AS (SELECT item_id AS query, 'text' AS field, unnest(list_slice(list_filter({_WORDS.format('text')}, lambda w: length(w) >= 5), 1, 4)) AS term, 1.0 AS weight FROM benchmark UNION ALL SELECT item_id, 'lang', 'en', 0.25 FROM benchmark),
q AS (SELECT query, field, term, CAST(sum(weight) AS DOUBLE) AS weight FROM a GROUP BY ALL),
p AS (SELECT doc_id, field, n AS size, term, count(*) AS tf FROM (SELECT doc_id, field, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT query, doc_id AS id, round(sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)))), 6) AS score FROM q JOIN p USING (field, term) JOIN c USING (field, term) JOIN f USING (field) GROUP BY query, doc_id)
SELECT query, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10
""")
def index_top_documents(t: Tables) -> DataFrame:
    """The ten best documents for four words of each benchmark item and, with a small weight, the language: BM25 by block maxima."""
    from lectern.operators.textindex import TextIndex

    index = TextIndex.build(t.documents, {"text": "text", "lang": "lang"}, "doc_id")
    long_words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 5)
    words = t.benchmark.select(F.col("item_id").cast("long").alias("query"), F.lit("text").alias("field"), F.explode(F.slice(long_words, 1, 4)).alias("term"), F.lit(1.0).alias("weight"))
    lang = t.benchmark.select(F.col("item_id").cast("long").alias("query"), F.lit("lang").alias("field"), F.lit("en").alias("term"), F.lit(0.25).alias("weight"))
    return index.ranked(words.unionByName(lang), 10)


@query(rf"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), g AS (SELECT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
q AS (SELECT item_id AS query, {_WORDS.format('text')}[1:5] AS g FROM benchmark)
SELECT query, doc_id AS id, count(*) AS n FROM q JOIN g USING (g) WHERE len(q.g) = 5 GROUP BY ALL
""")
def index_phrase_hits(t: Tables) -> DataFrame:
    """Documents that hold the first five words of a benchmark item in a row, from the positions in the index."""
    from lectern.operators.textindex import TextIndex

    index = TextIndex.build(t.documents, {"text": "text"}, "doc_id")
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 5)
    asked = t.benchmark.select(F.col("item_id").cast("long").alias("query"), F.lit("text").alias("field"), words.alias("words")).where(F.size("words") == 5)
    return index.phrases(asked)


@query(rf"""
WITH d AS (SELECT doc_id AS id, {_WORDS.format('text')} AS w, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS s FROM documents)
SELECT 1 AS query, id FROM d WHERE list_contains(w, 'license') AND NOT (contains(s, ' apache license ') OR contains(s, ' public license '))
UNION ALL SELECT 2, id FROM d WHERE (list_contains(w, 'the') OR list_contains(w, 'der') OR contains(s, ' de la ')) AND list_contains(w, 'token')
UNION ALL SELECT 3, id FROM d WHERE contains(s, ' under the mit license ') OR (contains(s, ' cc by ') AND NOT list_contains(w, 'the'))
""")
def index_boolean_matches(t: Tables) -> DataFrame:
    from lectern.operators.textindex import TextIndex, all_of, any_of, but_not, phrase, term

    index = TextIndex.build(t.documents, {"text": "text"}, "doc_id")
    trees = {
        1: but_not(term("license"), any_of(phrase("apache license"), phrase("public license"))),
        2: all_of(any_of(term("the"), term("der"), phrase("de la")), term("token")),
        3: any_of(phrase("under the mit license"), but_not(phrase("cc by"), term("the"))),
    }
    return index.matching(trees).select(F.col("query").cast("int").alias("query"), "id")


#: Bigrams of prose and the LaTeX that takes their place, in this order: nested and unbalanced constructs of every kind.
_MARKUP = [
    (". ", "\n"), ("qu", "\\["), ("ch", "\\]"), ("th", "\\emph{"), ("er", "}"), ("ll", "\\begin{quote}"), ("an", "\\end{quote}"), ("in", "$"), ("ss", "$$"), ("or", "% "),
    ("es", "\\cite["), ("st", "]{"), ("is", "\\%"), ("la", "\\item* "), ("wh", "\\begin{align*}"), ("nd", "\\end{align*}"),
]


def _sql_source() -> str:
    out = "coalesce(text, '')"
    for old, new in _MARKUP:
        out = f"replace({out}, '{old}', '{new}')" if "\n" not in new else f"replace({out}, '{old}', chr(10))"
    return out


def latex_sources(t: Tables, *more: Column) -> DataFrame:
    """Documents as LaTeX sources, and further columns of theirs; dealt before the text is worked on."""
    text = F.col("text")
    for old, new in _MARKUP:
        text = F.replace(text, F.lit(old), F.lit(new))
    return dealt(t.documents).select("doc_id", text.alias("source"), *more)


@query(rf"""
WITH s AS (SELECT doc_id, regexp_extract_all({_sql_source()}, '%[^\n]*|\\(?:begin|end)[ \t]*\{{[^{{}}\n]*\}}|\\\pL+\*?|\\[()\[\]]|\\[{{}}%\\#$^_&~]|\\(?:.|\n)?|\$\$|\$|[{{}}]|[\[\]]|[^ \t\n\r\f\v\\%${{}}\[\]]+') AS x FROM documents)
SELECT doc_id AS id, len(list_filter(x, lambda w: regexp_matches(w, '^\\(\pL|[^\pL()\[\]{{}}%\\#$^_&~]|$)') AND NOT regexp_matches(w, '^\\(begin|end)[ \t]*\{{'))) AS n_commands,
  len(list_filter(x, lambda w: starts_with(w, '%'))) AS n_comments, len(list_filter(x, lambda w: regexp_matches(w, '^\\[{{}}%\\#$^_&~]'))) AS n_escapes, len(list_filter(x, lambda w: regexp_matches(w, '^\\begin[ \t]*\{{'))) AS n_environments
FROM s WHERE len(x) > 0
""")
def latex_node_counts(t: Tables) -> DataFrame:
    """What each source holds: commands, comments, escapes and environments of its tree."""
    from lectern.functions.latex import kind_counts

    kinds = {"n_commands": "command", "n_comments": "comment", "n_escapes": "escape", "n_environments": "environment"}
    return kind_counts(latex_sources(t), "doc_id", "source", kinds).groupBy("id").agg(*[F.sum(n).alias(n) for n in kinds])


@query()
def latex_tree(t: Tables) -> DataFrame:
    from lectern.functions.latex import trees

    return trees(latex_sources(t), "doc_id")


#: A page with further markup around its own: handlers, external links, nested and unclosed dangerous elements, by its number.
_WRAPPED = "concat('<div onclick=\"x(1)\"><a href=\"https://', CAST(page_id AS STRING), '.example\">go</a>', coalesce(html, ''), '</div><form><p>in<form>deep</form>still</p></form><object>', CASE WHEN page_id % 2 = 0 THEN 'open' ELSE '</object>after' END)"


@query("""
WITH p AS (SELECT page_id AS id, regexp_replace(coalesce(html, ''), '<script>.*?</script>', '', 'g') AS h, len(regexp_extract_all(coalesce(html, ''), '<script>')) AS n FROM pages)
SELECT id, sha256('<div><a href="#">go</a>' || h || '</div>' || CASE WHEN id % 2 = 0 THEN '' ELSE 'after' END) AS digest, CAST(n + 2 AS INT) AS elements, 1::INT AS handlers, 1::INT AS links FROM p
""")
def sanitized_html(t: Tables) -> DataFrame:
    """Pages without dangerous elements (also nested and unclosed ones), handlers and external links."""
    from lectern.functions.html import sanitise

    done = sanitise(t.pages.select("page_id", F.expr(_WRAPPED).alias("html")), "page_id", "html")
    return done.select("id", F.sha2("html", 256).alias("digest"), "elements", "handlers", "links")


@query("""
WITH p AS (SELECT page_id AS id, regexp_replace(coalesce(html, ''), '<!--.*?-->|<script>.*?</script>', '', 'g') AS h, coalesce(html, '') AS o FROM pages),
e AS (SELECT id, lower(unnest(regexp_extract_all(h, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM p UNION ALL SELECT id, unnest(regexp_extract_all(o, '<(script)>', 1)) FROM p)
SELECT id, tag, count(*) AS n FROM e GROUP BY id, tag
""")
def html_elements(t: Tables) -> DataFrame:
    from lectern.functions.html import trees

    return trees(t.pages, "page_id", "html").groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n"))


#: Roles that inherit from roles: a tree, and some roles that inherit from a role far below them.
_ROLES = "SELECT c_custkey AS child, c_custkey // 4 AS parent FROM customer WHERE c_custkey >= 4 UNION ALL SELECT c_custkey, c_custkey * 16 + 3 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey * 16 + 3 <= (SELECT max(c_custkey) FROM customer)"


@query(f"""
WITH RECURSIVE e AS ({_ROLES}), r AS (SELECT child AS a, parent AS b FROM e UNION SELECT r.a, e.parent FROM r JOIN e ON r.b = e.child)
SELECT x.a AS node, min(x.b) AS component, count(*) AS size FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a
""")
def role_cycles(t: Tables) -> DataFrame:
    """Roles that inherit from themselves, with the cycle's name and size."""
    from lectern.operators.graphs import cycles

    n = t.customer.agg(F.max("c_custkey")).first()[0] or 0
    one = t.customer.where("c_custkey >= 4").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 4").alias("parent"))
    two = t.customer.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") * 16 + 3).alias("parent")).where(F.col("parent") <= n)
    return cycles(one.union(two))


@query(r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS piece, generate_subscripts(w, 1) AS i FROM s),
q AS (SELECT doc_id, piece, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
a AS (SELECT doc_id, piece, min(start) AS start FROM q WHERE regexp_full_match(piece, '[A-Z][a-z]{6,}') GROUP BY ALL), f AS (SELECT * FROM q WHERE regexp_full_match(piece, '[a-z]+(tion|heit|ment|ing)'))
SELECT a.doc_id AS id, a.piece AS author, string_agg(DISTINCT f.piece, ',' ORDER BY f.piece) AS affiliations FROM a JOIN f ON a.doc_id = f.doc_id AND f.start >= a.start - 250 AND f.start + length(f.piece) <= a.start + length(a.piece) + 250 GROUP BY a.doc_id, a.piece
""")
def author_affiliations(t: Tables) -> DataFrame:
    """Capitalised words as authors, words with certain endings as affiliations, within 250 characters of an author's first place."""
    from lectern.operators.intervals import mapped

    return mapped(t.documents, F.col("piece").rlike("^[A-Z][a-z]{6,}$"), F.col("piece").rlike("^[a-z]+(tion|heit|ment|ing)$"))


@query("""
WITH e AS (SELECT vec_id, vec_id // 2 AS presentation, embedding, CASE WHEN vec_id % 2 = 0 THEN 'combined' ELSE 'title' END AS kind FROM embeddings),
p AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0),
q AS (SELECT p.id AS query, arg_max(e.embedding, e.vec_id) AS q FROM p JOIN e ON e.presentation = p.id WHERE kind = 'combined' AND p.id % 20 = 0 GROUP BY p.id),
d AS (SELECT query, p.id, round(sqrt(list_sum(list_transform(list_zip(q, embedding), lambda z: power(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))), 6) AS distance FROM q JOIN p ON p.id <> query JOIN e ON e.presentation = p.id AND kind = 'combined')
SELECT query, id, distance, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d QUALIFY rank <= 5
""")
def similar_presentations(t: Tables) -> DataFrame:
    """The five presentations nearest to the latest combined vector of each presentation whose id is divisible by 20, exactly, by cells."""
    from lectern.operators.vectors import CellIndex

    living = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    combined = t.embeddings.where("vec_id % 2 = 0").withColumn("id", F.expr("vec_id div 2")).join(living, "id")
    latest = combined.where("id % 20 = 0").groupBy(F.col("id").alias("query")).agg(F.max_by("embedding", "vec_id").alias("q"))
    found = CellIndex(combined, "id", "embedding").search(latest, 5, decimals=6, others=True)
    return found.select("query", "id", rounded(F.col("distance"), 6).alias("distance"), "rank")


@query("""
WITH c AS (SELECT event_type, json_object('user', json_object('id', user_id, 'profile', json_object('level', user_id % 7)), 'event', json_object('value', value, 'props', CAST(coalesce(props, 'null') AS JSON))) AS ctx FROM events),
k AS (SELECT *, row_number() OVER (ORDER BY event_type) - 1 AS no FROM (SELECT DISTINCT event_type FROM events)),
p AS (SELECT n_nationkey AS policy, k.event_type, ['event.props.k', 'user.profile.level', 'event.value', 'user.missing.x', 'event.props'][1 + n_nationkey % 5] AS path, ['gt', 'lt', 'eq', 'exists', 'ne'][1 + (n_nationkey // 5) % 5] AS operator, CAST(n_nationkey % 7 * 3 AS VARCHAR) AS value FROM nation JOIN k ON k.no = n_nationkey % (SELECT count(*) FROM k)),
j AS (SELECT policy, operator, path, p.value, json_extract_string(ctx, '$.' || path) AS got FROM c JOIN p USING (event_type))
SELECT policy, path, operator, count(*) AS n, count(*) FILTER (WHERE CASE operator WHEN 'exists' THEN got IS NOT NULL WHEN 'eq' THEN got = value WHEN 'ne' THEN got <> value WHEN 'gt' THEN TRY_CAST(got AS DOUBLE) > TRY_CAST(value AS DOUBLE) WHEN 'lt' THEN TRY_CAST(got AS DOUBLE) < TRY_CAST(value AS DOUBLE) END) AS met FROM j GROUP BY policy, path, operator
""")
def policy_conditions(t: Tables) -> DataFrame:
    """How many events of its type meet each policy's condition; a policy names the attribute by a dotted path of its own."""
    from lectern.operators.attributes import evaluated

    context = F.expr("""parse_json(concat('{"user":{"id":', coalesce(CAST(user_id AS STRING), 'null'), ',"profile":{"level":', coalesce(CAST(user_id % 7 AS STRING), 'null'), '}},"event":{"value":', coalesce(CAST(value AS STRING), 'null'), ',"props":', coalesce(props, 'null'), '}}'))""")
    types = t.events.select("event_type").distinct().orderBy("event_type").agg(F.array_sort(F.collect_list("event_type")).alias("types"))  # a handful of types
    key = F.col("n_nationkey").cast("int")
    pick = lambda values, at: F.array(*[F.lit(v) for v in values])[at]
    policies = t.nation.crossJoin(F.broadcast(types)).select(
        F.col("n_nationkey").alias("policy"), F.col("types")[key % F.size("types")].alias("event_type"), pick(["event.props.k", "user.profile.level", "event.value", "user.missing.x", "event.props"], key % 5).alias("path"),
        pick(["gt", "lt", "eq", "exists", "ne"], F.expr("CAST(n_nationkey div 5 AS INT) % 5")).alias("operator"), (key % 7 * 3).cast("string").alias("value"),
    )
    met = evaluated(t.events.select("event_type", context.alias("context")), policies, "event_type")
    return met.groupBy("policy", "path", "operator").agg(F.count(F.lit(1)).alias("n"), F.count_if("met").alias("met"))
