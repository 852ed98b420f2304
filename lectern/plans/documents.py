"""Text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.arrow import dealt
from lectern.operators import scoring as S
from lectern.plans.registry import Tables, query

# The SQL states words and weights as literals of its own and takes texts apart into lists, where the library counts patterns.
_COUNTS = r"""
w AS (SELECT doc_id, lang, text, length(text) AS n_points, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS sentences,
  list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS tok, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS wtok FROM documents),
b AS (SELECT *, list_transform(words, lambda x: regexp_replace(lower(x), '[!-/:-@\[-`{-~]', '', 'g')) AS bare FROM w),
c AS (SELECT *, len(words) AS n_words, len(sentences) AS n_sentences,
  CAST(coalesce(list_sum(list_transform(bare, lambda x: CASE WHEN x = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') THEN 1 ELSE 0 END) END)), 0) AS BIGINT) AS n_syllables FROM b)
"""
_EASE = "(206.835 - 1.015 * CASE WHEN n_sentences = 0 THEN 0 ELSE n_words / n_sentences END - 84.6 * CASE WHEN n_words = 0 THEN 0 ELSE n_syllables / n_words END)"
_READ = f"(CASE WHEN n_points < 100 THEN 0 WHEN greatest(0, least(100, {_EASE})) >= 30 THEN least(100, greatest(0, least(100, {_EASE})) + 40) WHEN greatest(0, least(100, {_EASE})) >= 10 THEN greatest(0, least(100, {_EASE})) * 2 + 10 ELSE greatest(0, least(100, {_EASE})) * 3 END)"
_GRADE = "greatest(0, 0.39 * CASE WHEN n_sentences = 0 THEN 0 ELSE n_words / n_sentences END + 11.8 * CASE WHEN n_words = 0 THEN 0 ELSE n_syllables / n_words END - 15.59)"


def _listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _share(expr: str, total: str) -> str:
    return f"(CASE WHEN {total} = 0 THEN 0.0 ELSE {expr} * 1.0 / {total} END)"


_HAS = lambda listed: f"len(list_filter(wtok, lambda x: list_contains([{listed}], x)))"
_PHRASES = lambda listed: rf"len(regexp_extract_all(lower(text), '(?:^|[^\p{{L}}\p{{N}}_])(?:{listed})(?:[^\p{{L}}\p{{N}}_]|$)'))"
_GOOD = "(" + " + ".join([
    _HAS("'however', 'therefore', 'furthermore', 'moreover', 'nevertheless', 'consequently'"), _PHRASES("in addition|on the other hand|in contrast|as a result"),
    _HAS("'may', 'might', 'could', 'would', 'should', 'possibly', 'potentially', 'likely', 'suggest', 'indicate', 'appear', 'seem', 'tend'"),
    "len(list_filter(wtok, lambda x: regexp_matches(x, '.(tion|sion|ment|ance|ence|ity|ness)$')))",
]) + ")"
_BAD = "(" + _HAS("'very', 'really', 'quite', 'rather', 'pretty', 'somewhat', 'fairly'") + " + " + _PHRASES("in my opinion") + r" + len(regexp_extract_all(text, '[\p{L}\p{N}_]+''[\p{L}\p{N}_]+')))"
_TONE = f"greatest(0.0, least(100.0, 100 * {_share(_GOOD, 'n_words')} - 50 * {_share(_BAD, 'n_words')}))"
_MEAN = "list_avg(list_transform(sentences, lambda x: len(regexp_split_to_array(x, ' '))))"
_HARD = _share("len(list_filter(words, lambda x: length(x) > 6))", "n_words")
_CLARITY = f"""(CASE WHEN n_sentences = 0 THEN 0.0 ELSE 0.6 * CASE WHEN {_MEAN} BETWEEN 15 AND 25 THEN 100.0 WHEN {_MEAN} BETWEEN 10 AND 35 THEN 80.0 ELSE greatest(0.0, 100 - 2 * abs({_MEAN} - 20)) END
  + 0.4 * CASE WHEN {_HARD} BETWEEN 0.3 AND 0.5 THEN 100.0 ELSE greatest(0.0, 100 - 200 * abs({_HARD} - 0.4)) END END)"""
_WORDY = ["in order to", "due to the fact that", "it is important to note that", "it should be mentioned that", "it is worth noting that", "the fact that", "in the event that", "for the purpose of"]
_CONCISE = f"(CASE WHEN n_points = 0 THEN 0.0 ELSE greatest(0.0, 100 - 10 * ({' + '.join(map(_PHRASES, _WORDY))}) / greatest(n_words / 100.0, 1.0)) END)"
_ACADEMIC = "len(list_filter(tok, lambda x: regexp_matches(x, '(tion|ment|ness|ity|ism|ance|ence)$')))"
_VOCAB = f"(40 * {_share('len(list_filter(tok, lambda x: length(x) >= 7))', 'len(tok)')} + 30 * {_share('len(list_distinct(tok))', 'len(tok)')} + 30 * {_share(_ACADEMIC, 'len(tok)')})"
_SECTION = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(string_split(text, chr(10))[1]), '{k}')" for k in keys) + f" THEN {weight}"
    for weight, keys in [(15, ["abstract", "summary", "overview"]), (20, ["introduction", "background", "motivation"]), (0, ["literature review", "related work", "previous work"]), (20, ["methodology", "methods", "approach", "experimental design"]), (15, ["results", "findings", "outcomes", "analysis"]), (10, ["discussion", "interpretation", "implications"]), (5, ["conclusion", "final remarks"]), (5, ["references", "bibliography", "works cited"])]
)
_CITED = r"(len(regexp_extract_all(text, '\[\d+(?:\s*[-,]\s*\d+)*\]')) + len(regexp_extract_all(text, '\([A-Z][A-Za-z]+(?: et al\.)?,? \d{4}[a-z]?\)')) + len(regexp_extract_all(text, '\([A-Z][A-Za-z]+ (?:&|and) [A-Z][A-Za-z]+, \d{4}\)')))"
_COHERENCE = r"""
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
f AS (SELECT doc_id, w, count(*) AS n, min(i) AS pos FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(array_to_string(parts, ' ')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM l WHERE len(parts) > 1)) WHERE regexp_full_match(w, '[a-z]{4,}') GROUP BY 1, 2 HAVING count(*) > 1),
k AS (SELECT doc_id, list(w) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM f) WHERE r <= 20 GROUP BY 1),
h AS (SELECT l.doc_id, CASE WHEN len(parts) < 2 THEN 50.0 ELSE greatest(0.0, least(100.0, 40.0 * len(list_filter(parts, lambda p: regexp_matches(lower(p), 'however|therefore|furthermore|moreover|nevertheless|consequently|additionally|similarly|in contrast|on the other hand|as a result|in addition|finally'))) / len(parts)
  + 60.0 * CASE WHEN top IS NULL THEN 0.0 ELSE list_sum(list_transform(parts, lambda p: len(list_filter(top, lambda w: contains(lower(p), w))))) / len(top) / len(parts) END)) END AS coherence FROM l LEFT JOIN k USING (doc_id))
"""
_OVERALL = f"""(0.15 * {_READ} + 0.2 * coherence + 0.15 * (100.0 * CASE {_SECTION} ELSE 0 END / 100) + 0.15 * {_TONE} + 0.1 * (CASE WHEN {_CITED} = 0 THEN 30.0 ELSE least(80.0, 10 * {_share('1000 * ' + _CITED, 'n_words')}) + 14 END)
  + 0.1 * (30.0 + CASE WHEN CASE {_SECTION} ELSE -1 END < 0 THEN 0.0 ELSE 70.0 END) + 0.1 * {_CLARITY} + 0.05 * {_CONCISE})"""


@query(f"""WITH {_COUNTS} SELECT lang, count(*) AS documents, CAST(sum(n_words) AS BIGINT) AS words, CAST(sum(n_sentences) AS BIGINT) AS sentences, CAST(sum(n_syllables) AS BIGINT) AS syllables,
  round(avg({_EASE}), 4) AS ease, round(avg({_READ}), 4) AS readability, round(avg({_GRADE}), 4) AS grade FROM c GROUP BY lang""")
def readability_by_lang(t: Tables) -> DataFrame:
    scored = S.readability(S.counted(dealt(t.documents.select("lang", "text"))))
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"), F.sum("n_sentences").alias("sentences"), F.sum("n_syllables").alias("syllables"),
        *(F.round(F.avg(c), 4).alias(c) for c in ("ease", "readability", "grade")),
    )


@query(r"""
WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS x FROM documents), b AS (SELECT regexp_replace(lower(x), '[!-/:-@\[-`{-~]', '', 'g') AS x FROM w)
SELECT CAST(CASE WHEN x = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') THEN 1 ELSE 0 END) END AS BIGINT) AS syllables, count(*) AS n FROM b GROUP BY 1
""")
def syllable_histogram(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(X.words(X.text_of("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    return words.groupBy(X.syllables(F.col("w")).cast("long").alias("syllables")).agg(F.sum("k").alias("n"))


_ONE = lambda listed, first, stop: f"0.4 * {_share(_HAS(listed), 'len(wtok)')} + 0.3 * least(1.0, {_share(_HAS(first), 'len(wtok)')}) + 0.3 * {_share(_HAS(stop), 'len(wtok)')}"
_ES, _FR, _DE = "'el', 'de', 'que', 'y', 'a', 'en', 'un', 'es', 'se', 'no'", "'le', 'de', 'et', 'à', 'un', 'il', 'être', 'en', 'avoir'", "'der', 'die', 'und', 'in', 'den', 'von', 'zu', 'das', 'mit', 'sich'"
_LANG = f"""struct_pack(s := {_ONE("'the', 'and', 'of', 'to', 'a', 'in', 'is', 'it', 'you', 'that'", "'the', 'and', 'of', 'to', 'a'", "'the', 'be', 'to', 'of', 'and', 'a', 'in', 'that', 'have', 'i'")}, r := 0, l := 'en'),
  struct_pack(s := {_ONE(_ES, "'el', 'de', 'que', 'y', 'a'", _ES)}, r := -1, l := 'es'), struct_pack(s := {_ONE(_FR, "'le', 'de', 'et', 'à', 'un'", _FR)}, r := -2, l := 'fr'), struct_pack(s := {_ONE(_DE, "'der', 'die', 'und', 'in', 'den'", _DE)}, r := -3, l := 'de')"""


@query(f"""WITH {_COUNTS}, g AS (SELECT doc_id, length(trim(text)) AS n_trimmed, len(wtok) AS n, list_sort([{_LANG}], 'DESC') AS s FROM c)
SELECT doc_id, CASE WHEN n_trimmed < 50 OR n < 10 THEN 'unknown' ELSE s[1].l END AS detected, round(s[1].s, 4) AS score, CASE WHEN s[2].s > 0.1 THEN s[2].l END AS secondary, round(CASE WHEN s[1].s > 0 THEN s[2].s / s[1].s ELSE 0 END, 4) AS mixed FROM g""")
def language_detection(t: Tables) -> DataFrame:
    ranked = S.counted(dealt(t.documents.select("doc_id", "text"))).withColumn("r", S.languages())
    first, second = F.col("r")[0], F.col("r")[1]
    known = F.when((F.col("n_trimmed") < 50) | (F.col("n_tokens") < 10), "unknown").otherwise(first["lang"])
    return ranked.select("doc_id", known.alias("detected"), F.round(first["score"], 4).alias("score"), F.when(second["score"] > 0.1, second["lang"]).alias("secondary"), F.round(X.ratio(second["score"], first["score"]), 4).alias("mixed"))


def _single(name: str, sql: str, column):
    def f(t: Tables) -> DataFrame:
        return S.counted(dealt(t.documents.select("doc_id", "text"))).select("doc_id", F.round(column(), 4).alias("score"))

    f.__name__ = name
    return query(f"WITH {_COUNTS} SELECT doc_id, round({sql}, 4) AS score FROM c")(f)


academic_tone = _single("academic_tone", _TONE, S.tone)
clarity_score = _single("clarity_score", _CLARITY, S.clarity)
conciseness_score = _single("conciseness_score", _CONCISE, S.conciseness)
vocabulary_sophistication = _single("vocabulary_sophistication", _VOCAB, S.vocabulary)


@query(f"WITH {_COUNTS}, {_COHERENCE} SELECT doc_id, round({_OVERALL}, 3) AS overall FROM c JOIN h USING (doc_id)")
def intelligence_overall(t: Tables) -> DataFrame:
    return S.overall(dealt(t.documents.select("doc_id", "text"))).select("doc_id", F.round("overall", 3).alias("overall"))


_LEVEL = "CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 70 THEN 'good' WHEN overall >= 50 THEN 'fair' WHEN overall >= 30 THEN 'poor' ELSE 'critical' END"


@query(f"""WITH {_COUNTS}, {_COHERENCE}, q AS (SELECT lang, {_LEVEL} AS level FROM (SELECT lang, {_OVERALL} AS overall FROM c JOIN h USING (doc_id)))
SELECT l.lang, v.level, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (VALUES ('excellent'), ('good'), ('fair'), ('poor'), ('critical')) v(level) LEFT JOIN (SELECT lang, level, count(*) AS n FROM q GROUP BY 1, 2) q ON q.lang = l.lang AND q.level = v.level""")
def quality_level_distribution(t: Tables) -> DataFrame:
    levels = [name for _, name in X.QUALITY_LEVELS] + ["critical"]
    scored = S.overall(dealt(t.documents.select("doc_id", "lang", "text")))
    wide = scored.groupBy("lang").agg(*(F.count_if(F.col("level") == v).alias(v) for v in levels))
    return wide.select("lang", F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col(v).alias("n")) for v in levels))).alias("x")).select("lang", "x.*")


@query(f"""WITH {_COUNTS}, s AS (SELECT doc_id, n_sentences, list_transform(sentences, lambda x: len(regexp_split_to_array(x, ' '))) AS l FROM c WHERE n_sentences > 0)
SELECT doc_id, round(list_avg(l), 4) AS mean_words, round(CASE WHEN list_avg(l) = 0 THEN 0 ELSE list_stddev_pop(l) / list_avg(l) END, 4) AS variation, len(list_filter(l, lambda x: x < 3)) AS fragments, len(list_filter(l, lambda x: x > 40)) AS run_ons FROM s""".replace("list_stddev_pop(l)", "list_aggregate(l, 'stddev_pop')"))
def sentence_variety(t: Tables) -> DataFrame:
    counted = t.documents.select("doc_id", X.sentences(X.text_of("text")).alias("s")).where(F.size("s") > 0)
    n = F.transform("s", lambda x: F.size(F.split(x, " ")).cast("double"))
    mean = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n")
    var = F.aggregate("n", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("n")
    out = counted.withColumn("n", n).withColumn("m", mean)
    return out.select("doc_id", F.round("m", 4).alias("mean_words"), F.round(F.sqrt(var) / F.col("m"), 4).alias("variation"), F.size(F.filter("n", lambda x: x < 3)).cast("long").alias("fragments"), F.size(F.filter("n", lambda x: x > 40)).cast("long").alias("run_ons"))


_PASSIVE = r"\b(is|are|was|were|been|be|being) [a-z]+ed\b"


@query(rf"""WITH {_COUNTS} SELECT doc_id, len(list_filter(sentences, lambda x: regexp_matches(lower(x), '{_PASSIVE}'))) AS passive, n_sentences AS sentences,
  CASE WHEN n_sentences = 0 THEN 0.0 ELSE round(len(list_filter(sentences, lambda x: regexp_matches(lower(x), '{_PASSIVE}'))) * 1.0 / n_sentences, 4) END AS share FROM c""")
def passive_voice_share(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", X.sentences(X.text_of("text")).alias("s"))
    # only ASCII letters are parts of words here: Java's \b would take others for such, too
    pattern = _PASSIVE.replace(r"\b(", "(?<![A-Za-z0-9_])(").replace(r"ed\b", "ed(?![A-Za-z0-9_])")
    hit = F.size(F.filter("s", lambda x: F.lower(x).rlike(pattern))).cast("long")
    return s.select("doc_id", hit.alias("passive"), F.size("s").cast("long").alias("sentences"), X.rounded(X.ratio(hit, F.size("s")), 4).alias("share"))


@query(f"""WITH {_COUNTS}, i AS (SELECT doc_id, unnest(list_concat(
  CASE WHEN len(list_filter(words, lambda x: length(x) > 12)) > 0.05 * n_words THEN ['long_words'] ELSE [] END,
  CASE WHEN len(list_filter(tok, lambda x: regexp_matches(x, '(tion|ment|ness|ity)$'))) > 0.15 * len(tok) THEN ['technical_terms'] ELSE [] END,
  CASE WHEN len(list_filter(sentences, lambda x: len(regexp_split_to_array(x, ' ')) > 40)) > 0 THEN ['run_on'] ELSE [] END,
  CASE WHEN n_points < 100 THEN ['too_short'] ELSE [] END)) AS issue FROM c) SELECT issue, count(*) AS documents, min(doc_id) AS first_doc FROM i GROUP BY issue""")
def clarity_issues(t: Tables) -> DataFrame:
    d = S.counted(dealt(t.documents.select("doc_id", "text"))).withColumns({"tok": X.tokens(X.text_of("text")), "sentences": X.sentences(X.text_of("text"))})
    issues = [
        F.when(F.regexp_count("text", F.lit(r"\S{13,}")) > 0.05 * F.col("n_words"), "long_words"),
        F.when(F.size(F.filter("tok", lambda w: w.rlike("(tion|ment|ness|ity)$"))) > 0.15 * F.size("tok"), "technical_terms"),
        F.when(F.exists("sentences", lambda s: F.size(F.split(s, " ")) > 40), "run_on"),
        F.when(F.col("n_points") < 100, "too_short"),
    ]
    rows = d.select("doc_id", F.explode(F.array_compact(F.array(*issues))).alias("issue"))
    return rows.groupBy("issue").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


_STOP = ["the", "and", "for", "are", "with", "that", "this", "from", "was", "were", "have", "has", "not", "but", "its"]


@query(rf"""WITH k AS (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: length(x) >= 4 AND NOT list_contains({_listed(_STOP)}, x))) AS term FROM documents),
n AS (SELECT lang, term, count(*) AS n FROM k GROUP BY 1, 2) SELECT lang, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM n) WHERE rank <= 20""")
def topk_keywords_per_lang(t: Tables) -> DataFrame:
    return S.keywords(t.documents, ["lang"], "text", 20)


@query("""
WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), c AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS c FROM h), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY 1, 2)
SELECT d.doc_id, coalesce(entropy, 0) AS entropy FROM documents d LEFT JOIN (SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 3) AS entropy FROM n GROUP BY doc_id) USING (doc_id)
""")
def character_entropy(t: Tables) -> DataFrame:
    return S.entropy(t.documents, "doc_id").select("doc_id", (F.round("entropy", 3) + 0.0).alias("entropy"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l), t AS (SELECT doc_id, i, list_distinct(list_filter(regexp_split_to_array(lower(x), '[^\p{L}]+'), lambda y: y <> '')) AS a FROM p),
n AS (SELECT doc_id, i, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM t)
SELECT doc_id, count(*) AS pairs, round(avg(CASE WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / least(len(a), len(b)) END), 4) AS continuity FROM n WHERE b IS NOT NULL GROUP BY doc_id
""")
def topic_continuity(t: Tables) -> DataFrame:
    sets = t.documents.select("doc_id", F.transform(X.lines(X.text_of("text"), "\n"), X.tokens).alias("s")).where(F.size("s") > 1)
    pairs = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), X.overlap)
    out = sets.select("doc_id", pairs.alias("p"))
    return out.select("doc_id", F.size("p").cast("long").alias("pairs"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p"), 4).alias("continuity"))


@query(r"""
SELECT doc_id, length(text) // 4 AS tokens, substr(sha256('extract|' || text || '|{"n": 1}'), 1, 16) AS cache_key, round(floor(0.7 * (length(text) // 4)) * 0.003 / 1000 + floor(0.3 * (length(text) // 4)) * 0.015 / 1000, 4) AS cost FROM documents
""")
def token_cost_estimate(t: Tables) -> DataFrame:
    n = X.estimated_tokens(X.text_of("text"))
    key = F.substring(F.sha2(F.concat(F.lit("extract|"), F.col("text"), F.lit('|{"n": 1}')), 256), 1, 16)
    return t.documents.select("doc_id", n.alias("tokens"), key.alias("cache_key"), F.round(F.floor(0.7 * n) * 0.003 / 1000 + F.floor(0.3 * n) * 0.015 / 1000, 4).alias("cost"))


@query("""
SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'credential' WHEN contains(lower(text), 'licens') OR contains(lower(text), 'all rights') THEN 'license' WHEN contains(text, '@') THEN 'contact' ELSE 'other' END AS category FROM documents
""")
def first_match_category(t: Tables) -> DataFrame:
    low = F.lower(F.col("text"))
    cases = [("credential", ["password"]), ("license", ["licens", "all rights"]), ("contact", ["@"])]
    return t.documents.select("doc_id", X.first_match(low, cases, "other").alias("category"))


@query("""
WITH m AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p, (length(text) - length(replace(lower(text), 'license', ''))) // 7 AS tf FROM documents WHERE contains(lower(text), 'license'))
SELECT doc_id, tf, round(tf * 1.0 / (1 + length(text)), 6) AS rank, regexp_replace(substr(text, greatest(1, p - 75), 150), '(?i)(license)', '<mark>\\1</mark>', 'g') AS fragment FROM m ORDER BY rank DESC, doc_id LIMIT 50
""")
def full_text_search_highlight(t: Tables) -> DataFrame:
    d = t.documents.where(F.lower("text").contains("license"))
    tf = F.floor((F.length("text") - F.length(F.replace(F.lower("text"), F.lit("license"), F.lit("")))) / 7).cast("long")
    ranked = d.select("doc_id", tf.alias("tf"), F.round(tf / (1 + F.length("text")), 6).alias("rank"), X.highlight(F.col("text"), "license").alias("fragment"))
    return ranked.orderBy(F.desc("rank"), "doc_id").limit(50)


@query("""
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'size', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END, count(*) FROM documents GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'source', source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10)
""")
def search_facets(t: Tables) -> DataFrame:
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    named = lambda name, c: t.documents.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("facet"), "value", "n")
    return named("lang", F.col("lang")).unionByName(named("size", size)).unionByName(named("source", F.col("source")).orderBy(F.desc("n"), "value").limit(10))


@query(r"""
SELECT page_id, length(html) AS before, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS after,
  len(regexp_extract_all(html, '(?i)<a [^>]*href=')) AS links, contains(lower(html), '<script') AS has_script, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages
""")
def sanitize_pages(t: Tables) -> DataFrame:
    from lectern.functions.sanitize import plain_text

    html = F.col("html")
    return t.pages.select(
        "page_id", F.length(html).cast("long").alias("before"), F.length(plain_text(html)).cast("long").alias("after"), F.regexp_count(html, F.lit("(?i)<a [^>]*href=")).cast("long").alias("links"),
        F.lower(html).contains("<script").alias("has_script"), F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1).alias("title"),
    )


@query(r"""
SELECT CASE WHEN starts_with(url, 'https') THEN 'https' ELSE 'http' END AS scheme, regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n,
  count(*) FILTER (WHERE ends_with(regexp_extract(url, '^https?://([^/]+)', 1), '.org')) AS academic FROM pages GROUP BY 1, 2
""")
def hosts_by_scheme(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t.pages.groupBy(F.when(F.col("url").startswith("https"), "https").otherwise("http").alias("scheme"), host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(host.endswith(".org")).alias("academic"))


@query("""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM l),
r AS (SELECT doc_id, i, CAST(0 AS INTEGER) AS chunk, x AS text FROM u WHERE i = 1
  UNION ALL SELECT u.doc_id, u.i, CASE WHEN length(r.text || chr(10) || chr(10) || u.x) // 4 <= 200 THEN r.chunk ELSE r.chunk + 1 END, CASE WHEN length(r.text || chr(10) || chr(10) || u.x) // 4 <= 200 THEN r.text || chr(10) || chr(10) || u.x ELSE u.x END FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1)
SELECT doc_id, chunk, arg_max(text, i) AS text FROM r GROUP BY doc_id, chunk
""")
def paragraph_chunks(t: Tables) -> DataFrame:
    """Lines packed into chunks of at most 200 estimated tokens, in order."""
    return t.documents.select("doc_id", F.posexplode(S.chunks("text", "\n", 200)).alias("chunk", "text"))
