"""Documents as papers: structure, tone, abstracts, layout, files and search, scored text by text.

Lines of a document are its paragraphs, its first line is its title; a page's lines are drawn from the items of an order, whose
numbers serve as places on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import academic, sanitize, security
from lectern.functions import text as X
from lectern.operators import layout
from lectern.plans.registry import Tables, query

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


def _low() -> Column:
    return F.lower("text")


@query(f"""
WITH t AS (SELECT doc_id, text, {_TOK} AS tok, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, unnest(list_concat(CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}_]+''[\\p{{L}}\\p{{N}}_]+') THEN ['contractions'] ELSE [] END, CASE WHEN len(list_filter(tok, lambda x: list_contains(['i', 'me', 'my', 'we', 'our', 'us'], x))) > 0.02 * len(w) THEN ['first_person'] ELSE [] END)) AS issue FROM t)
SELECT issue, count(*) AS documents, min(doc_id) AS first FROM s GROUP BY issue
""")
def academic_tone_issues(t: Tables) -> DataFrame:
    """Contractions, and more than two in a hundred words in the first person."""
    first = X.word_hits(X.padded(F.col("text")), ["i", "me", "my", "we", "our", "us"])
    found = F.array_compact(F.array(F.when(F.col("text").rlike(r"[\p{L}\p{N}_]+'[\p{L}\p{N}_]+"), "contractions"), F.when(first > 0.02 * F.regexp_count("text", F.lit(r"\S+")), "first_person")))
    return t.documents.select("doc_id", F.explode(found).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))


_TYPES = [
    ("thesis", ["thesis", "dissertation", "chapter", "committee", "advisor", "defense"]), ("journal_article", ["abstract", "introduction", "methodology", "results", "discussion", "conclusion"]),
    ("conference_paper", ["conference", "proceedings", "workshop", "symposium", "acm", "ieee"]), ("technical_report", ["report", "technical", "specification", "analysis", "evaluation"]), ("review_paper", ["review", "survey"]),
]


@query(f"""
WITH t AS (SELECT doc_id, {_TOK} AS tok, contains(lower(text), 'abstract') AS a, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 10 AS many FROM documents), h AS (SELECT doc_id, a, many, lambda_hits FROM (SELECT doc_id, a, many,
  [len(list_filter(tok, lambda x: list_contains(['thesis', 'dissertation', 'chapter', 'committee', 'advisor', 'defense'], x))) + CASE WHEN many THEN 2 ELSE 0 END, len(list_filter(tok, lambda x: list_contains(['abstract', 'introduction', 'methodology', 'results', 'discussion', 'conclusion'], x))) + CASE WHEN a THEN 3 ELSE 0 END,
   len(list_filter(tok, lambda x: list_contains(['conference', 'proceedings', 'workshop', 'symposium', 'acm', 'ieee'], x))) + CASE WHEN a THEN 2 ELSE 0 END, len(list_filter(tok, lambda x: list_contains(['report', 'technical', 'specification', 'analysis', 'evaluation'], x))), len(list_filter(tok, lambda x: list_contains(['review', 'survey'], x)))] AS lambda_hits FROM t))
SELECT doc_id, list_max(lambda_hits) AS score, CASE WHEN list_max(lambda_hits) = 0 THEN 'unknown' ELSE list_extract(['thesis', 'journal_article', 'conference_paper', 'technical_report', 'review_paper'], CAST(list_position(lambda_hits, list_max(lambda_hits)) AS INTEGER)) END AS type FROM h
""")
def document_types(t: Tables) -> DataFrame:
    """Word hits of each type, two more for a thesis of over ten paragraphs, three and two for an abstract; the first type wins ties."""
    p, a, many = F.col("p"), F.col("a"), F.col("many")
    extra = {"thesis": F.when(many, 2).otherwise(0), "journal_article": F.when(a, 3).otherwise(0), "conference_paper": F.when(a, 2).otherwise(0)}
    d = t.documents.select("doc_id", X.padded(F.col("text")).alias("p"), _low().contains("abstract").alias("a"), (F.size(X.lines(F.col("text"), "\n")) > 10).alias("many"))
    scores = [F.struct((X.word_hits(p, words) + extra.get(name, F.lit(0))).cast("long").alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("type")) for i, (name, words) in enumerate(_TYPES)]
    best = d.select("doc_id", F.array_max(F.array(*scores)).alias("b"))
    return best.select("doc_id", F.col("b.score").alias("score"), F.when(F.col("b.score") == 0, "unknown").otherwise(F.col("b.type")).alias("type"))


@query(f"""
WITH t AS (SELECT doc_id, lower(text) AS low, len({_WORDS}) AS n FROM documents), g AS (SELECT unnest(list_concat(CASE WHEN NOT regexp_matches(low, 'problem|issue|challenge|gap|need') THEN ['missing_problem_statement'] ELSE [] END, CASE WHEN NOT regexp_matches(low, 'objective|goal|aim|purpose|research question') THEN ['missing_objectives'] ELSE [] END,
  CASE WHEN NOT regexp_matches(low, 'data|sample|participant|measurement|collection') THEN ['missing_data_description'] ELSE [] END, CASE WHEN n < 50 THEN ['short'] ELSE [] END)) AS gap FROM t) SELECT gap, count(*) AS documents FROM g GROUP BY gap
""")
def section_gaps(t: Tables) -> DataFrame:
    """What a text lacks as an introduction or a method section, by strings that it does not contain."""
    lacks = lambda words: ~X.any_of([_low().contains(w) for w in words])
    found = F.array_compact(F.array(
        F.when(lacks(["problem", "issue", "challenge", "gap", "need"]), "missing_problem_statement"), F.when(lacks(["objective", "goal", "aim", "purpose", "research question"]), "missing_objectives"),
        F.when(lacks(["data", "sample", "participant", "measurement", "collection"]), "missing_data_description"), F.when(F.regexp_count("text", F.lit(r"\S+")) < 50, "short"),
    ))
    return t.documents.select(F.explode(found).alias("gap")).groupBy("gap").agg(F.count(F.lit(1)).alias("documents"))


@query(f"""
WITH t AS (SELECT doc_id, lower(text) AS low, text, len({_WORDS}) AS n, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')) AS s FROM documents),
p AS (SELECT *, (CASE WHEN regexp_matches(low, 'background|problem|important') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, 'method|we use|approach') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, 'result|we find|show') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, 'conclu|implic|suggest') THEN 1 ELSE 0 END) / 4.0 AS share,
  CASE WHEN n BETWEEN 150 AND 250 THEN 100.0 WHEN n BETWEEN 100 AND 300 THEN 80.0 WHEN n BETWEEN 50 AND 400 THEN 60.0 ELSE 40.0 END AS length_score, CASE WHEN s = 0 THEN 0.0 ELSE n * 1.0 / s END AS mean,
  {' + '.join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in ("in order to", "due to the fact that", "it is important to note that", "it should be mentioned that", "it is worth noting that", "the fact that", "in the event that", "for the purpose of"))} AS wordy FROM t)
SELECT doc_id, round(70 * share + 0.3 * length_score, 4) AS completeness, round(length_score, 4)::DOUBLE AS conciseness, round(greatest(50.0, greatest(0.0, least(100.0, CASE WHEN mean < 15 THEN 100 - 3 * (15 - mean) WHEN mean > 25 THEN 100 - 3 * (mean - 25) ELSE 100 END)) - least(30, 5 * wordy)), 4) AS clarity, round(100 * share, 4) AS structure FROM p
""")
def abstract_scores(t: Tables) -> DataFrame:
    """Every document scored as an abstract: four parts, length, sentences and wordy phrases."""
    s = t.documents.select("doc_id", academic.abstract_scores(F.col("text")).alias("s"))
    return s.select("doc_id", *(F.round(F.col(f"s.{c}"), 4).alias(c) for c in ("completeness", "conciseness", "clarity", "structure")))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM l),
n AS (SELECT doc_id, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM u),
c AS (SELECT doc_id, 20 * len(list_filter(['however', 'furthermore', 'moreover', 'therefore', 'consequently', 'nevertheless', 'nonetheless', 'additionally', 'similarly', 'conversely'], lambda w: contains(substr(lower(y), 1, 100), w))) + 10 * least(5, len(list_intersect(
  list_distinct(list_filter(regexp_split_to_array(lower(x), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 4)), list_distinct(list_filter(regexp_split_to_array(lower(y), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 4))))) AS s FROM n WHERE y IS NOT NULL)
SELECT doc_id, count(*) AS pairs, round(avg(least(100, s)), 4) AS coherence FROM c GROUP BY doc_id
""")
def paragraph_coherence(t: Tables) -> DataFrame:
    """Neighbouring paragraphs: 20 for each linking word at the start of the second, 10 for each shared word of four letters, up to five."""
    linking = ["however", "furthermore", "moreover", "therefore", "consequently", "nevertheless", "nonetheless", "additionally", "similarly", "conversely"]
    words = lambda p: F.array_distinct(F.filter(F.split(F.lower(p), r"[^\p{L}\p{N}_]+"), lambda w: F.char_length(w) >= 4))
    each = t.documents.select("doc_id", F.transform(X.lines(F.col("text"), "\n"), lambda p: F.struct(words(p).alias("w"), F.substring(F.lower(p), 1, 100).alias("head"))).alias("p")).where(F.size("p") > 1)
    head = lambda h: sum((F.when(h.contains(w), 20).otherwise(0) for w in linking), F.lit(0))
    pair = lambda a, b: F.least(F.lit(100), head(b["head"]) + 10 * F.least(F.lit(5), F.size(F.array_intersect(a["w"], b["w"]))))
    scores = each.select("doc_id", F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), pair).alias("s"))
    return scores.select("doc_id", F.size("s").cast("long").alias("pairs"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"), 4).alias("coherence"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents), l AS (SELECT doc_id, list_transform(s, lambda x: len(regexp_split_to_array(x, ' '))) AS n, list_transform(s, lambda x: CASE WHEN len(string_split(x, ',')) - 1 = 0 THEN 'simple' WHEN len(string_split(x, ',')) - 1 = 1 THEN 'compound' ELSE 'complex' END) AS k FROM s WHERE len(s) > 1)
SELECT doc_id, round(least(50.0, 50 * list_aggregate(n, 'stddev_pop') / list_avg(n)) + 50.0 * len(list_distinct(k)) / 3, 4) AS variety FROM l
""")
def sentence_variety_score(t: Tables) -> DataFrame:
    """50 by the variation of lengths (population deviation over mean), 50 by how many of simple, compound and complex occur."""
    s = t.documents.select("doc_id", X.sentences(F.col("text")).alias("s")).where(F.size("s") > 1)
    commas = lambda x: F.size(F.split(x, ",")) - 1
    s = s.select("doc_id", F.transform("s", lambda x: F.size(F.split(x, " ")).cast("double")).alias("n"), F.array_distinct(F.transform("s", lambda x: F.least(commas(x), F.lit(2)))).alias("k"))
    s = s.withColumn("m", F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n"))
    var = F.aggregate("n", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("n")
    return s.select("doc_id", F.round(F.least(F.lit(50.0), 50 * F.sqrt(var) / F.col("m")) + 50.0 * F.size("k") / 3, 4).alias("variety"))


@query(r"""
WITH h AS (SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS size, hex(encode(text)) AS h FROM documents), b AS (SELECT doc_id, size, len(list_filter(regexp_extract_all(h, '..'), lambda x: regexp_matches(x, '^([2-6][0-9A-F]|7[0-9A-E]|09|0A|0D)$'))) AS printable, len(list_filter(regexp_extract_all(h, '..'), lambda x: x = '00')) AS nulls FROM h)
SELECT doc_id, size, round(CASE WHEN size = 0 THEN 0 ELSE printable * 1.0 / size END, 6) AS printable, round(CASE WHEN size = 0 THEN 0 ELSE nulls * 1.0 / size END, 6) AS nulls, round(log10(greatest(size, 1)), 6) AS magnitude FROM b
""")
def file_features(t: Tables) -> DataFrame:
    """Size, its logarithm, and the shares of printable and null bytes of each text as a file."""
    data, size = F.encode("text", "utf-8"), F.octet_length("text").cast("long")
    nulls = F.regexp_count(F.regexp_replace(F.hex(data), "(..)", "$1 "), F.lit("00 "))
    return t.documents.select("doc_id", size.alias("size"), F.round(security.printable_share(data), 6).alias("printable"), F.round(X.ratio(nulls, size), 6).alias("nulls"), F.round(F.log10(F.greatest(size, F.lit(1))), 6).alias("magnitude"))


@query(r"""
WITH i AS (SELECT page_id, lower(html) AS low, length(html) AS n FROM pages), v AS (SELECT page_id, CASE WHEN contains(low, '<script') THEN 30 ELSE 0 END AS high, CASE WHEN contains(low, '<form') OR contains(low, '<iframe') THEN 15 ELSE 0 END AS medium, CASE WHEN n > 5000 THEN 5 ELSE 0 END AS low_ FROM i)
SELECT page_id, greatest(0, 100 - high - medium - low_) AS score, CASE WHEN high > 0 THEN 'unsafe' WHEN medium > 0 THEN 'suspicious' WHEN low_ > 0 THEN 'warning' ELSE 'valid' END AS status, CASE WHEN high > 0 THEN 'quarantine,notify' WHEN medium > 0 THEN 'monitor' ELSE 'allow' END AS actions FROM v
""")
def file_validation(t: Tables) -> DataFrame:
    """A security score by the severity of what is found, the status that the worst of it gives, and what to do."""
    low = F.lower("html")
    high, medium, small = low.contains("<script"), low.contains("<form") | low.contains("<iframe"), F.char_length("html") > 5000
    points = lambda c, n: F.when(c, n).otherwise(0)
    return t.pages.select(
        "page_id", F.greatest(F.lit(0), 100 - points(high, 30) - points(medium, 15) - points(small, 5)).alias("score"), F.when(high, "unsafe").when(medium, "suspicious").when(small, "warning").otherwise("valid").alias("status"),
        F.when(high, "quarantine,notify").when(medium, "monitor").otherwise("allow").alias("actions"),
    )


@query(r"""
SELECT doc_id, len(string_split(text, chr(10))) AS lines, contains(text, chr(0)) AS has_null, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents
""")
def text_file_structure(t: Tables) -> DataFrame:
    rows = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(rows).cast("long").alias("lines"), F.contains(F.col("text"), F.lit("\0")).alias("has_null"), F.array_max(F.transform(rows, lambda x: F.char_length(x))).cast("long").alias("longest"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ ?Page [0-9]+ ?$', '', 'g')) = trim(text) AS unchanged, length(text) // 4 AS tokens FROM documents
""")
def cleaned_content(t: Tables) -> DataFrame:
    """Line ends, blank lines, blanks and page numbers put in order: whether that changes a text."""
    return t.documents.select("doc_id", (X.squeeze(F.col("text")) == F.trim("text")).alias("unchanged"), X.estimated_tokens(F.col("text")).alias("tokens"))


@query(r"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM t)
SELECT doc_id, i AS place, x AS point FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM u WHERE length(x) > 20 AND length(x) < 200) WHERE k <= 3
""")
def key_points(t: Tables) -> DataFrame:
    """The first three lines of each document that are longer than 20 and shorter than 200 characters."""
    points = F.filter(F.transform(X.lines(F.col("text"), "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("place"), x.alias("point"))), lambda x: (F.char_length(x["point"]) > 20) & (F.char_length(x["point"]) < 200))
    return t.documents.select("doc_id", F.explode(F.slice(points, 1, 3)).alias("x")).select("doc_id", "x.*")


@query(r"""
WITH m AS (SELECT doc_id, lang, len(list_filter(tok, lambda x: list_contains(['license', 'licensed'], x))) AS a, len(list_filter(tok, lambda x: x = 'work')) AS b, len(tok) AS n, lower(split_part(text, chr(10), 1)) AS title FROM (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS tok FROM documents))
SELECT doc_id, round((a * 1.0 + b * 0.4 + CASE WHEN contains(title, 'license') THEN 3 ELSE 0 END) / (1 + ln(1 + n)), 6) AS rank FROM m WHERE (a > 0 OR b > 0) AND NOT (a = 0 AND lang = 'fr') ORDER BY rank DESC, doc_id LIMIT 40
""")
def weighted_text_search(t: Tables) -> DataFrame:
    """A boolean full-text match (license or licensed, or work, but not work alone in French), ranked by weighted hits and length."""
    p = X.padded(F.col("text"))
    d = t.documents.select("doc_id", "lang", p.alias("p"), F.lower(F.substring_index("text", "\n", 1)).alias("title"))
    m = d.select("doc_id", "lang", "title", X.word_hits(F.col("p"), ["license", "licensed"]).alias("a"), X.word_hits(F.col("p"), ["work"]).alias("b"), F.regexp_count("p", F.lit(" [^ ]+ ")).alias("n"))
    rank = (F.col("a") * 1.0 + F.col("b") * 0.4 + F.when(F.col("title").contains("license"), 3).otherwise(0)) / (1 + F.log(1 + F.col("n")))
    return m.where("(a > 0 or b > 0) and not (a = 0 and lang = 'fr')").select("doc_id", F.round(rank, 6).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(40)


@query("""
SELECT conv_id, turn, contains(lower(text), 'the') AS in_text, role ILIKE '%assist%' AS in_role FROM conversations WHERE contains(lower(text), 'the') OR role ILIKE '%assist%'
""")
def slide_search(t: Tables) -> DataFrame:
    """Slides that have a string in their text or in their role, whatever the case."""
    a, b = F.lower("text").contains("the"), F.col("role").ilike("%assist%")
    return t.conversations.where(a | b).select("conv_id", "turn", a.alias("in_text"), b.alias("in_role"))


#: Characters that one task sorts and groups, about.
TASK_ROWS = 250_000
_CHARS = "c AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, CAST(l_quantity AS BIGINT) AS x0, CAST(l_quantity AS BIGINT) + 4 AS x1, CAST(round(l_discount * 100) AS BIGINT) * 3 AS y, 8 + l_suppkey % 5 AS size, 'w' || (l_partkey % 100) AS text FROM lineitem)"


def elements(t: Tables) -> DataFrame:
    """(page, ord, x0, x1, y, size, text): an order is a page, its items are words with places."""
    x = F.col("l_quantity").cast("long")
    return t.lineitem.select(
        F.col("l_orderkey").alias("page"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("ord"), x.alias("x0"), (x + 4).alias("x1"), (F.round(F.col("l_discount") * 100).cast("long") * 3).alias("y"),
        (8 + F.col("l_suppkey") % 5).alias("size"), F.concat(F.lit("w"), (F.col("l_partkey") % 100).cast("string")).alias("text"),
    )


@query(f"""WITH {_CHARS}, f AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 5 THEN 1 ELSE 0 END AS cut FROM c WINDOW w AS (PARTITION BY page ORDER BY ord)), g AS (SELECT *, sum(cut) OVER (PARTITION BY page ORDER BY ord) AS line FROM f)
SELECT page, CAST(line AS BIGINT) AS line, string_agg(text, ' ' ORDER BY ord) AS text, min(x0) AS x0, max(x1) AS x1, min(y) AS y FROM g GROUP BY page, line""")
def lines_of_words(t: Tables) -> DataFrame:
    """Words become lines where the height changes by five or less."""
    return layout.text_lines(elements(t))


@query(f"""WITH {_CHARS}, f AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 3 OR abs(y - lag(y) OVER w) > 0 THEN 1 ELSE 0 END AS cut FROM c WINDOW w AS (PARTITION BY page ORDER BY ord)), g AS (SELECT *, sum(cut) OVER (PARTITION BY page ORDER BY ord) AS word FROM f)
SELECT page, CAST(word AS BIGINT) AS word, count(*) AS chars, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY page, word""")
def words_of_characters(t: Tables) -> DataFrame:
    """Characters become words where the gap is three or less."""
    # in the order that numbers the characters, so that one sort serves all windows
    x, keys, order = F.col("l_quantity").cast("long"), ["page"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    chars = t.lineitem.select(F.col("l_orderkey").alias("page"), *order, x.alias("x0"), (x + 4).alias("x1"), (F.round(F.col("l_discount") * 100).cast("long") * 3).alias("y"))
    # nearly each character is a group of its own, so what a task holds follows its rows: there are as many tasks as rows ask for
    chars = chars.repartition(max(t.lineitem.count() // TASK_ROWS + 1, t.spark.sparkContext.defaultParallelism), "page")
    apart = (F.col("x0") - layout.before("x1", keys, order) > 3) | (F.abs(F.col("y") - layout.before("y", keys, order)) > 0)
    cut, upto = F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0), Window.partitionBy("page").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = chars.withColumn("cut", cut).withColumn("word", F.sum("cut").over(upto)).groupBy("page", "word")
    return grouped.agg(F.count(F.lit(1)).alias("chars"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(f"""WITH {_CHARS}, f AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 5 OR x0 - lag(x1) OVER w > 10 OR abs(size - lag(size) OVER w) > 2 THEN 1 ELSE 0 END AS cut FROM c WINDOW w AS (PARTITION BY page ORDER BY ord)), g AS (SELECT *, sum(cut) OVER (PARTITION BY page ORDER BY ord) AS block FROM f)
SELECT page, CAST(block AS BIGINT) AS block, string_agg(text, ' ' ORDER BY ord) AS text, min(x0) AS x0, max(x1) AS x1, round(avg(size), 6) AS size FROM g GROUP BY page, block""")
def merged_elements(t: Tables) -> DataFrame:
    """Neighbouring elements that are close in place and font size become one."""
    return layout.merged(elements(t)).withColumn("size", F.round("size", 6))


@query(f"""WITH {_CHARS}, f AS (SELECT page, x0, x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) AS gap, (x0 + lag(x0) OVER (PARTITION BY page ORDER BY x0)) / 2.0 AS mid FROM c), m AS (SELECT page, max((gap, mid)) AS b FROM f WHERE gap IS NOT NULL GROUP BY page),
s AS (SELECT DISTINCT c.page, CASE WHEN b[1] > 5 THEN 2 ELSE 1 END AS columns, CASE WHEN b[1] > 5 THEN b[2] END AS split FROM c LEFT JOIN m USING (page)), o AS (SELECT c.page, ord, columns, row_number() OVER (PARTITION BY c.page ORDER BY CASE WHEN split IS NOT NULL AND x0 >= split THEN 1 ELSE 0 END, y DESC, x0, ord) AS place FROM c JOIN s USING (page))
SELECT page, ord, CAST(columns AS INTEGER) AS columns, place FROM o""")
def column_reading_order(t: Tables) -> DataFrame:
    """One or two columns by the largest gap between left edges, then the reading order: column by column, downwards."""
    e = elements(t)
    sides = layout.columns_of(e, 100.0)
    rows = e.join(sides, "page", "left").withColumn("side", F.when(F.col("split").isNotNull() & (F.col("x0") >= F.col("split")), 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy("page").orderBy("side", F.desc("y"), "x0", "ord"))
    return rows.select("page", "ord", F.col("n_columns").alias("columns"), place.alias("place"))


@query(f"""WITH {_CHARS} SELECT page, min(x0) AS "left", 60 - max(x1) AS "right", min(y) AS bottom, 40 - max(y) AS top, count(*) FILTER (WHERE y > 27) AS header, count(*) FILTER (WHERE y < 3) AS footer, count(*) FILTER (WHERE size > 11) AS large, round(avg(size), 6) AS mean_size, min(size) AS least_size, max(size) AS most_size FROM c GROUP BY page""")
def page_regions(t: Tables) -> DataFrame:
    """Margins, elements in the header and footer, and statistics of font sizes."""
    y, size = F.col("y"), F.col("size")
    return elements(t).groupBy("page").agg(
        F.min("x0").alias("left"), (60 - F.max("x1")).alias("right"), F.min("y").alias("bottom"), (40 - F.max("y")).alias("top"), F.count_if(y > 27).alias("header"), F.count_if(y < 3).alias("footer"),
        F.count_if(size > 11).alias("large"), F.round(F.avg("size"), 6).alias("mean_size"), F.min("size").alias("least_size"), F.max("size").alias("most_size"),
    )


@query(f"""WITH {_CHARS}, m AS (SELECT page, avg(size) AS mean FROM c GROUP BY page) SELECT CASE WHEN y > 27 THEN 'header' WHEN y < 3 THEN 'footer' WHEN size > 1.2 * mean THEN 'heading' WHEN regexp_matches(text, '^w[0-9]$') THEN 'list_item' WHEN x0 > 40 THEN 'caption' ELSE 'paragraph' END AS kind, count(*) AS n FROM c JOIN m USING (page) GROUP BY 1""")
def element_kinds(t: Tables) -> DataFrame:
    """Elements by an ordered cascade: place on the page, size against the page's mean, pattern, indent."""
    e = elements(t).withColumn("mean", F.avg("size").over(Window.partitionBy("page")))
    kind = F.when(F.col("y") > 27, "header").when(F.col("y") < 3, "footer").when(F.col("size") > 1.2 * F.col("mean"), "heading").when(F.col("text").rlike("^w[0-9]$"), "list_item").when(F.col("x0") > 40, "caption").otherwise("paragraph")
    return e.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_TEX = r"""x AS (SELECT o_orderkey AS id, '\frac{a}{b} + ' || CASE WHEN o_custkey % 2 = 0 THEN '\int x^2 ' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN '\sum_i ' ELSE '' END || 'k = ' || o_custkey AS tex FROM orders)"""


@query(rf"""WITH {_TEX}, w AS (SELECT id, tex, 2.0 + CASE WHEN contains(tex, '\int') THEN 3.5 + 0.5 ELSE 0 END + CASE WHEN contains(tex, '\sum') THEN 3.5 + 0.5 ELSE 0 END + 0.5 AS weight FROM x)
SELECT id, round(least(100.0, 100 * weight / length(tex)), 4) AS complexity, CASE WHEN contains(tex, '\int') THEN 'integral' WHEN contains(tex, '\sum') THEN 'summation' WHEN contains(tex, '\frac') THEN 'fraction' ELSE 'algebraic' END AS kind FROM w""")
def equation_scores(t: Tables) -> DataFrame:
    """Complexity of equations by weighted structures over length, and their kind by the first keyword."""
    cust = F.col("o_custkey")
    tex = F.concat(F.lit("\\frac{a}{b} + "), F.when(cust % 2 == 0, "\\int x^2 ").otherwise(""), F.when(cust % 3 == 0, "\\sum_i ").otherwise(""), F.lit("k = "), cust.cast("string"))
    kind = X.first_match(F.col("tex"), [("integral", ["\\int"]), ("summation", ["\\sum"]), ("fraction", ["\\frac"])], "algebraic")
    return t.orders.select(F.col("o_orderkey").alias("id"), tex.alias("tex")).select("id", F.round(academic.equation_complexity(F.col("tex")), 4).alias("complexity"), kind.alias("kind"))


@query(r"""
WITH n AS (SELECT c_custkey, lower(c_mktsegment) || (c_custkey % 4) || CASE c_custkey % 3 WHEN 0 THEN '.edu' WHEN 1 THEN '.ac.uk' ELSE '.com' END AS domain FROM customer) SELECT c_custkey, ends_with(domain, '.edu') OR ends_with(domain, '.ac.uk') AS academic, upper(domain[1]) || substr(split_part(domain, '.', 1), 2) || CASE WHEN ends_with(domain, '.com') THEN '' ELSE ' University' END AS institution FROM n
""")
def academic_accounts(t: Tables) -> DataFrame:
    """Whether an address is an academic one, and a readable name of its institution."""
    suffix = F.when(F.col("c_custkey") % 3 == 0, ".edu").when(F.col("c_custkey") % 3 == 1, ".ac.uk").otherwise(".com")
    email = F.concat(F.lit("X@"), F.lower("c_mktsegment"), (F.col("c_custkey") % 4).cast("string"), suffix)
    return t.customer.select("c_custkey", security.likely_academic(email).alias("academic"), security.institution(security.domain(email)).alias("institution"))


@query("""
WITH e AS (SELECT event_id, list_extract(['Connection timed out', 'Out of memory', 'Unsupported format', 'Quota exceeded', 'Network unreachable', 'Process failed', 'Something else'], 1 + event_id % 7) AS message, list_extract(['Trojan.X', 'Worm.Y', 'Ransom.Z', 'SpyAgent', 'Adware.A', 'Virus.B', 'Oddity'], 1 + event_id % 7) AS threat FROM events)
SELECT CASE WHEN contains(lower(message), 'timeout') OR contains(lower(message), 'timed out') THEN 'timeout' WHEN contains(lower(message), 'memory') THEN 'memory' WHEN contains(lower(message), 'format') THEN 'format' WHEN contains(lower(message), 'quota') THEN 'quota' WHEN contains(lower(message), 'network') OR contains(lower(message), 'connection') THEN 'network' WHEN contains(lower(message), 'process') THEN 'processing' ELSE 'other' END AS error,
  CASE WHEN contains(lower(threat), 'trojan') THEN 'trojan' WHEN contains(lower(threat), 'worm') THEN 'worm' WHEN contains(lower(threat), 'ransom') THEN 'ransomware' WHEN contains(lower(threat), 'spy') THEN 'spyware' WHEN contains(lower(threat), 'adware') THEN 'adware' WHEN contains(lower(threat), 'virus') THEN 'virus' ELSE 'unknown' END AS threat_class, count(*) AS n FROM e GROUP BY 1, 2
""")
def error_and_threat_classes(t: Tables) -> DataFrame:
    """Messages and threat names by the first keyword."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (1 + F.col("event_id") % 7).cast("int"))
    message = pick(["Connection timed out", "Out of memory", "Unsupported format", "Quota exceeded", "Network unreachable", "Process failed", "Something else"])
    threat = pick(["Trojan.X", "Worm.Y", "Ransom.Z", "SpyAgent", "Adware.A", "Virus.B", "Oddity"])
    return t.events.groupBy(security.error_class(message).alias("error"), security.threat_class(threat).alias("threat_class")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH q AS (SELECT d.doc_id, quality, toxic, n_chars FROM documents d JOIN labels USING (doc_id)), p AS (SELECT doc_id, list_slice(list_concat(CASE WHEN quality = 0 THEN ['raise overall quality'] ELSE [] END, CASE WHEN n_chars < 800 THEN ['add missing sections'] ELSE [] END, CASE WHEN toxic = 1 THEN ['fix critical issues'] ELSE [] END, CASE WHEN n_chars > 4000 THEN ['improve readability'] ELSE [] END, CASE WHEN n_chars % 2 = 0 THEN ['strengthen coherence'] ELSE [] END), 1, 3) AS top FROM q)
SELECT doc_id, array_to_string(top, '; ') AS improvements, len(top) AS n FROM p
""")
def priority_improvements(t: Tables) -> DataFrame:
    """What to improve, in the order of importance, three things at most: that limit is the feature."""
    q = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality", "toxic"), "doc_id")
    found = F.array_compact(F.array(F.when(F.col("quality") == 0, "raise overall quality"), F.when(F.col("n_chars") < 800, "add missing sections"), F.when(F.col("toxic") == 1, "fix critical issues"), F.when(F.col("n_chars") > 4000, "improve readability"), F.when(F.col("n_chars") % 2 == 0, "strengthen coherence")))
    return q.select("doc_id", F.array_join(F.slice(found, 1, 3), "; ").alias("improvements"), F.size(F.slice(found, 1, 3)).cast("long").alias("n"))


@query(r"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages) SELECT page_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words, substr(md5(text), 1, 8) AS digest FROM t
""")
def page_texts(t: Tables) -> DataFrame:
    """The plain text of each page: its words and a digest."""
    text = sanitize.plain_text(F.col("html"))
    return t.pages.select("page_id", text.alias("x")).select("page_id", F.size(F.filter(F.split("x", " "), lambda w: w != "")).cast("long").alias("words"), F.substring(F.md5("x"), 1, 8).alias("digest"))


@query(f"""
WITH t AS (SELECT doc_id, text, {_TOK} AS tok, {_WORDS} AS w FROM documents), v AS (SELECT doc_id, round(len(list_filter(w, lambda x: length(x) >= 8)) * 1.0 / greatest(len(w), 1), 6) AS complex, round(len(list_filter(tok, lambda x: list_contains(['analysis', 'method', 'result', 'theory', 'model', 'research', 'study'], x))) * 1.0 / greatest(len(w), 1), 6) AS academic, len(w) AS n FROM t)
SELECT doc_id, complex, academic, CASE WHEN complex > 0.35 THEN 'hard' WHEN complex < 0.1 THEN 'easy' ELSE 'fit' END AS level FROM v
""")
def vocabulary_levels(t: Tables) -> DataFrame:
    """Shares of long and of academic words, and the level that they suit."""
    n = F.greatest(F.regexp_count("text", F.lit(r"\S+")), F.lit(1))
    v = t.documents.select("doc_id", F.round(F.regexp_count("text", F.lit(r"\S{8,}")) / n, 6).alias("complex"), F.round(X.word_hits(X.padded(F.col("text")), ["analysis", "method", "result", "theory", "model", "research", "study"]) / n, 6).alias("academic"))
    return v.select("doc_id", "complex", "academic", F.when(F.col("complex") > 0.35, "hard").when(F.col("complex") < 0.1, "easy").otherwise("fit").alias("level"))


@query(f"""
WITH t AS (SELECT doc_id, len({_WORDS}) AS n, len(regexp_extract_all(text, '\\([0-9]+\\)')) AS c, len(list_distinct(regexp_extract_all(text, '\\([0-9]+\\)'))) AS k FROM documents) SELECT doc_id, c AS citations, k AS sources, round(c / greatest(n / 250.0, 1), 6) AS per_page, c = 0 AS none, n > 500 AND c / greatest(n / 250.0, 1) < 1 AS sparse FROM t
""")
def citation_density(t: Tables) -> DataFrame:
    """Numbered citations of each text: how many, of how many sources, for each page of 250 words."""
    n, c = F.regexp_count("text", F.lit(r"\S+")).cast("long"), F.regexp_count("text", F.lit(r"\([0-9]+\)")).cast("long")
    sources = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\([0-9]+\)"), F.lit(0)))).cast("long")
    t_ = t.documents.select("doc_id", n.alias("n"), c.alias("citations"), sources.alias("sources"))
    per = F.col("citations") / F.greatest(F.col("n") / 250, F.lit(1.0))
    return t_.select("doc_id", "citations", "sources", F.round(per, 6).alias("per_page"), (F.col("citations") == 0).alias("none"), ((F.col("n") > 500) & (per < 1)).alias("sparse"))


@query("""
WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS section, CAST(sum(l_quantity) AS BIGINT) AS words FROM lineitem GROUP BY 1, 2), b AS (SELECT doc, count(*) AS n, avg(words) AS mean, stddev_pop(words) AS dev, coalesce(var_samp(words), 0) AS var FROM s GROUP BY doc)
SELECT doc, CASE WHEN n < 3 THEN 50.0 WHEN mean = 0 THEN 0.0 ELSE round(greatest(0.0, 100 - 100 * dev / mean), 4) END AS balance, round(greatest(0, 100 - var / greatest(mean, 1) * 10), 8) AS evenness FROM b
""")
def content_balance(t: Tables) -> DataFrame:
    """How evenly the sections of a document are filled: 100 less the variation; 50 for fewer than three."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("w"))
    b = s.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("m"), F.stddev_pop("w").alias("d"), F.coalesce(F.var_samp("w"), F.lit(0.0)).alias("v"))
    balance = F.when(F.col("n") < 3, 50.0).when(F.col("m") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 100 - 100 * F.col("d") / F.nullif("m", F.lit(0.0))), 4))
    return b.select("doc", balance.alias("balance"), F.round(F.greatest(F.lit(0.0), 100 - F.col("v") / F.greatest("m", F.lit(1.0)) * 10), 8).alias("evenness"))


@query("""
WITH o AS (SELECT doc_id, length(text) // 4 AS tokens FROM documents), p AS (SELECT doc_id, tokens, round(floor(CAST(0.7 AS DOUBLE) * tokens) * 0.01 / 1000 + floor(CAST(0.3 AS DOUBLE) * tokens) * 0.03 / 1000, 6) AS openai, round(floor(CAST(0.7 AS DOUBLE) * tokens) * 0.003 / 1000 + floor(CAST(0.3 AS DOUBLE) * tokens) * 0.015 / 1000, 6) AS anthropic FROM o)
SELECT doc_id, tokens, openai, anthropic, CASE WHEN anthropic <= openai THEN 'anthropic' ELSE 'openai' END AS cheapest, round(least(openai, anthropic) * (1 - least(0.8 * 0.25, 0.9)), 8) AS with_cache FROM p
""")
def provider_cost_estimates(t: Tables) -> DataFrame:
    """Costs by provider for 70 % input and 30 % output tokens, the cheapest one, and its cost at a hit rate of a quarter."""
    n = X.estimated_tokens(F.col("text"))
    cost = lambda a, b: F.round(F.floor(0.7 * F.col("tokens")) * a / 1000 + F.floor(0.3 * F.col("tokens")) * b / 1000, 6)
    p = t.documents.select("doc_id", n.alias("tokens")).withColumns({"openai": cost(0.01, 0.03), "anthropic": cost(0.003, 0.015)})
    return p.select("doc_id", "tokens", "openai", "anthropic", F.when(F.col("anthropic") <= F.col("openai"), "anthropic").otherwise("openai").alias("cheapest"), F.round(F.least("openai", "anthropic") * (1 - min(0.8 * 0.25, 0.9)), 8).alias("with_cache"))


@query(f"""
WITH t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(text) AS low FROM documents), s AS (SELECT doc_id, [CASE WHEN regexp_matches(title, 'introduction|background|motivation') THEN 0.4 ELSE 0 END + 0.3 * (CASE WHEN contains(low, 'problem') THEN 1 ELSE 0 END), CASE WHEN regexp_matches(title, 'method|approach') THEN 0.4 ELSE 0 END + 0.3 * (CASE WHEN contains(low, 'procedure') THEN 1 ELSE 0 END),
  CASE WHEN regexp_matches(title, 'result|finding') THEN 0.4 ELSE 0 END + 0.3 * (CASE WHEN contains(low, 'table') THEN 1 ELSE 0 END) + 0.3 * (CASE WHEN contains(low, 'figure') THEN 1 ELSE 0 END), CASE WHEN contains(title, 'discussion') THEN 0.4 ELSE 0 END + 0.3 * (CASE WHEN contains(low, 'limit') THEN 1 ELSE 0 END)] AS x FROM t)
SELECT doc_id, CASE WHEN list_max(x) = 0 THEN 'unknown' ELSE list_extract(['introduction', 'methods', 'results', 'discussion'], CAST(list_position(x, list_max(x)) AS INTEGER)) END AS section, round(list_max(x) / greatest(list_sum(x), 1), 6) AS confidence FROM s
""")
def section_predictions(t: Tables) -> DataFrame:
    """0.4 for a title that names a section, 0.3 for each phrase of its content; the first section wins ties; confidence is its share."""
    title, low = F.lower(F.substring_index("text", "\n", 1)), _low()
    rules = [("introduction", ["introduction", "background", "motivation"], ["problem"]), ("methods", ["method", "approach"], ["procedure"]), ("results", ["result", "finding"], ["table", "figure"]), ("discussion", ["discussion"], ["limit"])]
    score = lambda heads, body: sum((F.when(low.contains(b), 0.3).otherwise(0.0) for b in body), F.when(X.any_of([title.contains(h) for h in heads]), 0.4).otherwise(0.0))
    every = F.array(*(F.struct(score(h, b).alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("section")) for i, (n, h, b) in enumerate(rules)))
    s = t.documents.select("doc_id", every.alias("x")).select("doc_id", F.array_max("x").alias("b"), F.aggregate("x", F.lit(0.0), lambda a, y: a + y["score"]).alias("total"))
    return s.select("doc_id", F.when(F.col("b.score") == 0, "unknown").otherwise(F.col("b.section")).alias("section"), F.round(F.col("b.score") / F.greatest("total", F.lit(1.0)), 6).alias("confidence"))


@query("""
WITH b AS (SELECT p_partkey AS id, map_from_entries([('size', CAST(p_size AS VARCHAR)), ('brand', p_brand), ('type', p_type)]) AS base, CASE WHEN p_partkey % 2 = 0 THEN map_from_entries([('brand', 'OVERRIDE'), ('extra', 'x')]) ELSE map_from_entries([('extra', 'y')]) END AS over FROM part)
SELECT id, coalesce(over['brand'], base['brand']) AS brand, over['extra'] AS extra, len(list_distinct(list_concat(map_keys(base), map_keys(over)))) AS keys FROM b
""")
def merged_settings(t: Tables) -> DataFrame:
    """Settings over defaults: what both have is taken from the settings."""
    text = lambda c: c.cast("string")
    base = F.create_map(F.lit("size"), text(F.col("p_size")), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    over = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("brand"), F.lit("OVERRIDE"), F.lit("extra"), F.lit("x"))).otherwise(F.create_map(F.lit("extra"), F.lit("y")))
    both = t.part.select(F.col("p_partkey").alias("id"), F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over).alias("m"))
    return both.select("id", F.col("m")["brand"].alias("brand"), F.col("m")["extra"].alias("extra"), F.size("m").cast("long").alias("keys"))
