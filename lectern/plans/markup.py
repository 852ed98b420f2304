"""Equations, bibliographies, cite commands, styles of decks and sources in several files, in many shapes and with broken ones.

Their texts are put together from whole tables by fixed rules. For bibliographies and cite commands the SQL doesn't parse: it
reads the fields and places off the columns and rules that they came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import academic
from lectern.functions import bibliography as B
from lectern.functions import equations as E
from lectern.functions import text as X
from lectern.operators import reports, styles
from lectern.plans.forms import form_completeness
from lectern.plans.more import abstract_quality
from lectern.plans.registry import ORACLES, Tables, query

_PIECES = [r"\frac{a_{1}}{b}", r"\int_{0}^{1} x^{2} dx", r"\sum_{i} y_{i}", r"\sin(t) - \cos(t)", r"\begin{pmatrix} u & v \\ w & z \end{pmatrix}", r"\sqrt{q}", r"A \leq B", "% remark \\max\n", r"\alpha + \beta", r"\max f(k)", "m ≥ n", r"\vec{r} \cdot \vec{s}"]
_SQL_TEX = f"""x AS (SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus = 'F' AS numbered, o_orderpriority AS display, array_to_string(list_transform(range(1 + o_custkey % 5), lambda j: [{', '.join(f"'{p}'" for p in _PIECES)}][1 + CAST((o_orderkey + j * (1 + o_custkey % 7)) % 12 AS INT)]), ' ') AS tex FROM orders)"""


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def sources(t: Tables) -> DataFrame:
    """(id, customer, numbered, display, latex): each order as an equation of one to five pieces."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    tex = F.array_join(F.transform(F.sequence(F.lit(0), (cust % 5).cast("int")), lambda j: _pick(_PIECES, (order + j * (1 + cust % 7)) % 12)), " ")
    return t.orders.select(order.alias("id"), cust.alias("customer"), (F.col("o_orderstatus") == "F").alias("numbered"), F.col("o_orderpriority").alias("display"), tex.alias("latex"))


_SQL_SIGNS = "list_concat(regexp_extract_all(c, '[-+*/=<>≤≥≠≈∝∞∂∇∆∫∮∑∏⋃⋂∈∉⊂⊃⊆⊇∧∨¬⇒⇔∀∃]'), regexp_extract_all(c, '" + rf"\\({'|'.join(E.COMMANDS)})" + "', 1))"


@query(
    rf"""WITH {_SQL_TEX}, c AS (SELECT id, trim(regexp_replace(regexp_replace(tex, '%[^\n]*', '', 'g'), '\s+', ' ', 'g')) AS c FROM x),
p AS (SELECT id, c, list_sort(list_distinct(regexp_extract_all(regexp_replace(c, '\\[a-zA-Z]', '\\#', 'g'), '[a-zA-Z](?:_\{{[^}}]*\}})?(?:\^\{{[^}}]*\}})?'))) AS v, list_sort(list_distinct(regexp_extract_all(c, '\\({'|'.join(E.FUNCTIONS)})\b', 1))) AS f, list_sort(list_distinct({_SQL_SIGNS})) AS o FROM c)
SELECT id, array_to_string(v, ' ') AS variables, array_to_string(f, ' ') AS functions, array_to_string(o, ' ') AS operators, CAST(1 + len(regexp_extract_all(c, '\\\\')) AS BIGINT) AS n_lines,
  round(0.5 * len(v) + len(f) + 0.3 * len(o) + CASE WHEN contains(c, '\frac') THEN 2 ELSE 0 END + CASE WHEN contains(c, '\int') THEN 3 ELSE 0 END + CASE WHEN contains(c, '\sum') THEN 2.5 ELSE 0 END + CASE WHEN contains(c, '\pmatrix') THEN 3.5 ELSE 0 END, 4)::DOUBLE AS complexity FROM p"""
)
def equation_structures(t: Tables) -> DataFrame:
    """Variables, functions, operators, lines and complexity of each equation."""
    e = sources(t).select("id", E.parsed(F.col("latex")).alias("e"))
    return e.select("id", *(F.array_join(f"e.{k}", " ").alias(k) for k in ("variables", "functions", "operators")), F.col("e.n_lines").cast("long").alias("n_lines"), F.round("e.complexity", 4).alias("complexity"))


_SQL_DENSITY = r"2 * len(regexp_extract_all(tex, '\\frac')) + 3 * len(regexp_extract_all(tex, '\\(int|sum|prod|begin)')) + 2 * len(regexp_extract_all(tex, '\\sqrt')) + len(regexp_extract_all(tex, '[_^]')) + 4 * len(regexp_extract_all(tex, '\\matrix'))"


@query(
    rf"""WITH {_SQL_TEX}, d AS (SELECT *, least(100.0, 100.0 * ({_SQL_DENSITY}) / length(tex))::DOUBLE AS density, CASE WHEN regexp_matches(lower(tex), 'sum|int') THEN 'calculus' WHEN regexp_matches(lower(tex), 'matrix|vec|dot') THEN 'linear_algebra' WHEN regexp_matches(lower(tex), 'frac|/') THEN 'fraction' WHEN regexp_matches(lower(tex), '\^|pow|exp') THEN 'exponential' WHEN regexp_matches(lower(tex), 'sqrt|root') THEN 'radical' ELSE 'basic' END AS class FROM x)
SELECT customer, count(*) AS n, round(avg(density), 6) AS density, round(CASE WHEN count(*) < 2 THEN 100 ELSE (CASE WHEN bool_or(numbered) AND NOT bool_and(numbered) THEN 70 ELSE 100 END + 100.0 * count(DISTINCT display) / count(*)) / 2 END, 6)::DOUBLE AS consistency,
  count(*) FILTER (WHERE class = 'calculus') AS calculus, count(*) FILTER (WHERE class = 'linear_algebra') AS linear_algebra, count(*) FILTER (WHERE class = 'fraction') AS fraction, count(*) FILTER (WHERE class = 'exponential') AS exponential, count(*) FILTER (WHERE class = 'radical') AS radical, count(*) FILTER (WHERE class = 'basic') AS basic FROM d GROUP BY customer"""
)
def equation_profiles(t: Tables) -> DataFrame:
    """Equations of each customer: mean density of structures, consistency of numbering and display, and a count for each class."""
    p = E.profile(sources(t), "customer")
    return p.withColumns({"density": F.round("density", 6), "consistency": F.round("consistency", 6)})


_TYPES = ["Article", "BOOK", "inproceedings", "TechReport", "weird", "misc"]


def bibliographies(t: Tables) -> DataFrame:
    """(id, text): for each part a bibliography with a comment, an entry in one of many shapes, at times a later one with its key, and an entry that never ends."""
    i, name = F.col("p_partkey"), F.col("p_name")
    last = F.concat(F.lit("Author"), F.char(65 + i % 26))
    author = F.when(i % 4 == 0, F.concat(F.lit("{"), last, F.lit(", I.}"))).when(i % 4 == 1, F.concat(F.lit("{"), last, F.lit(", Jo  Ann Q.\n  AND F. Second}"))).when(i % 4 == 2, F.concat(F.lit('"'), last, F.lit('"'))).otherwise(F.concat(F.lit("{\\textbf{"), last, F.lit("}, A and B C van D}")))
    title = F.when(i % 3 == 0, F.concat(F.lit("{The \\emph{"), name, F.lit("} case}"))).when(i % 3 == 1, F.concat(F.lit('"'), name, F.lit(' \\url{x.org}"'))).otherwise(F.concat(F.lit("{"), name, F.lit("\n    continued\\cite{z}}")))
    year = _pick(["1999", "{c. 2001}", '"2003/04"', "{}", "{n.d.}"], i % 5)
    key = F.concat(F.lit("key"), i.cast("string"))
    entry = F.concat(F.lit("@"), _pick(_TYPES, i % 6), F.lit(" { "), key, F.lit(",\n  AUTHOR="), author, F.lit(",\n  title = {first},\n  Title = "), title, F.lit(",\n  year ="), year, F.lit(", volume = "), F.col("p_size").cast("string"), F.lit("\n}\n"))
    again = F.when(i % 10 == 3, F.concat(F.lit("@book{"), key, F.lit(",\n  year = 2020\n}\n"))).otherwise("")
    text = F.concat(F.lit("  % @book{no, title = {no}\n"), F.lit("preface\n"), entry, again, F.lit("@misc{open, title = {lost}"))
    return t.part.select(i.alias("id"), text.alias("text"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_size AS size, 'Author' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS last, p_partkey % 10 = 3 AS again FROM part)
SELECT id, 'key' || id AS cite_key, CASE WHEN again THEN 'book' ELSE ['article', 'book', 'inproceedings', 'techreport', 'misc', 'misc'][1 + CAST(id % 6 AS INT)] END AS kind,
  CASE WHEN again THEN NULL ELSE CASE id % 3 WHEN 0 THEN 'The ' || name || ' case' WHEN 1 THEN name || ' x.org' ELSE name || ' continued' END END AS title, CASE WHEN again THEN 2020 ELSE CASE id % 5 WHEN 0 THEN 1999 WHEN 1 THEN 2001 WHEN 2 THEN 2003 END END AS year,
  CASE WHEN NOT again THEN CASE id % 4 WHEN 0 THEN 'I.||' || last WHEN 1 THEN 'Jo|Ann Q.|' || last || '; F.||Second' WHEN 2 THEN '||' || last ELSE 'A||' || last || '; B|C van|D' END END AS authors, CASE WHEN NOT again THEN CAST(size AS VARCHAR) END AS volume FROM p""")
def bibtex_entries(t: Tables) -> DataFrame:
    """Kind, cleaned title, year, people and volume of every entry, the later one of a key."""
    e = B.entries(bibliographies(t), "id", "text")
    field = lambda n: B.field(F.col("fields"), n)
    who = F.transform(B.people(field("author")), lambda p: F.concat_ws("|", p["first"], p["middle"], p["last"]))
    year = F.nullif(F.regexp_extract(field("year"), r"(\d{4})", 1), F.lit("")).cast("int")
    return e.select("id", "cite_key", "kind", B.cleaned(field("title")).alias("title"), year.alias("year"), F.array_join(who, "; ").alias("authors"), field("volume").alias("volume"))


_SQL_CITED = r"""l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, (doc_id + i) % 7 AS k FROM l),
m AS (SELECT *, CASE k WHEN 0 THEN x || ' \citep[see][p.~' || i || ']{k' || i || ',k' || (doc_id % 7) || '}' WHEN 1 THEN x || ' \cite [ch. 2 ]{a' || i || '}' WHEN 2 THEN x || ' \citenum{b}, more' WHEN 3 THEN 'As \CiteAuthor{c' || i || '} says, ' || x WHEN 4 THEN x || ' \cite[]{}' WHEN 5 THEN x || ' \citet[a][]' || chr(10) || ' {d' || i || '} end' ELSE x END AS y,
  CASE k WHEN 3 THEN 3 ELSE length(x) + 1 END AS ahead FROM k),
b AS (SELECT *, coalesce(sum(length(y) + 1) OVER w, 0) AS begun, coalesce(sum(1 + CASE WHEN k = 5 THEN 1 ELSE 0 END) OVER w, 0) AS n FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(rf"""WITH {_SQL_CITED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, ['citep', 'cite', 'cite', 'citeauthor', NULL, 'citet'][1 + CAST(k AS INT)] AS type, CASE k WHEN 0 THEN 'see' ELSE '' END AS pre, CASE k WHEN 0 THEN 'p.~' || i WHEN 1 THEN 'ch. 2' WHEN 5 THEN 'a' ELSE '' END AS post,
  CASE k WHEN 0 THEN 'k' || i || ',k' || (doc_id % 7) WHEN 1 THEN 'a' || i WHEN 2 THEN 'b' WHEN 3 THEN 'c' || i ELSE 'd' || i END AS keys, CAST(begun + ahead AS BIGINT) AS position, CAST(n + 1 AS BIGINT) AS line, CAST(ahead + 1 AS BIGINT) AS col FROM b WHERE k NOT IN (4, 6)""")
def latex_citation_places(t: Tables) -> DataFrame:
    """Cite commands of each document with notes, keys, position, line and column; some are broken over lines, some hold no key."""
    doc = F.col("doc_id")

    def line(x: Column, i: Column) -> Column:
        k, n = (doc + i) % 7, i.cast("string")
        cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
        made = F.when(k == 0, cat(x, " \\citep[see][p.~", n, "]{k", n, ",k", (doc % 7).cast("string"), "}")).when(k == 1, cat(x, " \\cite [ch. 2 ]{a", n, "}")).when(k == 2, cat(x, " \\citenum{b}, more"))
        return made.when(k == 3, cat("As \\CiteAuthor{c", n, "} says, ", x)).when(k == 4, cat(x, " \\cite[]{}")).when(k == 5, cat(x, " \\citet[a][]\n {d", n, "} end")).otherwise(x)

    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return styles.citation_places(t.documents.select("doc_id", text.alias("text")), "doc_id", "text")


_FONTS = ["Arial", "Lato", "Inter", "Roboto", "Georgia"]
_KINDS = ["content", "title", "section"]


@query(f"""WITH s AS (SELECT conv_id, turn, {_KINDS}[1 + CAST(turn % 3 AS INT)] AS kind, length(coalesce(text, '')) AS n FROM conversations),
v AS (SELECT conv_id, 'fonts' AS rule, NULL AS kind, {_FONTS}[1 + CAST((conv_id + turn) % 5 AS INT)] AS value FROM s UNION ALL SELECT conv_id, 'fonts', NULL, {_FONTS}[1 + CAST(turn % (1 + conv_id % 3) AS INT)] FROM s
  UNION ALL SELECT conv_id, 'colours', NULL, '#00000' || (turn % 10) FROM s UNION ALL SELECT conv_id, 'colours', NULL, 'rgb(' || (turn % 3) || ', 0, 0)' FROM s UNION ALL SELECT conv_id, 'colours', NULL, '#AAbbCC' FROM s
  UNION ALL SELECT conv_id, 'spacing', kind, CASE WHEN conv_id % 2 = 0 THEN '1.' || (n % 2) ELSE 'None' END || '_' || CASE WHEN turn % 4 = 0 THEN 'None' ELSE '6' END FROM s WHERE conv_id % 2 = 0 OR turn % 4 <> 0),
c AS (SELECT conv_id, rule, kind, count(DISTINCT value) AS n FROM v GROUP BY ALL)
SELECT conv_id, rule, kind, CAST(NULL AS BIGINT) AS place, n FROM c WHERE n > CASE rule WHEN 'fonts' THEN 3 WHEN 'colours' THEN 5 ELSE 1 END
UNION ALL SELECT conv_id, 'images', NULL, CAST(turn AS BIGINT), r FROM (SELECT conv_id, turn, unnest([100 + n % 400, CASE WHEN n % 3 = 0 THEN 0 END]) AS r FROM s) WHERE r <> 0 AND r < 300""")
def deck_style_issues(t: Tables) -> DataFrame:
    """Fonts, colours, spacings and image resolutions that disagree within each conversation taken as a deck."""
    conv, turn, n = F.col("conv_id"), F.col("turn"), F.char_length(F.coalesce("text", F.lit("")))
    text = lambda c: c.cast("string")
    said = {
        "font_family": _pick(_FONTS, (conv + turn) % 5), "heading.headingFont": _pick(_FONTS, turn % (1 + conv % 3)), "font.family": F.lit("Ghost"), "color": F.concat(F.lit("#00000"), text(turn % 10)),
        "box.border": F.concat(F.lit("1px rgb("), text(turn % 3), F.lit(", 0, 0) #AAbbCC")), "line_height": F.when(conv % 2 == 0, F.concat(F.lit("1."), text(n % 2))), "paragraph_spacing": F.when(turn % 4 != 0, "6"),
    }
    style = F.map_filter(F.create_map(*(c for k, v in said.items() for c in (F.lit(k), v))), lambda k, v: v.isNotNull())
    resolutions = F.array(100 + n % 400, F.when(n % 3 == 0, 0))
    slides = t.conversations.select("conv_id", turn.cast("long").alias("place"), _pick(_KINDS, turn % 3).alias("kind"), style.alias("style"), resolutions.alias("resolutions"))
    return styles.style_issues(slides, "conv_id")


@query("""WITH RECURSIVE f AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 7 THEN doc_id + 1 WHEN doc_id % 50 = 8 THEN doc_id - 1 WHEN doc_id % 11 = 5 THEN -1 WHEN doc_id >= 3 THEN doc_id // 3 END AS needs, doc_id || ':' || string_split(coalesce(text, ''), chr(10))[1][1:40] AS own FROM documents),
w AS (SELECT id, id AS here, needs, own AS text, 0 AS depth FROM f UNION ALL SELECT w.id, f.id, f.needs, CASE WHEN w.here % 50 IN (7, 8) THEN w.text ELSE w.text || ' <' || f.own END, w.depth + 1 FROM w JOIN f ON f.id = w.needs WHERE w.depth < 40 AND w.here % 50 NOT IN (7, 8)),
e AS (SELECT id, max(depth) AS depth, bool_or(here % 50 IN (7, 8)) AS cyclic FROM w GROUP BY id),
r AS (SELECT w.*, e.cyclic FROM w JOIN e ON e.id = w.id AND e.depth = w.depth)
SELECT f.id, md5(CASE WHEN r.cyclic THEN f.own || ' <' || CASE WHEN f.id % 2 = 0 THEN chr(92) || 'input{f' ELSE chr(92) || 'include{f' END || f.needs || '}>' WHEN r.needs IS NULL THEN r.text || repeat('>', r.depth) ELSE r.text || ' <' || CASE WHEN r.here % 2 = 0 THEN chr(92) || 'input{f' ELSE chr(92) || 'include{f' END || r.needs || '}>' || repeat('>', r.depth) END) AS digest, r.cyclic FROM f JOIN r USING (id)""")
def latex_with_includes(t: Tables) -> DataFrame:
    """Sources that include others, put together from their files; unknown files and what leads to a cycle stay as they are."""
    i = F.col("doc_id")
    needs = F.when(i % 50 == 7, i + 1).when(i % 50 == 8, i - 1).when(i % 11 == 5, -1).when(i >= 3, F.floor(i / 3))
    own = F.concat(i.cast("string"), F.lit(":"), F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 40))
    command = F.concat(F.when(i % 2 == 0, "\\input{f").otherwise("\\include{f"), needs.cast("long").cast("string"), F.lit("}"))
    files = t.documents.select(F.concat(F.lit("f"), i.cast("string")).alias("path"), F.concat(own, F.coalesce(F.concat(F.lit(" <"), command, F.lit(">")), F.lit(""))).alias("text"))
    whole = reports.expand_includes(files)
    stays = F.col("text").rlike(r"^[^<]*<\\(input|include)\{f\d")
    return whole.select(F.substring("path", 2, 30).cast("long").alias("id"), F.md5("text").alias("digest"), stays.alias("cyclic"))


@query(f"""WITH q AS ({ORACLES['abstract_quality']}), f AS ({ORACLES['form_completeness']}), l AS (SELECT doc_id, avg(quality) * 50 AS written FROM labels WHERE quality > 0 GROUP BY doc_id),
c AS (SELECT doc_id, (q.completeness + q.conciseness + q.clarity) / 3 AS abstract, nullif(f.completeness, 0) AS form, l.written FROM q LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, round((coalesce(form * 0.15, 0) + coalesce(abstract * 0.15, 0) + coalesce(written * 0.2, 0)) / (CASE WHEN form IS NULL THEN 0 ELSE 0.15 END + CASE WHEN abstract IS NULL THEN 0 ELSE 0.15 END + CASE WHEN written IS NULL THEN 0 ELSE 0.2 END), 4)::DOUBLE AS overall FROM c""")
def overall_academic_scores(t: Tables) -> DataFrame:
    """Weighted mean of the scores that a document has, of form, abstract and writing; weights of missing ones go to the others."""
    a = abstract_quality(t).select("doc_id", ((F.col("completeness") + F.col("conciseness") + F.col("clarity")) / 3).alias("abstract"))
    f = form_completeness(t).select("doc_id", F.when(F.col("completeness") != 0, F.col("completeness")).alias("form"))
    w = t.labels.where("quality > 0").groupBy("doc_id").agg((F.avg("quality") * 50).alias("written"))
    both = a.join(f, "doc_id", "left").join(w, "doc_id", "left")
    score = academic.weighted({k: F.col(k) for k in ("form", "abstract", "written")}, {"form": 0.15, "abstract": 0.15, "written": 0.2})
    return both.select("doc_id", F.round(score, 4).alias("overall"))


#: What to do about an issue, in order.
_FIXES = {
    "fragments": "Review and fix sentence fragments and run-on sentences",
    "contractions": "Expand contractions (don't → do not, can't → cannot)",
    "first_person": "Reduce first-person pronouns, use third person or passive voice",
    "passive": "Convert some passive voice sentences to active voice",
    "clarity": "Replace overly complex words with clearer alternatives",
}
_SQL_FIXES = ", ".join(f"CASE WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}' END" for k, v in _FIXES.items())


@query(rf"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents), i AS (SELECT doc_id, regexp_matches(t, '(^|[.!?])\s*\S+(\s+\S+)?[.!?](\s|$)') AS fragments, regexp_matches(t, '[A-Za-z]''[A-Za-z]') AS contractions,
  len(list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}_]+'), lambda x: list_contains(['i', 'me', 'my', 'we', 'our', 'us'], x))) > 0.02 * n AS first_person, regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}_])(is|are|was|were|been|being)\s+[a-z]+ed($|[^\p{{L}}\p{{N}}_])') AS passive, len(regexp_extract_all(t, '\S{{13,}}')) > 0.05 * n AS clarity FROM c)
SELECT doc_id, array_to_string(list_filter([{_SQL_FIXES}], lambda x: x IS NOT NULL), '; ') AS fixes FROM i""")
def quick_fixes(t: Tables) -> DataFrame:
    """What to mend first in each document, by the kinds of issues that it has."""
    text = F.coalesce("text", F.lit(""))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    n = count(text, r"\S+")
    has = {
        "fragments": text.rlike(r"(^|[.!?])\s*\S+(\s+\S+)?[.!?](\s|$)"), "contractions": text.rlike("[A-Za-z]'[A-Za-z]"), "first_person": X.word_hits(X.padded(text), ["i", "me", "my", "we", "our", "us"]) > 0.02 * n,
        "passive": F.lower(text).rlike(r"(^|[^\p{L}\p{N}_])(is|are|was|were|been|being)\s+[a-z]+ed($|[^\p{L}\p{N}_])"), "clarity": count(text, r"\S{13,}") > 0.05 * n,
    }
    return t.documents.select("doc_id", F.array_join(F.array(*(F.when(has[k], fix) for k, fix in _FIXES.items())), "; ").alias("fixes"))
