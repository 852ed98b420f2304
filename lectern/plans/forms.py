"""Classes of sections and references, citation styles, sources as running text, sanitised texts, responses to threats, ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import papers as P
from lectern.functions import sanitize
from lectern.functions.security import BY_SEVERITY, BY_TYPE, responses
from lectern.plans.metrics import threat_risk_scores
from lectern.plans.references import _SQL as _SQL_REFERENCES
from lectern.plans.references import papers as entries
from lectern.plans.registry import ORACLES, Tables, query
from lectern.plans.search import _sql_source, latex_sources
from lectern.plans.structure import _SQL_LINES, _SQL_PAPER, papers


def _sql_points(kind: str) -> str:
    titles = [f"CASE WHEN regexp_matches(title, '(?i){p}') THEN {P.TITLE_TENTHS} ELSE 0 END" for p in P.TITLES[kind]]
    contents = [f"{P.CONTENT_TENTHS} * len(regexp_extract_all(content, '(?i){p}'))" for p in P.CONTENTS.get(kind, [])]
    return " + ".join(titles + contents)


_SQL_CLASSES = f"""{_SQL_LINES}, x AS (SELECT doc_id, no, unnest([{', '.join(_sql_points(k) for k in P.TITLES)}]) AS points, generate_subscripts(range({len(P.TITLES)}), 1) AS place FROM e),
c AS (SELECT doc_id, no, {list(P.TITLES)}[min(place) FILTER (WHERE points = most)] AS kind, max(points) / greatest(sum(points), 10) AS confidence FROM (SELECT *, max(points) OVER (PARTITION BY doc_id, no) AS most FROM x) GROUP BY doc_id, no)"""


def _classes(t: Tables) -> DataFrame:
    return papers(t).select("doc_id", F.transform(P.sections(F.col("text")), lambda s: P.section_class(s["title"], s["content"])).alias("c"))


@query(f"WITH {_SQL_CLASSES} SELECT doc_id, no, kind, round(confidence, 9) AS confidence FROM c")
def section_classes(t: Tables) -> DataFrame:
    """The class of every section by patterns in its title and contents, and how sure it is."""
    # an outer explode, as the filter that a plain one puts below itself would find all classes a second time
    each = _classes(t).select("doc_id", F.posexplode_outer("c").alias("at", "c")).where("c IS NOT NULL")
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("no"), "c.kind", F.round("c.confidence", 9).alias("confidence"))


@query(f"""WITH {_SQL_CLASSES}, f AS (SELECT doc_id, count(DISTINCT kind) FILTER (WHERE confidence > 0.5 AND kind IN ('abstract', 'introduction', 'methods', 'results', 'discussion')) AS n, avg(confidence) AS mean, list(kind) FILTER (WHERE confidence > 0.3) AS found FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) * 20.0::DOUBLE AS completeness, round(coalesce(mean, 0) * 100, 6) AS confidence, array_to_string(list_filter(['abstract', 'introduction', 'methods', 'results', 'discussion'], lambda k: NOT list_contains(coalesce(found, []), k)), ',') AS missing FROM p LEFT JOIN f USING (doc_id)""")
def form_completeness(t: Tables) -> DataFrame:
    """Share of the required classes that a paper surely has, mean confidence of its sections, and the classes it lacks."""
    f = _classes(t).select("doc_id", P.form(F.col("c")).alias("f"))
    return f.select("doc_id", "f.completeness", F.round("f.confidence", 6).alias("confidence"), F.array_join("f.missing", ",").alias("missing"))


@query(rf"""WITH {_SQL_LINES}, n AS (SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '') AS elements, count(*) FILTER (WHERE head) AS headings, count(*) FILTER (WHERE trim(line) <> '' AND NOT head) AS texts, count(*) FILTER (WHERE regexp_matches(line, '\[\d+\]')) AS refs FROM g GROUP BY doc_id)
SELECT doc_id, elements, headings, least(100, 50 + CASE WHEN elements > 50 THEN 20 WHEN elements > 20 THEN 10 ELSE 0 END + CASE WHEN headings > 3 THEN 15 ELSE 0 END + CASE WHEN headings > 0 THEN 10 ELSE 0 END + CASE WHEN refs > 0 THEN 5 ELSE 0 END + CASE WHEN texts > 10 THEN 10 ELSE 0 END) / 100 AS confidence FROM n""")
def analysis_confidence(t: Tables) -> DataFrame:
    """How far the analysis of a paper can be trusted, by its lines, headings and references."""
    lines = papers(t).select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct((F.trim(x) != "").alias("full"), P.is_heading(x).alias("head"), x.rlike(r"\[\d+\]").alias("ref"))).alias("ls"))
    count = lambda of: F.size(F.filter("ls", of)).cast("long")
    n = lines.select("doc_id", count(lambda x: x["full"]).alias("elements"), count(lambda x: x["head"]).alias("headings"), count(lambda x: x["full"] & ~x["head"]).alias("texts"), count(lambda x: x["ref"]).alias("refs"))
    confidence = P.analysis_confidence(F.col("elements"), F.col("headings"), F.col("texts"), F.col("headings"), F.col("refs"))
    return n.select("doc_id", "elements", "headings", confidence.alias("confidence"))


_STYLED = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS style, {i} AS place, unnest(regexp_extract_all(t, '{p}')) AS citation FROM p" for i, (s, p) in enumerate(C.STYLES.items()))


@query(f"""WITH p AS ({_SQL_PAPER}), a AS ({_STYLED}), n AS (SELECT doc_id, style, place, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT doc_id, arg_min(style, -n * 10 + place) AS main FROM n GROUP BY doc_id)
SELECT doc_id, style, citation, count(*) AS n, style = main AS is_main FROM a JOIN m USING (doc_id) GROUP BY ALL""")
def cited_styles(t: Tables) -> DataFrame:
    """Each citation of a paper with its style, how often it stands there, and whether its style is the paper's main one."""
    text = F.col("text")
    found = papers(t).select("doc_id", C.main_style(text).alias("main"), F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("c")) for s, p in C.STYLES.items()])).alias("s"))
    each = found.select("doc_id", "main", "s.style", F.explode("s.c").alias("citation"))
    return each.groupBy("doc_id", "style", "citation", (F.col("style") == F.col("main")).alias("is_main")).agg(F.count(F.lit(1)).alias("n"))


#: What follows author and title of a reference line, by the number of its part.
_VENUES = ["Journal of {}", "Workshop on {}", "{} Press, 2nd edition", "PhD dissertation, {}", "Retrieved from http://{}", "Transactions {}", "{}"]
_CLASSES = " ".join(f"WHEN regexp_matches(lower(line), '{'|'.join(words)}') THEN '{name}'" for name, words in C.REFERENCE_TYPES)


@query(f"""WITH {_SQL_REFERENCES}, l AS (SELECT id, last || ', ' || initial || '. ({chr(39)} || year || {chr(39)}). ' || title || '. ' || replace({[v.replace('{}', '@') for v in _VENUES]}[1 + CAST(id % {len(_VENUES)} AS INT)], '@', replace(venue, 'Journal of ', '')) AS line FROM r)
SELECT id, line, CASE {_CLASSES} ELSE 'unknown' END AS type FROM l""")
def reference_types(t: Tables) -> DataFrame:
    """Reference lines of several forms, each with its type."""
    where = F.element_at(F.array(*[F.lit(v.replace("{}", "@")) for v in _VENUES]), (F.col("id") % len(_VENUES) + 1).cast("int"))
    line = F.concat("last", F.lit(", "), "initial", F.lit(". ("), F.col("year").cast("string"), F.lit("). "), "title", F.lit(". "), F.replace(where, F.lit("@"), F.replace("venue", F.lit("Journal of "), F.lit(""))))
    return entries(t).select("id", line.alias("line")).withColumn("type", C.reference_type(F.col("line")))


_PREAMBLES = {"en": "\\usepackage[ngerman, english]{babel}\n", "de": "\\usepackage{polyglossia}\n\\setmainlanguage{german}\n", "fr": "\\usepackage[french]{babel}\n"}
_SQL_PREAMBLE = "CASE lang " + " ".join("WHEN '" + k + "' THEN '" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in _PREAMBLES.items()) + " ELSE '' END"
_SQL_PLAIN = r"trim(regexp_replace(regexp_replace({}, '\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{{[^}}]*\}})*', '', 'g'), '[\s\x0b]+', ' ', 'g'), ' ')"
_SQL_BARE = r"regexp_replace(source, '%[^\n]*', '', 'g')"
for _c in ("textbf", "textit", "emph", "texttt"):
    _SQL_BARE = rf"regexp_replace({_SQL_BARE}, '\\{_c}\{{([^}}]+)\}}', '\1', 'g')"


@query(f"""WITH s AS (SELECT doc_id, lang, {_SQL_PREAMBLE} || {_sql_source()} AS source FROM documents), c AS (SELECT doc_id, lang, {_SQL_PLAIN.format(_SQL_BARE)} AS x FROM s)
SELECT doc_id, length(x) AS n_chars, md5(x) AS digest, CASE lang WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'english' END AS language FROM c""")
def latex_texts(t: Tables) -> DataFrame:
    """Running text and main language of each document's source."""
    before = F
    for lang, text in _PREAMBLES.items():
        before = before.when(F.col("lang") == lang, text)
    sources = latex_sources(t, before.otherwise("").alias("head")).select("doc_id", F.concat("head", F.coalesce("source", F.lit(""))).alias("source"))
    out = sources.select("doc_id", C.plain_latex(F.col("source")).alias("x"), C.latex_language(F.col("source")).alias("language"))
    return out.select("doc_id", F.char_length("x").cast("long").alias("n_chars"), F.md5("x").alias("digest"), "language")


_SQL_STEPS = "s0 AS (SELECT page_id, html AS h, '' AS found FROM pages)" + "".join(
    f", s{i + 1} AS (SELECT page_id, regexp_replace(h, '(?is){q}', '', 'g') AS h, found || CASE WHEN regexp_matches(h, '(?is){q}') THEN ',{i}' ELSE '' END AS found FROM s{i})" for i, q in enumerate(p.replace("'", "''") for p in sanitize.TEXT_REMOVALS)
)


@query(rf"""WITH {_SQL_STEPS}, f AS (SELECT page_id, found[2:] AS found, replace(regexp_replace(regexp_replace(regexp_replace(h, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '\t+', chr(9), 'g'), chr(0), '') AS x FROM s{len(sanitize.TEXT_REMOVALS)})
SELECT page_id, found, length(x) AS n_chars, md5(x) AS digest FROM f""")
def filtered_texts(t: Tables) -> DataFrame:
    """Pages as plain texts without dangerous parts, and which of the removals found something."""
    p = t.pages.select("page_id", sanitize.filtered(F.col("html")).alias("f"))
    p = p.select("page_id", F.array_join(F.col("f.found").cast("array<string>"), ",").alias("found"), sanitize.tidy(F.col("f.text")).alias("x"))
    return p.select("page_id", "found", F.char_length("x").cast("long").alias("n_chars"), F.md5("x").alias("digest"))


_ACTIONS = " UNION ALL ".join([f"SELECT '{s}' AS severity, NULL AS type, '{a}' AS action" for s, actions in BY_SEVERITY.items() for a in actions] + [f"SELECT NULL, '{k}', '{a}'" for k, actions in BY_TYPE.items() for a in actions])


@query(f"""WITH z AS ({ORACLES['threat_risk_scores']}), k AS (SELECT *, ['ransomware', 'rootkit', 'malware', 'adware', 'unknown'][1 + CAST(file % 5 AS INT)] AS kind FROM z), a AS ({_ACTIONS}), b AS (SELECT file, action FROM k JOIN a ON a.severity = k.severity UNION SELECT file, action FROM k JOIN a ON a.type = k.kind UNION SELECT file, 'log' FROM k)
SELECT file, severity, kind, string_agg(action, ',' ORDER BY action) AS actions FROM k JOIN b USING (file) GROUP BY ALL""")
def threat_responses(t: Tables) -> DataFrame:
    """What is done about each file at risk, by severity and type of the threat."""
    kind = F.element_at(F.array(*map(F.lit, ["ransomware", "rootkit", "malware", "adware", "unknown"])), (F.col("file") % 5 + 1).cast("int"))
    return threat_risk_scores(t).select("file", "severity", kind.alias("kind")).withColumn("actions", F.array_join(responses(F.col("severity"), F.col("kind")), ","))


@query("""WITH p AS (SELECT l_suppkey AS system, l_returnflag || '-' || l_linestatus AS component, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem), f AS (SELECT system, CAST(sum(cents) AS BIGINT) AS full_cents FROM p GROUP BY 1), w AS (SELECT system, component, CAST(sum(cents) AS BIGINT) AS drop_cents FROM p GROUP BY 1, 2)
SELECT system, component, row_number() OVER (PARTITION BY system ORDER BY drop_cents DESC, component) AS rank, full_cents / 100 AS performance, (full_cents - drop_cents) / 100 AS without, drop_cents / 100 AS importance, drop_cents * 100 / full_cents AS percentage FROM w JOIN f USING (system)""")
def ablation_ranking(t: Tables) -> DataFrame:
    """What each supplier's revenue loses without the lines of one status: components by importance."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    w = t.lineitem.groupBy(F.col("l_suppkey").alias("system"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("component")).agg(F.sum(cents).alias("d"))
    by = Window.partitionBy("system")  # at most as many rows as there are pairs of status
    full = F.sum("d").over(by)
    return w.select("system", "component", F.row_number().over(by.orderBy(F.desc("d"), "component")).cast("long").alias("rank"), (full / 100).alias("performance"), ((full - F.col("d")) / 100).alias("without"), (F.col("d") / 100).alias("importance"), (F.col("d") * 100 / full).alias("percentage"))
