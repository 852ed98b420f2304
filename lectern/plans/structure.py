"""The structure of papers: sections, abstracts, key sections, captions, equations, citations and the four-part form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import papers as P
from lectern.functions.citations import captions
from lectern.plans.registry import Tables, query

#: What stands before a sentence, by its number and length: headings of several forms, captions, references, or nothing.
_BEFORE = [
    "", "\n# Introduction\n", "", "\n2. Methods and Materials\n", " [3] ", "\n## Experimental setup \n", "\nFigure 4: ", "\n3 Results\n", " (Miller et al., 2019) ", "\n3.1 Findings on Data\n", "\nTable 2. ",
    "\n### Implications\n", " see Equation (7) ", "\n#no heading\n", " [1, 2] ", "\n4. conclusion\n", " as eq. 12 ", "\n5. Conclusions\n", "\nAbstract: ", "\n#   Background \n",
]


def _quoted(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


#: The same in SQL: sentences with what stands before them.
_SQL_PAPER = (
    "SELECT doc_id, array_to_string(list_transform(s, lambda x, i: ["
    + ", ".join(_quoted(x) for x in _BEFORE)
    + "][1 + (i * 7 + length(x)) % 20] || x), '. ') AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS s FROM documents)"
)
_SQL_LINES = f"""p AS ({_SQL_PAPER}), l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM p),
h AS (SELECT *, regexp_matches(line, '^(#{{1,6}}\\s+\\S|\\d+(\\.\\d+)*\\.?\\s+[A-Z])') AS head FROM l), g AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM h),
s AS (SELECT doc_id, no, max(line) FILTER (WHERE head) AS head, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), ''), ' ') AS content FROM g WHERE no > 0 GROUP BY doc_id, no),
e AS (SELECT doc_id, no, CASE WHEN starts_with(head, '#') THEN length(regexp_extract(head, '^(#+)', 1)) ELSE len(string_split(regexp_extract(head, '^(\\d+(?:\\.\\d+)*)', 1), '.')) END AS level, trim(regexp_replace(head, '^(#+|\\d+(\\.\\d+)*\\.?)\\s+', ''), ' ') AS title, content FROM s)"""


def papers(t: Tables) -> DataFrame:
    """Documents with headings, captions and references before some of their sentences: (doc_id, text)."""
    before = F.array(*[F.lit(x) for x in _BEFORE])
    sentences = F.split(F.coalesce("text", F.lit("")), r"\. ", -1)
    put = F.transform(sentences, lambda x, i: F.concat(before[((i + 1) * 7 + F.length(x)) % 20], x))
    return t.documents.select("doc_id", F.array_join(put, ". ").alias("text"))


@query(f"WITH {_SQL_LINES} SELECT doc_id, no, level, title, length(content) AS n_chars, md5(content) AS digest FROM e")
def paper_sections(t: Tables) -> DataFrame:
    """Every section of every paper, with its level and what stands in it."""
    each = papers(t).select("doc_id", F.posexplode(P.sections(F.col("text"))).alias("at", "s"))
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("no"), F.col("s.level").cast("long").alias("level"), "s.title", F.length("s.content").cast("long").alias("n_chars"), F.md5("s.content").alias("digest"))


def _sql_key(key: str) -> str:
    return f"string_agg(content, chr(10) || chr(10) ORDER BY no) FILTER (WHERE {' OR '.join(f'contains(lower(title), {chr(39)}{n}{chr(39)})' for n in P.KEY_SECTIONS[key])})"


@query(f"WITH {_SQL_LINES}, k AS (SELECT doc_id, {', '.join(f'{_sql_key(k)} AS {k}' for k in P.KEY_SECTIONS)} FROM e GROUP BY doc_id) SELECT doc_id, {', '.join(f'md5({k}) AS {k}' for k in P.KEY_SECTIONS)} FROM p LEFT JOIN k USING (doc_id)")
def key_sections(t: Tables) -> DataFrame:
    """Introduction, methods, results, discussion and conclusion of each paper, put together from all sections that are named so."""
    found = papers(t).select("doc_id", P.sections(F.col("text")).alias("s"))
    return found.select("doc_id", *[F.md5(P.key_section(F.col("s"), k)).alias(k) for k in P.KEY_SECTIONS])


_PARTS = ", ".join(f"count(*) FILTER (WHERE {' OR '.join(f'contains(lower(title), {chr(39)}{n}{chr(39)})' for n in P.KEY_SECTIONS[k])}) > 0 AS {k}" for k in P.IMRAD)


@query(f"""WITH {_SQL_LINES}, k AS (SELECT doc_id, count(*) AS n, {_PARTS} FROM e GROUP BY doc_id), j AS (SELECT doc_id, coalesce(n, 0) AS n_sections, list_filter([{', '.join(f"CASE WHEN {k} THEN '{k}' END" for k in P.IMRAD)}], lambda x: x IS NOT NULL) AS parts FROM p LEFT JOIN k USING (doc_id))
SELECT doc_id, n_sections, array_to_string(parts, ',') AS parts, len(parts) / 4 AS completeness, array_to_string(list_filter(['introduction', 'methods', 'results', 'discussion'], lambda x: NOT list_contains(parts, x)), ',') AS missing, CASE WHEN len(parts) = 4 THEN 'standard' WHEN len(parts) >= 2 THEN 'partial' WHEN n_sections > 0 THEN 'other' ELSE 'unstructured' END AS structure FROM j""")
def imrad_structure(t: Tables) -> DataFrame:
    """Which parts of the four-part form a paper has and lacks, its completeness and the type of its structure."""
    found = papers(t).select("doc_id", P.sections(F.col("text")).alias("s")).withColumn("parts", P.present(F.col("s")))
    missing = F.array_except(F.array(*[F.lit(k) for k in P.IMRAD]), F.col("parts"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_sections"), F.array_join("parts", ",").alias("parts"), P.completeness(F.col("parts")).alias("completeness"), F.array_join(missing, ",").alias("missing"), P.structure_type(F.col("parts"), F.size("s")).alias("structure"))


@query(rf"""WITH p AS ({_SQL_PAPER}), f AS (SELECT doc_id, 'figure' AS kind, regexp_extract_all(t, '(?m)^\s*Figure\s+(\d+)[:.]\s*([^\n]+)', 1) AS n, regexp_extract_all(t, '(?m)^\s*Figure\s+(\d+)[:.]\s*([^\n]+)', 2) AS c FROM p
UNION ALL SELECT doc_id, 'table', regexp_extract_all(t, '(?m)^\s*Table\s+(\d+)[:.]\s*([^\n]+)', 1), regexp_extract_all(t, '(?m)^\s*Table\s+(\d+)[:.]\s*([^\n]+)', 2) FROM p), u AS (SELECT doc_id, kind, unnest(n) AS n, unnest(c) AS c, generate_subscripts(n, 1) AS nth FROM f)
SELECT doc_id, kind, nth, CAST(n AS INT) AS number, trim(c, ' ') AS caption FROM u""")
def figure_and_table_captions(t: Tables) -> DataFrame:
    every = None
    for kind in ("Figure", "Table"):
        rows = papers(t).select("doc_id", F.lit(kind.lower()).alias("kind"), F.posexplode(captions(F.col("text"), kind)).alias("at", "c"))
        every = rows if every is None else every.unionByName(rows)
    return every.select("doc_id", "kind", (F.col("at") + 1).cast("long").alias("nth"), "c.number", "c.caption")


@query(rf"""WITH p AS ({_SQL_PAPER}), c AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?i)\b(?:equation|eq\.)\s*\(?(\d+)\)?', 1), lambda n: 'eq_' || n) AS e, list_transform(regexp_extract_all(t, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda x: trim(x)) || list_transform(regexp_extract_all(t, '\(([A-Z][A-Za-z]+(?: et al\.)?,? \d{{4}})\)', 1), lambda x: trim(x)) AS c FROM p)
SELECT doc_id, array_to_string(e, ',') AS equations, array_to_string(list_sort(list_distinct(c)), '|') AS citations, len(c) AS n_citations FROM c""")
def equations_and_citations(t: Tables) -> DataFrame:
    text = F.col("text")
    numbers = F.regexp_count(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]")) + F.regexp_count(text, F.lit(r"\(([A-Z][A-Za-z]+(?: et al\.)?,? \d{4})\)"))
    return papers(t).select("doc_id", F.array_join(P.equations(text), ",").alias("equations"), F.array_join(F.array_sort(P.citations(text)), "|").alias("citations"), numbers.cast("long").alias("n_citations"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), b AS (SELECT doc_id, CASE WHEN ascii(trim(line)) IN (45, 42) THEN 'mark' WHEN regexp_matches(line, '^\s*\d+[.)]\s+') THEN 'number' WHEN length(line) = 0 THEN 'blank' ELSE 'plain' END AS kind,
  regexp_matches(trim(line), '[.!?;:,]$') AS stopped, regexp_matches(trim(line), '^\p{Lu}') AS capital FROM l)
SELECT doc_id, count(*) FILTER (WHERE kind <> 'blank') AS n_lines, count(DISTINCT kind) FILTER (WHERE kind <> 'blank') AS n_kinds, count(*) FILTER (WHERE stopped) AS n_stopped, count(*) FILTER (WHERE capital) AS n_capital,
  (count(*) FILTER (WHERE stopped) > 0 AND count(*) FILTER (WHERE stopped) < count(*) FILTER (WHERE kind <> 'blank')) OR count(DISTINCT kind) FILTER (WHERE kind <> 'blank') > 1 AS mixed FROM b GROUP BY doc_id""")
def bullet_formats(t: Tables) -> DataFrame:
    """How the lines of a text are marked, ended and begun, and whether they are mixed."""
    each = t.documents.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    bare = F.trim("line")
    kind = F.when(F.substring(bare, 1, 1).isin("-", "*"), "mark").when(F.col("line").rlike(r"^\s*\d+[.)]\s+"), "number").when(F.length("line") == 0, "blank").otherwise("plain")
    rows = each.select("doc_id", kind.alias("kind"), bare.rlike(r"[.!?;:,]$").alias("stopped"), bare.rlike(r"^\p{Lu}").alias("capital"))
    n, kinds, stopped = F.count_if(F.col("kind") != "blank"), F.count_distinct(F.when(F.col("kind") != "blank", F.col("kind"))), F.count_if("stopped")
    return rows.groupBy("doc_id").agg(n.alias("n_lines"), kinds.alias("n_kinds"), stopped.alias("n_stopped"), F.count_if("capital").alias("n_capital"), (((stopped > 0) & (stopped < n)) | (kinds > 1)).alias("mixed"))
