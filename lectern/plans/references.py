"""Citations, references and bibliographies, on lines that are put together from the given tables.

The tables hold no papers, so each part, supplier and order gives one: its names and numbers become authors, titles, venues and
years. The SQL puts the same lines together and reads the fields off the columns they came from, so the parsers are compared
with what went into the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.operators import relational as R
from lectern.plans.registry import Tables, query

_SQL = """
r AS (SELECT p_partkey AS id, 'Author' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS last, chr(CAST(65 + p_size % 26 AS INTEGER)) AS initial, p_name AS title, 'Journal of ' || replace(p_brand, '#', ' ') AS venue, 1990 + p_size % 35 AS year, p_size * 3 AS volume,
  '10.1234/' || p_partkey AS doi, 'key' || p_partkey AS key, CASE p_size % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'book' ELSE 'inproceedings' END AS kind FROM part)
"""


def papers(t: Tables) -> DataFrame:
    """(id, last, initial, title, venue, year, volume, doi, key, kind) of a paper for each part."""
    letter = lambda c: F.char((65 + c % 26).cast("long"))
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "article").when(size % 3 == 1, "book").otherwise("inproceedings")
    return t.part.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Author"), letter(F.col("p_partkey"))).alias("last"), letter(size).alias("initial"), F.col("p_name").alias("title"),
        F.concat(F.lit("Journal of "), F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("venue"), (1990 + size % 35).alias("year"), (size * 3).alias("volume"),
        F.concat(F.lit("10.1234/"), F.col("p_partkey").cast("string")).alias("doi"), F.concat(F.lit("key"), F.col("p_partkey").cast("string")).alias("key"), kind.alias("kind"),
    )


@query(f"WITH {_SQL} SELECT id, CASE WHEN id % 4 <> 0 THEN last || ', ' || initial || '. ' END AS authors, CASE WHEN length(title) >= 5 THEN title END AS title, year, CASE WHEN id % 3 = 0 THEN doi END AS doi, CAST(volume AS VARCHAR) AS volume, round(0.3 + CASE WHEN id % 4 <> 0 THEN 0.3 ELSE 0 END + CASE WHEN length(title) >= 5 THEN 0.2 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END + 0.1, 2)::DOUBLE AS confidence FROM r")
def parsed_references(t: Tables) -> DataFrame:
    """Fields and confidence of reference lines; some lines lack the authors, some the DOI."""
    who = F.when(F.col("id") % 4 != 0, F.concat("last", F.lit(", "), "initial", F.lit(". "))).otherwise("")
    line = F.concat(who, F.lit("("), F.col("year").cast("string"), F.lit(') "'), "title", F.lit('" '), "venue", F.lit(", vol. "), F.col("volume").cast("string"), F.lit(", pp. 1-9 "), F.when(F.col("id") % 3 == 0, F.col("doi")).otherwise(""))
    r = papers(t).select("id", C.reference(line).alias("r"))
    return r.select("id", F.when(F.col("r.authors").isNotNull(), F.concat("r.authors", F.lit(" "))).alias("authors"), "r.title", "r.year", "r.doi", "r.volume", "r.confidence")


@query(f"WITH {_SQL} SELECT id, kind, key, CASE WHEN kind <> 'book' THEN 'publisher' END AS lacks_publisher, last || ' ' || initial AS author, title, CAST(year AS VARCHAR) AS year FROM r")
def parsed_bibtex(t: Tables) -> DataFrame:
    """BibTeX entries: kind, key and fields in braces, quotes and bare."""
    text = F.concat(F.lit("@"), F.upper("kind"), F.lit("{"), "key", F.lit(",\n  author = {"), "last", F.lit(" "), "initial", F.lit('},\n  title = "'), "title", F.lit('",\n  year = '), F.col("year").cast("string"), F.when(F.col("kind") == "book", F.lit(",\n  publisher = {P}")).otherwise(""), F.lit("\n}"))
    e = papers(t).select("id", F.explode(C.bibtex(text)).alias("e"))
    field = lambda n: F.try_element_at("e.fields", F.lit(n))
    return e.select("id", F.col("e.kind").alias("kind"), F.col("e.key").alias("key"), F.when(field("publisher").isNull(), "publisher").alias("lacks_publisher"), field("author").alias("author"), field("title").alias("title"), field("year").alias("year"))


@query(f"""WITH {_SQL} SELECT kind, array_to_string(CASE kind WHEN 'article' THEN ['journal'] WHEN 'book' THEN ['publisher'] ELSE ['booktitle'] END, ',') AS missing, count(*) AS n FROM r GROUP BY 1, 2""")
def missing_reference_fields(t: Tables) -> DataFrame:
    """Required fields that entries of each kind lack."""
    fields = F.create_map(F.lit("author"), F.col("last"), F.lit("title"), F.col("title"), F.lit("year"), F.col("year").cast("string"))
    return papers(t).select("kind", F.array_join(C.missing_fields(F.col("kind"), fields), ",").alias("missing")).groupBy("kind", "missing").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SQL} SELECT id, last || ', ' || initial || '., "' || title || '," ' || venue || ', ' || year || '.' AS ieee, last || ', ' || initial || '. (' || year || '). ' || title || '. ' || venue || '.' AS apa, last || ', ' || initial || '.. "' || title || '." ' || venue || ', ' || year || '.' AS mla,
  last || ', ' || initial || '.. "' || title || '." ' || venue || ' (' || year || ').' AS chicago, last || ', ' || initial || '.. ' || year || '. ' || title || '. ' || venue || '.' AS acm FROM r""")
def formatted_references(t: Tables) -> DataFrame:
    """Each reference in five styles."""
    author = F.concat("last", F.lit(", "), "initial", F.lit("."))
    return papers(t).select("id", *(C.formatted(s, author, F.col("title"), F.col("venue"), F.col("year")).alias(s) for s in ("ieee", "apa", "mla", "chicago", "acm")))


@query(f"""WITH {_SQL}, c AS (SELECT 'key' || (l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END) AS key, l_orderkey AS doc FROM lineitem)
SELECT coalesce(r.kind, 'unresolved') AS kind, count(*) AS citations, count(DISTINCT c.key) AS keys FROM c LEFT JOIN r USING (key) GROUP BY 1""")
def resolved_citations(t: Tables) -> DataFrame:
    """Cited keys against the bibliography: by kind, and those that it lacks."""
    key = F.concat(F.lit("key"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1000000).otherwise(0)).cast("string"))
    cited = t.lineitem.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    both = cited.join(papers(t).select("key", "kind"), "key", "left")
    return both.groupBy(F.coalesce("kind", F.lit("unresolved")).alias("kind")).agg(F.sum("n").alias("citations"), F.count(F.lit(1)).alias("keys"))


@query(f"""WITH {_SQL}, c AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT c.doc, last || ' (' || year || ')' AS label FROM c JOIN r USING (id))
SELECT doc, count(DISTINCT label) AS cited, string_agg(DISTINCT label, '; ' ORDER BY label) AS labels FROM n GROUP BY doc""")
def citation_network(t: Tables) -> DataFrame:
    """What each document cites, as distinct labels of author and year."""
    label = F.concat("last", F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    cited = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id")).distinct()
    n = cited.join(papers(t).select("id", label.alias("label")), "id").select("doc", "label").distinct()
    return n.groupBy("doc").agg(F.count(F.lit(1)).alias("cited"), F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("labels"))


@query(f"""WITH {_SQL} SELECT year // 10 * 10 AS decade, kind, count(*) AS n, count(DISTINCT venue) AS venues, count(DISTINCT last) AS authors, min(year) AS first, max(year) AS last_year FROM r GROUP BY 1, 2""")
def citation_report(t: Tables) -> DataFrame:
    """References by decade and kind: number, venues, authors and years."""
    decade = F.expr("year div 10 * 10").cast("long")
    return papers(t).groupBy(decade.alias("decade"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("venue").alias("venues"), F.count_distinct("last").alias("authors"), F.min("year").alias("first"), F.max("year").alias("last_year"))


@query(f"""WITH {_SQL}, d AS (SELECT l_orderkey AS doc, r.* FROM lineitem JOIN r ON l_partkey = r.id) SELECT doc, count(*) AS refs, round((count(DISTINCT kind) * 1.0 / count(*) + count(DISTINCT venue) * 1.0 / count(*) + count(DISTINCT last) * 1.0 / count(*)) / 3 * 100, 4) AS diversity,
  CASE WHEN avg(2024 - year) <= 3 THEN 100 WHEN avg(2024 - year) <= 5 THEN 85 WHEN avg(2024 - year) <= 10 THEN 70 ELSE 50 END AS recency FROM d GROUP BY doc""")
def reference_scores(t: Tables) -> DataFrame:
    """Mean of three shares of distinct kinds, venues and authors, and a step score of the mean age."""
    d = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id")).join(papers(t).select("id", "kind", "venue", "last", "year"), "id")
    n = F.count(F.lit(1))
    age = F.avg(2024 - F.col("year"))
    # three kinds, 26 names and as many venues as brands: sets stay small, and no row is copied for each of the three counts
    distinct = lambda c: F.size(F.collect_set(c))
    shares = distinct("kind") / n + distinct("venue") / n + distinct("last") / n
    return d.groupBy("doc").agg(n.alias("refs"), F.round(shares / 3 * 100, 4).alias("diversity"), F.when(age <= 3, 100).when(age <= 5, 85).when(age <= 10, 70).otherwise(50).alias("recency"))


@query(f"""WITH {_SQL}, d AS (SELECT l_orderkey AS doc, (r.id % 4 <> 0)::INT || (r.id % 3 = 0)::INT || (r.volume > 60)::INT AS shape FROM lineitem JOIN r ON l_partkey = r.id), c AS (SELECT doc, shape, count(*) AS n FROM d GROUP BY 1, 2)
SELECT doc, round(max(n) * 100.0 / sum(n), 4) AS consistency FROM c GROUP BY doc""")
def reference_consistency(t: Tables) -> DataFrame:
    """Share of the most frequent set of present fields among a document's references."""
    bit = lambda c: F.when(c, "1").otherwise("0")
    shape = F.concat(bit(F.col("id") % 4 != 0), bit(F.col("id") % 3 == 0), bit(F.col("volume") > 60))
    d = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id")).join(papers(t).select("id", "volume"), "id")
    c = d.groupBy("doc", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("doc").agg(F.round(F.max("n") * 100 / F.sum("n"), 4).alias("consistency"))


@query(f"""WITH {_SQL} SELECT id, row_number() OVER (ORDER BY lower(last), CASE WHEN id % 5 = 0 THEN 9999 ELSE year END, lower(title), id) AS place FROM r""")
def sorted_reference_list(t: Tables) -> DataFrame:
    """References by last name, year (none last) and title."""
    year = F.when(F.col("id") % 5 == 0, 9999).otherwise(F.col("year"))
    keys = papers(t).select("id", F.lower("last").alias("name"), year.alias("y"), F.lower("title").alias("title"))
    return R.placed(keys, [F.col("name"), F.col("y"), F.col("title"), F.col("id")]).select("id", "place")


@query(f"""WITH {_SQL}, c AS (SELECT DISTINCT s_suppkey AS cite, 'author' || lower(chr(CAST(65 + s_suppkey % 30 AS INTEGER))) AS text FROM supplier), k AS (SELECT DISTINCT lower(last) AS name FROM r)
SELECT text, count(*) AS citations, EXISTS (SELECT 1 FROM k WHERE contains(k.name, c.text) OR contains(c.text, k.name)) AS listed FROM c GROUP BY text""")
def citation_consistency(t: Tables) -> DataFrame:
    """Citations that name no reference, by a substring either way. Distinct names are compared, a list of at most 26 on one side."""
    cited = t.supplier.select(F.concat(F.lit("author"), F.lower(F.char((65 + F.col("s_suppkey") % 30).cast("long")))).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("citations"))
    names = papers(t).select(F.lower("last").alias("name")).distinct()
    held = cited.join(F.broadcast(names), F.col("name").contains(F.col("text")) | F.col("text").contains(F.col("name")), "left_semi").select("text", F.lit(True).alias("listed"))
    return cited.join(held, "text", "left").na.fill(False, ["listed"])


@query(r"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\(([0-9]+)\)', 1)) AS n FROM documents) SELECT n AS equation, count(*) AS refs, count(DISTINCT doc_id) AS documents FROM c GROUP BY n
""")
def equation_references(t: Tables) -> DataFrame:
    """Numbers in parentheses, as references to equations of that number."""
    found = t.documents.where(F.col("text").contains("(")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\(([0-9]+)\)"), F.lit(1))).alias("equation"))
    return found.groupBy("equation").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("doc_id").alias("documents"))


@query(r"""
WITH x AS (SELECT o_orderkey AS doc, 'See \cite[p.~3]{k' || o_custkey || ', k' || (o_custkey % 7) || '} and \citep{k' || (o_custkey % 7) || '}. \label{s' || (o_orderkey % 3) || '} \ref{s' || (o_orderkey % 4) || '}' AS tex FROM orders)
SELECT doc, CASE WHEN doc_c = doc_m THEN 'k' || doc_c ELSE 'k' || doc_c || ',k' || doc_m END AS keys, 's' || (doc % 4) AS ref, doc % 4 = doc % 3 AS found FROM (SELECT o_orderkey AS doc, o_custkey AS doc_c, o_custkey % 7 AS doc_m FROM orders)
""")
def latex_keys_and_labels(t: Tables) -> DataFrame:
    """Keys of cite commands, each once, and references with or without a label of their document."""
    text = lambda c: c.cast("string")
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    tex = F.concat(F.lit("See \\cite[p.~3]{k"), text(cust), F.lit(", k"), text(cust % 7), F.lit("} and \\citep{k"), text(cust % 7), F.lit("}. \\label{s"), text(order % 3), F.lit("} \\ref{s"), text(order % 4), F.lit("}"))
    rows = t.orders.select(order.alias("doc"), tex.alias("tex"))
    label, ref = F.regexp_extract_all("tex", F.lit(r"\\label\{([^}]*)\}"), F.lit(1)), F.regexp_extract("tex", r"\\ref\{([^}]*)\}", 1)
    return rows.select("doc", F.array_join(C.cited_keys(F.col("tex")), ",").alias("keys"), ref.alias("ref"), F.array_contains(label, ref).alias("found"))


@query("""
WITH c AS (SELECT l_orderkey AS doc, 'Author ' || (l_partkey % 5) AS text, l_quantity AS x0, l_quantity + 3 AS x1, l_linenumber AS n, CAST(round(l_discount * 100) AS BIGINT) AS confidence FROM lineitem),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, text ORDER BY n) AS k FROM c) WHERE k = 1)
SELECT doc, n, text FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.doc = a.doc AND b.n <> a.n AND b.x0 <= a.x1 AND a.x0 <= b.x1 AND (b.confidence > a.confidence OR b.confidence = a.confidence AND b.n < a.n))
""")
def deduplicated_citations(t: Tables) -> DataFrame:
    """Citations of a document once by text, and of overlapping ones those that no surer one overlaps."""
    confidence = F.round(F.col("l_discount") * 100).cast("long")
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("Author "), (F.col("l_partkey") % 5).cast("string")).alias("text"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 3).alias("x1"), F.col("l_linenumber").alias("n"), confidence.alias("c"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # lines of an order share numbers: of equal ones the first in the table counts, whatever the number of tasks that read it
    once = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc", "text").orderBy("n", "file", "row"))).where("k = 1").drop("k", "file", "row")
    a, b = once.alias("a"), once.alias("b")
    surer = F.expr("a.doc = b.doc AND a.n <> b.n AND b.x0 <= a.x1 AND a.x0 <= b.x1 AND (b.c > a.c OR b.c = a.c AND b.n < a.n)")
    return a.join(b, surer, "left_anti").select("doc", "n", "text")


@query("""
WITH w AS (SELECT DISTINCT l_partkey AS work, extract(year FROM l_shipdate) AS year, CASE WHEN l_linenumber = 1 THEN NULL ELSE 1 END AS known FROM lineitem) SELECT work, year, row_number() OVER (ORDER BY year, work) AS place, min(year) OVER () AS first, max(year) OVER () AS last FROM w WHERE known IS NOT NULL
""")
def literature_timeline(t: Tables) -> DataFrame:
    """Works that have a year, in its order, with the first and last year."""
    work = F.when(F.col("l_linenumber") != 1, F.year("l_shipdate")).cast("long")
    w = t.lineitem.select(F.col("l_partkey").alias("work"), work.alias("year")).where("year is not null").distinct()
    span = w.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    return R.placed(w, [F.col("year"), F.col("work")]).crossJoin(F.broadcast(span)).select("work", "year", "place", "first", "last")


@query("""
WITH d AS (SELECT DISTINCT lower(c_mktsegment) AS segment, c_nationkey % 5 AS k FROM customer), e AS (SELECT segment || '.' || CASE k WHEN 0 THEN 'edu' WHEN 1 THEN 'ac.uk' WHEN 2 THEN 'org' WHEN 3 THEN 'edu.au' ELSE 'com' END AS domain FROM d)
SELECT domain, CASE WHEN domain = 'building.org' THEN 'known' WHEN ends_with(domain, '.edu') OR ends_with(domain, '.ac.uk') OR ends_with(domain, '.edu.au') THEN 'suffix' WHEN regexp_matches(domain, '^machin') THEN 'pattern' ELSE 'none' END AS rule FROM e
""")
def academic_domains(t: Tables) -> DataFrame:
    """A list of known domains, then suffixes, then patterns: the first that hits decides."""
    suffix = F.element_at(F.array(*map(F.lit, ("edu", "ac.uk", "org", "edu.au", "com"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    rows = t.customer.select(F.concat_ws(".", F.lower("c_mktsegment"), suffix).alias("domain")).distinct()
    d = F.col("domain")
    return rows.select("domain", F.when(d.isin("building.org"), "known").when(d.endswith(".edu") | d.endswith(".ac.uk") | d.endswith(".edu.au"), "suffix").when(d.rlike("^machin"), "pattern").otherwise("none").alias("rule"))
