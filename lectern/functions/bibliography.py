"""BibTeX of any shape as rows: comments, nested braces, quotes, bare values, repeated fields and keys, broken entries.

An entry ends at a brace that begins a line; what never ends is no entry. Of entries with one key in one text the last counts, and
of repeated fields the last. Null texts have no entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of entries (others are misc), and how entries and fields look.
KINDS = ["article", "book", "inbook", "incollection", "inproceedings", "proceedings", "conference", "mastersthesis", "phdthesis", "techreport", "manual", "misc", "unpublished", "online", "electronic"]
ENTRY = r"(?is)@(\w+)\s*\{\s*([^,\s]+)\s*,\s*(.*?)\n\}"
FIELD = r"(?s)(\w+)\s*=\s*(?:\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}|\"([^\"]*)\"|(\w+))"
#: Commands whose argument stays; of a link, its text.
KEEP = ["textbf", "textit", "emph", "texttt", "url"]


def cleaned(value: Column) -> Column:
    """A value without LaTeX commands; what formatting commands hold stays."""
    out = value
    for command in KEEP:
        out = F.regexp_replace(out, rf"\\{command}\{{([^}}]+)\}}", "$1")
    out = F.regexp_replace(out, r"\\href\{[^}]+\}\{([^}]+)\}", "$1")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+(?:\[[^\]]*\])?(?:\{[^}]*\})*", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def fields(body: Column) -> Column:
    """Array of (name, value) in the order of an entry; names in lower case."""
    part = lambda i: F.regexp_extract_all(body, F.lit(FIELD), F.lit(i))
    joined = lambda a, b: F.concat(a, b)
    whole = F.zip_with(F.zip_with(part(2), part(3), joined), part(4), joined)
    return F.zip_with(part(1), whole, lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("value")))


def field(listed: Column, name: str) -> Column:
    """The last value of a name, null without one."""
    return F.try_element_at(F.filter(listed, lambda f: f["name"] == name), F.lit(-1))["value"]


def people(value: Column) -> Column:
    """Array of (first, middle, last) of "Last, First Middle and First Middle Last"; a single word is a last name."""
    comma, blank = r"^(.+?),\s*(.+)$", r"^(.+?)\s+(.+)$"
    names = F.filter(F.transform(F.split(value, r"(?i)\s+and\s+"), cleaned), lambda a: a != "")

    def person(first: Column, middle: Column, last: Column) -> Column:
        return F.struct(first.alias("first"), F.coalesce(middle, F.lit("")).alias("middle"), last.alias("last"))

    def after(words: Column, last: Column) -> Column:
        return person(words[0], F.array_join(F.slice(words, F.lit(2), F.size(words)), " "), last)

    def one(a: Column) -> Column:
        words = F.split(a, " ")
        turned = F.when(a.rlike(comma), F.array(F.regexp_extract(a, comma, 1), F.regexp_extract(a, comma, 2))).when(a.rlike(blank), F.array(F.regexp_extract(a, blank, 1), F.regexp_extract(a, blank, 2)))
        straight = person(words[0], F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " "), F.element_at(words, -1))
        alone = person(F.lit(""), F.lit(""), a)
        return F.when(a.contains(",") & turned.isNotNull(), after(F.split(F.trim(turned[1]), " "), F.trim(turned[0]))).when(F.size(words) > 1, straight).otherwise(alone)

    return F.transform(names, one)


def entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cite_key, kind, fields) for the entries of each text; ``key`` tells the texts apart.

    Entries of one cite key meet by a grouping with partial aggregation, so the later one wins without a sort.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: ~x.rlike(r"^\s*%"))
    part = lambda i: F.regexp_extract_all("_t", F.lit(ENTRY), F.lit(i))
    found = texts.select(key, F.array_join(lines, "\n").alias("_t")).where(F.col("_t").contains("@"))
    each = found.select(key, F.posexplode(F.arrays_zip(part(1).alias("kind"), part(2).alias("cite_key"), part(3).alias("body"))).alias("_at", "_e"))
    kind = F.lower("_e.kind")
    rows = each.select(key, "_at", F.col("_e.cite_key").alias("cite_key"), F.struct(F.when(kind.isin(KINDS), kind).otherwise("misc").alias("kind"), fields(F.col("_e.body")).alias("fields")).alias("_v"))
    return rows.groupBy(key, "cite_key").agg(F.max_by("_v", "_at").alias("_v")).select(key, "cite_key", "_v.kind", "_v.fields")
