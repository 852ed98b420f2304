"""Citations, references, BibTeX and LaTeX as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import first_match

#: How citations look, in the order that decides ties.
STYLES = {
    "numeric": r"\[\d+(?:\s*[-,]\s*\d+)*\]",
    "author_year": r"\([A-Z][A-Za-z]+(?: et al\.)?,? \d{4}[a-z]?\)",
    "apa": r"\([A-Z][A-Za-z]+ (?:&|and) [A-Z][A-Za-z]+, \d{4}\)",
}
#: Fields that a BibTeX entry must have.
REQUIRED = {"article": ["author", "title", "journal", "year"], "book": ["author", "title", "publisher", "year"], "inproceedings": ["author", "title", "booktitle", "year"], "misc": ["title"]}


def citations(text: Column) -> Column:
    """Array of (style, citation), style by style, distinct."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _styled(style)) for style, p in STYLES.items()]
    return F.array_distinct(F.concat(*found))


def _styled(style: str):
    return lambda c: F.struct(F.lit(style).alias("style"), c.alias("citation"))


def main_style(text: Column) -> Column:
    """The style with most citations; the earlier one on ties, null without any."""
    counts = [F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("rank"), F.lit(style).alias("style")) for i, (style, p) in enumerate(STYLES.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["style"])


def reference(line: Column) -> Column:
    """The fields of a reference line, and how sure it is one; lines under 20 characters are none."""
    year = F.nullif(F.regexp_extract(line, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    doi = F.nullif(F.regexp_extract(line, r"(10\.\d{4,9}/[^\s\"<>]+)", 1), F.lit(""))
    url = F.nullif(F.regexp_extract(line, r"(https?://[^\s]+)", 1), F.lit(""))
    title = F.nullif(F.regexp_extract(line, r"[\"\u201c]([^\"\u201d]{5,})[\"\u201d]", 1), F.lit(""))
    authors = F.nullif(F.regexp_extract(line, r"^(?:\[\d+\]\s*)?([A-Z][A-Za-z]+,\s*[A-Z]\.(?:[^(\"]*?))(?=\s*[(\"])", 1), F.lit(""))
    pages = F.nullif(F.regexp_extract(line, r"pp?\.\s*(\d+\s*[-\u2013]\s*\d+)", 1), F.lit(""))
    volume = F.nullif(F.regexp_extract(line, r"[Vv]ol\.\s*(\d+)", 1), F.lit(""))
    present = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in ((year, 0.3), (authors, 0.3), (title, 0.2), (doi, 0.1), (pages, 0.1))), F.lit(0.0))
    fields = F.struct(authors.alias("authors"), title.alias("title"), year.cast("int").alias("year"), doi.alias("doi"), url.alias("url"), pages.alias("pages"), volume.alias("volume"), F.round(present, 2).alias("confidence"))
    return F.when((F.char_length(line) >= 20) & (present > 0.3), fields)


#: Words that tell a reference's type, in the order that decides.
REFERENCE_TYPES = [
    ("journal_article", ["journal", "proceedings", "transactions", "letters", "review", "science", "nature", "cell", "lancet", "ieee", "acm"]),
    ("conference_paper", ["conference", "symposium", "workshop", "congress", "meeting", "proceedings", "international", "annual", "ieee", "acm"]),
    ("book", ["press", "publisher", "edition", "isbn"]),
    ("thesis", ["thesis", "dissertation", "phd", "master"]),
    ("website", ["http", "www", "website", "retrieved"]),
]


def reference_type(line: Column) -> Column:
    """The first type of which a reference line holds a word, within words too; else unknown."""
    return first_match(F.lower(line), REFERENCE_TYPES, "unknown")


def bibtex(text: Column) -> Column:
    """Array of (kind, key, fields) of the entries of a BibTeX text; fields are name = {value}, "value" or a number."""
    entries = F.regexp_extract_all(text, F.lit(r"(?s)@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\s*\}"), F.lit(0))
    field = r"(?s)(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\d+))"

    def entry(e: Column) -> Column:
        body = F.regexp_extract(e, r"(?s)@\w+\s*\{\s*[^,\s]+\s*,(.*)", 1)
        names = F.transform(F.regexp_extract_all(body, F.lit(field), F.lit(1)), lambda n: F.lower(n))
        values = F.zip_with(F.regexp_extract_all(body, F.lit(field), F.lit(2)), F.regexp_extract_all(body, F.lit(field), F.lit(3)), lambda a, b: F.concat(a, b))
        values = F.zip_with(values, F.regexp_extract_all(body, F.lit(field), F.lit(4)), lambda a, b: clean_latex(F.concat(a, b)))
        return F.struct(F.lower(F.regexp_extract(e, r"@(\w+)", 1)).alias("kind"), F.regexp_extract(e, r"@\w+\s*\{\s*([^,\s]+)", 1).alias("key"), F.map_from_arrays(names, values).alias("fields"))

    return F.transform(entries, entry)


def missing_fields(kind: Column, fields: Column) -> Column:
    """Required fields that an entry lacks, by its kind (others as misc)."""
    out = F
    for k, names in REQUIRED.items():
        out = out.when(kind == k, F.array_except(F.array(*map(F.lit, names)), F.map_keys(fields)))
    return out.otherwise(F.array_except(F.array(F.lit("title")), F.map_keys(fields)))


def authors(value: Column) -> Column:
    """(last, first) of each author of "Last, First and First Last"."""

    def one(a: Column) -> Column:
        parts, names = F.split(a, r",\s*"), F.split(F.trim(a), r"\s+")
        comma = F.size(parts) > 1
        first = F.when(comma, F.element_at(parts, 2)).otherwise(F.array_join(F.slice(names, 1, F.size(names) - 1), " "))
        return F.struct(F.when(comma, F.element_at(parts, 1)).otherwise(F.element_at(names, -1)).alias("last"), first.alias("first"))

    return F.transform(F.filter(F.split(value, r"\s+and\s+"), lambda a: F.trim(a) != ""), one)


def clean_latex(text: Column) -> Column:
    """Text without comments, formatting commands and braces."""
    out = F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")
    out = F.regexp_replace(out, r"\\(?:textbf|textit|emph|text|mathrm|textsc)\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[{}]", ""), r"\s+", " "))


def plain_latex(text: Column) -> Column:
    """Running text of a source: comments go, four formatting commands leave what they format, other commands go with their arguments."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"%[^\n]*", "")
    for command in ("textbf", "textit", "emph", "texttt"):
        out = F.regexp_replace(out, rf"\\{command}\{{([^}}]+)\}}", "$1")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})*", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def latex_language(source: Column) -> Column:
    """The main language of a source: the last option of babel, else what polyglossia sets, else english."""
    options = F.split(F.regexp_extract(source, r"\\usepackage\[([^\]]*)\]\{babel\}", 1), ",")
    babel = F.nullif(F.trim(F.element_at(options, -1)), F.lit(""))
    other = F.when(source.rlike(r"\\usepackage(?:\[[^\]]*\])?\{[^}]*polyglossia"), F.nullif(F.regexp_extract(source, r"\\setmainlanguage\{([^}]+)\}", 1), F.lit("")))
    return F.coalesce(babel, other, F.lit("english"))


def cited_keys(latex: Column) -> Column:
    """Keys of all cite commands, in order, each once."""
    groups = F.regexp_extract_all(latex, F.lit(r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\]){0,2}\{([^}]*)\}"), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k))))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def sections(text: Column) -> Column:
    """(level, title) of Markdown and numbered headings, in order."""
    rows = F.split(text, "\n")
    heads = F.filter(rows, lambda r: r.rlike(r"^(#{1,6}\s+\S|\d+(\.\d+)*\.?\s+[A-Z])"))

    def head(r: Column) -> Column:
        marks, number = F.regexp_extract(r, "^(#+)", 1), F.regexp_extract(r, r"^(\d+(?:\.\d+)*)", 1)
        level = F.when(marks != "", F.length(marks)).otherwise(F.size(F.split(number, r"\.")))
        return F.struct(level.alias("level"), F.trim(F.regexp_replace(r, r"^(#+|\d+(\.\d+)*\.?)\s+", "")).alias("title"))

    return F.transform(heads, head)


def captions(text: Column, kind: str) -> Column:
    """(number, caption) of "Figure 3: ..." or "Table 2. ..." lines."""
    pattern = rf"(?m)^\s*{kind}\s+(\d+)[:.]\s*([^\n]+)"
    return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda n, c: F.struct(n.cast("int").alias("number"), F.trim(c).alias("caption")))


def abstract(text: Column) -> Column:
    """What follows a heading Abstract or Summary up to the next heading or blank line with one."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?is)(?:^|\n)#*\s*(?:abstract|summary)[:\s]*\n?(.*?)(?=\n#|\n\s*(?:1\.?\s+)?introduction|\n\s*keywords|\z)", 1)), F.lit(""))


def formatted(style: str, author: Column, title: Column, venue: Column, year: Column) -> Column:
    """A reference as a string: ieee, apa, mla, chicago or acm; parts that are null are left out."""
    y = year.cast("string")
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    shapes = {
        "ieee": [part(author, ","), part('"', title, ',"'), part(venue, ","), part(y, ".")],
        "apa": [part(author, " (", y, ")."), part(title, "."), part(venue, ".")],
        "mla": [part(author, "."), part('"', title, '."'), part(venue, ","), part(y, ".")],
        "chicago": [part(author, "."), part('"', title, '."'), part(venue, " (", y, ").")],
        "acm": [part(author, "."), part(y, "."), part(title, "."), part(venue, ".")],
    }
    return F.concat_ws(" ", *shapes[style])


def resolved(cited: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Each cited key with its entry's key, null where there is none; ``cited`` has key."""
    known = bibliography.select(F.col("key").alias("known_key")).distinct()
    return cited.join(known, cited["key"] == known["known_key"], "left")
