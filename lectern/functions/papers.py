"""The structure of papers in plain text: sections with levels and contents, key sections, equations and citations.

Everything is a column of arrays; texts are split into lines once. A heading is a line of one to six ``#`` and a blank, or of a
number such as 2.1 and a capital letter. Null texts give nulls or empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Names under which a key section stands.
KEY_SECTIONS = {
    "introduction": ["introduction", "background", "motivation"],
    "methods": ["methods", "methodology", "materials and methods", "experimental setup"],
    "results": ["results", "findings", "experiments", "evaluation"],
    "discussion": ["discussion", "analysis", "implications"],
    "conclusion": ["conclusion", "conclusions", "summary", "future work"],
}
#: Sections of the four-part form, and the order that the standard form has.
IMRAD = ["introduction", "methods", "results", "discussion"]

#: Patterns of titles and of contents that tell a section's class, in the order that decides ties.
TITLES = {
    "abstract": [r"\babstract\b", r"\bsummary\b", r"\bexecutive\s+summary\b"],
    "introduction": [r"\bintroduction\b", r"\bbackground\b", r"\bmotivation\b", r"\boverview\b"],
    "methods": [r"\bmethods?\b", r"\bmethodology\b", r"\bapproach\b", r"\bexperimental\s+setup\b", r"\bmaterials?\s+and\s+methods?\b", r"\bdata\s+collection\b"],
    "results": [r"\bresults?\b", r"\bfindings?\b", r"\boutcomes?\b", r"\banalysis\b", r"\bevaluation\b"],
    "discussion": [r"\bdiscussion\b", r"\binterpretation\b", r"\bimplications?\b", r"\banalysis\s+and\s+discussion\b"],
    "conclusion": [r"\bconclusions?\b", r"\bsummary\b", r"\bfinal\s+remarks?\b", r"\bclosing\s+thoughts?\b"],
    "references": [r"\breferences?\b", r"\bbibliography\b", r"\bworks?\s+cited\b", r"\bliterature\s+cited\b"],
}
CONTENTS = {
    "methods": [r"\bwe\s+(used|employed|applied|implemented)\b", r"\bthe\s+(method|approach|technique|algorithm)\b", r"\bdata\s+was\s+collected\b", r"\bexperiments?\s+were\s+conducted\b", r"\bparticipants?\b", r"\bsamples?\b"],
    "results": [r"\bour\s+results?\s+show\b", r"\bwe\s+found\s+that\b", r"\bthe\s+analysis\s+revealed\b", r"\bfigure\s+\d+\s+shows?\b", r"\btable\s+\d+\s+presents?\b", r"\bstatistically\s+significant\b"],
    "discussion": [r"\bthese\s+results?\s+suggest\b", r"\bour\s+findings?\s+indicate\b", r"\bthis\s+implies?\b", r"\bin\s+contrast\s+to\s+previous\b", r"\bcompared\s+to\s+other\s+studies\b", r"\blimitations?\b"],
}
#: Tenths that a title pattern, and each place of a content pattern, count; what a complete paper has.
TITLE_TENTHS, CONTENT_TENTHS = 4, 3
REQUIRED = ["abstract", "introduction", "methods", "results", "discussion"]

HEADING = r"^(#{1,6}\s+\S|\d+(\.\d+)*\.?\s+[A-Z])"
#: The same within a text of several lines: blanks don't reach over the line's end.
_HEADING_AHEAD = r"#{1,6}[^\S\n]+\S|\d++(?:\.\d++)*+\.?[^\S\n]+[A-Z]"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def level(line: Column) -> Column:
    """1 for the outermost headings: the number of marks, or of parts of the number."""
    marks, number = F.char_length(line) - F.char_length(F.ltrim(line, F.lit("#"))), F.regexp_extract(line, r"^(\d++(?:\.\d++)*+)", 1)
    return F.when(marks > 0, marks).otherwise(F.size(F.split(number, r"\.")))


def title(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^(?:#+|\d++(?:\.\d++)*+\.?)\s+", ""))


def sections(text: Column) -> Column:
    """array of (level, title, content): each heading with the lines up to the next one, of any level."""

    def section(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(level(head).alias("level"), title(head).alias("title"), F.trim(F.substr(part, F.char_length(head) + 2)).alias("content"))

    # all parts but the first begin with a heading
    parts = F.filter(F.split(text, rf"\n(?={_HEADING_AHEAD})"), lambda part, i: (i > 0) | part.rlike(rf"\A(?:{_HEADING_AHEAD})"))
    return F.coalesce(F.transform(parts, section), F.array().cast("array<struct<level:int,title:string,content:string>>"))


def key_section(found: Column, key: str) -> Column:
    """The contents of all sections whose title holds one of the key's names, with a blank line between; null without one."""
    low = lambda s: F.lower(s["title"])

    def named(s: Column) -> Column:
        out = F.lit(False)
        for name in KEY_SECTIONS[key]:
            out = out | F.contains(low(s), F.lit(name))
        return out

    mine = F.transform(F.filter(found, named), lambda s: s["content"])
    return F.when(F.size(mine) > 0, F.array_join(mine, "\n\n"))


def present(found: Column) -> Column:
    """Which parts of the four-part form have a section, in the form's order."""
    return F.filter(F.array(*[F.when(key_section(found, k).isNotNull(), F.lit(k)) for k in IMRAD]), lambda k: k.isNotNull())


def completeness(parts: Column) -> Column:
    """Share of the four parts, from 0 to 1."""
    return F.size(parts) / len(IMRAD)


def structure_type(parts: Column, n_sections: Column) -> Column:
    """standard (all four parts), partial (two or three), other (sections, but not these) or unstructured."""
    return F.when(F.size(parts) == len(IMRAD), "standard").when(F.size(parts) >= 2, "partial").when(n_sections > 0, "other").otherwise("unstructured")


def equations(text: Column) -> Column:
    """Numbers of the equations that a text refers to, in order, as often as it does."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:equation|eq\.)\s*\(?(\d+)\)?"), F.lit(1)), lambda n: F.concat(F.lit("eq_"), n))


def citations(text: Column) -> Column:
    """What a text cites, each once, in order of its form: numbers in brackets, then author and year in parentheses."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1)), lambda c: F.trim(c))
    names = F.transform(F.regexp_extract_all(text, F.lit(r"\(([A-Z][A-Za-z]+(?: et al\.)?,? \d{4})\)"), F.lit(1)), lambda c: F.trim(c))
    return F.array_distinct(F.concat(numbers, names))


def section_class(title: Column, content: Column) -> Column:
    """struct of kind and confidence: the class with most points, of all points (or of one, if they are fewer); without any, abstract and 0."""
    # no two content patterns match at places that overlap, so the matches of all are found by one pass and each tells its class by itself
    found = F.regexp_extract_all(content, F.lit(_any_of([p for patterns in CONTENTS.values() for p in patterns])), F.lit(0))
    return X.once(found, lambda places: _told(title, places))


def _any_of(patterns: list[str]) -> str:
    """All patterns in one; each begins with a word of two letters or more, by which most places are told apart."""
    bare = [p.removeprefix(r"\b") for p in patterns]
    first, second = ("".join(sorted({p[i] for p in bare})) for i in range(2))
    return rf"(?i)(?=[{first}][{second}])\b(?:{'|'.join(bare)})"


def _told(title: Column, places: Column) -> Column:
    scores = []
    for i, (kind, patterns) in enumerate(TITLES.items()):
        points = sum((F.when(title.rlike(f"(?i){p}"), TITLE_TENTHS).otherwise(0) for p in patterns), F.lit(0))
        points = F.when(title.rlike(_any_of(patterns)), points).otherwise(0)
        if kind in CONTENTS:
            mine = _any_of(CONTENTS[kind])
            points = points + CONTENT_TENTHS * F.array_size(F.filter(places, lambda x: x.rlike(mine)))  # noqa: B023
        scores.append(F.struct(F.coalesce(points, F.lit(0)).alias("points"), F.lit(-i).alias("rank"), F.lit(kind).alias("kind")))

    def told(every: Column) -> Column:
        best, total = F.array_max(every), F.aggregate(every, F.lit(0), lambda n, x: n + x["points"])
        return F.struct(best["kind"].alias("kind"), (best["points"] / F.greatest(total, F.lit(10))).alias("confidence"))

    return X.once(F.array(*scores), told)


def form(classes: Column) -> Column:
    """struct of completeness, confidence (both to 100) and missing classes, of an array of ``section_class``."""
    required = F.array(*map(F.lit, REQUIRED))
    sure = lambda least: F.transform(F.filter(classes, lambda c: c["confidence"] > least), lambda c: c["kind"])
    total = F.aggregate(classes, F.lit(0.0), lambda n, c: n + c["confidence"])
    whole = F.size(F.array_intersect(required, sure(0.5))) / len(REQUIRED) * 100
    mean = F.when(F.size(classes) > 0, total / F.size(classes) * 100).otherwise(0.0)
    return F.struct(whole.alias("completeness"), mean.alias("confidence"), F.array_except(required, sure(0.3)).alias("missing"))


def analysis_confidence(elements: Column, sections_: Column, texts: Column, headings: Column, references: Column) -> Column:
    """How far an analysis of a document with so many elements of each kind can be trusted, from 0.5 to 1."""
    add = lambda c, hundredths: F.when(c, hundredths).otherwise(0)
    total = 50 + F.when(elements > 50, 20).when(elements > 20, 10).otherwise(0) + add(sections_ > 3, 15) + add(headings > 0, 10) + add(references > 0, 5) + add(texts > 10, 10)
    return F.least(total, F.lit(100)) / 100
