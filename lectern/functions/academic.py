"""Scores of academic papers: abstract, section types, references and completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Keywords of section titles, in the order that decides, and weights of the sections.
SECTIONS = [
    ("abstract", ["abstract", "summary", "overview"]),
    ("introduction", ["introduction", "background", "motivation"]),
    ("literature_review", ["literature review", "related work", "previous work"]),
    ("methodology", ["methodology", "methods", "approach", "experimental design"]),
    ("results", ["results", "findings", "outcomes", "analysis"]),
    ("discussion", ["discussion", "interpretation", "implications"]),
    ("conclusion", ["conclusion", "conclusions", "summary", "final remarks"]),
    ("references", ["references", "bibliography", "works cited"]),
]
WEIGHTS = {"title": 10, "abstract": 15, "introduction": 20, "methodology": 20, "results": 15, "discussion": 10, "conclusion": 5, "references": 5}


def section_type(title: Column) -> Column:
    return X.first_match(F.lower(title), SECTIONS, "unknown")


def completeness(types: Column) -> Column:
    """Weighted share of the section types that a document has."""
    total = sum(WEIGHTS.values())
    return 100 * sum((F.when(F.array_contains(types, name), w).otherwise(0) for name, w in WEIGHTS.items()), F.lit(0)) / total


def missing_sections(types: Column) -> Column:
    return F.array_except(F.array(*[F.lit(n) for n in WEIGHTS if n not in ("title", "abstract")]), types)


def abstract_scores(abstract: Column) -> Column:
    """Completeness, conciseness, clarity and structure of an abstract."""
    found = F.struct(X.once(F.lower(abstract), _said).alias("said"), F.regexp_count(abstract, F.lit(r"\S+")).alias("n"), X.n_sentences(abstract).alias("n_sentences"))
    return X.once(found, _abstract_scores)


def _said(low: Column) -> Column:
    parts = [X.any_of([low.contains(p) for p in group]) for group in (["background", "problem", "important"], ["method", "we use", "approach"], ["result", "we find", "show"], ["conclu", "implic", "suggest"])]
    share = sum((F.when(p, 1.0).otherwise(0.0) for p in parts), F.lit(0.0)) / 4
    return F.struct(share.alias("share"), sum((F.when(low.contains(p), 1).otherwise(0) for p in X.WORDY), F.lit(0)).alias("issues"))


def _abstract_scores(found: Column) -> Column:
    n, share = found["n"], found["said"]["share"]
    length = F.when(n.between(150, 250), 100.0).when(n.between(100, 300), 80.0).when(n.between(50, 400), 60.0).otherwise(40.0)
    mean = X.ratio(n, found["n_sentences"])
    clear = F.greatest(F.lit(50.0), X.band(mean, 15, 25, 3) - F.least(F.lit(30), 5 * found["said"]["issues"]))
    return F.struct((70 * share + 0.3 * length).alias("completeness"), length.alias("conciseness"), clear.alias("clarity"), (100 * share).alias("structure"))


def recency(years: Column, now: int) -> Column:
    """Step score of the mean age of references."""
    age = now - F.aggregate(years, F.lit(0.0), lambda a, y: a + y) / F.when(F.size(years) > 0, F.size(years))
    return F.when(F.size(years) == 0, 0.0).when(age <= 3, 100.0).when(age <= 5, 85.0).when(age <= 10, 70.0).otherwise(50.0)


def citation_quality(n: Column, n_words: Column) -> Column:
    """Density for each 1000 words, at most 80, and a constant share; 30 without citations."""
    return F.when(n == 0, 30.0).otherwise(F.least(F.lit(80.0), 10 * X.ratio(1000 * n, n_words)) + 14)


def weighted(present: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores that are not null, with weights made to sum to one."""
    used = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in present.items()), F.lit(0.0))
    total = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in present.items()), F.lit(0.0))
    return X.ratio(total, used)


def equation_complexity(latex: Column) -> Column:
    """Weighted counts of structures in an equation over its length, at most 100."""
    kinds = [(r"\\frac", 2.0), (r"\\int", 3.0), (r"\\sum", 3.0), (r"\\begin\{[pb]?matrix\}", 4.0), (r"\^|_", 0.5), (r"\\[a-z]+", 0.5)]
    weight = sum((w * F.regexp_count(latex, F.lit(p)) for p, w in kinds), F.lit(0.0))
    return F.least(F.lit(100.0), 100 * X.ratio(weight, F.char_length(latex)))


#: The phrases of a section by its kind.
KEY_PHRASES = {
    "methods": r"(?i)\b(?:we|the)\s+(?:used|employed|applied|implemented)\s+\w+(?:\s+\w+){0,3}",
    "results": r"(?i)\b(?:results?|findings?|analysis)\s+(?:show|reveal|indicate|demonstrate)\s+\w+(?:\s+\w+){0,3}",
    "discussion": r"(?i)\b(?:this|these)\s+(?:results?|findings?)\s+(?:suggest|indicate|imply)\s+\w+(?:\s+\w+){0,3}",
}
