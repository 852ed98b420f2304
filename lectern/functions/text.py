"""Column-valued text measures. All of them are narrow projections of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and phrases of the scorers, in lower case.
CONNECTORS = ["however", "therefore", "furthermore", "moreover", "nevertheless", "consequently"]
CONNECTOR_PHRASES = ["in addition", "on the other hand", "in contrast", "as a result"]
HEDGES = ["may", "might", "could", "would", "should", "possibly", "potentially", "likely", "suggest", "indicate", "appear", "seem", "tend"]
WEAK = ["very", "really", "quite", "rather", "pretty", "somewhat", "fairly"]
WEAK_PHRASES = ["in my opinion"]
NOMINAL_ENDINGS = ["tion", "sion", "ment", "ance", "ence", "ity", "ness"]
WORDY = [
    "in order to", "due to the fact that", "it is important to note that", "it should be mentioned that",
    "it is worth noting that", "the fact that", "in the event that", "for the purpose of",
]
#: Words that open a paragraph which takes up the one before it.
LINKS = ["however", "therefore", "furthermore", "moreover", "nevertheless", "consequently", "additionally", "similarly", "finally", "meanwhile", "subsequently", "thus", "hence"]
#: Words and phrases that make a paragraph count as linked.
TRANSITION_PARTS = ["however", "therefore", "furthermore", "moreover", "nevertheless", "consequently", "additionally", "similarly", "in contrast", "on the other hand", "as a result", "in addition", "finally"]
#: Common words of each language; those of the first five are patterns, too.
COMMON_WORDS = {
    "en": ["the", "and", "of", "to", "a", "in", "is", "it", "you", "that"],
    "es": ["el", "de", "que", "y", "a", "en", "un", "es", "se", "no"],
    "fr": ["le", "de", "et", "à", "un", "il", "être", "en", "avoir"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
}
#: Stop words of each language, where they are not its common words.
LANGUAGE_STOP_WORDS = {"en": ["the", "be", "to", "of", "and", "a", "in", "that", "have", "i"]}
STOP_WORDS = ["the", "and", "for", "are", "with", "that", "this", "from", "was", "were", "have", "has", "not", "but", "its"]
TRANSITIONS = ["next", "now", "first", "second", "finally", "however", "therefore", "in addition", "for example", "in conclusion"]
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it: as a list of one it is a variable, not written out again."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def n_sentences(text: Column) -> Column:
    """How many ``sentences`` a text has, without making them."""
    return F.regexp_count(text, F.lit(r"[^\s.!?][^.!?]*"))


def lines(text: Column, separator: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def syllables(word: Column) -> Column:
    """Vowel runs, one less for a final e, at least one; none for a word of ASCII punctuation."""
    bare = F.regexp_replace(F.lower(word), PUNCTUATION, "")
    n = F.regexp_count(bare, F.lit("[aeiouy]+")) - F.when(bare.endswith("e"), 1).otherwise(0)
    return F.when(bare == "", 0).otherwise(F.greatest(F.lit(1), n))


def padded(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, each with a blank on both sides: so that whole words are counted by one pattern."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "  "), F.lit(" "))


def bare_words(text: Column) -> Column:
    """Lower-case words without ASCII punctuation, each with a blank on both sides."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"\s+", "  "), F.lit(" "))


def word_hits(padded_: Column, listed: list[str]) -> Column:
    return F.regexp_count(padded_, F.lit(f" (?:{'|'.join(listed)}) "))


def ending_hits(padded_: Column, endings: list[str]) -> Column:
    return F.regexp_count(padded_, F.lit(f" [^ ]+(?:{'|'.join(endings)}) "))


def all_syllables(bare: Column) -> Column:
    """Syllables of all words of ``bare_words``, without taking them apart: vowel runs, less final e's, and one for each word
    that would have none (no vowel at all, or only one run that ends in its final e)."""
    count = lambda p: F.regexp_count(bare, F.lit(p))
    return (count("[aeiouy]+") - count("e ") + count(" [^aeiouy ]+ ") + count(" [^aeiouy ]*[aeiouy]*e ")).cast("long")


def phrase_count(text: Column, phrases: list[str]) -> Column:
    """How often the phrases stand in the text as whole words; a text without them is searched for their letters only."""
    low = F.lower(text)
    n = F.regexp_count(low, F.lit(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(phrases) + r")(?:[^\p{L}\p{N}_]|$)"))
    return F.when(any_of([F.contains(low, F.lit(p)) for p in phrases]), n).otherwise(F.when(text.isNotNull(), 0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def rounded(x: Column, digits: int) -> Column:
    """A number of at least 0 with so many decimals; halves are told by the product with the power of ten, as SQL engines do it."""
    return F.round(x * 10.0**digits) / 10.0**digits


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def hits(tokens_: Column, listed: list[str]) -> Column:
    return F.size(F.filter(tokens_, lambda w: w.isin(listed)))


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains."""
    low = F.lower(text)
    return sum((F.when(low.contains(p), 1).otherwise(0) for p in phrases), F.lit(0))


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return F.lit(206.835) - 1.015 * ratio(n_words, n_sentences) - 84.6 * ratio(n_syllables, n_words)


def grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Flesch-Kincaid grade, not below 0."""
    return F.greatest(F.lit(0.0), 0.39 * ratio(n_words, n_sentences) + 11.8 * ratio(n_syllables, n_words) - 15.59)


def academic_readability(ease: Column, n_chars: Column) -> Column:
    """Academic texts are not expected to be easy: pieces of the clamped ease; short texts have none."""
    e = clamp(ease)
    return F.when(n_chars < 100, F.lit(0.0)).when(e >= 30, F.least(F.lit(100.0), e + 40)).when(e >= 10, e * 2 + 10).otherwise(e * 3)


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the size of the smaller set."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return ratio(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y)))


def transition_quality(a: Column, b: Column) -> Column:
    """0.4 for a linking word among the first ten tokens of b, 0.6 by the overlap of both."""
    leads = F.arrays_overlap(F.slice(b, 1, 10), F.array(*map(F.lit, LINKS)))
    return F.when(leads, 0.4).otherwise(0.0) + 0.6 * overlap(a, b)


def band(x: Column, low: float, high: float, step: float) -> Column:
    """100 between low and high, falling by ``step`` for each unit outside."""
    return clamp(F.when(x < low, 100 - step * (low - x)).when(x > high, 100 - step * (x - high)).otherwise(100.0))


def level(score: Column, names: list[tuple[float, str]], other: str) -> Column:
    out = F
    for least, name in names:
        out = out.when(score >= least, name)
    return out.otherwise(other)


#: The least score of each level.
QUALITY_LEVELS = [(90.0, "excellent"), (70.0, "good"), (50.0, "fair"), (30.0, "poor")]


def first_match(text: Column, cases: list[tuple[str, list[str]]], other: str | None = None) -> Column:
    """The label of the first case of which the text contains a string."""
    out = F
    for label, parts in cases:
        out = out.when(any_of([text.contains(p) for p in parts]), label)
    return out.otherwise(F.lit(other))


def squeeze(text: Column) -> Column:
    """Line ends unified, runs of blank lines and blanks collapsed, page numbers dropped."""
    out = F.regexp_replace(text, "\r\n", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"(?m)^ ?Page [0-9]+ ?$", ""))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("long")


def file_size(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n < kb, F.format_string("%d bytes", n.cast("long")))
        .when(n < mb, F.format_string("%.1f KB", n / kb))
        .when(n < gb, F.format_string("%.1f MB", n / mb))
        .otherwise(F.format_string("%.1f GB", n / gb))
    )


def highlight(text: Column, term: str, size: int = 150) -> Column:
    """A fragment around the first hit, with the term marked; null without a hit."""
    at = F.locate(term.lower(), F.lower(text))
    begin = F.greatest(F.lit(1), at - size // 2)
    return F.when(at > 0, F.regexp_replace(F.substring(text, begin, F.lit(size)), f"(?i)({term})", "<mark>$1</mark>"))
