"""Sanitising text and HTML with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is removed from plain text, in this order.
TEXT_REMOVALS = [
    r"<script[^>]*>.*?</script>", r"javascript:[^\"']*", r"vbscript:[^\"']*", r"data:[^\"']*",
    r"<form[^>]*>.*?</form>", r"<input[^>]*>", r"<button[^>]*>.*?</button>",
    r"<object[^>]*>.*?</object>", r"<embed[^>]*>.*?</embed>", r"<applet[^>]*>.*?</applet>", r"<iframe[^>]*>.*?</iframe>",
    r"\.exe[\"'\s]", r"\.bat[\"'\s]", r"\.cmd[\"'\s]", r"\.com[\"'\s]", r"\.scr[\"'\s]",
]


def plain_text(html: Column) -> Column:
    """Readable text: scripts, styles and navigation go with what they hold, then all tags; blanks are squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"[ \t\n\r]+", " "))


def filtered(text: Column) -> Column:
    """struct of text (what is left after all removals) and found (numbers of the removals, from 0, that found something)."""
    rows = F.array(F.struct(text.alias("text"), F.array().cast("array<int>").alias("found")))
    for i, pattern in enumerate(TEXT_REMOVALS):
        rows = F.transform(rows, _step(i, f"(?is){pattern}"))
    return rows[0]


def _step(i: int, pattern: str):
    def left(before: Column):
        shorter = lambda t: F.char_length(t) < F.char_length(before["text"])
        return lambda t: F.struct(t.alias("text"), F.when(shorter(t), F.concat(before["found"], F.array(F.lit(i)))).otherwise(before["found"]).alias("found"))

    # as a list of one, what is left is a variable and not replaced anew by each step that reads it
    return lambda before: F.transform(F.array(F.regexp_replace(before["text"], pattern, "")), left(before))[0]


def tidy(text: Column, strict: bool = False) -> Column:
    """At most two line ends, one blank and one tab in a row, and no null characters.

    ``strict`` also removes what can't be printed: all control and format characters and separators but blanks, tabs and line ends.
    """
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " "), r"\t+", "\t")
    out = F.replace(out, F.lit("\x00"), F.lit(""))
    return F.regexp_replace(out, r"[\p{C}\p{Z}&&[^ \n\t\r]]", "") if strict else out


def safe_text(text: Column, strict: bool = False) -> Column:
    """Text without dangerous parts, tidied."""
    for pattern in TEXT_REMOVALS:
        text = F.regexp_replace(text, f"(?is){pattern}", "")
    return tidy(text, strict)
