"""Names of institutions from the domains of their addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import any_of

#: Endings of academic domains, labels that name a service, abbreviations, and words that make "University" needless.
ENDINGS = [".edu", ".ac.uk", ".edu.au", ".edu.cn", ".ac.jp", ".edu.br", ".edu.mx", ".ac.in"]
SERVICES = ["mail", "email", "smtp", "www"]
ABBREVIATIONS = {"uni": "University", "univ": "University", "tech": "Technology", "inst": "Institute", "coll": "College", "acad": "Academy", "poly": "Polytechnic"}
COMPLETE = ["university", "college", "institute", "academy", "school", "center"]


def institution_name(domain: Column) -> Column:
    """The last label of more than three letters that names no service (else all labels), in title case, abbreviations in full."""
    bare = F.regexp_replace(domain, rf"({'|'.join(e.replace('.', chr(92) + '.') for e in ENDINGS)})$", "")
    labels = F.split(bare, r"\.")
    named = F.try_element_at(F.filter(labels, lambda x: (F.char_length(x) > 3) & ~x.isin(SERVICES)), F.lit(-1))
    whole = F.when(F.size(labels) > 1, F.coalesce(named, bare)).otherwise(bare)
    words = F.filter(F.split(F.translate(whole, "-_", "  "), r"\s+"), lambda w: w != "")
    known = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))

    def full(w: Column) -> Column:
        titled = F.array_join(F.transform(F.split(F.lower(w), r"(?<=[^a-z])(?=[a-z])"), lambda x: F.initcap(x)), "")
        return F.coalesce(F.try_element_at(known, F.lower(w)), titled)

    name = F.array_join(F.transform(words, full), " ")
    return F.when(any_of([F.lower(name).contains(w) for w in COMPLETE]), name).otherwise(F.concat(name, F.lit(" University")))
