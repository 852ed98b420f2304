"""Equations, bibliographies, cite commands and styles of decks against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import bibliography as B
from lectern.functions import equations as E
from lectern.operators import styles


def plain_equation(tex):
    c = re.sub(r"\s+", " ", re.sub(r"%.*", "", tex)).strip()
    v = sorted(set(re.findall(r"(?<!\\)[a-zA-Z](?:_\{[^}]*\})?(?:\^\{[^}]*\})?", c)))
    f = sorted({m for m in re.findall(r"\\(" + "|".join(E.FUNCTIONS) + r")\b", c)})
    o = sorted({x for x in c if x in E.SYMBOLS} | set(re.findall(r"\\(" + "|".join(E.COMMANDS) + ")", c)))
    bonus = 2 * (r"\frac" in c or r"\dfrac" in c or r"\tfrac" in c) + 3 * any(s in c for s in (r"\int", r"\iint", r"\iiint", r"\oint")) + 2.5 * (r"\sum" in c or r"\prod" in c) + 3.5 * any(s in c for s in (r"\matrix", r"\pmatrix", r"\bmatrix", r"\Bmatrix", r"\vmatrix", r"\Vmatrix"))
    return v, f, o, c.count("\\\\") + 1, 0.5 * len(v) + len(f) + 0.3 * len(o) + bonus


def plain_density(tex):
    weights = {r"\\frac": 2, r"\\int": 3, r"\\sum": 3, r"\\prod": 3, r"\\sqrt": 2, r"\^": 1, "_": 1, r"\\matrix": 4, r"\\begin": 3}
    return min(100, 100 * sum(w * len(re.findall(p, tex)) for p, w in weights.items()) / max(len(tex), 1))


def formulas():
    rng = random.Random(3)
    parts = [r"\frac{a}{b_{i}}", r"\int", r"\infty", r"x_{\alpha}^{2}", r"\sinh(t)", r"\sin x", r"\in S", "% gone\n", "≤", "-", "+", "/", "\\\\", r"\matrix{q}", r"\dfrac12", r"\prod", "\t", r"\sqrt y", r"\begin{pmatrix}", "k'", r"\Delta", "_", "^", "é", r"\vec v"]
    return ["", " ", "%x"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]


def test_parts_of_equations(spark):
    rows = list(enumerate(formulas()))
    df = spark.createDataFrame(rows, "id long, latex string").select("id", E.parsed(F.col("latex")).alias("e"), E.density(F.col("latex")).alias("d"), E.equation_class(F.col("latex")).alias("c"))
    for r in df.collect():
        tex, e = rows[r["id"]][1], r["e"]
        v, f, o, lines, complexity = plain_equation(tex)
        assert (e["variables"], e["functions"], e["operators"], e["n_lines"]) == (v, f, o, lines), tex
        assert e["complexity"] == pytest.approx(complexity) and r["d"] == pytest.approx(plain_density(tex))
        low = tex.lower()
        assert r["c"] == next((k for k, words in E.CLASSES if any(w in low for w in words)), "basic")


def test_null_equations(spark):
    r = spark.createDataFrame([(None,)], "latex string").select(E.parsed(F.col("latex")).alias("e"), E.density(F.col("latex")).alias("d"), E.equation_class(F.col("latex")).alias("c")).head()
    assert (r["e"]["variables"], r["e"]["n_lines"], r["e"]["complexity"], r["d"], r["c"]) == ([], 1, 0, 0, "basic")


def test_profiles(spark):
    rng = random.Random(4)
    rows = [(d, rng.choice(formulas()), rng.random() < 0.5, rng.choice("abc")) for d in range(40) for _ in range(rng.randint(1, 4))]
    got = {r["doc"]: r for r in E.profile(spark.createDataFrame(rows, "doc long, latex string, numbered boolean, display string"), "doc").collect()}
    for d in range(40):
        mine = [r for r in rows if r[0] == d]
        mixed = 70 if len({r[2] for r in mine}) == 2 else 100
        want = 100 if len(mine) < 2 else (mixed + 100 * len({r[3] for r in mine}) / len(mine)) / 2
        assert got[d]["n"] == len(mine) and got[d]["consistency"] == pytest.approx(want)
        assert got[d]["density"] == pytest.approx(sum(plain_density(r[1]) for r in mine) / len(mine))
        assert sum(got[d][k] for k in ("calculus", "linear_algebra", "fraction", "exponential", "radical", "basic")) == len(mine)
    assert E.profile(spark.createDataFrame([], "doc long, latex string, numbered boolean, display string"), "doc").count() == 0


BIB = """
% @article{gone, title = {x}
@Article{one,
  author = {Doe, Jane Q. and John van Smith AND \\textbf{Plato}},
  title = {A {Nested} \\emph{title}
     over lines},
  year = "c. 1987", pages = {1--2}, note = {see \\href{http://a.b}{here}},
  Pages = {3--4}
}
@strange{ two ,
  title = bare
}
@book{one2, title = {no end}
@misc{two,
  title = {later}
}
  @online{three,
  note = {}
  }
"""


def test_entries_of_a_bibliography(spark):
    df = spark.createDataFrame([(1, BIB), (2, None), (3, ""), (4, "no entry @ all")], "id long, bib string")
    got = {r["cite_key"]: r for r in B.entries(df, "id", "bib").collect()}
    assert set(got) == {"one", "two", "one2"}  # what never ends runs to the next brace that begins a line
    listed = [(f["name"], f["value"]) for f in got["one"]["fields"]]
    assert [n for n, _ in listed] == ["author", "title", "year", "pages", "note", "pages"] and dict(listed)["pages"] == "3--4"
    assert got["one"]["kind"] == "article" and got["two"]["kind"] == "misc"
    f = B.entries(df, "id", "bib").where("cite_key = 'one'").select(B.cleaned(B.field(F.col("fields"), "title")).alias("t"), B.cleaned(B.field(F.col("fields"), "note")).alias("n"), B.people(B.field(F.col("fields"), "author")).alias("p"), B.field(F.col("fields"), "doi").alias("none")).head()
    assert f["t"] == "A {Nested} title over lines" and f["n"] == "see here" and f["none"] is None
    assert [tuple(p) for p in f["p"]] == [("Jane", "Q.", "Doe"), ("John", "van", "Smith"), ("", "", "Plato")]


def test_people(spark):
    rows = ["A", "A B", "A B C D", "D, A", "D, A B C", "van D, A", "D,", " and ", "A and  B  AND C", "\\emph{A} B", "A, B and C", ""]
    want = [[("", "", "A")], [("A", "", "B")], [("A", "B C", "D")], [("A", "", "D")], [("A", "B C", "D")], [("A", "", "van D")], [("", "", "D,")], [], [("", "", "A"), ("", "", "B"), ("", "", "C")], [("A", "", "B")], [("B", "", "A"), ("", "", "C")], []]
    got = spark.createDataFrame(list(enumerate(rows)), "i long, a string").select("i", B.people(F.col("a")).alias("p")).orderBy("i").collect()
    for r, w in zip(got, want, strict=True):
        if rows[r["i"]] != " and ":
            assert [tuple(p) for p in r["p"]] == w, rows[r["i"]]


def plain_places(text):
    out = []
    for no, m in enumerate(re.finditer(r"\\(cite[a-z]*)\s*(?:\[([^\]]*)\])?\s*(?:\[([^\]]*)\])?\s*\{([^}]+)\}", text, re.I), 1):
        pre, post = m.group(2) or "", m.group(3) or ""
        if pre and not post:
            pre, post = "", pre
        lines = text[: m.start()].split("\n")
        kind = m.group(1).lower()
        out.append((no, kind if kind in styles.CITE_TYPES else "cite", pre.strip(" "), post.strip(" "), m.group(4), m.start(), len(lines), len(lines[-1]) + 1))
    return out


def test_places_of_citations(spark):
    rng = random.Random(9)
    parts = ["\n", "word ", "\\cite{a}", "\\Citep[x]{b, c}", "\\citet [ p ]\n[]\n{d}", "\\cite[a][b]{e\nf}", "\\cite{}", "ü😀", "\\citenum{g}", "\n\n", "{", "\\cite", "[z]{h}", "\\citeyear{i}"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(200)] + [(900, None), (901, "\\cite{x}" * 3000)]
    got = {}
    for r in styles.citation_places(spark.createDataFrame(rows, "id long, tex string"), "id", "tex").collect():
        got.setdefault(r["id"], []).append((r["no"], r["type"], r["pre"], r["post"], r["keys"], r["position"], r["line"], r["col"]))
    for i, text in rows:
        assert sorted(got.get(i, [])) == plain_places(text or ""), text


def test_styles_of_decks(spark):
    rng = random.Random(6)
    keys = ["font_family", "Title.headingFont", "font.size", "color", "box.border", "line_height", "paragraph_spacing"]
    values = ["Arial", "Lato", "Inter", "Roboto", "#aabbcc", "#AABBCC and rgb(1, 2)", "#12345", "#000000#111111", "#222222#333333", "1.5"]
    rows = []
    for deck in range(30):
        for place in range(rng.randint(1, 6)):
            style = {k: rng.choice(values) for k in rng.sample(keys, rng.randint(0, 6))} if rng.random() < 0.9 else None
            rows.append((deck, place, rng.choice(["content", "title"]), style, rng.choice([None, [], [299, 300, None, 0], [72, 72]])))
    df = spark.createDataFrame(rows, "deck long, place long, kind string, style map<string,string>, resolutions array<int>")
    want = []
    for deck in range(30):
        mine = [r for r in rows if r[0] == deck]
        said = [(k, v) for r in mine for k, v in (r[3] or {}).items()]
        fonts = {v for k, v in said if "font" in k.split(".")[-1].lower()}
        colours = {c for _, v in said for c in re.findall(styles.COLOUR, v)}
        want += [(deck, "fonts", None, None, len(fonts))] * (len(fonts) > 3) + [(deck, "colours", None, None, len(colours))] * (len(colours) > 5)
        for kind in ("content", "title"):
            spaced = {(r[3].get("line_height"), r[3].get("paragraph_spacing")) for r in mine if r[2] == kind and r[3] and {"line_height", "paragraph_spacing"} & set(r[3])}
            want += [(deck, "spacing", kind, None, len(spaced))] * (len(spaced) > 1)
        want += [(deck, "images", None, r[1], n) for r in mine for n in r[4] or [] if n and n < 300]
    got = [tuple(r) for r in styles.style_issues(df, "deck").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {w[1] for w in want} == {"fonts", "colours", "spacing", "images"}
