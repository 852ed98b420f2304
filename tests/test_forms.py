"""Classes of sections and references, sanitised texts, LaTeX sources and responses against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import papers as P
from lectern.functions import sanitize, security


def plain_class(title, content):
    points = {}
    for kind, patterns in P.TITLES.items():
        points[kind] = 4 * sum(bool(re.search(p, title, re.I)) for p in patterns) + 3 * sum(len(re.findall(p, content, re.I)) for p in P.CONTENTS.get(kind, []))
    best = max(points, key=points.get)
    return best, points[best] / max(sum(points.values()), 10)


#: A match of each content pattern.
SAID = [
    "We used", "the algorithm", "data was collected", "experiments were  conducted", "participant", "Samples", "our result show", "we found that", "the analysis revealed", "figure 12 shows", "table 3 present", "statistically significant",
    "these results suggest", "our findings indicate", "this implie", "in contrast to previous", "compared to other studies", "limitation",
]


def sections():
    rng = random.Random(11)
    titles = ["Introduction", "Background and Motivation", "Materials and Methods", "Results", "Analysis and Discussion", "Summary", "Final remarks", "Works cited", "Nothing", "", "metHOD", "Methodical"]
    says = ["We used samples.", "our results show", "These results suggest a limitation", "Figure 3 shows", "participants", "the algorithm", "compared to other studies", "plain words", "we found that", "table x presents"]
    return [(i, rng.choice(titles), " ".join(rng.choice(says) for _ in range(rng.randint(0, 9)))) for i in range(200)]


def test_section_classes(spark):
    rows = sections()
    got = {r["id"]: r["c"] for r in spark.createDataFrame(rows, "id long, title string, content string").select("id", P.section_class(F.col("title"), F.col("content")).alias("c")).collect()}
    for i, title, content in rows:
        kind, confidence = plain_class(title, content)
        assert got[i]["kind"] == kind and got[i]["confidence"] == pytest.approx(confidence)


def test_places_of_all_content_patterns_are_found_by_one_pass(spark):
    rng = random.Random(8)
    words = sorted({w for p in P.CONTENTS.values() for q in p for w in re.findall("[a-z]{2,}", q.replace(r"\b", "").replace(r"\s", " "))} | {"in", "7", "show", "implies", "results", "experiment", "x", ".", "\n"})
    rows = [(i, "Results", " ".join(rng.choice([w, w.title(), w + "s"]) for w in rng.choices(words, k=60))) for i in range(400)]
    rows += [(400 + i, "", f"{a} {b}.") for i, (a, b) in enumerate((a, b) for a in SAID for b in SAID)]
    df = spark.createDataFrame(rows, "id long, title string, content string").select("id", P.section_class(F.col("title"), F.col("content")).alias("c"))
    got = {r["id"]: r["c"] for r in df.collect()}
    for i, title, content in rows:
        kind, confidence = plain_class(title, content)
        assert got[i]["kind"] == kind and got[i]["confidence"] == pytest.approx(confidence)


def test_a_section_is_searched_for_content_once(spark):
    df = spark.range(1).select(P.section_class(F.col("id").cast("string"), F.col("id").cast("string")).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_nulls_are_no_section_of_any_class(spark):
    r = spark.createDataFrame([(None, None)], "title string, content string").select(P.section_class(F.col("title"), F.col("content")).alias("c")).head()["c"]
    assert (r["kind"], r["confidence"]) == ("abstract", 0)


def test_form_of_papers(spark):
    rng = random.Random(5)
    kinds = list(P.TITLES)
    papers = [(i, [(rng.choice(kinds), rng.choice([0.0, 0.3, 0.31, 0.5, 0.51, 1.0])) for _ in range(rng.randint(0, 7))]) for i in range(60)]
    df = spark.createDataFrame(papers, "id long, c array<struct<kind:string,confidence:double>>")
    for r in df.select("id", P.form(F.col("c")).alias("f")).collect():
        c = papers[r["id"]][1]
        assert r["f"]["completeness"] == pytest.approx(100 * len({k for k, x in c if x > 0.5} & set(P.REQUIRED)) / 5)
        assert r["f"]["confidence"] == pytest.approx(100 * sum(x for _, x in c) / len(c) if c else 0)
        assert r["f"]["missing"] == [k for k in P.REQUIRED if k not in {k for k, x in c if x > 0.3}]


def test_confidence_of_an_analysis(spark):
    rows = [(e, s, t, h, r) for e in (0, 20, 21, 50, 51) for s in (3, 4) for t in (10, 11) for h in (0, 1) for r in (0, 2)]
    df = spark.createDataFrame(rows, "e int, s int, t int, h int, r int")
    for x in df.select("*", P.analysis_confidence(*map(F.col, "esthr")).alias("c")).collect():
        want = 0.5 + (0.2 if x["e"] > 50 else 0.1 if x["e"] > 20 else 0) + 0.15 * (x["s"] > 3) + 0.1 * (x["h"] > 0) + 0.05 * (x["r"] > 0) + 0.1 * (x["t"] > 10)
        assert x["c"] == pytest.approx(min(1, want))


def plain_safe(text, strict):
    found = []
    for i, p in enumerate(sanitize.TEXT_REMOVALS):
        if re.search(p, text, re.I | re.S):
            found.append(i)
            text = re.sub(p, "", text, flags=re.I | re.S)
    text = re.sub(r"\t+", "\t", re.sub(" {2,}", " ", re.sub(r"\n{3,}", "\n\n", text))).replace("\x00", "")
    return found, "".join(c for c in text if c.isprintable() or c in "\n\t\r") if strict else text


def test_safe_texts(spark):
    rng = random.Random(3)
    bits = ["<script>", "</SCRIPT>", "javascript:go()", "'", '"', " data:x", "<form a>", "</form>", "<input x>", "\n", "\n\n\n", "  ", "\t\t", "\x00", "\x07", "\u200b", "\u00a0", "é", "run.exe ", ".com'", "<iframe\n>", "</iframe>", "<embed>", "</embed>", "text"]
    texts = ["", None] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    t = F.col("t")
    for r in df.select("id", sanitize.safe_text(t).alias("a"), sanitize.safe_text(t, strict=True).alias("b"), sanitize.filtered(t)["found"].alias("k"), sanitize.tidy(sanitize.filtered(t)["text"]).alias("c")).collect():
        if texts[r["id"]] is None:
            assert r["a"] is None and r["b"] is None and r["k"] == []
        else:
            found, plain = plain_safe(texts[r["id"]], False)
            assert (r["k"], r["a"], r["b"]) == (found, plain, plain_safe(texts[r["id"]], True)[1]) and r["c"] == plain


def test_reference_types(spark):
    lines = [("In Journal of X", "journal_article"), ("Annual Workshop", "conference_paper"), ("MIT Press", "book"), ("PhD", "thesis"), ("at www.x.org", "website"), ("Nothing", "unknown"), ("cellular PRESS", "journal_article"), ("", "unknown")]
    df = spark.createDataFrame(lines, "line string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", C.reference_type(F.col("line"))).collect())


def test_latex_sources(spark):
    cases = [
        ("\\textbf{bold} and \\emph{it} % gone\n\\cite[p. 3]{key} end", "bold and it end"), ("a\\section*{Title}b  c", "ab c"), ("\\textbf{}x", "x"), (None, ""), ("plain", "plain"), ("\\emph{a \\textit{b}} c", "a b} c"),
    ]
    df = spark.createDataFrame(cases, "s string, want string")
    rows = df.select("s", "want", C.plain_latex(F.col("s")).alias("got")).collect()

    def plain(text):
        text = re.sub(r"%.*", "", text or "")
        for c in ("textbf", "textit", "emph", "texttt"):
            text = re.sub(rf"\\{c}\{{([^}}]+)\}}", r"\1", text)
        return re.sub(r"\s+", " ", re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})*", "", text)).strip()

    assert all(r["got"] == plain(r["s"]) for r in rows)
    heads = [("\\usepackage[ngerman, english]{babel}", "english"), ("\\usepackage[french]{babel}", "french"), ("\\usepackage{polyglossia}\\setmainlanguage{german}", "german"), ("\\setmainlanguage{german}", "english"), ("", "english"), ("\\usepackage{babel}", "english")]
    got = spark.createDataFrame(heads, "s string, want string").withColumn("got", C.latex_language(F.col("s"))).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_responses(spark):
    rows = [("critical", "ransomware"), ("high", "rootkit"), ("medium", "trojan"), ("low", "adware"), (None, None)]
    got = [r["a"] for r in spark.createDataFrame(rows, "s string, k string").select(security.responses(F.col("s"), F.col("k")).alias("a")).collect()]
    assert got == [
        ["alert", "block", "isolate_user", "log", "notify_admin", "quarantine", "scan_system"], ["alert", "log", "notify_admin", "quarantine", "scan_system"], ["alert", "log"], ["log"], ["log"],
    ]
