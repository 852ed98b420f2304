"""Paper structure, coherence and ordered places against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import papers as P
from lectern.functions import text as X
from lectern.operators import relational, rules, scoring


def plain_sections(text):
    out, held = [], None
    for line in text.split("\n"):
        m = re.match(r"(#{1,6})\s+\S|(\d+(?:\.\d+)*)\.?\s+[A-Z]", line)
        if m:
            level = len(m.group(1)) if m.group(1) else m.group(2).count(".") + 1
            held = [level, re.sub(r"^(#+|\d+(\.\d+)*\.?)\s+", "", line).strip(" "), []]
            out.append(held)
        elif held:
            held[2].append(line)
    return [(level, title, "\n".join(body).strip(" ")) for level, title, body in out]


def texts():
    rng = random.Random(4)
    parts = ["# Introduction", "## Experimental setup", "2.1 Findings on data", "3. conclusion", "3. Conclusions", "#none", "body text [1, 2]", "", "  see eq. 7 and Equation (12)", "### Analysis and Implications", "7 Methodology", "(Miller et al., 2019) [1, 2] [3]"]
    return [None, "", "# A", "plain"] + ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(60)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id long, text string")


def test_sections_and_form(rows):
    df = rows.select("*", P.sections(F.coalesce("text", F.lit(""))).alias("s"))
    keys = [P.key_section(F.col("s"), k).alias(k) for k in P.KEY_SECTIONS]
    parts = P.present(F.col("s"))
    for r in df.select("id", "text", "s", *keys, parts.alias("parts"), P.completeness(parts).alias("whole"), P.structure_type(parts, F.size("s")).alias("kind")).collect():
        want = plain_sections(r["text"] or "")
        assert [tuple(x) for x in r["s"]] == want
        named = {k: [c for _, t, c in want if any(n in t.lower() for n in names)] for k, names in P.KEY_SECTIONS.items()}
        assert {k: r[k] for k in named} == {k: "\n\n".join(v) if v else None for k, v in named.items()}
        have = [k for k in P.IMRAD if named[k]]
        assert r["parts"] == have and r["whole"] == len(have) / 4
        assert r["kind"] == ("standard" if len(have) == 4 else "partial" if len(have) > 1 else "other" if want else "unstructured")


def test_headings_end_with_their_line(spark):
    texts = ["# \nfoo", "1.\nA", "a\n#  \n## B \t\n", "# A", "\n\n# A\n\n# B\n", "1.1.1 X\n" + "1." * 5000 + " Y\nz", "####### no\n###### yes\n 1 No", "1. Ä\n2.x Y\n3.\tZ\r\nend\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", P.sections(F.col("text")).alias("s"))
    for r in df.collect():
        assert [tuple(x) for x in r["s"]] == plain_sections(texts[r["id"]])


def test_equations_and_citations(rows):
    for r in rows.where("text IS NOT NULL").select("text", P.equations(F.col("text")).alias("e"), P.citations(F.col("text")).alias("c")).collect():
        assert r["e"] == ["eq_" + n for n in re.findall(r"(?i)\b(?:equation|eq\.)\s*\(?(\d+)\)?", r["text"])]
        assert r["c"] == list(dict.fromkeys(re.findall(r"\[(\d+(?:\s*,\s*\d+)*)\]", r["text"]) + re.findall(r"\(([A-Z][A-Za-z]+(?: et al\.)?,? \d{4})\)", r["text"])))


def test_coherence(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "however", "as", "a", "result", "Über", "x1234", "long_word", "betas"]
    made = [None, "", "one\n two", "\n\n  \n"] + ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "id long, text string")
    for r in df.select("text", scoring.coherence(F.col("text")).alias("c")).collect():
        parts = [p.strip(" ") for p in (r["text"] or "").lower().split("\n") if p.strip(" ")]
        want = 50.0
        if len(parts) > 1:
            seen = [w for w in re.split(r"[^\w]+", " ".join(parts)) if re.fullmatch("[a-z]{4,}", w)]
            top = [w for w, n in Counter(seen).most_common() if n > 1][:20]
            linked = sum(any(x in p for x in X.TRANSITION_PARTS) for p in parts) / len(parts)
            topic = sum(sum(w in p for w in top) / len(top) for p in parts) / len(parts) if top else 0
            want = 100 * (0.4 * linked + 0.6 * topic)
        assert r["c"] == pytest.approx(min(100.0, want))


def test_citation_forms_count(spark):
    cases = {
        "a study (Smith and Jones, 2024)": False, "a study (Smith & Jones 2024)": False, "a study [Smith, 2024]": False, "a study (Smith et al. Jones, 2024)": False, "a study [3]": False, "a study^2": False,
        "a study (smith, 2024)": True, "a study": True, "nothing to cite": False, "results show": True, "95 % of": True, "95 of": False,
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r["text"]: r["u"] for r in df.select("text", rules.uncited(F.col("text")).alias("u")).collect()} == cases


def test_places(spark):
    rng = random.Random(2)
    keys = [(rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(keys, "a long, b long").repartition(7)
    got = [(r["a"], r["b"]) for r in relational.placed(df, [F.col("a"), F.desc("b")]).orderBy("place").collect()]
    assert got == sorted(keys, key=lambda k: (k[0], -k[1]))
    assert sorted(r["place"] for r in relational.placed(df, [F.col("a")]).collect()) == list(range(1, 501))
    assert relational.placed(df.limit(0), [F.col("a")]).collect() == []
