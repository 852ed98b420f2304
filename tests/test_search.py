"""Index, trees, cycles, intervals, cells and dotted paths against plain Python."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.plans.registry import Tables
from lectern.plans.search import latex_sources
from lectern.functions import html, latex
from lectern.operators import graphs, intervals, textindex, vectors
from lectern.operators.attributes import at_path, satisfied
from lectern.operators.vectors import CellIndex

WORDS = ["alpha", "beta", "gamma", "delta", "é", "2024", "x", "rare", "Licence"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    out = [(i, " ".join(rng.choices(WORDS, [9, 7, 5, 3, 2, 2, 2, 0.1, 1], k=rng.randint(0, 40))), rng.choice(["en", "de", None])) for i in range(300)]
    return out + [(900, None, "en"), (901, "", None), (902, "alpha " * 3000, "en"), (903, "alpha-beta_gamma,Alpha", "en"), (903, "beta beta", "en")]


@pytest.fixture(scope="module")
def index(spark, texts):
    held, textindex.BLOCK_BITS = textindex.BLOCK_BITS, 3
    docs = spark.createDataFrame([(*x, "k", 1) for x in texts], "doc_id long, text string, lang string, key string, block int").repartition(3)
    out = textindex.TextIndex.build(docs, {"text": "text", "lang": "lang"}, "doc_id")
    textindex.BLOCK_BITS = held
    return out


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_BITS", 3)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bm25(texts, asked):
    scores = Counter()
    for field, term, weight in asked:
        lists = [words(x[1] if field == "text" else x[2]) for x in texts]
        mean, df = sum(map(len, lists)) / len(lists), sum(term in w for w in lists)
        for at, w in enumerate(lists):
            if term in w:
                tf = w.count(term)
                scores[at] += weight * math.log(1 + (len(lists) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return sorted(((texts[at][0], round(s, 6)) for at, s in scores.items()), key=lambda x: (-x[1], x[0]))


ASKED = {1: [("text", "rare", 1.0), ("text", "alpha", 0.5)], 2: [("text", "beta", 1.0), ("lang", "de", 0.25)], 3: [("text", "nowhere", 1.0)], 4: [("text", "licence", 2.0), ("text", "x", 1.0), ("text", "é", 1.0)]}


def test_block_max_top_k_is_the_full_ranking(spark, texts, index):
    queries = spark.createDataFrame([(q, *t) for q, ts in ASKED.items() for t in ts], "query long, field string, term string, weight double")
    for k in (1, 7, 1000):
        got = {q: [] for q in ASKED}
        for r in index.ranked(queries, k).orderBy("query", "rank").collect():
            got[r["query"]].append((r["id"], r["score"]))
        for q, asked in ASKED.items():
            want = bm25(texts, asked)[:k]
            assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want], atol=2e-6)


def test_block_max_reads_fewer_blocks(spark, index):
    queries = spark.createDataFrame([(4, *t) for t in ASKED[4]], "query long, field string, term string, weight double")
    first, then, _ = index.waves(queries, 3)
    every = index.blocks.where(F.col("key").isin("text:licence", "text:x", "text:é")).select("block").distinct().count()
    assert first.count() + then.count() < every


def test_phrases_and_trees(spark, texts, index):
    phrases = {1: ["alpha", "beta"], 2: ["alpha", "alpha", "alpha"], 3: ["gamma"], 4: ["rare", "rare"], 5: []}
    asked = spark.createDataFrame([(q, "text", p) for q, p in phrases.items()], "query long, field string, words array<string>")
    got = sorted((r["query"], r["id"], r["n"]) for r in index.phrases(asked).collect())
    want = []
    for q, p in phrases.items():
        for i, text, _ in texts:
            n = sum(words(text)[at : at + len(p)] == p for at in range(len(words(text)))) if p else 0
            want += [(q, i, n)] if n else []
    assert got == sorted(want)
    t = textindex
    trees = {1: t.all_of(t.term("alpha"), t.any_of(t.phrase("beta gamma"), t.term("rare"))), 2: t.but_not(t.term("delta"), t.term("alpha")), 3: t.all_of(t.term("de", "lang"), t.term("nowhere"))}
    has = lambda w, p: any(w[at : at + len(p)] == p for at in range(len(w)))
    tests = {1: lambda w: "alpha" in w and (has(w, ["beta", "gamma"]) or "rare" in w), 2: lambda w: "delta" in w and "alpha" not in w, 3: lambda w: False}
    found = sorted((r["query"], r["id"]) for r in index.matching(trees).collect())
    assert found == sorted((q, i) for q, test in tests.items() for i, text, _ in texts if test(words(text)))


def test_index_of_nothing(spark):
    empty = textindex.TextIndex.build(spark.createDataFrame([], "doc_id long, text string"), {"text": "text"}, "doc_id")
    assert empty.ranked(spark.createDataFrame([(1, "text", "a", 1.0)], "query long, field string, term string, weight double"), 3).collect() == []
    assert textindex.TextIndex(spark, empty.path).blocks.count() == 0


# LaTeX


def plain_tree(text):
    """Nodes by recursion over a reversed list of tokens: (kind, name, start, stop, closed, children)."""
    tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"%[^\n]*|\\(?:begin|end)[ \t]*\{[^{}\n]*\}|\\[^\W\d_]+\*?|\\(?:.|\n)?|\$\$|[${}\[\]]|[^ \t\n\r\f\v\\%${}\[\]]+", text)]
    tokens.reverse()

    def ends(word):
        if m := re.fullmatch(r"\\end[ \t]*\{(.*)\}", word):
            return "env " + m.group(1).strip()
        return {"}": "}", "]": "]", r"\)": r"\(", r"\]": r"\[", "$": "$", "$$": "$$"}.get(word)

    def inner(stack, fresh=-1):
        """Children until something ends; (children, what ended, where it starts and stops)."""
        out = []
        while tokens:
            word, a, b = tokens[-1]
            end, opens = ends(word), None
            if m := re.fullmatch(r"\\begin[ \t]*\{(.*)\}", word):
                opens = ("environment", m.group(1).strip(), "env " + m.group(1).strip())
            elif word == "{":
                opens = ("group", "", "}")
            elif word == "[" and fresh == a:
                opens = ("option", "", "]")
            elif word in (r"\(", r"\["):
                opens = ("math" if word == r"\(" else "display", word, word)
            elif word in ("$", "$$") and not any(s[1] == word for s in stack):
                opens = ("math" if word == "$" else "display", word, word)
            if opens:
                tokens.pop()
                kids, got, x, y = inner([*stack, (opens[0], opens[2])], b if opens[0] == "environment" else -1)
                closed = got == opens[2]
                if closed:
                    tokens.pop()
                out.append((opens[0], opens[1], a, y if closed else x, closed, kids))
                fresh = y if opens[0] == "option" and closed else -1
                if not closed:
                    return out, got, x, y
                continue
            if end == "]" and not (stack and stack[-1][1] == "]"):
                end = None
            if end:
                stop_at = {"}": ("environment",), r"\(": ("environment", "group"), r"\[": ("environment", "group"), "$": ("environment",), "$$": ("environment",)}.get(end, ())
                fits = False
                for kind, closer in reversed(stack):
                    if closer == end:
                        fits = True
                        break
                    if kind in stop_at:
                        break
                if fits:
                    return out, end, a, b
                tokens.pop()
                out.append(("stray", end.removeprefix("env "), a, b, True, []))
                fresh = -1
                continue
            tokens.pop()
            if word[0] == "%":
                out.append(("comment", "", a, b, True, []))
            elif word[0] == "\\" and word[1:2] and word[1:2] in "{}%\\#$^_&~":
                out.append(("escape", word, a, b, True, []))
            elif word[0] == "\\":
                out.append(("command", word[1:], a, b, True, []))
            else:
                out.append(("text", "", a, b, True, []))
            fresh = b if out[-1][0] == "command" else -1
        return out, None, len(text), len(text)

    top, *_ = inner([])
    rows = []

    def walk(nodes, parent, depth):
        for kind, name, a, b, closed, kids in nodes:
            me = len(rows)
            before = text[:a]
            rows.append([me, parent, depth, kind, name, a, b, before.count("\n") + 1, a - (before.rfind("\n") + 1) + 1, closed])
            walk(kids, me, depth + 1)

    walk(top, -1, 0)
    return rows


def random_latex(rng):
    parts = ["{", "}", "[", "]", "$", "$$", r"\(", r"\)", r"\[", r"\]", r"\begin{a}", r"\end{a}", r"\begin{b*}", r"\end{b*}", r"\emph", r"\section*", "% note\n", r"\%", r"\$", "\n", " ", "word", "é", "\\", r"\1"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_latex_tree():
    rng = random.Random(9)
    for text in [r"\cite[p.~3][x]{a}{b}", r"\begin{a}[o]{x\begin{b*}$y$\end{b*}}\end{a}", r"{\[x}\]", r"$a\$b$ % $ {", r"\begin{a}$x\end{a}$", *(random_latex(rng) for _ in range(1500))]:
        assert latex.parsed(text) == plain_tree(text), text
    option = latex.parsed(r"\begin{a}[o]\end{a}")
    assert [r[3] for r in option] == ["environment", "option", "text"]


def test_latex_tables(spark):
    rows = [(1, r"\cite[p]{a}\emph{b}{c} x"), (2, None), (3, ""), (1, "{")]
    df = spark.createDataFrame(rows, "id long, source string")
    nodes = latex.trees(df)
    assert nodes.where("id = 2 OR id = 3").count() == 0 and nodes.where("NOT closed").count() == 1
    one = spark.createDataFrame(rows[:1], "id long, source string")
    got = {r["name"]: (r["n_options"], r["n_groups"]) for r in latex.arguments(latex.trees(one)).collect()}
    assert got == {"cite": (1, 1), "emph": (0, 2)}


def test_latex_is_linear_for_stray_ends():
    assert len(latex.parsed("{" * 100_000 + r"\end{x}" * 100_000 + "$" + r"\)" * 50_000)) == 250_001


def test_latex_of_many_texts_and_dealt_sources(spark, sf):
    rng = random.Random(4)
    texts = ["", " \n", *(random_latex(rng) for _ in range(300)), "\\", "% end", "{", r"}\item"]
    names = [x.split()[0] for x in latex.NODE.split(", ")]
    text_of, columns = latex.parsed_many(texts, latex.Tokens(), names)
    got = [list(r) for r in zip(text_of.tolist(), *(c.to_pylist() for c in columns.values()), strict=True)]
    assert got == [[i, *row] for i, text in enumerate(texts) for row in plain_tree(text)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, source string")
    per = latex.kind_counts(df, "id", "source", {"n": "text", "m": "stray"}).collect()
    trees = {i: [r[3] for r in plain_tree(text)] for i, text in enumerate(texts)}
    assert {r["id"]: (r["n"], r["m"]) for r in per} == {i: (k.count("text"), k.count("stray")) for i, k in trees.items() if k}
    # a file of one row group is read by one task; its texts are dealt before they are worked on
    plan = latex_sources(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("replace(") < plan.index("RepartitionByExpression")


# HTML


def test_html_tree_and_sanitiser(spark):
    rows, _ = html.elements("<!-- <b> --><div><p>a<b>c</p>d</b><br/><script>if (a<b) '</p>'</script></div></i><p>")
    assert [(r[3], r[1], r[2], r[6]) for r in rows] == [("div", -1, 0, True), ("p", 0, 1, True), ("b", 1, 2, False), ("br", 0, 1, True), ("script", 0, 1, True), ("p", -1, 0, False)]
    cases = {
        "<p>a</p><form>b<form>c</form>d</form>e": ("<p>a</p>e", 1, 0, 0),
        "x<object><p>y": ("x", 1, 0, 0),
        "<div onclick='a>b' id=q onload=z><a class=x href=http://e>t</a><a href='/in'>u</a></div>": ('<div id=q><a class=x href="#">t</a><a href=\'/in\'>u</a></div>', 0, 2, 1),
        "<SCRIPT>1</SCRIPT><script>open": ("", 2, 0, 0),
        "<!-- <script> --><input><iframe></iframe>": ("<!-- <script> --><iframe></iframe>", 1, 0, 0),
        "a < b > c": ("a < b > c", 0, 0, 0),
    }
    for source, want in cases.items():
        assert html.sanitised(source) == want, source
    assert html.sanitised("<iframe>x</iframe>y", paranoid=True) == ("y", 1, 0, 0)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<form>x")], "page_id long, html string")
    assert sorted((r["id"], r["html"], r["elements"]) for r in html.sanitise(df, "page_id", "html").collect()) == [(1, None, 0), (2, "", 0), (3, "", 1)]
    assert [r["tag"] for r in html.trees(df, "page_id", "html").collect()] == ["form"]


# cycles, intervals, cells, paths


def test_cycles(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(100, 101), (101, 102), (102, 100), (102, 103), (7, 7), (None, 1), (100, 101)]
    reach = {(a, b) for a, b in edges if a is not None}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    want = {}
    for a in {a for a, b in reach if a == b}:
        own = {b for x, b in reach if x == a and (b, a) in reach}
        want[a] = (min(own), len(own))
    df = spark.createDataFrame(edges, "child long, parent long")
    assert {r["node"]: (r["component"], r["size"]) for r in graphs.cycles(df).collect()} == want and len(want) > 5
    assert graphs.cycles(df.limit(0)).collect() == []


def test_interval_join(spark):
    rng = random.Random(8)
    make = lambda n: [(rng.randrange(3), a, a + rng.choice([1, 5, 900]), f"n{i}") for i, a in enumerate(rng.randrange(4000) for _ in range(n))]
    left, right = make(60), make(80)
    schema = "id long, start long, stop long, name string"
    got = intervals.within_reach(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 100, ["id"])
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and b[1] >= max(0, a[1] - 100) and b[2] <= a[2] + 100)
    assert sorted((r["a"]["name"], r["b"]["name"]) for r in got.collect()) == want and want
    docs = spark.createDataFrame([(1, "ab  cd e"), (1, "ab"), (2, None)], "doc_id long, text string")
    assert sorted((r["id"], r["start"], r["stop"], r["piece"]) for r in intervals.pieces(docs).collect()) == [(1, 0, 2, "ab"), (1, 0, 2, "ab"), (1, 4, 6, "cd"), (1, 7, 8, "e")]


def test_cell_index(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(900, 8)) * 0.3 + rng.integers(-2, 3, size=8), rng.normal(size=(600, 8))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [])], "id long, v array<double>")
    index = CellIndex(rows, "id", "v", cells=24)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 1500, 30)], "query long, q array<double>")
    exact = {}
    for i in range(0, 1500, 30):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        exact[i] = [int(j) for j in np.lexsort((np.arange(len(d)), d.round(9)))[:5]]

    def found(**how):
        out = {}
        for r in index.search(asked, 5, **how).orderBy("query", "rank").collect():
            out.setdefault(r["query"], []).append(r["id"])
        return out

    assert found() == exact
    some = found(probes=6)
    assert sum(len(set(some[i]) & set(x)) for i, x in exact.items()) / (5 * len(exact)) >= 0.9
    assert index.rows.count() == 1500


def test_cells_are_compared_in_blocks(spark, monkeypatch):
    """Slices of queries meet blocks of rows, and only rows that may be among the nearest leave them, copies and near ties included."""
    for name, value in (("BLOCK", 64), ("SLICE", 16), ("SHARE", 128)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=(1400, 8)).round(1), np.ones((600, 8)), np.ones((40, 8)) + rng.normal(size=(40, 8)) * 1e-8])
    rng.shuffle(v)
    index = CellIndex(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), "id", "v", cells=8)
    asked = list(range(0, len(v), 20))
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in asked], "query long, q array<double>")
    got = {}
    for r in index.search(queries, 5, decimals=6, others=True).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    for i in asked:
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        assert got[i] == [int(j) for j in np.lexsort((np.arange(len(d)), d.round(6))) if j != i][:5]
    near = index.near_cells(queries).withColumn("worst", F.lit(None).cast("double"))
    left = index.distances(near, index.blocks(), 5, 0, 8, 6, True)
    assert max(index.deals.values()) > 4 and left.count() < len(asked) * len(v) / 5


def test_dotted_paths(spark):
    contexts = [{"user": {"id": 5, "tags": ["a"]}, "x.y": 1}, {"user": 3}, {}, {"user": {"id": None}}, {"user": {"id": "10"}}]
    rows = [(json.dumps(c), p, op, v) for c in contexts for p, op, v in [("user.id", "eq", "5"), ("user.id", "gt", "7"), ("user.id", "exists", ""), ("user", "ne", "3"), ("user.id.z", "exists", ""), ("user.id", "in", "4,5,10"), ("user.id", "lt", "x")]]
    df = spark.createDataFrame(rows, "j string, p string, op string, v string").withColumn("c", F.parse_json("j"))

    def plain(context, path):
        for step in path.split("."):
            context = context.get(step) if isinstance(context, dict) else None
        return context

    def holds(got, op, v):
        if op == "exists" or got is None:
            return op == "exists" and got is not None
        text = str(got) if not isinstance(got, dict) else "{}"
        try:
            numbers = float(text), float(v)
        except ValueError:
            numbers = None
        return {"eq": text == v, "ne": text != v, "in": text in v.split(","), "gt": bool(numbers) and numbers[0] > numbers[1], "lt": bool(numbers) and numbers[0] < numbers[1]}[op]

    for r in df.select("*", at_path(F.col("c"), F.col("p")).alias("got"), satisfied(F.col("c"), F.col("p"), F.col("op"), F.col("v")).alias("met")).collect():
        want = plain(json.loads(r["j"]), r["p"])
        assert (r["got"] is None) == (want is None) and r["met"] == holds(want, r["op"], r["v"]), r


def test_long_documents_end_a_block_and_the_build_moves_no_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "alpha beta " * n) for i, n in enumerate([1, 900, 2, 0, 900, 3])], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(textindex, "BLOCK_CHARS", 5000)
    built = textindex.TextIndex.build(docs, {"text": "text"}, "doc_id")
    heads = built.postings.where("key = 'text:'").orderBy("block").collect()
    assert [(r["block"], r["ids"]) for r in heads] == [(0, [0, 1]), (2, [2, 3, 4]), (5, [5])]
    asked = spark.createDataFrame([(1, "text", ["beta", "alpha"])], "query long, field string, words array<string>")
    assert {(r["id"], r["n"]) for r in built.phrases(asked).collect()} == {(1, 899), (2, 1), (4, 899), (5, 2)}
