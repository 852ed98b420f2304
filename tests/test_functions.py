"""Column functions on literal texts, against values stated by hand."""

import random

from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import sanitize
from lectern.functions import text as X
from lectern.functions import words
from lectern.operators import scoring as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_syllables(spark):
    rows = spark.createDataFrame([("hello", 2), ("world", 1), ("computer", 3), ("analysis", 4), ("a", 1), ("", 0), ("the", 1), ("!?", 0)], "w string, n int")
    assert rows.where(X.syllables(F.col("w")) != F.col("n")).count() == 0


def test_readability_bounds(spark):
    df = spark.createDataFrame([("",), (None,), ("Short.",), ("The cat sat on the mat. " * 20,), ("Institutional considerations necessitate comprehensive organisational reconfiguration " * 8,)], "text string")
    got = [r["readability"] for r in S.readability(S.counted(df)).select("readability").collect()]
    assert got[:3] == [0, 0, 0] and all(0 <= x <= 100 for x in got) and got[3] > got[4]


def test_academic_tone_prefers_academic_text(spark):
    df = spark.createDataFrame([("However, the evaluation suggests improvement; moreover, the implementation may need refinement.",), ("It's really very nice stuff and just lots of things, you don't care.",)], "text string")
    a, b = [r["x"] for r in S.counted(df).select(S.tone().alias("x")).collect()]
    assert a > b


def test_transition_quality(spark):
    a, b, c = "the model improves results", "however the model improves accuracy", "bananas grow quickly"
    good = one(spark, X.transition_quality(X.tokens(F.col("a")), X.tokens(F.col("b"))), a=a, b=b)
    assert good > one(spark, X.transition_quality(X.tokens(F.col("a")), X.tokens(F.col("b"))), a=a, b=c) == 0


def test_citations(spark):
    text = "Seen before [1, 2] and (Smith, 2020); also (Jones & Lee, 2019) and [1, 2]."
    got = one(spark, C.citations(F.col("t")), t=text)
    assert [(c["style"], c["citation"]) for c in got] == [("numeric", "[1, 2]"), ("author_year", "(Smith, 2020)"), ("apa", "(Jones & Lee, 2019)")]
    assert one(spark, C.main_style(F.col("t")), t=text) == "numeric" and one(spark, C.main_style(F.col("t")), t="none") is None


def test_references(spark):
    line = '[3] Smith, J., "A study of things" (2019). Journal, vol. 4, pp. 10-20. doi 10.1000/xyz123'
    r = one(spark, C.reference(F.col("t")), t=line)
    assert (r["title"], r["year"], r["doi"], r["pages"], r["volume"]) == ("A study of things", 2019, "10.1000/xyz123", "10-20", "4")
    assert one(spark, C.reference(F.col("t")), t="too short 2019") is None


def test_bibtex(spark):
    text = '@article{key1,\n  author = {Smith, John and Ann Lee},\n  title = {A {Nice} \\emph{paper}},\n  year = 2020\n}\n@book{b2,\n title = "Other"\n}'
    got = one(spark, C.bibtex(F.col("t")), t=text)
    assert [(e["kind"], e["key"]) for e in got] == [("article", "key1"), ("book", "b2")]
    assert got[0]["fields"] == {"author": "Smith, John and Ann Lee", "title": "A Nice paper", "year": "2020"} and got[1]["fields"] == {"title": "Other"}
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(C.bibtex(F.col("t"))).alias("e"))
    assert [r["x"] for r in df.select(C.missing_fields(F.col("e.kind"), F.col("e.fields")).alias("x")).collect()] == [["journal"], ["author", "publisher", "year"]]
    assert [(a["last"], a["first"]) for a in one(spark, C.authors(F.col("a")), a="Smith, John and Ann B. Lee")] == [("Smith", "John"), ("Lee", "Ann B.")]


def test_latex(spark):
    assert one(spark, C.cited_keys(F.col("t")), t=r"\cite{a, b} and \citep[see][p. 2]{c} \cite{a}") == ["a", "b", "c"]
    assert one(spark, C.clean_latex(F.col("t")), t="Some \\textbf{bold} 5\\% % comment\n text \\label{x}") == "Some bold 5\\% text x"


def test_structure(spark):
    text = "# Title\n## Abstract\nA novel approach.\n## Introduction\n1.2 Methods here\nFigure 3: A plot\nTable 1. Numbers"
    assert [(s["level"], s["title"]) for s in one(spark, C.sections(F.col("t")), t=text)] == [(1, "Title"), (2, "Abstract"), (2, "Introduction"), (2, "Methods here")]
    assert one(spark, C.abstract(F.col("t")), t=text) == "A novel approach."
    assert [tuple(c) for c in one(spark, C.captions(F.col("t"), "Figure"), t=text)] == [(3, "A plot")]


def test_formats(spark):
    args = [F.lit("Lee, A."), F.lit("On things"), F.lit("Journal"), F.lit(2020)]
    assert one(spark, C.formatted("apa", *args), t="") == "Lee, A. (2020). On things. Journal."
    assert one(spark, C.formatted("ieee", *args), t="") == 'Lee, A., "On things," Journal, 2020.'
    assert one(spark, C.formatted("mla", args[0], args[1], F.lit(None).cast("string"), args[3]), t="") == 'Lee, A.. "On things." 2020.'


def test_sanitising(spark):
    assert one(spark, sanitize.safe_text(F.col("t")), t="a <script>x()</script>  b\x00 javascript:c'd") == "a b 'd"
    assert one(spark, sanitize.plain_text(F.col("t")), t="<nav>x</nav><p>Hello <b>you</b></p><style>p{}</style>") == "Hello you"


def test_highlight_and_sizes(spark):
    assert one(spark, X.highlight(F.col("t"), "cat"), t="A Cat sat") == "A <mark>Cat</mark> sat" and one(spark, X.highlight(F.col("t"), "dog"), t="A Cat sat") is None
    assert [one(spark, X.file_size(F.lit(n)), t="") for n in (10, 2048, 3 * 1024**2)] == ["10 bytes", "2.0 KB", "3.0 MB"]


def test_chunks_keep_order_and_size(spark):
    text = "\n\n".join("x" * n for n in (100, 100, 300, 50))
    got = one(spark, S.chunks("t", "\n\n", 60), t=text)
    assert "\n\n".join(got) == text and [len(c) for c in got] == [202, 300, 50]
    assert one(spark, S.chunks("t", "\n\n", 60), t="") == []


def test_sums_over_words(spark):
    rng = random.Random(3)
    parts = ["The", "nation", "it's", "they'd've", "very", "However,", "est-ce", "à", "Être", "x_1", "tion", "station.tension", "e.g.", "!?", "--", "\t", "\x0b", "\u00a0", "Ça²", "don''t", "rhythm", "the-the", "a.b!c", "…"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(300, ""), (301, "  ")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    low, padded = F.lower("text"), X.padded(F.col("text"))
    plain = {
        "n_words": F.size(X.words(low)), "n_syllables": X.total(F.transform(X.words(low), lambda w: X.syllables(w).cast("long"))), "n_spoken": F.regexp_count("text", F.lit(r"[^\s.!?]+")), "n_tokens": X.word_hits(padded, ["[^ ]+"]),
        "contractions": F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+'[\p{L}\p{N}_]+")), "nominal": X.ending_hits(padded, X.NOMINAL_ENDINGS), "weak": X.word_hits(padded, X.WEAK), "en_common": X.word_hits(padded, X.COMMON_WORDS["en"]),
        "fr_first": X.word_hits(padded, X.COMMON_WORDS["fr"][:5]), "en_stop": X.word_hits(padded, X.LANGUAGE_STOP_WORDS["en"]),
    }
    wrong = df.select("id", "text", words.sums(low).alias("s"), F.struct(*(c.cast("long").alias(k) for k, c in plain.items())).alias("p")).where(" OR ".join(f"s.{k} <> p.{k}" for k in plain))
    assert wrong.collect() == []
    tok = X.tokens(F.col("text"))
    want = F.struct(F.size(tok).alias("n"), F.size(F.array_distinct(tok)).alias("n_different"), F.size(F.filter(tok, lambda w: F.char_length(w) >= 7)).alias("n_long"), F.size(F.filter(tok, lambda w: w.rlike("(tion|ment|ness|ity|ism|ance|ence)$"))).alias("n_academic"))
    wrong = df.select("text", words.variety(low).alias("v"), want.alias("w")).where("v.n <> w.n OR v.n_different <> w.n_different OR v.n_long <> w.n_long OR v.n_academic <> w.n_academic")
    assert wrong.collect() == [] and df.limit(0).select(words.sums(low), words.variety(low)).collect() == []
