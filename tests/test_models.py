"""Layout, decks, security, academic scores and plugins on literal rows."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import academic as A
from lectern.functions import security as S
from lectern.operators import deck, layout, reports
from lectern.operators import timeline as T
from lectern.plans import plugins


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_lines_and_blocks(spark):
    words = spark.createDataFrame([(1, i, 10.0 * i, 10.0 * i + 8, y, w) for i, (w, y) in enumerate([("a", 100.0), ("b", 101.0), ("c", 80.0), ("d", 79.0)])], "page int, ord int, x0 double, x1 double, y double, text string")
    assert [r["text"] for r in layout.text_lines(words).orderBy("line").collect()] == ["a b", "c d"]
    sized = words.withColumn("size", F.when(F.col("ord") == 1, 20.0).otherwise(10.0))
    assert [r["text"] for r in layout.merged(sized).orderBy("block").collect()] == ["a", "b", "c d"]
    assert layout.margins(words, 100, 120).first()["left"] == 0


def test_columns_and_reading_order(spark):
    el = spark.createDataFrame([(1, x, y, t) for x, y, t in ((10.0, 90.0, "a"), (12.0, 50.0, "b"), (300.0, 95.0, "c"), (302.0, 40.0, "d"))], "page int, x0 double, y double, text string")
    cols = layout.columns_of(el, 600)
    assert cols.first()["n_columns"] == 2
    assert [r["text"] for r in layout.reading_order(el, cols).orderBy("place").collect()] == ["a", "b", "c", "d"]


def test_heading_tree(spark):
    h = spark.createDataFrame([("d", i, lv, f"h{i}") for i, lv in enumerate([1, 2, 3, 2, 1, 3])], "doc string, ord int, level int, id string")
    assert [r["parent"] for r in layout.parents(h, "doc", "ord", "level", "id").orderBy("ord").collect()] == [None, "h0", "h1", "h0", None, "h4"]
    assert [r["id"] for r in layout.skipped_levels(h, "doc", "ord", "level").collect()] == ["h5"]


def test_dependency_levels_leave_cycles_out(spark):
    tasks = spark.createDataFrame([(x,) for x in "abcdef"], "task string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("f", "d")], "task string, needs string")
    assert {r["task"]: r["level"] for r in layout.dependency_levels(tasks, edges).collect()} == {"a": 0, "b": 1, "c": 2}


SLIDE = '{"title": "%s", "body": [{"type": "bullets", "items": [%s]}, {"type": "chart", "series": 7}, {"type": "image", "dpi": 72}, {"type": "table", "rows": 3, "columns": 2}]%s}'


def test_deck_rules(spark):
    bullets = ",".join('{"text": "%s"}' % ("word " * n) for n in (3, 3, 3, 3, 3, 12))
    rows = [(1, SLIDE % ("T" * 70, bullets, ', "animations": ["spin"]')), (2, '{"title": "Fine", "body": []}'), (3, None), (4, "broken")]
    df = deck.flags(deck.parsed(spark.createDataFrame(rows, "id int, content string")))
    got = {(r["id"], r["rule_id"]) for r in deck.rules().violations(df, ["id"]).collect()}
    assert got == {(1, r) for r in ("text.bullet_count", "text.bullet_length", "text.title_length", "visual.count", "visual.chart", "visual.image", "visual.animations")}
    first = df.where("id = 1").first()
    assert (first["has_image"], first["has_table"], first["has_chart"], first["figure_count"]) == (True, True, True, 3)
    decks = df.withColumns({"deck": F.lit("d"), "kind": F.lit("content"), "s": F.lit(200)})
    assert {r["problem"] for r in deck.deck_problems(decks, "deck", F.lit(10), F.col("s"), F.col("kind")).collect()} == {"no_references", "no_questions", "slide_count", "total_time", "long_slide"}


def test_claims_need_citations(spark):
    rows = [(1, '{"title": "x", "body": [{"type": "text", "content": "Studies show gains"}]}'), (2, '{"title": "x", "body": [{"type": "text", "content": "Studies show gains [3]"}]}')]
    got = deck.rules().violations(deck.parsed(spark.createDataFrame(rows, "id int, content string")), ["id"]).where("rule_id = 'cite.presence'")
    assert [r["id"] for r in got.collect()] == [1]


def test_security(spark):
    assert [one(spark, S.password_problem(F.col("p")), p=p) for p in ("Short1!", "alllowercase1!", "GoodPassword1!")] == ["length", "upper", None]
    assert one(spark, S.request_threat(F.col("t")), t="/?q=1 UNION SELECT x") == "sql_injection" and one(spark, S.request_threat(F.col("t")), t="../../etc") == "path_traversal"
    assert one(spark, S.likely_academic(F.col("e")), e="a@cs.mit.edu") and not one(spark, S.likely_academic(F.col("e")), e="a@x.com")
    assert one(spark, S.institution(F.col("d")), d="cs.stanford.edu") == "Stanford University"
    assert one(spark, S.threat_class(F.col("t")), t="Win32.Trojan.X") == "trojan" and one(spark, S.error_class(F.col("t")), t="Connection reset") == "network"
    assert one(spark, S.printable_share(F.col("t").cast("binary")), t="ab\x00\x01") == pytest.approx(0.5)


def test_academic(spark):
    assert [one(spark, A.section_type(F.col("t")), t=t) for t in ("Abstract", "Results and Discussion", "Random Section")] == ["abstract", "results", "unknown"]
    types = F.array(*map(F.lit, ["abstract", "results", "conclusion"]))
    assert one(spark, A.completeness(types), t="") == 35 and one(spark, A.missing_sections(types), t="") == ["introduction", "methodology", "discussion", "references"]
    assert one(spark, A.recency(F.array(F.lit(2023), F.lit(2021)), 2024), t="") == 100 and one(spark, A.citation_quality(F.lit(0), F.lit(100)), t="") == 30
    assert one(spark, A.weighted({"a": F.lit(80.0), "b": F.lit(None).cast("double")}, {"a": 0.5, "b": 0.5}), t="") == 80
    assert one(spark, A.abstract_scores(F.lit("The problem is hard. We use a method. Results show gains. We conclude.")), t="")["structure"] == 100


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate([1500, 1500, 1500, 4000, 10] + [1] * 12)], "key string, i int, n int")
    got = [r["batch"] for r in T.packed(rows, "key", ["i"], "n", 10, 4000).orderBy("i").collect()]
    assert got == [0, 0, 1, 2] + [3] * 10 + [4] * 3


def test_plugins(spark):
    df = spark.createDataFrame([("pdf", 1.0), ("doc", 0.0), (None, 0.5)], "kind string, x double")
    scorers = plugins.Scorers()
    scorers.register("a", lambda: F.col("x"), 3.0)
    scorers.register("b", lambda: F.lit(1.0))
    assert [r["overall"] for r in scorers.apply(df).collect()] == [1.0, 0.25, 0.625]
    ext = plugins.Extensions()
    ext.register("one", lambda d: d.withColumn("one", F.lit(1)))
    ext.register("two", lambda d: d.withColumn("two", F.col("one") + 1), ["one"])
    assert ext.apply(df, "two").first()["two"] == 2
    with pytest.raises(ValueError):
        ext.register("x", lambda d: d, ["missing"])
    processors = plugins.Processors()
    processors.register("pdf", lambda d: d.withColumn("x", F.col("x") + 1))
    assert sorted(r["x"] for r in processors.apply(df, "kind").collect()) == [0.0, 0.5, 2.0]
    plugins.register_functions(spark)
    assert spark.sql("SELECT lectern_words('a b  c') w, lectern_clamp(7.0, 0.0, 5.0) c").first()[:] == (3, 5.0)


def test_includes_are_expanded_to_a_bounded_depth(spark):
    files = spark.createDataFrame([("main", r"a \input{one} \include{none} z"), ("one", r"[\include{two}]"), ("two", "2"), ("self", r"x \input{self}")], "path string, text string")
    got = {r["path"]: r["text"] for r in reports.expand_includes(files).collect()}
    assert got["one"] == "[2]" and got["self"] == r"x \input{self}" and got["main"].startswith("a [2] ")


def test_near_text_and_boxes(spark):
    text = "Ann Lee works at " + "x" * 300 + " Example University"
    assert one(spark, reports.near_text(F.col("t"), F.lit("ann lee"), F.lit("works at")), t=text)
    assert not one(spark, reports.near_text(F.col("t"), F.lit("ann lee"), F.lit("Example University")), t=text)
    box = lambda x0, x1: F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), F.lit(0).alias("y0"), F.lit(1).alias("y1"), F.lit(1).alias("page"))
    assert one(spark, reports.overlapping(box(0, 5), box(4, 9)), t="") and not one(spark, reports.overlapping(box(0, 3), box(4, 9)), t="")


def test_trend_and_fuzzy(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 2.0)], "k string, i int, v double")
    assert {r["k"]: r["direction"] for r in reports.trend(rows, "k", ["i"], "v").collect()} == {"a": "up", "b": "new"}
    docs = spark.createDataFrame([(1, "colour theory"), (2, "color wheel"), (3, "sound")], "id int, t string")
    assert [r["id"] for r in reports.fuzzy(docs, "t", "colour").orderBy("id").collect()] == [1, 2]


def test_dependency_levels_raise_at_a_bound(spark):
    tasks = spark.createDataFrame([(i,) for i in range(6)], "task int")
    edges = spark.createDataFrame([(i + 1, i) for i in range(5)], "task int, needs int")
    assert {r["task"]: r["level"] for r in layout.dependency_levels(tasks, edges).collect()} == {i: i for i in range(6)}
    with pytest.raises(ValueError, match="more than 3 levels"):
        layout.dependency_levels(tasks, edges, most=3)
