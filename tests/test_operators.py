"""Operators on small tables, against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.operators import relational as R
from lectern.operators import rules, scoring, slides
from lectern.operators import timeline as T
from lectern.plans import catalog
from lectern.sources import files
from lectern.streaming import events as E


@pytest.fixture(scope="module")
def calls(spark):
    start = dt.datetime(2024, 1, 1)
    offsets = [0, 1, 2, 3, 4, 5, 11, 11.5, 12, 30, 31, 100]
    return spark.createDataFrame([(i, k, start + dt.timedelta(seconds=s)) for k in (1, 2) for i, s in enumerate(offsets)], "event_id long, user long, ts timestamp_ntz"), offsets


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "x")], "k int, v string")
    assert sorted(tuple(r) for r in R.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    rows = spark.createDataFrame([("f", 1, 10), ("f", 2, 11), ("g", 1, 12)], "file string, at int, id int")
    got = {r["id"]: (r["version_number"], r["parent_id"], r["is_current"]) for r in R.versioned(rows, "file", ["at"], "id").collect()}
    assert got == {10: (1, None, False), 11: (2, 10, True), 12: (1, None, True)}


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child int, parent int")
    assert {(r["child"], r["parent"]) for r in R.closure(edges).collect()} == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}


def test_sliding_window_counts_accepted_only(calls):
    df, offsets = calls
    accepted, want = [], []
    for s in offsets:
        accepted = [a for a in accepted if a > s - 10]
        want.append(len(accepted) < 5)
        accepted += [s] if want[-1] else []
    got = T.sliding_window(df, "user", "ts", ["ts", "event_id"], 5, 10).orderBy("user", "event_id").collect()
    assert [r["allowed"] for r in got] == want * 2 and want[:6] == [True] * 5 + [False]


def test_token_bucket_batch_and_stream_agree(spark, sf, calls):
    df, offsets = calls
    level, last, want = 3.0, None, []
    for s in offsets:
        level = min(3, level + ((s - last) * 3 / 10 if last is not None else 0))
        want.append(level >= 1)
        level, last = level - want[-1], s
    got = T.token_bucket(df, "user", "ts", ["ts", "event_id"], 3, 10).orderBy("user", "event_id").collect()
    assert [r["allowed"] for r in got] == want * 2
    batch = {(r["event_id"], r["allowed"]) for r in catalog.queries()["token_bucket_rate_limit"](spark, sf).collect()}
    assert {(r["event_id"], r["allowed"]) for r in catalog.queries()["stream_token_bucket"](spark, sf).collect()} == batch


def test_lockout_durations_grow(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, 1, start + dt.timedelta(seconds=i)) for i in range(50)], "event_id long, user long, ts timestamp_ntz")
    assert [r["minutes"] for r in T.lockouts(rows, "user", "ts", ["ts"]).orderBy("lockout").collect()] == [*T.LOCKOUT_MINUTES, 1440, 1440]


def test_rules_and_overrides(spark):
    df = scoring.readability(scoring.counted(spark.createDataFrame([(1, "\n".join(["word"] * 6)), (2, "fine text"), (3, "It kind of grew by 40%. " + "w " * 120)], "id int, text string")))
    engine = rules.slide_rules()
    got = {(r["id"], r["rule_id"]) for r in engine.violations(df, ["id"]).collect()}
    assert {(1, "text.bullets"), (3, "text.density"), (3, "tone.informal"), (3, "cite.claim")} <= got and not any(i == 2 for i, _ in got)
    engine.override("text.bullets", settings={"most": 10})
    engine.override("cite.claim", enabled=False)
    engine.override("text.density", severity="error")
    after = engine.violations(df, ["id"])
    assert {(r["id"], r["rule_id"]) for r in after.collect()} == got - {(1, "text.bullets"), (3, "cite.claim")}
    assert [(r["id"], r["valid"]) for r in rules.summary(after, ["id"]).where("id = 3").collect()] == [(3, False)]
    assert len(engine.of("conference")) == len(engine.of()) + 1


def test_pacing_of_short_decks(spark):
    df = spark.createDataFrame([("a", i, 30) for i in range(4)] + [("b", i, 10 if i < 3 else 90) for i in range(9)], "deck string, n int, s int")
    got = {r["deck"]: r["pacing"] for r in slides.thirds(df, "deck", "n", "s").collect()}
    assert got["a"] == 0.8 and got["b"] < 0.7


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    files.export_many(df, str(tmp_path), ["json", "csv", "parquet", "orc"])
    assert spark.read.schema(df.schema).json(f"{tmp_path}/json").count() == spark.read.orc(f"{tmp_path}/orc").count() == 2
    (tmp_path / "log.json").write_text('{"event_id": 1, "user_id": 7, "event_type": "error", "value": 2.5}\nbroken\n{"event_id": 2, "user_id": 8, "event_type": "view"}\n')
    assert [r["event_id"] for r in files.audit_log(spark, str(tmp_path / "log.json"), event_type=["error"]).collect()] == [1]


def test_duplicates_within_the_watermark(spark, sf):
    stream = files.event_stream(spark, sf)
    assert E.run_available(E.first_seen(stream, ["user_id"]), "first").count() <= spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count() * 20


def test_windowed_stream_equals_batch(spark, sf):
    got = catalog.queries()["stream_hourly_counts"](spark, sf)
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = catalog.queries()[name](spark, sf), con.execute(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    shown = lambda r: tuple("" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(shown(r[c] for c in columns) for r in got.collect()) == sorted(shown(r[i] for i in at) for r in want.fetchall())


def test_closure_has_no_silent_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(36)], "child int, parent int").coalesce(1)
    got = R.closure(edges).agg(F.count("*").alias("n"), F.max("depth").alias("depth")).first()
    assert (got["n"], got["depth"]) == (36 * 37 // 2, 36)
    with pytest.raises(ValueError, match="deeper than 2"):
        R.closure(edges.where("child < 4"), most=2)
    assert R.closure(edges.where("child < 2"), most=2).count() == 3


def test_only_some_rules_are_judged(spark):
    known = rules.slide_rules()
    known.register(rules.Rule("costly", lambda s: F.raise_error(F.lit("judged")).cast("boolean"), "never asked for"))
    df = scoring.readability(scoring.counted(spark.createDataFrame([(1, "\n".join(["word"] * 6)), (2, "fine text")], "id int, text string")))
    assert [(r["id"], r["rule_id"]) for r in known.violations(df, ["id"], only=["text.bullets", "text.density"]).collect()] == [(1, "text.bullets")]
