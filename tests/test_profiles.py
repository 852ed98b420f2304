"""Behaviour scores, coverage by references, abrupt sections, names of institutions and audit exports against plain Python."""

import datetime as dt
import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from lectern.functions import institutions
from lectern.operators import profiles


def plain_scores(events):
    out, seen = {}, {}
    for i, user, _, hour, kind, size in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        p, score = seen.get(user), 0.0
        if p:
            held = p["sizes"][-100:]
            mean, dev = (statistics.fmean(held), statistics.pstdev(held)) if held else (0, 0)
            score += 0.3 * (hour is not None and hour not in p["hours"]) + 0.4 * (bool(kind) and kind not in p["kinds"]) + 0.3 * (abs((size or 0) - mean) > 2 * dev)
        p = seen.setdefault(user, {"hours": set(), "kinds": set(), "sizes": []})
        p["hours"].add(hour)
        p["kinds"].add(kind)
        if size and size > 0:
            p["sizes"].append(size)
        out[i] = min(1.0, round(score, 2))
    return out


def test_behaviour(spark):
    rng = random.Random(2)
    events = [(i, rng.choice([1, 1, 1, 2, 3]), i // 2, rng.choice([None, *range(6)]), rng.choice(["pdf", "tex", "", None, "docx"]), rng.choice([None, -4.0, 0.0, 100.0, 110.0, 120.0, 130.0, 900.0])) for i in range(700)]
    df = spark.createDataFrame(events, "id long, user long, at long, h int, kind string, size double")
    got = profiles.behaviour_scores(df, "user", ["at", "id"], F.col("h"), F.col("kind"), F.col("size"))
    assert got.columns == [*df.columns, "odd_size", "unseen_hour", "unseen_type", "score"]
    want = plain_scores(events)
    assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx(want) and len(set(want.values())) > 4
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_coverage_by_references(spark):
    rng = random.Random(7)
    rows = [(d, rng.choice([None, 1987, 1999, 2013, 2014, 2019, 2024]), rng.choice([None, "", "a", "b", "c", "d"])) for d in range(60) for _ in range(rng.randint(1, 14))]
    for r in profiles.reference_coverage(spark.createDataFrame(rows, "doc long, year long, venue string"), "doc", 2024).collect():
        mine = [x for x in rows if x[0] == r["doc"]]
        years, venues = [y for _, y, _ in mine if y], {v for _, _, v in mine if v}
        recent = sum(y >= 2019 for y in years)
        decades = ",".join(f"{d}s:{sum(y // 10 * 10 == d for y in years)}" for d in sorted({y // 10 * 10 for y in years}))
        assert (r["n"], r["recent"], r["venues"], r["decades"]) == (len(mine), recent, len(venues), decades)
        assert r["many_old"] == (sum(y < 2014 for y in years) > 0.5 * len(years)) and r["few_venues"] == (len(venues) < 3 and len(mine) > 5)
        assert r["score"] == pytest.approx(0.5 + 0.2 * (recent > 0.3 * len(mine)) + 0.2 * (len(venues) >= 3) + 0.1 * (len(mine) >= 10))


def test_abrupt_sections(spark):
    long = "one two three four five six seven eight nine ten eleven"
    sections = [("a", long), ("b", long), ("c", "\n \n" + long + "\nhowever"), ("d", "In Contrast " + long), ("e", "one two"), ("f", ""), ("g", None), ("h", long[:-7])]
    df = spark.createDataFrame([(1, sections), (2, []), (3, None)], "id long, s array<struct<title:string,content:string>>")
    got = {r["id"]: r["a"] for r in df.select("id", profiles.abrupt(F.col("s")).alias("a")).collect()}
    assert [(x["no"], x["title"], x["n_words"]) for x in got[1]] == [(2, "b", 11), (3, "c", 11)] and got[2] == [] and got[3] is None


def plain_name(domain):
    name = next((domain[: -len(e)] for e in institutions.ENDINGS if domain.endswith(e)), domain)
    parts = name.split(".")
    if len(parts) > 1:
        name = next((p for p in reversed(parts) if len(p) > 3 and p not in institutions.SERVICES), name)
    name = " ".join(institutions.ABBREVIATIONS.get(w.lower(), w.title()) for w in re.sub("[-_]", " ", name).split())
    return name if any(w in name.lower() for w in institutions.COMPLETE) else f"{name} University"


def test_names_of_institutions(spark):
    rng = random.Random(1)
    parts = ["mit", "uni", "univ-x", "state-poly", "mail", "www", "harvard", "a_b", "cs", "mit2x", "tech", "college", "school9of", "edu", "ac", "uk", "org"]
    domains = sorted({".".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)}) + ["", "x.edu", "edu.au", "m.edu.au"]
    df = spark.createDataFrame([(d,) for d in domains], "d string")
    got = {r["d"]: r["n"] for r in df.select("d", institutions.institution_name(F.col("d")).alias("n")).collect()}
    assert got == {d: plain_name(d) for d in domains}


def test_audit_lines(spark):
    day = lambda n: dt.datetime(2024, 1, n, 3, 4, 5)
    rows = [(1, day(1), ["gdpr"]), (2, day(2), ["gdpr", "soc2"]), (3, day(3), ["soc2"]), (4, day(4), None), (5, day(5), ["gdpr"]), (6, None, ["gdpr"])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, frameworks array<string>")
    lines = lambda f: {r["event_id"]: json.loads(r["line"]) for r in profiles.audit_lines(df, ["event_id", "ts"], "ts", F.lit(day(2)), F.lit(day(4)), f).collect()}
    assert set(lines(None)) == {2, 3, 4} and set(lines("gdpr")) == {2} and set(lines("hipaa")) == set()
    assert lines("gdpr")[2] == {"event_id": 2, "ts": "2024-01-02 03:04:05"}
