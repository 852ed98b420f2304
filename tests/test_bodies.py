"""Nested slide bodies, parsed from JSON, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import bodies as B


def made(rng):
    words = ["alpha", "beta", "email", "e-mail", "(Miller 2020)", "[x 1999]", "on-line", "online", ""]
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))

    def element():
        kind = rng.choice(["text", "bullet_list", "image", "chart", "table", "equation", "code", "diagram", "video", "unknown", None])
        e = {"type": kind} if kind else {}
        if kind == "text" and rng.random() < 0.8:
            e["content"] = say(90)
        if kind == "bullet_list" and rng.random() < 0.9:
            e["items"] = [{"text": say(18)} for _ in range(rng.randint(0, 7))]
        if kind == "image":
            e |= {k: v for k, v in {"resolution": rng.choice([72, 300, 600]), "attribution": rng.choice(["", " ", "x"]), "alt_text": rng.choice(["", "y"])}.items() if rng.random() < 0.7}
        if kind == "chart" and rng.random() < 0.9:
            e["data"] = {"series": [{"data": [0.5] * rng.randint(0, 13)} for _ in range(rng.randint(0, 7))], **{k: rng.choice(["", "a"]) for k in ("x_label", "y_label") if rng.random() < 0.8}}
        if kind == "table":
            e |= {"headers": ["h"] * rng.randint(0, 8), "rows": [["c"]] * rng.randint(0, 9)}
        if kind in ("table", "chart") and rng.random() < 0.6:
            e["caption"] = say(6)
        return e

    out = {"title": "t" * rng.choice([5, 70, 90]), "body": [element() for _ in range(rng.randint(0, 6))]}
    if rng.random() < 0.5:
        out |= {"subtitle": say(4), "speaker_notes": say(5), "animations": [{"type": rng.choice(["Fade", "zoomIn", "spin", "wipe"])} for _ in range(rng.randint(0, 5))], "style": {"color": "red", "transition": "push"}}
    return out


def plain_violations(s, kind):
    out, count = [], lambda t: len((t or "").split())
    body = s.get("body", [])
    bullets = [(i, j, b["text"]) for i, e in enumerate(body) if e.get("type") == "bullet_list" for j, b in enumerate(e.get("items", []))]
    if len(bullets) > 5:
        out.append(("text.bullet_count", f"Slide has {len(bullets)} bullet points, exceeding limit of 5", None, None))
    for i, j, text in bullets:
        n = count(re.sub(r"\[[^\]]*\d{4}[^\]]*\]", "", re.sub(r"\([^)]*\d{4}[^)]*\)", "", text)))
        if n > 10:
            out.append(("text.bullet_length", f"Bullet point has {n} words, exceeding limit of 10", i, j))
    if len(s.get("title", "")) > 60:
        out.append(("text.title_length", f"Title has {len(s['title'])} characters, exceeding limit of 60", None, None))
    words = plain_words(s)
    if words > 100:
        out.append(("text.density", f"Slide has {words} words, exceeding limit of 100", None, None))
    low = plain_text(s, False).lower()
    out += [("text.terminology", f"Inconsistent terminology: both '{a}' and '{b}' used", None, None) for a, b in B.SPELLINGS if a in low and b in low]
    n = sum(e.get("type") in B.VISUALS for e in body)
    if n > 2:
        out.append(("visual.element_count", f"Slide has {n} visual elements, exceeding limit of 2", None, None))
    moves = s.get("animations", [])
    if len(moves) > 3:
        out.append(("visual.animation_use", f"Slide has {len(moves)} animations, which may be distracting", None, None))
    if kind in B.FORMAL and any(f in m["type"].lower() for m in moves for f in B.FLASHY):
        out.append(("visual.animation_use", "Flashy animations may be inappropriate for academic presentation", None, None))
    for i, e in enumerate(body):
        if e.get("type") == "image":
            if e.get("resolution") and e["resolution"] < 300:
                out.append(("visual.image_quality", f"Image resolution ({e['resolution']} dpi) below minimum (300 dpi)", i, None))
            if kind in B.FORMAL and not e.get("attribution", "").strip():
                out.append(("visual.image_quality", "Image missing attribution/source", i, None))
            if not e.get("alt_text", "").strip():
                out.append(("visual.image_quality", "Image missing alt text for accessibility", i, None))
        if e.get("type") == "chart":
            data = e.get("data", {})
            series = data.get("series", [])
            if len(series) > 5:
                out.append(("visual.chart_complexity", f"Chart has {len(series)} data series, exceeding limit of 5", i, None))
            out += [("visual.chart_complexity", f"Chart series has {len(x['data'])} data points, exceeding limit of 10", i, j) for j, x in enumerate(series) if len(x["data"]) > 10]
            if not data.get("x_label") or not data.get("y_label"):
                out.append(("visual.chart_complexity", "Chart missing axis labels", i, None))
        if e.get("type") == "table":
            if len(e["headers"]) > 5:
                out.append(("visual.table_size", f"Table has {len(e['headers'])} columns, exceeding limit of 5", i, None))
            if len(e["rows"]) > 6:
                out.append(("visual.table_size", f"Table has {len(e['rows'])} rows, exceeding limit of 6", i, None))
            if not e.get("caption"):
                out.append(("visual.table_size", "Table missing caption", i, None))
    return out


def plain_words(s):
    count = lambda t: len((t or "").split())
    n = count(s.get("title")) + count(s.get("subtitle"))
    for e in s.get("body", []):
        n += count(e.get("content")) if e.get("type") == "text" else 0
        n += sum(count(b["text"]) for b in e.get("items", [])) if e.get("type") == "bullet_list" else 0
        n += count(e.get("caption")) if e.get("type") in ("table", "chart") else 0
    return n


def plain_text(s, notes=True):
    parts = [s["title"]] if s.get("title") else []
    parts += [s["subtitle"]] if "subtitle" in s else []
    for e in s.get("body", []):
        parts += [e.get("content", "")] if e.get("type") == "text" else [b["text"] for b in e.get("items", [])] if e.get("type") == "bullet_list" else []
    return " ".join(parts + ([s["speaker_notes"]] if notes and s.get("speaker_notes") else []))


KINDS = ["lecture", "conference", "defense", None]


@pytest.fixture(scope="module")
def slides(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(KINDS), made(rng)) for i in range(120)] + [(120, "defense", {}), (121, "lecture", {"title": "x", "body": [{"type": "text", "content": "word " * 200_000}]})]
    df = spark.createDataFrame([(i, k, json.dumps(s)) for i, k, s in rows] + [(200, None, None), (201, "lecture", "no json")], "id long, kind string, json string")
    return rows, df.withColumn("slide", B.parsed(F.col("json"))).drop("json").cache()


def test_violations(slides):
    rows, df = slides
    s = F.col("slide")
    got = {}
    for r in B.violations(df, ["id"], B.text_rules(s) + B.visual_rules(s, F.col("kind"))).collect():
        got.setdefault(r["id"], []).append((r["rule_id"], r["message"], r["element"], r["part"]))
    for i, kind, slide in rows:
        assert sorted(got.get(i, []), key=repr) == sorted(plain_violations(slide, kind), key=repr)
    assert not {200, 201} & set(got)


def test_words_texts_and_counts(slides):
    rows, df = slides
    s = F.col("slide")
    got = {r["id"]: r for r in df.select("id", B.all_words(s).alias("n"), B.spoken(s).alias("x"), B.element_counts(s).alias("c"), B.visual_text(s).alias("v")).collect()}
    for i, _, slide in rows:
        body = slide.get("body", [])
        assert got[i]["n"] == plain_words(slide) and got[i]["x"] == plain_text(slide)
        c = got[i]["c"]
        kinds = [e.get("type") for e in body]
        assert (c["text"], c["equations"], c["code"], c["tables"]) == tuple(kinds.count(k) for k in ("text", "equation", "code", "table"))
        assert c["bullets"] == sum(len(e.get("items", [])) for e in body if e.get("type") == "bullet_list") and c["visuals"] == sum(k in B.PICTURES for k in kinds)
        lists = sum(any(len(b["text"]) > 100 for b in e.get("items", [])) for e in body if e.get("type") == "bullet_list")
        long, wordy = len(slide.get("title", "")) > 80, len(plain_text(slide, False).split()) > 150
        v = got[i]["v"]
        assert (v["long_title"], v["long_lists"], v["wordy"]) == (long, lists, wordy) and v["score"] == pytest.approx(max(0, 1 - 0.2 * long - 0.1 * lists - 0.3 * wordy))
    assert got[200]["n"] == 0 and got[200]["x"] == ""


def test_counts_take_the_record_into_account(slides):
    rows, df = slides
    c = df.where("id = 120").select(B.element_counts(F.col("slide"), F.lit(3), F.lit(True), F.lit(None).cast("boolean")).alias("c")).head()["c"]
    assert (c["visuals"], c["equations"], c["code"]) == (3, 1, 0)


def test_without_effects(slides):
    rows, df = slides
    got = {r["id"]: json.loads(r["j"]) for r in df.where("id < 120").select("id", F.to_json(B.without_effects(F.col("slide"))).alias("j")).collect()}
    for i, _, slide in rows[:120]:
        assert "animations" not in got[i] and got[i].get("style", {}) == ({"color": "red"} if "style" in slide else {})
        assert got[i].get("title") == slide.get("title") and len(got[i].get("body", [])) == len(slide["body"])


def test_quick_checks_of_one_text(spark):
    rows = [("title", "t" * 61), ("bullet", "w " * 11), ("text", "w " * 101), ("bullet", "fine"), ("title", None), ("text", "")]
    df = spark.createDataFrame(rows, "kind string, x string").select("kind", B.quick_slide(F.col("x"), F.col("kind")).alias("slide"))
    got = B.violations(df, ["kind"], B.text_rules(F.col("slide"))).collect()
    assert sorted((r["kind"], r["rule_id"]) for r in got) == [("bullet", "text.bullet_length"), ("text", "text.density"), ("title", "text.title_length")]
