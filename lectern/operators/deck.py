"""Slides with a nested body: parsing, counts and the full set of slide and deck rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.rules import FIRST_PERSON, TRANSITIONS, VAGUE, Rule, RuleSet, informal, uncited

BODY = "struct<title:string,body:array<struct<type:string,content:string,items:array<struct<text:string>>,rows:int,columns:int,series:int,points:int,dpi:int,alt_text:string,caption:string>>,notes:string,animations:array<string>>"
#: Spellings of one term, and effects that distract.
PAIRS = [("e-mail", "email"), ("data set", "dataset"), ("on-line", "online"), ("web site", "website"), ("co-operate", "cooperate")]
FLASHY = ["spin", "bounce", "fly-in", "swivel", "boomerang"]


def parsed(df: DataFrame, column: str = "content") -> DataFrame:
    """Adds the nested content and what the rules need: bullets, all words, visuals and their text."""
    c = F.from_json(column, BODY)
    out = df.withColumn("c", c)
    body = F.coalesce(F.col("c.body"), F.array().cast("array<struct<type:string,content:string,items:array<struct<text:string>>,rows:int,columns:int,series:int,points:int,dpi:int,alt_text:string,caption:string>>"))
    out = out.withColumn("body", body)
    items = F.flatten(F.transform("body", lambda b: F.coalesce(F.transform(b["items"], lambda i: i["text"]), F.array().cast("array<string>"))))
    texts = F.concat(F.transform("body", lambda b: F.concat_ws(" ", b["content"], b["caption"])), items)
    out = out.withColumns({"bullets": items, "plain": F.concat_ws(" ", F.col("c.title"), F.array_join(texts, " ")), "visuals": F.filter("body", lambda b: b["type"].isin("image", "chart", "table", "figure"))})
    n = F.size(X.words(F.col("plain"))).cast("long")
    return out.withColumns({"n_words": n, "title": F.coalesce("c.title", F.lit("")), "tok": X.tokens(F.col("plain"))})


def flags(df: DataFrame) -> DataFrame:
    """Derived columns of a slide: which kinds of elements it holds, and how many figures."""
    kind = lambda *t: F.exists("body", lambda b: b["type"].isin(*t))
    return df.withColumns({"has_image": kind("image", "figure"), "has_table": kind("table"), "has_chart": kind("chart"), "has_bullets": F.size("bullets") > 0, "figure_count": F.size("visuals").cast("long")})


def _of(kind: str, broken) -> Column:
    return F.exists(F.filter("body", lambda b: b["type"] == kind), lambda b: F.coalesce(broken(b), F.lit(False)))


def rules() -> RuleSet:
    """The rules for single slides; thresholds are settings."""
    out = RuleSet()
    low = lambda: F.lower("plain")
    short = lambda b: F.regexp_replace(b, r"[(\[][^)\]]*\d{4}[^)\]]*[)\]]", "")
    add = lambda rule_id, broken, message, severity="warning", *sets, **settings: out.register(Rule(rule_id, broken, message, severity, settings), *sets)
    add("text.bullet_count", lambda s: F.size("bullets") > s["most"], "more than {most} bullets", most=5)
    add("text.bullet_length", lambda s: F.exists("bullets", lambda b: F.size(X.words(short(b))) > s["most"]), "a bullet has more than {most} words", most=10)
    add("text.title_length", lambda s: F.char_length("title") > s["most"], "title longer than {most} characters", most=60)
    add("text.density", lambda s: F.col("n_words") > s["most"], "more than {most} words", most=100)
    add("text.terminology", lambda s: X.any_of([low().contains(a) & low().contains(b) for a, b in PAIRS]), "two spellings of one term", "info")
    add("tone.informal", lambda s: informal(low()), "informal wording")
    add("tone.first_person", lambda s: F.arrays_overlap("tok", F.array(*map(F.lit, FIRST_PERSON))), "first person", "info", "conference", "defense")
    add("tone.vague", lambda s: F.arrays_overlap("tok", F.array(*map(F.lit, VAGUE))), "vague words", "info")
    add("tone.transitions", lambda s: (F.col("n_words") > s["least"]) & ~F.arrays_overlap("tok", F.array(*map(F.lit, TRANSITIONS))), "no transitions in more than {least} words", "info", least=50)
    add("cite.presence", lambda s: uncited(F.col("plain")), "claim without citation")
    add("cite.format", lambda s: F.col("plain").rlike(r"\[\d+\]") & F.col("plain").rlike(r"\([A-Z]\w+,? \d{4}\)"), "more than one citation style", "info")
    add("visual.count", lambda s: F.size("visuals") > s["most"], "more than {most} visuals", most=2)
    add("visual.image", lambda s: _of("image", lambda b: (b["dpi"] < s["dpi"]) | b["alt_text"].isNull()), "image below {dpi} dpi or without alternative text", dpi=300)
    add("visual.chart", lambda s: _of("chart", lambda b: (b["series"] > s["series"]) | (b["points"] > s["points"])), "chart with more than {series} series or {points} points", series=5, points=10)
    add("visual.table", lambda s: _of("table", lambda b: (b["rows"] > s["rows"]) | (b["columns"] > s["columns"])), "table larger than {rows} by {columns}", rows=6, columns=5)
    add("visual.animations", lambda s: (F.size(F.coalesce("c.animations", F.array().cast("array<string>"))) > s["most"]) | F.coalesce(F.arrays_overlap("c.animations", F.array(*map(F.lit, FLASHY))), F.lit(False)), "too many or flashy animations", "info", most=3)
    return out


def deck_problems(slides: DataFrame, key: str, minutes: Column, seconds: Column, kind: Column) -> DataFrame:
    """(key, problem) for whole decks: missing references or questions slides, slide count and total time, visual share."""
    per = slides.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(minutes).alias("minutes"), F.sum(seconds).alias("seconds"), F.bool_or(kind == "references").alias("refs"), F.bool_or(kind == "questions").alias("qa"),
        (F.count_if(F.size("visuals") > 0) / F.count(F.lit(1))).alias("visual"), F.max(seconds).alias("longest"),
    )
    m = F.col("minutes")
    found = [
        F.when(~F.col("refs"), "no_references"), F.when(~F.col("qa"), "no_questions"), F.when((F.col("n") < m / 1.2) | (F.col("n") > m / 0.8), "slide_count"),
        F.when(F.abs(F.col("seconds") - m * 60) > 0.1 * m * 60, "total_time"), F.when(F.col("longest") > 120, "long_slide"), F.when((F.col("visual") == 0) | (F.col("visual") > 0.8), "visual_balance"),
    ]
    return per.select(key, F.explode(F.array_compact(F.array(*found))).alias("problem"))
