"""Quality of slide decks: conversations are decks, turns are slides.

What a turn lacks is derived from it by fixed rules, the same in the SQL: its layout, effect, duration and visuals follow from
its ordinal and length, its elements from its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.plans.registry import Tables, query

#: Words that tell a slide's type, in the order that decides.
TYPES = [
    ("title", ["title slide", "presentation title"]), ("overview", ["overview", "outline", "agenda", "contents", "roadmap"]), ("section", ["section", "part", "chapter"]),
    ("conclusion", ["conclusion", "summary", "concluding", "final thoughts"]), ("references", ["references", "bibliography", "sources", "citations"]), ("questions", ["questions", "q&a", "thank you", "discussion"]),
]
#: Effects that suit a type, others only fade; elements that a layout takes.
EFFECTS = {"title": ["fade", "zoom", "appear"], "overview": ["fade", "push", "wipe"], "section": ["cube", "flip", "fade"], "content": ["fade", "push", "slide"], "conclusion": ["fade", "zoom"], "references": ["fade", "appear"]}
LAYOUTS = [("single", 3), ("two_column", 6), ("image_left", 4), ("image_right", 4), ("comparison", 8), ("grid", 9)]
#: Recommended seconds of a slide type (30 to 120 for others).
TIMES = {"title": (10, 20), "overview": (30, 60), "content": (45, 120), "section": (15, 30), "conclusion": (60, 120), "references": (10, 30), "questions": (10, 20)}

_SQL = r"""
s AS (SELECT conv_id, turn, role, text, length(text) AS n_chars, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS bullets, (turn * 7 + length(text)) % 3 AS visuals, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words,
  list_extract(['single', 'two_column', 'image_left', 'image_right', 'comparison', 'grid'], 1 + (conv_id + turn) % 6) AS layout, list_extract([3, 6, 4, 4, 8, 9], 1 + (conv_id + turn) % 6) AS takes,
  list_extract(['fade', 'zoom', 'push', 'wipe', 'cube'], 1 + length(text) % 5) AS effect, 0.5 * (1 + turn % 5) AS duration, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n_slides,
  CASE WHEN regexp_matches(lower(text), 'title slide|presentation title') THEN 'title' WHEN regexp_matches(lower(text), 'overview|outline|agenda|contents|roadmap') THEN 'overview' WHEN regexp_matches(lower(text), 'section|part|chapter') THEN 'section'
    WHEN regexp_matches(lower(text), 'conclusion|summary|concluding|final thoughts') THEN 'conclusion' WHEN regexp_matches(lower(text), 'references|bibliography|sources|citations') THEN 'references' WHEN regexp_matches(lower(text), 'questions|q&a|thank you|discussion') THEN 'questions' ELSE 'content' END AS kind FROM conversations)
"""


def slides(t: Tables) -> DataFrame:
    """(conv_id, turn, role, n_chars, bullets, visuals, words, layout, takes, effect, duration, place, n_slides, kind) of each turn."""
    c, n = t.conversations, F.char_length("text").cast("long")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    by = Window.partitionBy("conv_id")
    return c.select(
        "conv_id", "turn", "role", n.alias("n_chars"), F.size(X.lines(F.col("text"), "\n")).cast("long").alias("bullets"), ((F.col("turn") * 7 + n) % 3).alias("visuals"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"),
        pick([x for x, _ in LAYOUTS], (F.col("conv_id") + F.col("turn")) % 6).alias("layout"), pick([x for _, x in LAYOUTS], (F.col("conv_id") + F.col("turn")) % 6).alias("takes"),
        pick(["fade", "zoom", "push", "wipe", "cube"], n % 5).alias("effect"), (0.5 * (1 + F.col("turn") % 5)).alias("duration"), F.row_number().over(by.orderBy("turn")).alias("place"), F.count(F.lit(1)).over(by).alias("n_slides"),
        X.first_match(F.lower("text"), TYPES, "content").alias("kind"), F.lower("text").alias("low"),
    )


@query(f"""WITH {_SQL}, e AS (SELECT conv_id, effect, duration, list_contains(CASE kind WHEN 'title' THEN ['fade', 'zoom', 'appear'] WHEN 'overview' THEN ['fade', 'push', 'wipe'] WHEN 'section' THEN ['cube', 'flip', 'fade'] WHEN 'content' THEN ['fade', 'push', 'slide'] WHEN 'conclusion' THEN ['fade', 'zoom'] WHEN 'references' THEN ['fade', 'appear'] ELSE ['fade'] END, effect) AS fits FROM s)
SELECT conv_id, round(count(*) FILTER (WHERE fits) * 1.0 / count(*), 6) AS score, count(*) FILTER (WHERE NOT fits) AS distracting, count(*) FILTER (WHERE duration > 2) AS too_long, count(DISTINCT effect) > 3 AS too_many FROM e GROUP BY conv_id""")
def transition_effects(t: Tables) -> DataFrame:
    """Effects that suit the type of their slide, durations over two seconds, and more than three different effects."""
    suits = F.lit(False)
    for kind, effects in EFFECTS.items():
        suits = suits | ((F.col("kind") == kind) & F.col("effect").isin(effects))
    rows = slides(t).withColumn("fits", suits | (~F.col("kind").isin(list(EFFECTS)) & (F.col("effect") == "fade")))
    return rows.groupBy("conv_id").agg(F.round(F.count_if("fits") / F.count(F.lit(1)), 6).alias("score"), F.count_if(~F.col("fits")).alias("distracting"), F.count_if(F.col("duration") > 2).alias("too_long"), (F.count_distinct("effect") > 3).alias("too_many"))


@query(f"""WITH {_SQL}, d AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE visuals > 0) AS visual, count(*) FILTER (WHERE visuals = 0 AND place > 1 AND place < n_slides) AS text_only, count(*) FILTER (WHERE 1 + bullets + visuals > 5) AS overloaded, count(*) FILTER (WHERE bullets > 7) AS bullets FROM s GROUP BY conv_id)
SELECT conv_id, visual, text_only, overloaded, bullets, round(0.5 + CASE WHEN visual * 1.0 / n >= 0.4 THEN 0.2 ELSE 0 END + CASE WHEN overloaded < n * 0.1 THEN 0.2 ELSE 0 END + CASE WHEN text_only < n * 0.3 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS score, visual * 1.0 / n < 0.3 AS too_few FROM d""")
def element_distribution(t: Tables) -> DataFrame:
    """Share of slides with visuals, slides of text alone (other than the first and last), and overloaded ones (over five elements)."""
    total, n = 1 + F.col("bullets") + F.col("visuals"), F.col("n")
    d = slides(t).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("visuals") > 0).alias("visual"), F.count_if((F.col("visuals") == 0) & (F.col("place") > 1) & (F.col("place") < F.col("n_slides"))).alias("text_only"), F.count_if(total > 5).alias("overloaded"), F.count_if(F.col("bullets") > 7).alias("bullets"))
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    score = 0.5 + part(F.col("visual") / n >= 0.4, 0.2) + part(F.col("overloaded") < n * 0.1, 0.2) + part(F.col("text_only") < n * 0.3, 0.1)
    return d.select("conv_id", "visual", "text_only", "overloaded", "bullets", F.round(score, 4).alias("score"), (F.col("visual") / n < 0.3).alias("too_few"))


@query(f"""WITH {_SQL}, r AS (SELECT conv_id, role, (1 + bullets) * 1.0 / (1 + bullets + visuals) AS ratio, visuals FROM s)
SELECT conv_id, round(avg(ratio), 6) AS mean_ratio, count(*) FILTER (WHERE ratio > 0.85) AS text_heavy, count(*) FILTER (WHERE ratio < 0.15 AND visuals > 0) AS visual_heavy, round(greatest(0, 1 - 2 * abs(avg(ratio) - 0.6)), 6) AS score FROM r GROUP BY conv_id""")
def text_visual_balance(t: Tables) -> DataFrame:
    """Text over all elements of a slide; the deck is best at 60 %."""
    text = 1 + F.col("bullets")
    r = slides(t).select("conv_id", "visuals", (text / (text + F.col("visuals"))).alias("ratio"))
    return r.groupBy("conv_id").agg(F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.count_if(F.col("ratio") > 0.85).alias("text_heavy"), F.count_if((F.col("ratio") < 0.15) & (F.col("visuals") > 0)).alias("visual_heavy"), F.round(F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.avg("ratio") - 0.6)), 6).alias("score"))


@query(f"""WITH {_SQL} SELECT conv_id, round(count(*) FILTER (WHERE 1 + bullets + visuals <= takes) * 1.0 / count(*), 6) AS score, count(*) FILTER (WHERE layout = 'two_column' AND bullets < 1) AS thin_columns, count(*) FILTER (WHERE layout IN ('image_left', 'image_right') AND visuals = 0) AS no_image FROM s GROUP BY conv_id""")
def layout_fit(t: Tables) -> DataFrame:
    """Slides whose elements their layout takes, columns with too little text, and image layouts without an image."""
    fits = 1 + F.col("bullets") + F.col("visuals") <= F.col("takes")
    image = F.col("layout").isin("image_left", "image_right") & (F.col("visuals") == 0)
    return slides(t).groupBy("conv_id").agg(F.round(F.count_if(fits) / F.count(F.lit(1)), 6).alias("score"), F.count_if((F.col("layout") == "two_column") & (F.col("bullets") < 1)).alias("thin_columns"), F.count_if(image).alias("no_image"))


@query(f"""WITH {_SQL}, m AS (SELECT conv_id, layout, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT conv_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS n, min(layout) FILTER (WHERE n = (SELECT max(n) FROM m x WHERE x.conv_id = m.conv_id)) AS layout FROM m GROUP BY conv_id) SELECT conv_id, layout, round(least(1.0, 1.5 * most / n), 6) AS score FROM k""")
def visual_consistency(t: Tables) -> DataFrame:
    """Share of the most frequent layout, times 1.5, at most 1; the first by name on ties."""
    m = slides(t).groupBy("conv_id", "layout").agg(F.count(F.lit(1)).alias("n"))
    k = m.groupBy("conv_id").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "layout")).alias("first"))
    return k.select("conv_id", F.col("first.layout").alias("layout"), F.round(F.least(F.lit(1.0), 1.5 * F.col("most") / F.col("n")), 6).alias("score"))


@query(f"""WITH {_SQL}, d AS (SELECT conv_id, kind, least(1.0, words / 100.0) AS density FROM s)
SELECT conv_id, round(greatest(0, 1 - 2 * abs(avg(density) - 0.65)), 6) AS score, count(*) FILTER (WHERE density > 0.85) AS dense, count(*) FILTER (WHERE density < 0.3 AND kind = 'content') AS sparse, max(density) - min(density) > 0.6 AS uneven FROM d GROUP BY conv_id""")
def density_balance(t: Tables) -> DataFrame:
    """Mean density of a deck, best at 0.65; dense slides, sparse content slides, and a wide range."""
    d = slides(t).select("conv_id", "kind", F.least(F.lit(1.0), F.col("words") / 100).alias("density"))
    return d.groupBy("conv_id").agg(F.round(F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.avg("density") - 0.65)), 6).alias("score"), F.count_if(F.col("density") > 0.85).alias("dense"), F.count_if((F.col("density") < 0.3) & (F.col("kind") == "content")).alias("sparse"), (F.max("density") - F.min("density") > 0.6).alias("uneven"))


_LOW = "CASE kind WHEN 'title' THEN 10 WHEN 'overview' THEN 30 WHEN 'content' THEN 45 WHEN 'section' THEN 15 WHEN 'conclusion' THEN 60 WHEN 'references' THEN 10 WHEN 'questions' THEN 10 ELSE 30 END"
_HIGH = "CASE kind WHEN 'title' THEN 20 WHEN 'overview' THEN 60 WHEN 'content' THEN 120 WHEN 'section' THEN 30 WHEN 'conclusion' THEN 120 WHEN 'references' THEN 30 WHEN 'questions' THEN 20 ELSE 120 END"


@query(f"""WITH {_SQL}, x AS (SELECT conv_id, CASE kind WHEN 'title' THEN 10 WHEN 'section' THEN 15 ELSE 20 END + CAST(floor(words / 130.0 * 60) AS BIGINT) + 30 * visuals + 3 AS seconds, least(1.0, words / 100.0) AS density, {_LOW} AS low, {_HIGH} AS high FROM s),
y AS (SELECT conv_id, seconds, CASE WHEN density < 0.3 THEN low * 0.7 ELSE low END AS low, CASE WHEN density > 0.7 THEN high * 1.3 ELSE high END AS high FROM x)
SELECT conv_id, CAST(sum(seconds) AS BIGINT) AS total, count(*) FILTER (WHERE seconds < low) AS too_short, count(*) FILTER (WHERE seconds > high) AS too_long, round(count(*) FILTER (WHERE seconds BETWEEN low AND high) * 1.0 / count(*), 6) AS score FROM y GROUP BY conv_id""")
def individual_timings(t: Tables) -> DataFrame:
    """Slides whose estimated time lies in the range of their type; dense ones may take 1.3 times as long, sparse ones 0.7 times."""
    base = F.when(F.col("kind") == "title", 10).when(F.col("kind") == "section", 15).otherwise(20)
    seconds = base + F.floor(F.col("words") / 130 * 60) + 30 * F.col("visuals") + 3
    low, high = F, F
    for kind, (a, b) in TIMES.items():
        low, high = low.when(F.col("kind") == kind, a), high.when(F.col("kind") == kind, b)
    density = F.least(F.lit(1.0), F.col("words") / 100)
    rows = slides(t).select("conv_id", seconds.alias("s"), (low.otherwise(30) * F.when(density < 0.3, 0.7).otherwise(1.0)).alias("low"), (high.otherwise(120) * F.when(density > 0.7, 1.3).otherwise(1.0)).alias("high"))
    s = F.col("s")
    return rows.groupBy("conv_id").agg(F.sum("s").cast("long").alias("total"), F.count_if(s < F.col("low")).alias("too_short"), F.count_if(s > F.col("high")).alias("too_long"), F.round(F.count_if(s.between(F.col("low"), F.col("high"))) / F.count(F.lit(1)), 6).alias("score"))


@query(f"""WITH {_SQL}, p AS (SELECT conv_id, CASE WHEN role = 'system' THEN 'section' ELSE kind END AS kind, lead(CASE WHEN role = 'system' THEN 'section' ELSE kind END) OVER w AS after, lead(text) OVER w AS next FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT conv_id, regexp_matches(lower(next), 'in this section|we will discuss|focus on|next|furthermore|additionally|moreover') AS linked FROM p WHERE after IS NOT NULL AND (kind = 'section' OR after = 'section'))
SELECT conv_id, count(*) AS boundaries, count(*) FILTER (WHERE linked) AS linked, round(count(*) FILTER (WHERE linked) * 1.0 / count(*), 6) AS score FROM b GROUP BY conv_id""")
def section_transitions(t: Tables) -> DataFrame:
    """Boundaries of sections, and how many of the slides behind them take up what was before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = slides(t).withColumn("kind", F.when(F.col("role") == "system", "section").otherwise(F.col("kind")))
    p = rows.select("conv_id", "turn", "kind", F.lead("kind").over(w).alias("after"), F.lead("low").over(w).alias("next"))
    b = p.where("after is not null and (kind = 'section' or after = 'section')").withColumn("linked", X.any_of([F.col("next").contains(x) for x in ("in this section", "we will discuss", "focus on", "next", "furthermore", "additionally", "moreover")]))
    return b.groupBy("conv_id").agg(F.count(F.lit(1)).alias("boundaries"), F.count_if("linked").alias("linked"), F.round(F.count_if("linked") / F.count(F.lit(1)), 6).alias("score"))


@query(f"""WITH {_SQL} SELECT conv_id, bool_or(kind = 'overview') AS has_overview, bool_or(kind = 'conclusion') AS has_conclusion, bool_or(kind = 'references') AS has_references, coalesce(min(place) FILTER (WHERE kind = 'conclusion') < max(place) FILTER (WHERE kind = 'overview'), false) AS out_of_order FROM s GROUP BY conv_id""")
def section_structure(t: Tables) -> DataFrame:
    """Expected parts of a deck, and a conclusion that comes before an overview."""
    at = lambda f, k: f(F.when(F.col("kind") == k, F.col("place")))
    has = lambda k: F.bool_or(F.col("kind") == k)
    return slides(t).groupBy("conv_id").agg(has("overview").alias("has_overview"), has("conclusion").alias("has_conclusion"), has("references").alias("has_references"), F.coalesce(at(F.min, "conclusion") < at(F.max, "overview"), F.lit(False)).alias("out_of_order"))


@query(f"""WITH {_SQL}, i AS (SELECT conv_id, count(DISTINCT effect) AS fonts, count(DISTINCT layout) AS colours, count(DISTINCT CASE WHEN kind = 'content' THEN visuals END) AS spacings, count(*) FILTER (WHERE n_chars < 300) AS low_resolution FROM s GROUP BY 1)
SELECT conv_id, issue, severity, row_number() OVER (PARTITION BY conv_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, issue) AS place FROM (
  SELECT conv_id, 'fonts' AS issue, 'warning' AS severity FROM i WHERE fonts > 2 UNION ALL SELECT conv_id, 'colours', 'warning' FROM i WHERE colours > 4 UNION ALL SELECT conv_id, 'spacing', 'info' FROM i WHERE spacings > 1 UNION ALL SELECT conv_id, 'images', 'error' FROM i WHERE low_resolution > 0)""")
def style_consistency(t: Tables) -> DataFrame:
    """Too many fonts or colours, several spacings in slides of one type, images below the least resolution; issues by severity."""
    i = slides(t).groupBy("conv_id").agg(F.count_distinct("effect").alias("fonts"), F.count_distinct("layout").alias("colours"), F.count_distinct(F.when(F.col("kind") == "content", F.col("visuals"))).alias("spacings"), F.count_if(F.col("n_chars") < 300).alias("low"))
    issue = lambda c, name, severity, rank: F.when(c, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    found = F.array(issue(F.col("low") > 0, "images", "error", 0), issue(F.col("fonts") > 2, "fonts", "warning", 1), issue(F.col("colours") > 4, "colours", "warning", 1), issue(F.col("spacings") > 1, "spacing", "info", 2))
    rows = i.select("conv_id", F.posexplode(F.array_sort(F.array_compact(found))).alias("at", "x"))
    return rows.select("conv_id", "x.issue", "x.severity", (F.col("at") + 1).cast("long").alias("place"))


@query(f"""WITH {_SQL}, e AS (SELECT conv_id, place, 1 AS needs FROM s WHERE place > 1 UNION SELECT a.conv_id, a.place, max(b.place) FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.place < a.place AND b.kind = 'section' GROUP BY 1, 2 UNION SELECT conv_id, place, visuals FROM s WHERE visuals >= 1 AND visuals < place)
SELECT conv_id, place, needs FROM e""")
def slide_dependencies(t: Tables) -> DataFrame:
    """What each slide needs: the first one, the nearest section slide before it, and the one that it names."""
    w = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    s = slides(t).select("conv_id", F.col("place").cast("long").alias("place"), "kind", "visuals")
    s = s.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("place")), ignorenulls=True).over(w))
    needs = F.array_distinct(F.array_compact(F.array(F.when(F.col("place") > 1, F.lit(1).cast("long")), F.col("section"), F.when((F.col("visuals") >= 1) & (F.col("visuals") < F.col("place")), F.col("visuals")))))
    return s.select("conv_id", "place", F.explode(needs).alias("needs"))


@query(f"""WITH {_SQL}, x AS (SELECT conv_id, turn, greatest(0.0, 1 - CASE WHEN regexp_matches(lower(text), '\\b(is|are|was|were|been) [a-z]+ed\\b') THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(lower(text), 'in order to|due to the fact that') THEN 0.1 ELSE 0 END - 0.05 * len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains(['this', 'that', 'it', 'they'], w)))) AS score, words, n_chars FROM s)
SELECT conv_id, round(avg(score), 6) AS clarity, count(*) FILTER (WHERE words > 150) AS wordy, count(*) FILTER (WHERE n_chars > 800) AS long FROM x GROUP BY conv_id""")
def slide_clarity(t: Tables) -> DataFrame:
    """One, less 0.2 for passive voice, 0.1 for wordy phrases and 0.05 for each pronoun; the mean of a deck."""
    low = F.col("low")
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    score = 1 - part(low.rlike(r"\b(is|are|was|were|been) [a-z]+ed\b"), 0.2) - part(low.contains("in order to") | low.contains("due to the fact that"), 0.1) - 0.05 * X.word_hits(X.padded(low), ["this", "that", "it", "they"])
    rows = slides(t).select("conv_id", "words", "n_chars", F.greatest(F.lit(0.0), score).alias("score"))
    return rows.groupBy("conv_id").agg(F.round(F.avg("score"), 6).alias("clarity"), F.count_if(F.col("words") > 150).alias("wordy"), F.count_if(F.col("n_chars") > 800).alias("long"))



@query(f"""WITH {_SQL}, v AS (SELECT conv_id, unnest(list_concat(CASE WHEN bullets > 5 THEN ['text.bullets'] ELSE [] END, CASE WHEN words > 100 THEN ['text.density'] ELSE [] END, CASE WHEN visuals > 1 THEN ['visual.count'] ELSE [] END, CASE WHEN duration > 2 THEN ['time.transition'] ELSE [] END)) AS rule FROM s),
c AS (SELECT conv_id, rule, count(*) AS n FROM v GROUP BY 1, 2) SELECT conv_id, CAST(sum(n) AS BIGINT) AS violations, CAST(sum(CASE WHEN rule = 'text.density' THEN n ELSE 0 END) AS BIGINT) AS errors, min(rule) FILTER (WHERE n = (SELECT max(n) FROM c x WHERE x.conv_id = c.conv_id)) AS most_common FROM c GROUP BY conv_id""")
def presentation_validation(t: Tables) -> DataFrame:
    """Violations of a deck's slides: how many, how many errors, and the most common rule (the first by name on ties)."""
    found = F.array_compact(F.array(F.when(F.col("bullets") > 5, "text.bullets"), F.when(F.col("words") > 100, "text.density"), F.when(F.col("visuals") > 1, "visual.count"), F.when(F.col("duration") > 2, "time.transition")))
    c = slides(t).select("conv_id", F.explode(found).alias("rule")).groupBy("conv_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("m"), "rule"))
    return c.groupBy("conv_id").agg(F.sum("n").alias("violations"), F.sum(F.when(F.col("rule") == "text.density", F.col("n")).otherwise(0)).alias("errors"), first.alias("f")).select("conv_id", "violations", "errors", F.col("f.rule").alias("most_common"))


@query(f"""WITH {_SQL}, p AS (SELECT conv_id, duration, lead(effect) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM s) SELECT conv_id, count(*) FILTER (WHERE next IS NOT NULL) AS transitions, round(sum(CASE WHEN next IS NOT NULL THEN duration ELSE 0 END), 4)::DOUBLE AS seconds, sum(CASE WHEN next IS NOT NULL THEN duration ELSE 0 END) > 0.1 * count(*) * 10 AS too_long FROM p GROUP BY conv_id""")
def transition_time(t: Tables) -> DataFrame:
    """Time that transitions take, against a tenth of the time of the deck (ten seconds a slide here)."""
    p = slides(t).select("conv_id", F.when(F.lead("effect").over(Window.partitionBy("conv_id").orderBy("turn")).isNotNull(), F.col("duration")).alias("d"))
    used = F.sum(F.coalesce("d", F.lit(0.0)))
    return p.groupBy("conv_id").agg(F.count("d").alias("transitions"), F.round(used, 4).alias("seconds"), (used > 0.1 * F.count(F.lit(1)) * 10).alias("too_long"))


@query(f"""WITH {_SQL} SELECT conv_id, turn, CASE WHEN words = 0 THEN 'empty' WHEN layout IS NULL THEN 'no layout' WHEN n_chars < 20 AND bullets = 0 THEN 'no title and body' WHEN effect NOT IN ('fade', 'zoom', 'push', 'wipe') THEN 'unknown effect' ELSE 'ok' END AS problem FROM s""")
def export_request_checks(t: Tables) -> DataFrame:
    """The first check of an export request that a slide fails."""
    problem = F.when(F.col("words") == 0, "empty").when(F.col("layout").isNull(), "no layout").when((F.col("n_chars") < 20) & (F.col("bullets") == 0), "no title and body").when(~F.col("effect").isin("fade", "zoom", "push", "wipe"), "unknown effect").otherwise("ok")
    return slides(t).select("conv_id", "turn", problem.alias("problem"))
