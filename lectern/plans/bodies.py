"""Slides with nested bodies, put together from conversations: each line of a turn is an element, by fixed rules that the SQL repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import bodies as B
from lectern.plans.registry import Tables, query

_KINDS = ["text", "bullet_list", "image", "chart", "table", "equation", "code", "bullet_list", "text", "diagram"]
_MOVES = ["fade", "Spin", "appear", "zoomIn", "wipe"]
_PRESENTATIONS = ["lecture", "conference", "defense", "research", "workshop"]

_SQL = rf"""
s AS (SELECT conv_id, turn, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls, {_PRESENTATIONS}[1 + CAST(conv_id % 5 AS INT)] AS kind FROM conversations),
t AS (SELECT *, string_split(text, '. ')[1] AS title, CASE WHEN turn % 2 = 1 THEN string_split(text, ' ')[1] END AS subtitle, ls[len(ls)] AS notes, length(text) % 6 AS moves FROM s),
l AS (SELECT conv_id, turn, kind, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM s),
e AS (SELECT *, length(x) AS n, {_KINDS}[1 + CAST((turn + 3 * i + length(x)) % 10 AS INT)] AS type FROM l),
b AS (SELECT conv_id, turn, i, unnest(string_split(x, ', ')) AS bullet, generate_subscripts(string_split(x, ', '), 1) - 1 AS j FROM e WHERE type = 'bullet_list'),
w AS (SELECT conv_id, turn, sum(CASE WHEN type = 'text' OR type = 'chart' OR (type = 'table' AND n % 3 <> 0) THEN len(regexp_extract_all(x, '\S+')) WHEN type = 'bullet_list' THEN list_sum(list_transform(string_split(x, ', '), lambda y: len(regexp_extract_all(y, '\S+')))) ELSE 0 END) AS n FROM e GROUP BY ALL),
p AS (SELECT conv_id, turn, string_agg(CASE type WHEN 'text' THEN x ELSE replace(x, ', ', ' ') END, ' ' ORDER BY i) AS x FROM e WHERE type IN ('text', 'bullet_list') GROUP BY ALL),
k AS (SELECT conv_id, turn, count(*) FILTER (WHERE type = 'text') AS n_text, coalesce(sum(len(string_split(x, ', '))) FILTER (WHERE type = 'bullet_list'), 0) AS n_bullets, count(*) FILTER (WHERE type IN ('image', 'chart', 'diagram')) AS n_visuals, count(*) FILTER (WHERE type = 'equation') AS n_equations, count(*) FILTER (WHERE type = 'code') AS n_code, count(*) FILTER (WHERE type = 'table') AS n_tables,
  count(*) FILTER (WHERE type IN ('image', 'chart', 'table', 'diagram', 'equation', 'code')) AS n_any FROM e GROUP BY ALL),
a AS (SELECT t.*, len(regexp_extract_all(title, '\S+')) + len(regexp_extract_all(coalesce(subtitle, ''), '\S+')) + coalesce(w.n, 0) AS n_words, concat_ws(' ', nullif(title, ''), subtitle, p.x) AS shown, concat_ws(' ', nullif(title, ''), subtitle, p.x, nullif(notes, '')) AS spoken, k.* EXCLUDE (conv_id, turn)
  FROM t LEFT JOIN w USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn))"""


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _element(x: Column, i: Column) -> Column:
    n, words = F.char_length(x), F.split(x, " ")
    series = F.transform(F.sequence(F.lit(1), 1 + n % 8), lambda s: F.struct(F.array_repeat(F.lit(0.5), (n + s) % 14).alias("data")))
    data = F.struct(series.alias("series"), F.when(n % 5 != 0, "x").alias("x_label"), F.when(n % 4 == 0, "").otherwise("y").alias("y_label"))
    made = {
        "text": B.element("text", content=x),
        "bullet_list": B.element("bullet_list", items=F.transform(F.split(x, ", "), lambda b: F.struct(b.alias("text")))),
        "image": B.element("image", resolution=F.when(n % 7 != 0, 150 + n * 37 % 300), attribution=F.when(n % 3 == 0, "").when(n % 3 == 2, words[0]), alt_text=F.when(n % 4 != 0, x)),
        "chart": B.element("chart", data=data, caption=x),
        "table": B.element("table", headers=F.slice(words, F.lit(1), n % 8), rows=F.array_repeat(F.array(F.lit("a")), n % 10), caption=F.when(n % 3 != 0, x)),
        "equation": B.element("equation", content=x), "code": B.element("code", content=x), "diagram": B.element("diagram", content=x),
    }
    kind, out = _pick(_KINDS, (F.col("turn") + 3 * i + n) % 10), F
    for name, e in made.items():
        out = out.when(kind == name, e)
    return out


def slides(t: Tables) -> DataFrame:
    """(conv_id, turn, kind, slide): each turn as a slide with nested elements, in a presentation of some kind."""
    text = F.coalesce("text", F.lit(""))
    turn = t.conversations.select("conv_id", "turn", text.alias("text"), F.split(text, "\n").alias("ls"), _pick(_PRESENTATIONS, F.col("conv_id") % 5).alias("kind"))
    moves = F.transform(F.slice(F.array(*map(F.lit, _MOVES)), F.lit(1), F.char_length("text") % 6), lambda m: F.struct(m.alias("type")))
    style = F.struct(F.concat(F.lit("#"), F.col("turn").cast("string")).alias("color"), F.lit("fade").alias("animation"), F.when(F.col("turn") % 2 == 0, "push").alias("transition"), F.lit("scale(2)").alias("transform"))
    slide = B.slide_of(F.transform("ls", _element), title=F.split("text", r"\. ")[0], subtitle=F.when(F.col("turn") % 2 == 1, F.split("text", " ")[0]), animations=moves, style=style, speaker_notes=F.element_at("ls", -1))
    return turn.select("conv_id", "turn", "kind", slide.alias("slide"))


@query(f"WITH {_SQL} SELECT conv_id, turn, n_text, CAST(n_bullets AS BIGINT) AS n_bullets, greatest(n_visuals, turn % 3) AS n_visuals, greatest(n_equations, CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END) AS n_equations, greatest(n_code, CASE WHEN turn % 5 = 0 THEN 1 ELSE 0 END) AS n_code, n_tables FROM a")
def slide_element_counts(t: Tables) -> DataFrame:
    """Elements of each slide by kind; its record names figures, equations and code that the body may lack."""
    turn = F.col("turn")
    c = slides(t).select("conv_id", "turn", B.element_counts(F.col("slide"), turn % 3, turn % 4 == 0, turn % 5 == 0).alias("c"))
    return c.select("conv_id", "turn", *[F.col(f"c.{k}").cast("long").alias(f"n_{k}") for k in ("text", "bullets", "visuals", "equations", "code", "tables")])


@query(rf"""WITH {_SQL}, q AS (SELECT conv_id, turn, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, i FROM b WHERE length(bullet) > 100) GROUP BY ALL)
SELECT conv_id, turn, CAST(n_words AS BIGINT) AS n_words, md5(spoken) AS digest, length(title) > 80 AS long_title, coalesce(q.n, 0) AS long_lists, len(regexp_extract_all(shown, '\S+')) > 150 AS wordy,
  greatest(0, 10 - CASE WHEN length(title) > 80 THEN 2 ELSE 0 END - coalesce(q.n, 0) - CASE WHEN len(regexp_extract_all(shown, '\S+')) > 150 THEN 3 ELSE 0 END) / 10 AS score FROM a LEFT JOIN q USING (conv_id, turn)""")
def slide_text_checks(t: Tables) -> DataFrame:
    """Words and text of each slide, with its notes, and how its text looks: long titles, long bullets, too many words."""
    s = F.col("slide")
    c = slides(t).select("conv_id", "turn", B.all_words(s).cast("long").alias("n_words"), F.md5(B.spoken(s)).alias("digest"), B.visual_text(s).alias("v"))
    return c.select("conv_id", "turn", "n_words", "digest", "v.long_title", F.col("v.long_lists").cast("long").alias("long_lists"), "v.wordy", "v.score")


@query(rf"""WITH {_SQL}, c AS (SELECT *, 1 + n % 8 AS series, n % 8 AS want, n % 10 AS n_rows, len(string_split(x, ' ')) AS n_parts FROM e),
g AS (SELECT conv_id, turn, i, n, unnest(range(1, 2 + n % 8)) AS s FROM e WHERE type = 'chart'),
u AS (SELECT conv_id, turn, i, j, len(regexp_extract_all(regexp_replace(regexp_replace(bullet, '\([^)]*\d{{4}}[^)]*\)', '', 'g'), '\[[^\]]*\d{{4}}[^\]]*\]', '', 'g'), '\S+')) AS n FROM b)
SELECT conv_id, turn, 'text.bullet_count' AS rule_id, 'warning' AS severity, 'Slide has ' || CAST(n_bullets AS BIGINT) || ' bullet points, exceeding limit of 5' AS message, CAST(NULL AS INT) AS element, CAST(NULL AS INT) AS part FROM a WHERE n_bullets > 5
UNION ALL SELECT conv_id, turn, 'text.title_length', 'warning', 'Title has ' || length(title) || ' characters, exceeding limit of 60', NULL, NULL FROM a WHERE length(title) > 60
UNION ALL SELECT conv_id, turn, 'text.density', 'warning', 'Slide has ' || CAST(n_words AS BIGINT) || ' words, exceeding limit of 100', NULL, NULL FROM a WHERE n_words > 100
UNION ALL SELECT conv_id, turn, 'text.terminology', 'info', 'Inconsistent terminology: both ''' || v.x || ''' and ''' || v.y || ''' used', NULL, NULL FROM a, (VALUES ('e-mail', 'email'), ('web site', 'website'), ('data base', 'database'), ('on-line', 'online'), ('co-ordinate', 'coordinate')) v(x, y) WHERE contains(lower(shown), v.x) AND contains(lower(shown), v.y)
UNION ALL SELECT conv_id, turn, 'text.bullet_length', 'warning', 'Bullet point has ' || n || ' words, exceeding limit of 10', i, j FROM u WHERE n > 10
UNION ALL SELECT conv_id, turn, 'visual.element_count', 'warning', 'Slide has ' || n_any || ' visual elements, exceeding limit of 2', NULL, NULL FROM a WHERE n_any > 2
UNION ALL SELECT conv_id, turn, 'visual.animation_use', 'info', 'Slide has ' || moves || ' animations, which may be distracting', NULL, NULL FROM a WHERE moves > 3
UNION ALL SELECT conv_id, turn, 'visual.animation_use', 'info', 'Flashy animations may be inappropriate for academic presentation', NULL, NULL FROM a WHERE moves > 1 AND kind IN ('conference', 'defense', 'research')
UNION ALL SELECT conv_id, turn, 'visual.image_quality', 'warning', 'Image resolution (' || (150 + n * 37 % 300) || ' dpi) below minimum (300 dpi)', i, NULL FROM e WHERE type = 'image' AND n % 7 <> 0 AND 150 + n * 37 % 300 < 300
UNION ALL SELECT conv_id, turn, 'visual.image_quality', 'warning', 'Image missing attribution/source', i, NULL FROM e WHERE type = 'image' AND kind IN ('conference', 'defense', 'research') AND (n % 3 <> 2 OR trim(string_split(x, ' ')[1]) = '')
UNION ALL SELECT conv_id, turn, 'visual.image_quality', 'info', 'Image missing alt text for accessibility', i, NULL FROM e WHERE type = 'image' AND (n % 4 = 0 OR trim(x) = '')
UNION ALL SELECT conv_id, turn, 'visual.chart_complexity', 'warning', 'Chart has ' || series || ' data series, exceeding limit of 5', i, NULL FROM c WHERE type = 'chart' AND series > 5
UNION ALL SELECT conv_id, turn, 'visual.chart_complexity', 'warning', 'Chart missing axis labels', i, NULL FROM c WHERE type = 'chart' AND (n % 5 = 0 OR n % 4 = 0)
UNION ALL SELECT conv_id, turn, 'visual.chart_complexity', 'warning', 'Chart series has ' || ((n + s) % 14) || ' data points, exceeding limit of 10', i, s - 1 FROM g WHERE (n + s) % 14 > 10
UNION ALL SELECT conv_id, turn, 'visual.table_size', 'warning', 'Table has ' || least(want, n_parts) || ' columns, exceeding limit of 5', i, NULL FROM c WHERE type = 'table' AND least(want, n_parts) > 5
UNION ALL SELECT conv_id, turn, 'visual.table_size', 'warning', 'Table has ' || n_rows || ' rows, exceeding limit of 6', i, NULL FROM c WHERE type = 'table' AND n_rows > 6
UNION ALL SELECT conv_id, turn, 'visual.table_size', 'info', 'Table missing caption', i, NULL FROM c WHERE type = 'table' AND (n % 3 = 0 OR x = '')""")
def slide_body_violations(t: Tables) -> DataFrame:
    """Every rule for texts and visuals that a slide breaks, with the element and the bullet or series at fault."""
    s = F.col("slide")
    return B.violations(slides(t), ["conv_id", "turn"], B.text_rules(s) + B.visual_rules(s, F.col("kind")))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents), k AS (SELECT *, CASE WHEN line = 0 THEN 'title' WHEN line % 2 = 1 THEN 'bullet' ELSE 'text' END AS kind, len(regexp_extract_all(x, '\S+')) AS n,
  len(regexp_extract_all(regexp_replace(regexp_replace(x, '\([^)]*\d{4}[^)]*\)', '', 'g'), '\[[^\]]*\d{4}[^\]]*\]', '', 'g'), '\S+')) AS u FROM l)
SELECT doc_id, line, kind, 'text.title_length' AS rule_id, 'warning' AS severity, 'Title has ' || length(x) || ' characters, exceeding limit of 60' AS message FROM k WHERE kind = 'title' AND length(x) > 60
UNION ALL SELECT doc_id, line, kind, 'text.bullet_length', 'warning', 'Bullet point has ' || u || ' words, exceeding limit of 10' FROM k WHERE kind = 'bullet' AND u > 10
UNION ALL SELECT doc_id, line, kind, 'text.density', 'warning', 'Slide has ' || n || ' words, exceeding limit of 100' FROM k WHERE n > 100
UNION ALL SELECT doc_id, line, kind, 'text.terminology', 'info', 'Inconsistent terminology: both ''' || v.x || ''' and ''' || v.y || ''' used' FROM k, (VALUES ('e-mail', 'email'), ('web site', 'website'), ('data base', 'database'), ('on-line', 'online'), ('co-ordinate', 'coordinate')) v(x, y) WHERE contains(lower(k.x), v.x) AND contains(lower(k.x), v.y)""")
def quick_text_checks(t: Tables) -> DataFrame:
    """The rules for texts on every line of every document, each as a slide of its own: a title, a bullet or a text."""
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "x"))
    kind = F.when(F.col("line") == 0, "title").when(F.col("line") % 2 == 1, "bullet").otherwise("text")
    each = lines.select("doc_id", F.col("line").cast("long").alias("line"), kind.alias("kind"), B.quick_slide(F.col("x"), kind).alias("slide"))
    return B.violations(each, ["doc_id", "line", "kind"], B.text_rules(F.col("slide"))).drop("element", "part")


@query(f"""WITH {_SQL} SELECT conv_id, turn, '{{"color":"#' || turn || '"}}' AS style, false AS moves, len(ls) AS n_elements, md5(title) AS title FROM t""")
def slides_without_effects(t: Tables) -> DataFrame:
    """Slides as an export without animations holds them: what is left of the style, and the rest as it was."""
    s = slides(t).select("conv_id", "turn", B.without_effects(F.col("slide")).alias("s"))
    out = s.select("conv_id", "turn", "s", F.to_json("s").alias("j"))
    return out.select("conv_id", "turn", F.get_json_object("j", "$.style").alias("style"), F.get_json_object("j", "$.animations").isNotNull().alias("moves"), F.size("s.body").cast("long").alias("n_elements"), F.md5("s.title").alias("title"))
