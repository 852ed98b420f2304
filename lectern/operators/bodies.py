"""Slides with a nested body of typed elements: counts, texts, rules that name the element at fault, and exports without effects.

A slide is one struct column of type SLIDE, parsed from JSON or put together by expressions; everything stays within the row, so
no step shuffles. Null slides, bodies and elements count as empty; an element of an unknown type has no text and breaks no rule.
Element and part numbers start at 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "type": "string", "content": "string", "items": "array<struct<text:string>>", "resolution": "int", "attribution": "string", "alt_text": "string",
    "data": "struct<series:array<struct<data:array<double>>>,x_label:string,y_label:string>", "headers": "array<string>", "rows": "array<array<string>>", "caption": "string",
}
ELEMENT = f"struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>"
STYLE = "struct<color:string,animation:string,transition:string,transform:string>"
SLIDE = f"struct<title:string,subtitle:string,body:array<{ELEMENT}>,animations:array<struct<type:string>>,style:{STYLE},speaker_notes:string>"
#: Elements that count as visuals by the rules, and in the balance of a slide.
VISUALS = ["image", "chart", "table", "diagram", "video", "equation", "code"]
PICTURES = ["image", "chart", "diagram"]
#: Kinds of presentations that need sources of images and no flashy effects; those effects; spellings of one term.
FORMAL = ["conference", "defense", "research"]
FLASHY = ["bounce", "spin", "zoom", "fly", "swivel", "pulse"]
SPELLINGS = [("e-mail", "email"), ("web site", "website"), ("data base", "database"), ("on-line", "online"), ("co-ordinate", "coordinate")]
#: Limits of the rules.
LIMITS = {"bullets": 5, "bullet_words": 10, "title": 60, "words": 100, "visuals": 2, "dpi": 300, "series": 5, "points": 10, "columns": 5, "rows": 6, "animations": 3}
EFFECTS = ["animation", "transition", "transform"]
FOUND = "array<struct<rule_id:string,severity:string,message:string,element:int,part:int>>"


def parsed(json: Column) -> Column:
    return F.from_json(json, SLIDE)


def body(slide: Column) -> Column:
    return F.coalesce(slide["body"], F.array().cast(f"array<{ELEMENT}>"))


def _items(e: Column) -> Column:
    return F.coalesce(e["items"], F.array().cast("array<struct<text:string>>"))


def n_words(text: Column) -> Column:
    """White-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def _total(rows: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0), lambda n, e: n + F.coalesce(value(e), F.lit(0)))


def all_words(slide: Column) -> Column:
    """Words of title, subtitle, texts, bullets, and captions of tables and charts."""

    def of(e: Column) -> Column:
        return F.when(e["type"] == "text", n_words(e["content"])).when(e["type"] == "bullet_list", _total(_items(e), lambda i: n_words(i["text"]))).when(e["type"].isin("table", "chart"), n_words(e["caption"]))

    return n_words(slide["title"]) + n_words(slide["subtitle"]) + _total(body(slide), of)


def spoken(slide: Column, notes: bool = True) -> Column:
    """Title, subtitle, texts, bullets and notes in order, with a blank between; parts that are missing are left out."""

    def of(e: Column) -> Column:
        bullets = F.transform(_items(e), lambda i: F.coalesce(i["text"], F.lit("")))
        return F.when(e["type"] == "text", F.array(F.coalesce(e["content"], F.lit("")))).when(e["type"] == "bullet_list", bullets).otherwise(F.array().cast("array<string>"))

    parts = [F.array(F.nullif(slide["title"], F.lit("")), slide["subtitle"]), F.flatten(F.transform(body(slide), of))]
    if notes:
        parts.append(F.array(F.nullif(slide["speaker_notes"], F.lit(""))))
    return F.array_join(F.array_compact(F.concat(*parts)), " ")


def element_counts(slide: Column, figures: Column | None = None, equations: Column | None = None, code: Column | None = None) -> Column:
    """struct of text, bullets, visuals, equations, code and tables; what the slide's own record says (figures, flags) is the least."""
    count = lambda *kinds: F.size(F.filter(body(slide), lambda e: e["type"].isin(*kinds)))
    bullets = _total(F.filter(body(slide), lambda e: e["type"] == "bullet_list"), lambda e: F.size(_items(e)))
    least = lambda n, c: n if c is None else F.greatest(n, F.coalesce(c.cast("int"), F.lit(0)))
    return F.struct(
        count("text").alias("text"), bullets.alias("bullets"), least(count(*PICTURES), figures).alias("visuals"), least(count("equation"), equations).alias("equations"),
        least(count("code"), code).alias("code"), count("table").alias("tables"),
    )


def visual_text(slide: Column) -> Column:
    """struct of score (one less 0.2 for a long title, 0.1 for each list with long bullets, 0.3 for many words; at least 0), long_title, long_lists, wordy."""
    title = F.coalesce(F.char_length(slide["title"]) > 80, F.lit(False))
    lists = F.size(F.filter(body(slide), lambda e: (e["type"] == "bullet_list") & F.exists(_items(e), lambda i: F.coalesce(F.char_length(i["text"]) > 100, F.lit(False)))))
    wordy = n_words(spoken(slide, notes=False)) > 150
    tenths = 10 - F.when(title, 2).otherwise(0) - lists - F.when(wordy, 3).otherwise(0)
    return F.struct((F.greatest(tenths, F.lit(0)) / 10).alias("score"), title.alias("long_title"), lists.alias("long_lists"), wordy.alias("wordy"))


def _hit(broken: Column, rule_id: str, severity: str, message: Column | str, element: Column | None = None, part: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(broken, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), text.alias("message"), (none if element is None else element.cast("int")).alias("element"), (none if part is None else part.cast("int")).alias("part")))


def _more(what: str, n: Column, limit: int, unit: str) -> Column:
    return F.concat(F.lit(f"{what} has "), n.cast("string"), F.lit(f" {unit}, exceeding limit of {limit}"))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def cited_words(text: Column) -> Column:
    """Words of a bullet without citations in parentheses or brackets."""
    return n_words(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\d{4}[^)]*\)", ""), r"\[[^\]]*\d{4}[^\]]*\]", ""))


def text_rules(slide: Column, limits: dict[str, int] = LIMITS) -> list[Column]:
    """Arrays of what a slide breaks: bullets, their length, title, density, spellings."""

    def bullets(e: Column, i: Column) -> Column:
        def one(b: Column, j: Column) -> Column:
            n = cited_words(b["text"])
            return _hit(n > limits["bullet_words"], "text.bullet_length", "warning", _more("Bullet point", n, limits["bullet_words"], "words"), i, j)

        return F.when(e["type"] == "bullet_list", F.transform(_items(e), one)).otherwise(F.array().cast(FOUND))

    count, title, words = element_counts(slide)["bullets"], F.coalesce(F.char_length(slide["title"]), F.lit(0)), all_words(slide)
    low = F.lower(spoken(slide, notes=False))
    slide_wide = [
        _hit(count > limits["bullets"], "text.bullet_count", "warning", _more("Slide", count, limits["bullets"], "bullet points")),
        _hit(title > limits["title"], "text.title_length", "warning", _more("Title", title, limits["title"], "characters")),
        _hit(words > limits["words"], "text.density", "warning", _more("Slide", words, limits["words"], "words")),
        *[_hit(low.contains(a) & low.contains(b), "text.terminology", "info", f"Inconsistent terminology: both '{a}' and '{b}' used") for a, b in SPELLINGS],
    ]
    return [F.array(*slide_wide), F.flatten(F.transform(body(slide), bullets))]


def visual_rules(slide: Column, kind: Column, limits: dict[str, int] = LIMITS) -> list[Column]:
    """Arrays of what a slide of a presentation of this kind breaks: visuals, images, charts and their series, tables, animations."""
    formal = kind.isin(FORMAL)

    def image(e: Column, i: Column) -> list[Column]:
        dpi = e["resolution"]
        return [
            _hit((dpi > 0) & (dpi < limits["dpi"]), "visual.image_quality", "warning", F.concat(F.lit("Image resolution ("), dpi.cast("string"), F.lit(f" dpi) below minimum ({limits['dpi']} dpi)")), i),
            _hit(formal & _blank(e["attribution"]), "visual.image_quality", "warning", "Image missing attribution/source", i),
            _hit(_blank(e["alt_text"]), "visual.image_quality", "info", "Image missing alt text for accessibility", i),
        ]

    def chart(e: Column, i: Column) -> Column:
        series = F.coalesce(e["data"]["series"], F.array().cast("array<struct<data:array<double>>>"))
        points = F.transform(series, lambda s, j: _hit(F.coalesce(F.size(s["data"]), F.lit(0)) > limits["points"], "visual.chart_complexity", "warning", _more("Chart series", F.size(s["data"]), limits["points"], "data points"), i, j))
        unnamed = (F.coalesce(e["data"]["x_label"], F.lit("")) == "") | (F.coalesce(e["data"]["y_label"], F.lit("")) == "")
        whole = [
            _hit(F.size(series) > limits["series"], "visual.chart_complexity", "warning", _more("Chart", F.size(series), limits["series"], "data series"), i),
            _hit(unnamed, "visual.chart_complexity", "warning", "Chart missing axis labels", i),
        ]
        return F.concat(F.array(*whole), points)

    def table(e: Column, i: Column) -> list[Column]:
        columns, rows = F.coalesce(F.size(e["headers"]), F.lit(0)), F.coalesce(F.size(e["rows"]), F.lit(0))
        return [
            _hit(columns > limits["columns"], "visual.table_size", "warning", _more("Table", columns, limits["columns"], "columns"), i),
            _hit(rows > limits["rows"], "visual.table_size", "warning", _more("Table", rows, limits["rows"], "rows"), i),
            _hit(F.coalesce(e["caption"], F.lit("")) == "", "visual.table_size", "info", "Table missing caption", i),
        ]

    def of(e: Column, i: Column) -> Column:
        return F.when(e["type"] == "image", F.array(*image(e, i))).when(e["type"] == "chart", chart(e, i)).when(e["type"] == "table", F.array(*table(e, i))).otherwise(F.array().cast(FOUND))

    visuals = F.size(F.filter(body(slide), lambda e: e["type"].isin(VISUALS)))
    moves = F.coalesce(slide["animations"], F.array().cast("array<struct<type:string>>"))
    flashy = F.exists(moves, lambda a: F.coalesce(F.lower(a["type"]).rlike("|".join(FLASHY)), F.lit(False)))
    slide_wide = [
        _hit(visuals > limits["visuals"], "visual.element_count", "warning", _more("Slide", visuals, limits["visuals"], "visual elements")),
        _hit(F.size(moves) > limits["animations"], "visual.animation_use", "info", F.concat(F.lit("Slide has "), F.size(moves).cast("string"), F.lit(" animations, which may be distracting"))),
        _hit(formal & flashy, "visual.animation_use", "info", "Flashy animations may be inappropriate for academic presentation"),
    ]
    return [F.array(*slide_wide), F.flatten(F.transform(body(slide), of))]


def violations(slides: DataFrame, keys: list[str], found: list[Column]) -> DataFrame:
    """One row for each rule that a slide, one of its elements or a part of it breaks."""
    # an outer explode, as the filter that a plain one puts below itself would judge all rules a second time
    return slides.select(*keys, F.explode_outer(F.concat(*found)).alias("v")).where("v IS NOT NULL").select(*keys, "v.*")


def element(kind: str, **given: Column) -> Column:
    """An element of this type with the given fields; others are null."""
    fields = {"type": F.lit(kind)} | given
    return F.struct(*[fields.get(k, F.lit(None)).cast(v).alias(k) for k, v in FIELDS.items()])


def slide_of(whole: Column, **given: Column) -> Column:
    """A slide with these elements and the given fields; others are null."""
    kinds = {"title": "string", "subtitle": "string", "body": f"array<{ELEMENT}>", "animations": "array<struct<type:string>>", "style": STYLE, "speaker_notes": "string"}
    fields = given | {"body": whole}
    return F.struct(*[fields.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()])


def quick_slide(text: Column, kind: Column) -> Column:
    """The slide that a single text makes: a title, a list of one bullet, or a text."""
    bullet = element("bullet_list", items=F.array(F.struct(text.alias("text"))))
    whole = F.when(kind == "bullet", F.array(bullet)).when(kind == "title", F.array().cast(f"array<{ELEMENT}>")).otherwise(F.array(element("text", content=text)))
    return slide_of(whole, title=F.when(kind == "title", text))


def without_effects(slide: Column) -> Column:
    """The slide without its animations, and its style without what moves."""
    return slide.withField("style", slide["style"].dropFields(*EFFECTS)).dropFields("animations")
