"""Consistency of style over a deck, and places of citations in sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many fonts and colours a deck may have, the least resolution of images, and how colours look.
MOST_FONTS, MOST_COLOURS, LEAST_DPI = 3, 5, 300
COLOUR = r"#[0-9a-fA-F]{6}|rgb\([^)]+\)"
#: A cite command with up to two notes and its keys, in any case.
CITE = r"(?i)\\(cite[a-z]*)\s*(?:\[([^\]]*)\])?\s*(?:\[([^\]]*)\])?\s*\{([^}]+)\}"
#: Commands that are a type of their own; others count as cite.
CITE_TYPES = ["cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear"]


def _said(style: Column) -> Column:
    """What a style says, as (rule, value): fonts and colours at any depth. Keys of nested styles are joined by dots."""
    entries = F.map_entries(F.coalesce(style, F.create_map().cast("map<string,string>")))
    fonts = F.filter(entries, lambda e: F.lower(F.substring_index(e["key"], ".", -1)).contains("font") & e["value"].isNotNull())
    colours = F.flatten(F.transform(entries, lambda e: F.regexp_extract_all(F.coalesce(e["value"], F.lit("")), F.lit(COLOUR), F.lit(0))))
    named = lambda rule, values: F.transform(values, lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))
    return F.concat(named("fonts", F.transform(fonts, lambda e: e["value"])), named("colours", colours))


def style_issues(slides: DataFrame, deck: str) -> DataFrame:
    """(deck, rule, kind, place, n) of decks whose slides (place, kind, style, resolutions) disagree.

    fonts, colours: n distinct ones, more than a deck may have. spacing: slides of one kind with n different line heights and
    distances of paragraphs; slides that state neither are left out. images: a row for each image whose resolution n is known
    and too low. The distinct values of a deck are counted by partial aggregation, so the length of a deck doesn't matter.
    """
    said = slides.select(deck, F.explode(_said(F.col("style"))).alias("x")).select(deck, "x.rule", F.lit(None).cast("string").alias("kind"), "x.value")
    at = lambda k: F.coalesce(F.try_element_at("style", F.lit(k)), F.lit("None"))
    stated = F.map_contains_key("style", F.lit("line_height")) | F.map_contains_key("style", F.lit("paragraph_spacing"))
    spaced = slides.where(stated).select(deck, F.lit("spacing").alias("rule"), "kind", F.concat_ws("_", at("line_height"), at("paragraph_spacing")).alias("value"))
    counted = said.unionByName(spaced).groupBy(deck, "rule", "kind").agg(F.count_distinct("value").alias("n"))
    most = F.when(F.col("rule") == "fonts", MOST_FONTS).when(F.col("rule") == "colours", MOST_COLOURS).otherwise(1)
    low = slides.select(deck, F.lit("images").alias("rule"), F.lit(None).cast("string").alias("kind"), "place", F.explode(F.col("resolutions").cast("array<bigint>")).alias("n")).where((F.col("n") != 0) & (F.col("n") < LEAST_DPI))
    wrong = counted.where(F.col("n") > most).withColumn("place", F.lit(None).cast(slides.schema["place"].dataType))
    return wrong.unionByName(low).select(deck, "rule", "kind", "place", "n")


def citation_places(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, type, pre, post, keys, position, line, col) of the cite commands of each text; ``key`` tells the texts apart.

    A single note is the one behind; positions start at 0, lines and columns at 1. What lies between the commands is measured in
    the row, and only these numbers are shuffled and summed up by text; the work is linear in the citations of a text.
    """
    part = lambda i: F.regexp_extract_all(text, F.lit(CITE), F.lit(i))
    pieces = F.transform(F.split(text, CITE, -1), lambda s: F.struct(F.char_length(s).alias("n"), F.regexp_count(s, F.lit("\n")).alias("breaks"), F.char_length(F.substring_index(s, "\n", -1)).alias("tail")))
    found = F.arrays_zip(*(part(i).alias(n) for i, n in enumerate(("raw", "command", "one", "two", "keys"))))
    rows = texts.where(F.lower(text).contains("\\cite")).select(key, pieces.alias("p"), found.alias("f"))
    each = rows.select(key, F.posexplode(F.zip_with(F.slice("p", F.lit(1), F.size("f")), "f", lambda p, f: F.struct(p.alias("p"), f.alias("f")))).alias("no", "x"))
    raw = F.col("x.f.raw")
    each = each.select(key, (F.col("no") + 1).cast("long").alias("no"), "x.p.*", "x.f.*", F.char_length(raw).alias("own"), F.regexp_count(raw, F.lit("\n")).alias("inside"), F.char_length(F.substring_index(raw, "\n", -1)).alias("end"))
    w = Window.partitionBy(key).orderBy("no")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("n") + F.col("own")).over(upto) - F.col("own")
    line = 1 + F.sum(F.col("breaks") + F.col("inside")).over(upto) - F.col("inside")
    placed = each.withColumns({"position": start.cast("long"), "line": line.cast("long")})
    # where the latest line began: before this command, or at the end of an earlier one that was broken itself
    begun = F.when(F.col("breaks") > 0, F.col("position") - F.col("tail"))
    broken = F.when(F.col("inside") > 0, F.col("position") + F.col("own") - F.col("end"))
    earlier = F.max(broken).over(w.rowsBetween(Window.unboundedPreceding, -1))
    column = F.col("position") - F.greatest(F.lit(0), F.max(begun).over(upto), earlier) + 1
    command, single = F.lower("command"), (F.col("two") == "")
    return placed.select(
        key, "no", F.when(command.isin(CITE_TYPES), command).otherwise("cite").alias("type"), F.trim(F.when(single, "").otherwise(F.col("one"))).alias("pre"), F.trim(F.when(single, F.col("one")).otherwise(F.col("two"))).alias("post"),
        "keys", "position", "line", column.cast("long").alias("col"),
    )
