"""Behaviour of users against what they did before, coverage of a topic by references, abrupt sections, and exports of an audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

#: What an unseen hour, an unseen type and an unusual size add to a score; how many sizes a profile holds.
UNSEEN_HOUR, UNSEEN_TYPE, ODD_SIZE, SIZES = 0.3, 0.4, 0.3, 100
#: Phrases that link a section to the one before it, and the words beyond which a paragraph needs one.
LINKS = ["however", "therefore", "furthermore", "moreover", "nevertheless", "consequently", "additionally", "similarly", "in contrast", "on the other hand", "as a result", "in addition", "finally"]
LEAST_WORDS = 10


def behaviour_scores(events: DataFrame, user: str, order: list[str], hour: Column, kind: Column, size: Column) -> DataFrame:
    """``events`` with unseen_hour, unseen_type, odd_size and score (0 to 1): each event against its user's earlier ones.

    A user's first event is no anomaly. Sizes count if positive, the latest SIZES of them; an odd one is more than two standard
    deviations from their mean (both 0 before the first one, the deviation 0 with a single one). A null hour or type, and an empty
    type, is not unusual. All windows are partitioned by the user, or finer, so one shuffle serves them; frames are read as streams.
    """
    by = Window.partitionBy(user)
    rows = events.withColumns({"_hour": hour, "_kind": kind, "_size": F.coalesce(size, F.lit(0.0)).cast("double")})
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_at": F.row_number().over(by.orderBy(*order)), "_x": (F.coalesce(F.sum(F.when(F.col("_size") > 0, 1).otherwise(0)).over(before), F.lit(0)) + 1).cast("long")})
    latest = by.orderBy("_x").rangeBetween(-SIZES, -1)  # numbers of the positive sizes before, whatever stands between them
    held = F.when(F.col("_size") > 0, F.col("_size"))
    mean, dev = F.coalesce(F.avg(held).over(latest), F.lit(0.0)), F.coalesce(F.stddev_pop(held).over(latest), F.lit(0.0))
    new = lambda c: F.row_number().over(Window.partitionBy(user, c).orderBy("_at")) == 1
    later = F.col("_at") > 1
    told = rows.withColumns({
        "odd_size": later & (F.abs(F.col("_size") - mean) > 2 * dev),
        "unseen_hour": later & F.col("_hour").isNotNull() & new("_hour"),
        "unseen_type": later & (F.coalesce("_kind", F.lit("")) != "") & new("_kind"),
    })
    add = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    score = F.least(F.lit(1.0), F.round(add("unseen_hour", UNSEEN_HOUR) + add("unseen_type", UNSEEN_TYPE) + add("odd_size", ODD_SIZE), 2))
    return told.withColumn("score", score).drop("_hour", "_kind", "_size", "_at", "_x")


def reference_coverage(references: DataFrame, doc: str, now: int) -> DataFrame:
    """(doc, n, recent, venues, decades, many_old, few_venues, score) of rows with year and venue, either of which may be null.

    Years and venues are counted by partial aggregation; only the few decades of a document are listed.
    """
    year, one = F.col("year"), F.count(F.lit(1))
    known = F.count("year")
    c = references.groupBy(doc).agg(one.alias("n"), F.count_if(year >= now - 5).alias("recent"), F.count_distinct(F.nullif("venue", F.lit(""))).alias("venues"), (F.count_if(year < now - 10) > 0.5 * known).alias("many_old"))
    each = references.where(year.isNotNull()).groupBy(doc, (F.floor(year / 10) * 10).alias("decade")).agg(one.alias("k"))
    listed = each.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("decade", "k"))).alias("ds"))
    decades = F.array_join(F.transform("ds", lambda d: F.concat(d["decade"].cast("string"), F.lit("s:"), d["k"].cast("string"))), ",")
    score = 0.5 + F.when(F.col("recent") > 0.3 * F.col("n"), 0.2).otherwise(0.0) + F.when(F.col("venues") >= 3, 0.2).otherwise(0.0) + F.when(F.col("n") >= 10, 0.1).otherwise(0.0)
    return c.join(listed, doc, "left").select(doc, "n", "recent", "venues", F.coalesce(decades, F.lit("")).alias("decades"), "many_old", ((F.col("venues") < 3) & (F.col("n") > 5)).alias("few_venues"), F.round(F.least(F.lit(1.0), score), 2).alias("score"))


def abrupt(sections: Column) -> Column:
    """Array of (no, title, n_words) of sections, from the second, whose first paragraph has many words and no linking phrase."""

    def told(s: Column, i: Column) -> Column:
        first = F.coalesce(F.try_element_at(F.filter(F.split(s["content"], "\n"), lambda x: x.rlike(r"\S")), F.lit(1)), F.lit(""))
        n, low = F.regexp_count(first, F.lit(r"\S+")), F.lower(first)
        return F.struct((i + 1).cast("long").alias("no"), s["title"].alias("title"), n.cast("long").alias("n_words"), ((i > 0) & (n > LEAST_WORDS) & ~X.any_of([low.contains(w) for w in LINKS])).alias("abrupt"))

    return F.filter(F.transform(sections, told), lambda s: s["abrupt"])


def audit_lines(events: DataFrame, fields: list[str], at: str, start: Column, end: Column, framework: str | None = None) -> DataFrame:
    """(event_id, line): the events from start to end, both included, with ``fields`` as JSON lines; of one framework, if it is named.

    ``events`` has an array ``frameworks``; null is none. An export has no limit here: it is written in parallel, file by file.
    """
    rows = events.where(F.col(at).between(start, end))
    if framework:
        rows = rows.where(F.array_contains("frameworks", framework))
    shape = "yyyy-MM-dd HH:mm:ss"
    return rows.select("event_id", F.to_json(F.struct(*fields), {"timestampFormat": shape, "timestampNTZFormat": shape}).alias("line"))
