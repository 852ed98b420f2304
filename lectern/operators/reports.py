"""Reports over scored items, suggestions, fuzzy search, priority queues and small keyed joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.layout import dependency_levels
from lectern.operators.relational import settled_rows


def dimension_report(df: DataFrame, keys: list[str], dimensions: list[str]) -> DataFrame:
    """(keys, dimension, mean, low, high, n): one pass over wide scores, made long after the aggregate."""
    parts = [F.struct(F.lit(d).alias("dimension"), F.avg(d).alias("mean"), F.min(d).alias("low"), F.max(d).alias("high"), F.count(d).alias("n")) for d in dimensions]
    return df.groupBy(*keys).agg(F.array(*parts).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")


def trend(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, latest, previous, direction) of the last two values of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    two = df.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    pair = two.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("_n") == 2, F.col(value))).alias("previous"))
    change = F.col("latest") - F.col("previous")
    return pair.withColumn("direction", F.when(F.col("previous").isNull(), "new").when(change > 0, "up").when(change < 0, "down").otherwise("same"))


def suggestions(df: DataFrame, column: str, start: str, limit: int) -> DataFrame:
    """Distinct values that start with or contain the text: those that start with it first, then by the alphabet."""
    low = F.lower(F.col(column))
    found = df.where(low.contains(start.lower())).select(F.col(column).alias("value"), (~low.startswith(start.lower())).alias("inner")).distinct()
    return found.orderBy("inner", "value").limit(limit)


def fuzzy(df: DataFrame, column: str, term: str) -> DataFrame:
    """Rows with a token within the edit distance that the term's length allows (0 to two letters, 1 to five, else 2)."""
    most = 0 if len(term) < 3 else 1 if len(term) < 6 else 2
    near = F.filter(X.tokens(X.text_of(column)), lambda w: F.levenshtein(w, F.lit(term)) <= most)
    return df.withColumn("hits", F.size(near).cast("long")).where("hits > 0")


def weighted_rank(fields: dict[str, float], term: str) -> Column:
    """Largest of the fields' term frequencies by their weights."""
    tf = [w * F.size(F.filter(X.tokens(X.text_of(c)), lambda t: t == term)) for c, w in fields.items()]
    return F.greatest(*tf) if len(tf) > 1 else tf[0]


def next_in_queue(df: DataFrame, priority: str, ranks: list[str], enqueued: list[str], limit: int = 1) -> DataFrame:
    """The first tasks by rank of their priority, first in first out within it."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(priority))
    return df.orderBy(rank, *enqueued).limit(limit)


def after_heading(elements: DataFrame, key: str, order: str, is_heading: Column, ends: Column) -> DataFrame:
    """Elements after a heading of a kind, up to the next heading that ends it."""
    w = Window.partitionBy(key).orderBy(order)
    state = F.when(is_heading, 1).when(ends, 0)
    inside = F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return elements.withColumn("_in", inside).where((F.col("_in") == 1) & ~is_heading & ~ends).drop("_in")


def expand_includes(files: DataFrame) -> DataFrame:
    """(path, text) with each \\input{x} or \\include{x} replaced by that file's text, until nothing changes.

    Unknown names stay as they are, and so do names of files that lie on a cycle or lead to one, which would never end.
    """
    pattern = r"\\(?:input|include)\{([^}]*)\}"
    named = files.select(F.col("path").alias("task"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("needs"))
    edges = settled_rows(named.join(files.select(F.col("path").alias("needs")), "needs", "left_semi").select("task", "needs"))
    levels = dependency_levels(files.select(F.col("path").alias("task")), edges)
    # each file is put together once everything that it includes is; so every round settles one level
    out = settled_rows(files.select("path", "text"))
    for level in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        now = levels.where(F.col("level") == level).select("task")
        parts = edges.join(now, "task", "left_semi").select(F.col("task").alias("child"), F.col("needs").alias("_p")).join(out.select(F.col("path").alias("_p"), F.col("text").alias("_t")), "_p")
        listed = parts.groupBy("child").agg(F.collect_list(F.struct("_p", "_t")).alias("parts"))
        put = lambda t, x: F.replace(F.replace(t, F.concat(F.lit("\\input{"), x["_p"], F.lit("}")), x["_t"]), F.concat(F.lit("\\include{"), x["_p"], F.lit("}")), x["_t"])
        joined = out.join(listed, F.col("path") == F.col("child"), "left")
        out = settled_rows(joined.select("path", F.when(F.col("parts").isNotNull(), F.aggregate("parts", F.col("text"), put)).otherwise(F.col("text")).alias("text")))
    return out


def overlapping(a: Column, b: Column) -> Column:
    """Whether two boxes (x0, y0, x1, y1, page) share a point."""
    return (a["page"] == b["page"]) & (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def near_text(text: Column, a: Column, b: Column, reach: int = 250) -> Column:
    """Whether b stands within ``reach`` characters of the first a, whatever the case."""
    at = F.instr(F.lower(text), F.lower(a))
    begin = F.greatest(F.lit(1), at - reach)
    return (at > 0) & F.contains(F.lower(F.substring(text, begin, at + F.length(a) + reach - begin)), F.lower(b))
