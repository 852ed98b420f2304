"""Repository-style operators: lookups, filters, paging, keyed writes as transforms, versions and ordinals."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.files import scratch


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """One page in a given order. At scale prefer ``after_key``: an offset has to sort and skip all earlier rows."""
    return df.orderBy(*order).offset(skip).limit(limit)


def after_key(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The page behind the last key seen; the bound reaches the scan as a pushed filter."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(limit)


def with_total(paged: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds the number of all matches to each row of a page (one broadcast row)."""
    return paged.crossJoin(F.broadcast(matches.agg(F.count(F.lit(1)).alias("total"))))


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Optional equality, list and range filters: None is no filter, a list an IN, a pair (low, high) a range."""
    parts = []
    for name, value in wanted.items():
        if isinstance(value, list):
            parts.append(F.col(name).isin(value))
        elif isinstance(value, tuple):
            low, high = value
            parts += [F.col(name) >= F.lit(low)] if low is not None else []
            parts += [F.col(name) < F.lit(high)] if high is not None else []
        elif value is not None:
            parts.append(F.col(name) == F.lit(value))
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def compiled(df: DataFrame, filters: dict, limit: int, order: list[Column], most: int = 100) -> DataFrame:
    """Filters by the shape of their value: a list is an IN, a dict a range (gt, gte, lt, lte) or {exists}, a scalar an equality.

    A page never has more than ``most`` rows.
    """
    bounds = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
    for name, value in filters.items():
        c = F.col(name)
        if isinstance(value, list):
            df = df.where(c.isin(value))
        elif isinstance(value, dict):
            for key, bound in value.items():
                df = df.where((c.isNotNull() if bound else c.isNull()) if key == "exists" else bounds[key](c, F.lit(bound)))
        else:
            df = df.where(c == F.lit(value))
    return df.orderBy(*order).limit(min(limit, most))


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which a column contains the text, whatever the case; nulls don't match."""
    return df.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(text.lower()) for c in columns]))


def condition(value: Column, op: str, operand) -> Column:
    """A predicate of a policy; a missing value is no match."""
    tests = {
        "equals": lambda: value == F.lit(operand),
        "not_equals": lambda: value != F.lit(operand),
        "in": lambda: value.isin(operand),
        "not_in": lambda: ~value.isin(operand),
        "contains": lambda: value.contains(operand),
        "starts_with": lambda: value.startswith(operand),
        "ends_with": lambda: value.endswith(operand),
        "greater_than": lambda: value > F.lit(operand),
        "less_than": lambda: value < F.lit(operand),
        "between": lambda: value.between(*operand),
        "regex": lambda: value.rlike(f"^(?:{operand})"),
    }
    return F.coalesce(tests[op](), F.lit(False))


def wildcard(value: Column, pattern: str) -> Column:
    """Match with ``*`` at either end or alone."""
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith("*"):
        return value.startswith(pattern[:-1])
    return value.endswith(pattern[1:]) if pattern.startswith("*") else value == pattern


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Ties need a last column that is unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old``, replaced or joined by those of ``new`` (one for each key); rows without a key are dropped."""
    keyed = new.dropna(subset=keys)
    return old.join(keyed.select(*keys), keys, "left_anti").unionByName(keyed)


def versioned(df: DataFrame, key: str, order: list[str], id_: str) -> DataFrame:
    """Adds version_number, parent_id and is_current in the order of the rows of a key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({"version_number": F.row_number().over(w).cast("long"), "parent_id": F.lag(id_).over(w), "is_current": F.lead(id_).over(w).isNull()})


def newest(df: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """At most ``keep`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def shifted(df: DataFrame, ordinal: str, start: int, by: int) -> DataFrame:
    """Ordinals from ``start`` on moved by ``by``."""
    return df.withColumn(ordinal, F.when(F.col(ordinal) >= start, F.col(ordinal) + by).otherwise(F.col(ordinal)))


def duplicated(df: DataFrame, ordinal: str, at: int, to: int, title: str) -> DataFrame:
    """A copy of the rows at one ordinal is inserted at another; what follows moves on."""
    copy = df.where(F.col(ordinal) == at).withColumn(title, F.concat(title, F.lit(" (Copy)"))).withColumn(ordinal, F.lit(to).cast(df.schema[ordinal].dataType))
    return shifted(df, ordinal, to, 1).unionByName(copy)


def removed(df: DataFrame, ordinal: str, at: int) -> DataFrame:
    """Rows at an ordinal go, what follows moves up."""
    return shifted(df.where(F.col(ordinal) != at), ordinal, at + 1, -1)


def reordered(df: DataFrame, key: Column, ordinal: str, new_order: DataFrame) -> DataFrame:
    """Ordinals taken from ``new_order`` (id, position); ids that it lacks keep theirs."""
    placed = df.join(new_order.withColumnsRenamed({"id": "_id", "position": "_position"}), key == F.col("_id"), "left")
    return placed.withColumn(ordinal, F.coalesce("_position", ordinal)).drop("_id", "_position")


def zero_filled(counts: DataFrame, key: str, values: list) -> DataFrame:
    """Counts for every listed value, 0 where there is none."""
    spark = counts.sparkSession
    dim = spark.createDataFrame([(v,) for v in values], f"{key} string")
    return dim.join(counts, key, "left").na.fill(0)


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_anti")


def settled_rows(df: DataFrame) -> DataFrame:
    """The rows of one round of a loop, written to the shared folder: without the plan that made them, and safe from lost executors."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 1) in a total order, by a range sort: no task sees more than its range.

    The rows of each range are counted (as many counts as partitions) and numbered from where the ranges before end.
    """
    ranged = settled_rows(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    begins, total = [], 0
    for p, n in sizes:
        begins.append((p, total))
        total += n
    begin = df.sparkSession.createDataFrame(begins, "_p int, _begin long")
    numbered = ranged.withColumn("_p", part).join(F.broadcast(begin), "_p")
    return numbered.withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_at", "_begin")


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(child, parent) for all ancestors, with the shortest distance; cycles end as no new pair appears.

    Each round joins the newest pairs with the edges, until there are none. ``most`` is a bound on the depth for callers who
    know one: deeper edges raise, and nothing is left out.
    """
    known = newest_ = settled_rows(edges.select("child", "parent").distinct().withColumn("depth", F.lit(1)))
    step = edges.select(F.col("child").alias("parent"), F.col("parent").alias("next")).distinct()
    for depth in count(2):
        newest_ = settled_rows(newest_.join(step, "parent").select("child", F.col("next").alias("parent")).distinct().join(known.select("child", "parent"), ["child", "parent"], "left_anti").withColumn("depth", F.lit(depth)))
        if newest_.isEmpty():
            return known
        if most is not None and depth > most:
            raise ValueError(f"the edges are deeper than {most}")
        known = known.unionByName(newest_)
