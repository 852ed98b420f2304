"""Measures of ordered slides: flow, coherence, transitions, timing, density and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X


def adjacent(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Adds ``_next``: the column's value in the following row of the key."""
    return df.withColumn("_next", F.lead(column).over(Window.partitionBy(key).orderBy(order)))


def flow(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, pairs, flow, weak): mean transition quality of adjacent texts, and how many are below 0.4."""
    pairs = adjacent(df.select(key, order, X.tokens(X.text_of(text)).alias("tok")), key, order, "tok").where(F.col("_next").isNotNull())
    quality = X.transition_quality(F.col("tok"), F.col("_next"))
    return pairs.withColumn("q", quality).groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("q"), 4).alias("flow"), F.count_if(F.col("q") < 0.4).alias("weak"))


def seconds_of(n_words: Column, extra: Column) -> Column:
    """Base and transition time, reading speed of 130 words a minute, and what visuals take; whole seconds."""
    return F.floor(15 + n_words / 130 * 60 + extra + 3).cast("long")


def timing(df: DataFrame, key: str, seconds: str) -> DataFrame:
    """(key, slides, total, variation, outliers): sample deviation over mean, and slides beyond two deviations."""
    w = Window.partitionBy(key)
    mean, sigma = F.avg(seconds).over(w), F.stddev_samp(seconds).over(w)
    marked = df.withColumns({"_m": mean, "_s": sigma}).withColumn("_o", F.coalesce(F.abs(F.col(seconds) - F.col("_m")) > 2 * F.col("_s"), F.lit(False)))
    n = F.count(F.lit(1))
    return marked.groupBy(key).agg(n.alias("slides"), F.sum(seconds).alias("total"), F.round(F.when(n < 3, 1.0).otherwise(F.first("_s") / F.first("_m")), 4).alias("variation"), F.count_if("_o").alias("outliers"))


def thirds(df: DataFrame, key: str, order: str, seconds: str) -> DataFrame:
    """(key, pacing): 1 - variance of the means of the three thirds over the squared mean; short decks get 0.8."""
    w = Window.partitionBy(key)
    number = F.row_number().over(w.orderBy(order)) - 1
    size = F.floor(F.count(F.lit(1)).over(w) / 3)
    parts = df.withColumns({"_i": number, "_n": size}).withColumn("_t", F.when(F.col("_n") > 0, F.least(F.lit(2), F.floor(F.col("_i") / F.when(F.col("_n") > 0, F.col("_n"))))))
    means = parts.groupBy(key, "_n", "_t").agg(F.avg(seconds).alias("m"))
    score = F.greatest(F.lit(0.0), 1 - F.var_samp("m") / F.pow(F.avg("m"), F.lit(2.0)))
    return means.groupBy(key).agg(F.round(F.when(F.max("_n") < 2, 0.8).otherwise(score), 4).alias("pacing"))


def variants(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, base, variants, preferred): words of a key that are written in more than one way; ties by the alphabet."""
    used = df.select(key, F.explode(X.words(F.regexp_replace(X.text_of(text), r"[.,!?;:]", ""))).alias("v")).where(F.char_length("v") > 3)
    counts = used.groupBy(key, F.lower("v").alias("base"), "v").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))
    return counts.groupBy(key, "base").agg(F.count(F.lit(1)).alias("variants"), best.alias("b")).where("variants > 1").select(key, "base", "variants", F.col("b.v").alias("preferred"))
