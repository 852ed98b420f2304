"""Registries for extensions: scorers with weights, processors by document type, and named functions for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Scorers:
    """Weighted scorers; each makes a column from 0 to 1, and the overall score is their weighted mean."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable[[], Column], float]] = {}

    def register(self, name: str, scorer: Callable[[], Column], weight: float = 1.0) -> None:
        self.known[name] = (scorer, weight)

    def apply(self, df: DataFrame) -> DataFrame:
        scored = df.withColumns({name: scorer() for name, (scorer, _) in self.known.items()})
        total = sum(w for _, w in self.known.values())
        return scored.withColumn("overall", sum((F.col(n) * w for n, (_, w) in self.known.items()), F.lit(0.0)) / total)


class Extensions:
    """Named transforms of tables with the names of those they need first."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {}

    def register(self, name: str, transform: Callable[[DataFrame], DataFrame], needs: list[str] | None = None) -> None:
        missing = [n for n in needs or [] if n not in self.known]
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        self.known[name] = (transform, needs or [])

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        transform, needs = self.known[name]
        for n in needs:
            df = self.apply(df, n)
        return df.transform(transform)


class Processors:
    """A transform for each document type; rows of other types pass as they are."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, kind: str, transform: Callable[[DataFrame], DataFrame]) -> None:
        self.known[kind] = transform

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        out = df.where(~F.col(column).isin(list(self.known)) | F.col(column).isNull()) if self.known else df
        for kind, transform in self.known.items():
            out = out.unionByName(transform(df.where(F.col(column) == kind)), allowMissingColumns=True)
        return out


def register_functions(spark: SparkSession) -> list[str]:
    """SQL functions of the library (SQL-bodied, so that the optimiser sees through them)."""
    made = {
        "lectern_words": "(t STRING) RETURNS BIGINT RETURN cast(size(filter(split(t, '[ \t\n\r]+'), w -> w <> '')) as bigint)",
        "lectern_tokens_estimate": "(t STRING) RETURNS BIGINT RETURN cast(floor(char_length(t) / 4) as bigint)",
        "lectern_clamp": "(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN greatest(low, least(high, x))",
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(made)
