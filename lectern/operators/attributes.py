"""Dotted paths into semi-structured attributes, and the conditions of policies on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_path(context: Column, path: Column) -> Column:
    """The scalar at a dotted path (``user.profile.id``) of a VARIANT as a string; null where a step is missing or no object.

    The path is data: rows may have paths of their own. Objects and lists are returned as JSON.
    """
    steps = F.transform(F.split(path, r"\."), lambda s: F.concat(F.lit("['"), s, F.lit("']")))
    return F.try_variant_get(context, F.concat(F.lit("$"), F.array_join(steps, "")), "string")


def satisfied(context: Column, path: Column, operator: Column, value: Column) -> Column:
    """Whether the attribute at ``path`` meets a condition: exists, eq, ne, gt, lt or in (values between commas); never null."""
    got = at_path(context, path)
    number = lambda c: c.try_cast("double")
    met = (
        F.when(operator == "exists", got.isNotNull())
        .when(operator == "eq", got == value)
        .when(operator == "ne", got != value)
        .when(operator == "gt", number(got) > number(value))
        .when(operator == "lt", number(got) < number(value))
        .when(operator == "in", F.array_contains(F.split(value, ","), got))
    )
    return F.coalesce(met, F.lit(False))


def evaluated(requests: DataFrame, policies: DataFrame, on: str) -> DataFrame:
    """``requests`` (.., context variant) with each policy (policy, path, operator, value) of the same ``on``, and whether it is met."""
    return requests.join(policies, on).withColumn("met", satisfied(F.col("context"), F.col("path"), F.col("operator"), F.col("value")))
