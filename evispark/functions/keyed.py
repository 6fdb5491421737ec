"""Keyed order: first and last rows of a key, and the expansions that turn prefix and suffix tests into equalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row per key: the values of its last row at the place of its first, as an insertion-ordered map keeps them."""
    values = F.struct(*[c for c in rows.columns if c not in keys])
    held = rows.groupBy(*keys).agg(F.max_by(values, order).alias("v"), F.min(order).alias("place"))
    return held.select(*[F.col("place").alias(c) if c == order else F.col(c) if c in keys else F.col(f"v.{c}").alias(c) for c in rows.columns])


def first_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row per key: its first."""
    values = F.struct(*[c for c in rows.columns if c not in keys])
    held = rows.groupBy(*keys).agg(F.min_by(values, order).alias("v"))
    return held.select(*[F.col(c) if c in keys else F.col(f"v.{c}").alias(c) for c in rows.columns])


def first_value(value: str, order: str = "seq") -> Column:
    """Aggregate: the value of a group's first row."""
    return F.min_by(value, order)


def upper_median(value: str) -> Column:
    """Aggregate: the middle value, the upper of the two where the count is even; null for no rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def ancestors(path: Column) -> Column:
    """All roots that hold a path: '', each folder above it, and itself."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), above))


def strict_ancestors(path: Column) -> Column:
    """As ancestors, without the path itself."""
    return F.array_except(ancestors(path), F.array(path))


def dot_suffixes(qualified: Column) -> Column:
    """Every part of a qualified name that stands behind a dot."""
    parts = F.split(qualified, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda k: F.array_join(F.slice(parts, k, n), "."))).otherwise(F.array().cast("array<string>"))
