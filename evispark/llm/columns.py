"""Columns of any name carried through an operator: names with dots, scratch names and names of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(docs: DataFrame, name: str) -> Column:
    """The column ``name`` of ``by_place(docs)``."""
    return F.col(f"c{docs.columns.index(name)}")


def by_place(docs: DataFrame) -> DataFrame:
    """docs with its columns named by their places, so that none clashes with what is added."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def named(docs: DataFrame, results: list[str]) -> list[Column]:
    """What to select from ``by_place(docs)`` with results added: docs' own columns but for those that results replace."""
    return [F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns) if n not in results] + [F.col(r) for r in results]
