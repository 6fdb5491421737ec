"""Counts of an observation by kind, resolution and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.keyed import first_wins


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def relation_counts(relations: DataFrame) -> DataFrame:
    """(measure, value, n): relations by kind and by resolution, from one scan."""
    held = relations.groupingSets([[F.col("kind")], [F.col("resolution")]], "kind", "resolution").agg(F.grouping("kind").alias("g"), F.count("*").alias("n"))
    by_kind = F.col("g") == 0
    return held.select(F.when(by_kind, "kind").otherwise("resolution").alias("measure"), F.when(by_kind, F.col("kind")).otherwise(F.col("resolution")).alias("value"), "n")


def by_language(files: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(language, files, entities, relations), zero where a language lacks one of them.

    A file's language is its first file entity's, 'unknown' without one; a relation's is its source's, 'none'
    without one. Where entities share an id, the one with the source's name counts, else the first. The three tables are tagged and summed together, so no outer join is needed.
    """
    file_languages = first_wins(entities.where("kind = 'file'").select(F.col("file_path").alias("path"), "language", "seq"), ["path"]).drop("seq")
    named = first_wins(entities.select("id", "qualified_name", "language", "seq"), ["id", "qualified_name"])
    held = F.sort_array(F.collect_list(F.struct("seq", "qualified_name", "language")))  # as many as names share a label
    spoken = named.groupBy("id").agg(held.alias("held"))
    same = F.filter("held", lambda h: h["qualified_name"].eqNullSafe(F.col("source_name")))
    source = F.coalesce(F.get(same, F.lit(0))["language"], F.get("held", F.lit(0))["language"], F.lit("none"))
    tagged = [
        files.select("path").join(file_languages, "path", "left").select(F.coalesce("language", F.lit("unknown")).alias("language"), F.lit("files").alias("measure")),
        entities.select("language", F.lit("entities").alias("measure")),
        relations.select(F.col("source").alias("id"), "source_name").join(spoken, "id", "left").select(source.alias("language"), F.lit("relations").alias("measure")),
    ]
    counted = [t.groupBy("language", "measure").agg(F.count("*").alias("n")) for t in tagged]
    every = counted[0].unionByName(counted[1]).unionByName(counted[2])
    total = lambda m: F.sum(F.when(F.col("measure") == m, F.col("n")).otherwise(0)).cast("long").alias(m)
    return every.groupBy("language").agg(*[total(m) for m in ("files", "entities", "relations")])
