"""What an observation lacks: unindexed files, relations without endpoints, files without symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 10


def missing_files(files: DataFrame) -> DataFrame:
    """Candidates that weren't indexed; unlike in the coverage, case counts."""
    indexed = files.where("is_indexed").select("path")
    return files.where("is_candidate").select("path", "seq").join(indexed, "path", "left_anti")


def orphan_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations that lack an endpoint among the entities."""
    ids = entities.select("id").distinct()
    joined = relations.join(ids.select(F.col("id").alias("__s")), F.col("source") == F.col("__s"), "left").join(ids.select(F.col("id").alias("__t")), F.col("target") == F.col("__t"), "left")
    return joined.where("__s IS NULL OR __t IS NULL").select(*relations.columns)


def zero_symbol_files(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Indexed files that only a file entity, or none, stands for."""
    symbols = entities.where("kind <> 'file' AND file_path <> ''").select(F.col("file_path").alias("path"))
    return files.where("is_indexed").select("path", "seq").join(symbols, "path", "left_anti")


def first_paths(files: DataFrame, text: Column) -> DataFrame:
    """At most one row (line): the number of files, a text, and the first paths; only SHOWN paths are ever gathered."""
    shown = files.select("path").orderBy("path").limit(SHOWN).agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("paths"))
    counted = files.agg(F.count("*").alias("n"))
    joined = counted.withColumn("__one", F.lit(1)).join(shown.withColumn("__one", F.lit(1)), "__one").where("n > 0")
    return joined.select(F.concat(F.col("n").cast("string"), text, F.col("paths")).alias("line"))


def diagnostics(files: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(place, line): up to three lines, each only where it has something to tell."""
    orphans = orphan_edges(relations, entities).agg(F.count("*").alias("n")).where("n > 0")
    lines = [
        first_paths(missing_files(files), F.lit(" supported source file(s) were not indexed: ")),
        orphans.select(F.concat(F.col("n").cast("string"), F.lit(" relation(s) have missing endpoints")).alias("line")),
        first_paths(zero_symbol_files(files, entities), F.lit(" indexed source file(s) produced zero symbols: ")),
    ]
    placed = [line.select(F.lit(k).alias("place"), "line") for k, line in enumerate(lines)]
    return placed[0].unionByName(placed[1]).unionByName(placed[2])
