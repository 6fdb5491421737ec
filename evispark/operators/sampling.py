"""Deterministic stratified samples of files for review, and the review seed that belongs to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.keyed import first_wins
from evispark.functions.scalars import is_entry_path, jitter
from evispark.session import cut_lineage, sent

ALL_REASON = "all files selected"


def scores(files: DataFrame, entities: DataFrame, relations: DataFrame, seed: str) -> DataFrame:
    """(path, seq, language, score, reasons) of every file (path, seq): its size in the graph, bonuses and a jitter.

    Entities and relations are counted per file before they meet the files.
    """
    own = entities.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_entities"), F.bool_or(F.col("kind") == "component").alias("ui"))
    edges = relations.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_relations"), F.bool_or(F.col("resolution").isin("external", "unresolved")).alias("boundary"))
    spoken = first_wins(entities.where("kind = 'file'").select(F.col("file_path").alias("path"), "language", "seq"), ["path"]).drop("seq")
    held = files.select("path", "seq").join(own, "path", "left").join(edges, "path", "left").join(spoken, "path", "left")
    held = held.withColumns({"ui": F.coalesce("ui", F.lit(False)), "boundary": F.coalesce("boundary", F.lit(False)), "language": F.coalesce("language", F.lit("unknown")), "entry": is_entry_path(F.col("path"))})
    bonus = sum((F.when(F.col(c), F.lit(v)).otherwise(F.lit(0)) for c, v in (("ui", 100), ("entry", 40), ("boundary", 20))), F.lit(0))
    why = F.array_compact(F.array(F.when(F.col("ui"), "contains UI component"), F.when(F.col("entry"), "entry/service/test path"), F.when(F.col("boundary"), "boundary or unresolved relation")))
    score = F.coalesce("n_entities", F.lit(0)) + F.coalesce("n_relations", F.lit(0)) + bonus + jitter(seed, F.col("path"))
    return held.select("path", "seq", "language", score.alias("score"), F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("structural diversity"))).alias("reasons"))


def strata(scored: DataFrame, size: int) -> DataFrame:
    """(path, stratum) of each language's best file, languages in order of their first file, at most ``size``.

    Equal scores go by path in the order of the Unicode collation. One aggregation, so that a language with a third
    of all files is reduced before it moves.
    """
    order = F.struct(-F.col("score"), F.collate("path", "UNICODE"))
    best = scored.groupBy("language").agg(F.min_by("path", order).alias("path"), F.min("seq").alias("stratum"))
    return best.select("path", "stratum").orderBy("stratum").limit(size)


def sample(scored: DataFrame, size: int, files: DataFrame | None = None) -> DataFrame:
    """(path, selected, reasons) of every file; ``size`` 0 selects all, as does one that no fewer files than that exist.

    files: what was scored; counting them costs less than scoring them. Scores, a row for each file, are written once and
    then ranked by languages and as a whole.
    """
    if size == 0 or (scored if files is None else files).limit(size + 1).count() <= size:
        return scored.select("path", F.lit(True).alias("selected"), F.array(F.lit(ALL_REASON)).alias("reasons"))
    scored = cut_lineage(scored)
    first = strata(scored, size)  # no more rows than the sample
    marked = scored.join(sent(first, size), "path", "left")
    chosen = marked.orderBy(F.col("stratum").isNull(), "stratum", F.desc("score"), F.collate("path", "UNICODE")).limit(size).select("path", F.lit(True).alias("selected"))
    reasons = F.when(F.col("stratum").isNotNull(), F.concat("reasons", F.array(F.lit("language stratum")))).otherwise(F.col("reasons"))
    return marked.join(sent(chosen, size), "path", "left").select("path", F.coalesce("selected", F.lit(False)).alias("selected"), reasons.alias("reasons"))


def review_seed(entities: DataFrame, relations: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of the selected files (path), with the endpoints of those relations, marked as manual.

    An endpoint is told by id and name; where no entity of its id has that name, by its id alone. Relations and entities are
    each read once. The files and the endpoints of a sample are sent to them, so that only what belongs to the seed moves;
    those of a sample of everything are joined by exchange.
    """
    paths = cut_lineage(selected.select(F.col("path").alias("file_path")).distinct())
    edges = cut_lineage(relations.where("file_path <> ''").join(sent(paths, paths.count()), "file_path", "left_semi").select(*relations.columns))
    end = lambda side: F.struct(F.col(side).alias("id"), F.col(f"{side}_name").alias("name"))
    ends = cut_lineage(edges.select(F.explode(F.array(end("source"), end("target"))).alias("e")).groupBy("e.id").agg(F.collect_set("e.name").alias("__names")))
    marked = entities.join(sent(paths.withColumn("__own", F.lit(True)), paths.count()), "file_path", "left").join(sent(ends, ends.count()), "id", "left")
    marked = marked.withColumn("__own", F.coalesce(F.col("__own") & (F.col("file_path") != ""), F.lit(False))).where(F.col("__own") | F.col("__names").isNotNull())
    held = cut_lineage(marked.withColumn("__named", F.coalesce(F.array_contains("__names", F.col("qualified_name")), F.lit(False))))
    known = held.where("__named").select("id").distinct()
    kept = held.where("__own OR __named").unionByName(held.where("NOT __own AND NOT __named").join(known, "id", "left_anti").select(*held.columns))
    return kept.select(*entities.columns).withColumn("provenance", F.lit("manual")), edges.withColumn("provenance", F.lit("manual"))
