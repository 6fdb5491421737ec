"""What a change of some files changes elsewhere: calls kept resolved, and relations to resolve anew.

A store of four tables keeps the calls of a graph resolved (strictly, as ``calls.resolve`` does):

* ``entities`` and ``calls`` by file, as the files declare them;
* ``postings`` by text: every entity that a text can mean, so that the next one is known when the first goes;
* ``resolved`` by text: the calls with their targets.

When files change, only the texts of their old and new entities can have another first candidate, and only calls of
texts whose first candidate did change, whatever file they are in, are resolved anew. Both are found in the
buckets of those texts; one aggregation tells the first entity of a text before and after. Afterwards ``resolved`` is what resolving everything would give.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators.calls import first_of, postings, resolve_by
from evispark.session import cut_lineage
from evispark.sources import store

ENTITY = ("id", "name", "qualified_name", "file_path", "seq")
CALL = ("owner", "text", "file_path", "seq")


def keep_resolved(entities: DataFrame, calls: DataFrame, folder: str, buckets: int = store.BUCKETS) -> store.Version:
    """Stores entities and calls (``calls.calls_of``) with their resolution below folder."""
    entities, calls = entities.select(*ENTITY), calls.select(*CALL)
    known = postings(entities)
    tables = {"entities": (entities, "file_path"), "calls": (calls, "file_path"), "postings": (known, "text"), "resolved": (resolve_by(calls, first_of(known)), "text")}
    return store.create(tables, folder, buckets)


def distinct_of(column: str, *tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(column) for t in tables]).distinct()


def first_where(which: Column, name: str) -> tuple[Column, Column]:
    """Aggregates of postings: the first of some of a text's entities, as calls.first_of has it, and its place; null if there is none."""
    seq = F.when(which, F.col("seq"))
    return F.min_by(F.struct("id", "qualified_name"), seq).alias(name), F.min(seq).alias(f"{name}_seq")


def replace_files(spark: SparkSession, folder: str, changed: DataFrame, entities: DataFrame, calls: DataFrame, writer: str, number: int) -> DataFrame:
    """Gives changed files (file_path) new entities and calls, none where they are gone. Returns the calls of other files
    that were resolved anew; none if the writer's change of that number was made before."""
    now = store.latest(spark, folder)
    if now.applied.get(writer, -1) >= number:
        return spark.createDataFrame([], now.schema("resolved"))
    files = cut_lineage(changed.select("file_path").distinct())
    entities, calls = (cut_lineage(t.select(*c).join(files, "file_path", "left_semi").select(*c)) for t, c in ((entities, ENTITY), (calls, CALL)))
    made, gone = cut_lineage(postings(entities)), cut_lineage(postings(now.of_keys("entities", files)))
    declared = cut_lineage(distinct_of("text", made, gone))
    called = cut_lineage(distinct_of("text", calls, now.of_keys("calls", files)))
    gone_files = files.withColumn("gone", F.lit(True))
    held = cut_lineage(now.of_keys("postings", distinct_of("text", declared, called)).join(gone_files, "file_path", "left"))
    stay, added = F.col("gone").isNull(), F.col("new")
    every = held.withColumn("new", F.lit(False)).unionByName(made.withColumns({"gone": F.lit(None).cast("boolean"), "new": F.lit(True)}))
    firsts = cut_lineage(every.groupBy("text").agg(*first_where(~added, "was"), *first_where(stay, "is")))
    moved = firsts.join(declared, "text", "left_semi").where("NOT (was <=> is AND was_seq <=> is_seq)")
    moved = cut_lineage(moved.select("text"))
    first = firsts.where("is_seq IS NOT NULL").select("text", F.col("is.id").alias("first_id"), F.col("is.qualified_name").alias("first_name"), F.col("is_seq").alias("first_seq"))
    after = every.where(stay).select(*made.columns)
    touched = distinct_of("text", moved, called)
    stays = now.of_keys("resolved", touched).join(files, "file_path", "left_anti")
    again = stays.join(moved, "text", "left_semi").select(*CALL)
    renewed = cut_lineage(resolve_by(again.withColumn("own", F.lit(False)).unionByName(calls.withColumn("own", F.lit(True))), first))
    resolved = stays.join(moved, "text", "left_anti").unionByName(renewed.drop("own"))
    rewritten = {"entities": (entities, files), "calls": (calls, files), "postings": (after, declared), "resolved": (resolved, touched)}
    store.change(spark, folder, rewritten, writer, number)
    return renewed.where("NOT own").select(*now.schema("resolved").names)


def affected_relations(relations: DataFrame, entities: DataFrame, changed: DataFrame) -> DataFrame:
    """Relations of other files that point to or from entities of changed files, and so may have to be resolved anew."""
    ids = entities.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id").distinct()
    outside = relations.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")
    hit = outside.select("kind", "source", "target", F.explode(F.array("source", "target")).alias("id")).join(ids, "id", "left_semi")
    return outside.join(hit.select("kind", "source", "target").distinct(), ["kind", "source", "target"], "left_semi").select(*relations.columns)
