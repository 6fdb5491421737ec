"""Exact duplicates with a split for heavy hitters.

Texts are equal when they are identical after lower-casing A-Z, so each row is reduced to the SHA-256 digest of its
normalised text once, and those digests (never the texts) are what is counted and exchanged.

1. Misra-Gries: each task keeps at most ``counters`` digests with counts; the counts a digest gets over all tasks
   fall short of its true number by ``rows / (counters + 1)`` at most. So every digest with more than twice that
   share has a summed count above it, and fewer than ``counters + 1`` digests can: that bounds what is broadcast.
2. The frequent digests' rows are aggregated exactly (a row for each of them and task is exchanged), which gives
   their verified sizes and winners. These are broadcast, and the rows are decided where they lie.
3. All other digests, each of them rare, meet in an ordinary exchange.

Defined results: null texts count as empty; null keys count as smaller than all others; of rows that share the largest
key of a group one stays, whichever; repeated rows are rows of their own; an empty table gives an empty table.
Columns of any name are carried but for the text, and those named as results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evispark.llm.arrow import encoded
from evispark.llm.columns import at, by_place, named
from evispark.session import cut_lineage

#: Counters of a task's summary, and the bound of the frequent digests that are broadcast (some 60 bytes each).
COUNTERS = 1024
RESULTS = ["keep_id", "group_size", "kept", "digest"]


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text with A-Z lower-cased; null counts as empty."""

    @F.arrow_udf("binary")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([hashlib.sha256(t.lower()).digest() for t in encoded(batch)], pa.binary())

    return hashed(text)


def merged(digests: pa.Array, counts: np.ndarray, counters: int) -> tuple[pa.Array, np.ndarray]:
    """A summary of at most ``counters`` digests: all counts lose the largest one that doesn't fit."""
    summed = pa.table({"digest": digests, "count": counts}).group_by("digest").aggregate([("count", "sum")])
    digests, counts = summed["digest"].combine_chunks(), summed["count_sum"].to_numpy()
    if len(counts) > counters:
        counts = counts - np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
        digests, counts = digests.filter(pa.array(counts > 0)), counts[counts > 0]
    return digests, counts


def summaries(counters: int, kind: pa.DataType = pa.binary()):
    """Over partitions of digests: the rows seen (digest null), and the digests of a Misra-Gries summary of them."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, rows = pa.array([], kind), np.zeros(0, np.int64), 0
        for batch in batches:
            seen = pc.value_counts(batch.column("digest").cast(kind))
            rows += len(batch)
            held, counts = merged(pa.concat_arrays([held, seen.field("values")]), np.concatenate([counts, seen.field("counts").to_numpy()]), counters)
        digests = pa.concat_arrays([pa.array([None], kind), held])
        yield pa.RecordBatch.from_arrays([digests, pa.array(np.concatenate([[rows], counts]), pa.int64())], names=["digest", "count"])

    return summed


def frequent(digests: DataFrame, counters: int = COUNTERS, column: str = "digest") -> DataFrame:
    """The digests, or other keys without nulls, that may have more than ``2 * rows / (counters + 1)`` rows: all that have, and
    ``counters`` at most."""
    keys = digests.select(F.col(column).alias("digest"))
    kind = keys.schema["digest"].dataType
    counts = keys.mapInArrow(summaries(counters, to_arrow_type(kind)), f"digest {kind.simpleString()}, count bigint")
    counts = cut_lineage(counts.groupBy("digest").agg(F.sum("count").alias("count")))
    rows = counts.where("digest IS NULL").agg(F.sum("count")).first()[0] or 0
    return counts.where(F.col("digest").isNotNull() & (F.col("count") * (counters + 1) > rows)).select(F.col("digest").alias(column))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, row_): exact size and winner of each digest of rows (digest, id_, row_)."""
    held = rows.groupBy("digest").agg(F.max(F.struct("id_", "row_")).alias("w"), F.count("*").alias("group_size"))
    return held.select("digest", F.col("w.id_").alias("keep_id"), "group_size", F.col("w.row_").alias("winner_"))


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """Each row of docs without its text, with ``keep_id`` (the key of the row that stays of its group), ``group_size``,
    ``kept`` and ``digest``."""
    carried = docs.drop(F.col(f"`{text}`"))
    placed = by_place(docs).withColumn("digest", digest(at(docs, text))).drop(at(docs, text))
    placed = placed.toDF(*[f"c{k}" for k in range(len(carried.columns))], "digest")
    rows = cut_lineage(placed.withColumns({"id_": at(carried, key), "row_": F.monotonically_increasing_id()}))
    hot = cut_lineage(frequent(rows, counters))
    won = cut_lineage(winners(rows.select("digest", "id_", "row_").join(F.broadcast(hot), "digest")))
    common = rows.join(F.broadcast(won), "digest").withColumn("kept", F.col("row_") == F.col("winner_"))
    group = Window.partitionBy("digest").orderBy(F.desc_nulls_last("id_"), F.desc("row_"))
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rare = rows.join(F.broadcast(hot), "digest", "left_anti").withColumns(
        {"keep_id": F.first("id_").over(whole), "group_size": F.count("*").over(whole), "kept": F.row_number().over(group) == 1}
    )
    columns = named(carried, RESULTS)
    return common.select(*columns).unionByName(rare.select(*columns))


def unique_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows of frequent texts that go are dropped where they lie, so
    the texts of copies made a thousand times aren't exchanged; texts of rare digests are, once."""
    rows = by_place(docs).withColumns({"digest": digest(at(docs, text)), "id_": at(docs, key)})
    slim = cut_lineage(rows.select("digest", "id_").withColumn("row_", F.lit(0)))
    hot = cut_lineage(frequent(slim, counters))
    won = F.broadcast(cut_lineage(winners(slim.join(F.broadcast(hot), "digest")).select("digest", "keep_id")))
    common = rows.join(won, "digest").where(F.col("id_").eqNullSafe(F.col("keep_id"))).drop("keep_id")
    rare = rows.join(F.broadcast(hot), "digest", "left_anti")
    held = F.struct(*[f"c{k}" for k in range(len(docs.columns))])
    stays = common.unionByName(rare).groupBy("digest").agg(F.max_by(held, F.struct(F.col("id_").isNotNull(), "id_")).alias("w"))
    return stays.select(*[F.col(f"w.c{k}").alias(c) for k, c in enumerate(docs.columns)])
