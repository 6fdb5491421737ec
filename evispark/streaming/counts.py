"""Counts of a graph kept current by the stream of its files' evidence, without reading the graph again.

Each file's last counts are the state of a stream processor. When new evidence of a file comes in, the processor passes
on what each count gains or loses, and those signed numbers are summed into a small stored table, once for each batch. A
file whose evidence comes without rows of its own is gone, and its counts are taken back.

Evidence is counted by file where it lies, so the processor gets a few rows of each file and not every row. Each exchange of
a state takes longer than counting a file, so files share states by a hash of their path: however many files a batch
has, states are asked for and written ``STATES`` times at most.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evispark.sources import store

#: The state store that stream processors of this kind need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVIDENCE = "file_path string, part string, kind string, resolution string, language string"
COUNTS = "measure string, value string, n bigint"
FOUND = ["file_path", "measure", "value", "n"]
#: States that files share; a running stream keeps its number.
STATES = 16_384
#: part of the evidence: what is counted of it, as (measure, column).
MEASURES = {"entity": (("entities_by_kind", "kind"), ("entities_by_language", "language")), "relation": (("relations_by_kind", "kind"), ("relations_by_resolution", "resolution"))}


def counted(rows: DataFrame) -> DataFrame:
    """(measure, value, n): the counts of evidence, read as a whole."""
    pairs = [F.when(F.col("part") == part, F.struct(F.lit(measure).alias("measure"), F.col(column).alias("value"))) for part, held in MEASURES.items() for measure, column in held]
    each = rows.select(F.explode(F.array_compact(F.array(*pairs))).alias("c"))
    return each.groupBy("c.measure", "c.value").agg(F.count("*").alias("n"))


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over evidence: the counts of each batch by file (file_path, measure, value, n); a file whose rows count for nothing
    has a row without a measure."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        of = {part: rows.filter(pc.equal(rows["part"], part)) for part in MEASURES}
        for part, held in MEASURES.items():
            for measure, column in held:
                n = of[part].group_by(["file_path", column]).aggregate([([], "count_all")])
                yield from pa.table([n["file_path"], pa.array([measure] * len(n), pa.string()), n[column], n["count_all"]], FOUND).to_batches()
        rest = rows.filter(pc.invert(pc.is_in(rows["part"], pa.array(MEASURES)))).group_by(["file_path"]).aggregate([])
        yield from pa.table([rest["file_path"], pa.nulls(len(rest), pa.string()), pa.nulls(len(rest), pa.string()), pa.array([0] * len(rest), pa.int64())], FOUND).to_batches()


class Deltas(StatefulProcessor):
    """State: the last counts of the files of one hash, as JSON: a list of a file and its (measure, value, n). A task holds those of one hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("counted", "files string")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        now: dict[str | None, Counter[tuple[str, str | None]]] = {}
        for row in rows:
            counts = now.setdefault(row["file_path"], Counter())
            if row["measure"] is not None:
                counts[row["measure"], row["value"]] += row["n"]
        last = self.last.get()
        files = {file: {(m, v): n for m, v, n in held} for file, held in json.loads(last[0])} if last else {}
        gained: Counter[tuple[str, str | None]] = Counter()
        changed = False
        for file, counts in now.items():
            before = files.pop(file, {})
            changed = changed or before != counts
            gained.update(counts)
            gained.subtract(before)
            if counts:
                files[file] = counts
        if not files and last:
            self.last.clear()
        elif changed:
            self.last.update((json.dumps([(file, [(*at, n) for at, n in counts.items()]) for file, counts in files.items()]),))
        for at, n in sorted(gained.items(), key=repr):
            if n:
                yield Row(measure=at[0], value=at[1], n=n)

    def close(self) -> None:
        pass


def deltas(stream: DataFrame) -> DataFrame:
    """(measure, value, n): what the counts gain and lose by the stream's evidence."""
    found = stream.select("file_path", "part", "kind", "resolution", "language").mapInArrow(combined, f"file_path string, {COUNTS}")
    shared = found.withColumn("state", F.pmod(F.xxhash64("file_path"), F.lit(STATES)))
    return shared.groupBy("state").transformWithState(statefulProcessor=Deltas(), outputStructType=COUNTS, outputMode="Update", timeMode="None")


def create(spark: SparkSession, folder: str) -> store.Version:
    """The stored counts of an empty graph."""
    return store.create({"counts": (spark.createDataFrame([], COUNTS), "measure")}, folder, buckets=8)


def start(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the counts below folder current."""

    def apply(batch: DataFrame, number: int) -> None:
        spark, gained = batch.sparkSession, batch.groupBy("measure", "value").agg(F.sum("n").alias("n")).persist()
        now = store.latest(spark, folder).of_keys("counts", gained)
        summed = now.unionByName(gained).groupBy("measure", "value").agg(F.sum("n").alias("n")).where("n <> 0")
        store.change(spark, folder, {"counts": (summed, gained.select("measure"))}, checkpoint, number)
        gained.unpersist()

    return deltas(stream).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).start()
