"""Evidence kept current by a stream of changed files.

The stream holds the new evidence of files, and a row of nulls but for the file where one is gone. Each batch
replaces the rows of the files it names and publishes them as one version of the store, so readers see the store before a
batch or after it. A batch that is run again is known by its number and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evispark.operators.incremental import CALL, ENTITY, replace_files
from evispark.sources import store


def applied(stream: DataFrame, checkpoint: str, change: Callable[[DataFrame, int], None]) -> StreamingQuery:
    def apply(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        change(held, number)
        held.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def start(stream: DataFrame, folder: str, checkpoint: str, name: str = "rows", key: str = "file_path", present: str = "id") -> StreamingQuery:
    """Applies a stream to a table of a store. Rows with a null ``present`` only remove."""

    def change(batch: DataFrame, number: int) -> None:
        store.change(batch.sparkSession, folder, {name: (batch.where(F.col(present).isNotNull()), batch.select(key))}, checkpoint, number)

    return applied(stream, checkpoint, change)


def start_calls(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the store of ``incremental.keep_resolved`` current. Rows with an ``id`` are entities, rows with an ``owner`` are
    calls, and rows with neither only name a file."""

    def change(batch: DataFrame, number: int) -> None:
        entities, calls = batch.where("id IS NOT NULL").select(*ENTITY), batch.where("owner IS NOT NULL").select(*CALL)
        replace_files(batch.sparkSession, folder, batch.select("file_path"), entities, calls, checkpoint, number)

    return applied(stream, checkpoint, change)
