"""Stored tables that change by buckets and are read in versions.

A store holds one or more tables, each in buckets of its key's hash. A change writes new files for the buckets that it
touches, of all tables, and then publishes a version: a small document that names the files of every bucket. It is
written aside and renamed, so a reader sees the whole of one version or of another, and a change that was interrupted
has changed nothing; its files are removed by the next. Versions older than the ``keep`` latest are removed with all
files that no other names, so a reader may be behind by as many changes.

One writer at a time. A writer numbers its changes: one that is already in the latest version isn't made again.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evispark.session import listed, read_text, remove, renamed, write_text

#: Buckets of a stored table, and files that a bucket's rows are dealt out to, so that a hot key isn't one task.
BUCKETS, FILES, KEEP = 256, 8, 2
BUCKET = "__bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Version:
    """What the store's tables hold at one time. tables: by name the key, the number of buckets, the schema, and each
    bucket's folder; applied: each writer's last change."""

    spark: SparkSession
    folder: str
    number: int
    applied: dict[str, int]
    tables: dict[str, dict]

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.tables[name]["schema"])

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or the rows of some of its buckets."""
        held = self.tables[name]["buckets"]
        paths = [f"{self.folder}/{held[b]}" for b in (held if buckets is None else map(str, buckets)) if b in held]
        return self.spark.read.schema(self.schema(name)).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema(name))

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of keys, which has the key's column."""
        of = self.tables[name]
        return [r[0] for r in keys.select(bucket_of(of["key"], of["n"]).alias(BUCKET)).distinct().collect()]  # as many as buckets at most

    def of_keys(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys, read from their buckets only."""
        key = self.tables[name]["key"]
        return self.read(name, self.touched(name, keys)).join(keys.select(key).distinct(), key, "left_semi").select(*self.schema(name).names)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with their bucket, at most ``FILES`` tasks to a bucket. Columns of maps have no hash and aren't allowed."""
    return rows.repartition(BUCKET, F.pmod(F.xxhash64(*[c for c in rows.columns if c != BUCKET]), F.lit(FILES)))


def write_buckets(rows: DataFrame, folder: str, at: str, key: str, buckets: int) -> dict[str, str]:
    """Writes rows below folder/at; the folder of each bucket that has any."""
    dealt(rows.withColumn(BUCKET, bucket_of(key, buckets))).write.partitionBy(BUCKET).parquet(f"{folder}/{at}")
    names = (re.fullmatch(rf"{BUCKET}=(\d+)", n) for n in listed(rows.sparkSession, f"{folder}/{at}"))
    return {m[1]: f"{at}/{m[0]}" for m in names if m}


def numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(m[1]) for n in listed(spark, f"{folder}/versions") if (m := re.fullmatch(r"(\d+)\.json", n)))


def version(spark: SparkSession, folder: str, number: int) -> Version:
    return Version(spark, folder, number, **json.loads(read_text(spark, f"{folder}/versions/{number:010d}.json")))


def latest(spark: SparkSession, folder: str) -> Version:
    return version(spark, folder, numbers(spark, folder)[-1])


def publish(made: Version) -> None:
    """Makes a version the latest; fails if another writer has published one of its number."""
    aside = f"{made.folder}/versions/.{uuid.uuid4()}"
    write_text(made.spark, aside, json.dumps({"applied": made.applied, "tables": made.tables}))
    if not renamed(made.spark, aside, f"{made.folder}/versions/{made.number:010d}.json"):
        raise RuntimeError(f"version {made.number} of {made.folder} was published by another writer")


def clean(spark: SparkSession, folder: str, keep: int = KEEP) -> None:
    """Removes all but the latest versions, and the files that none of those names."""
    every = numbers(spark, folder)
    named = lambda some: {path for n in some for t in version(spark, folder, n).tables.values() for path in t["buckets"].values()}
    held = named(every[-keep:])
    for path in named(every[:-keep]) - held:
        remove(spark, f"{folder}/{path}")
    for n in every[:-keep]:
        remove(spark, f"{folder}/versions/{n:010d}.json")
    for run in set(listed(spark, f"{folder}/data")) - {path.split("/")[1] for path in held}:
        remove(spark, f"{folder}/data/{run}")


def create(tables: dict[str, tuple[DataFrame, str]], folder: str, buckets: int = BUCKETS) -> Version:
    """Stores tables (rows, key) below folder as one version. What the store held before is read until it is published."""
    spark, run, made = next(iter(tables.values()))[0].sparkSession, f"data/{uuid.uuid4()}", {}
    for name, (rows, key) in tables.items():
        made[name] = {"key": key, "n": buckets, "schema": rows.schema.jsonValue(), "buckets": write_buckets(rows, folder, f"{run}/{name}", key, buckets)}
    publish(first := Version(spark, folder, (numbers(spark, folder) or [-1])[-1] + 1, {}, made))
    clean(spark, folder)
    return first


def replace_rows(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Old rows but those of changed keys, and the new rows of changed keys. A changed key without new rows is gone."""
    keys = changed.select(key).distinct()
    return old.join(keys, key, "left_anti").select(*old.columns).unionByName(new.join(keys, key, "left_semi").select(*old.columns))


def change(spark: SparkSession, folder: str, changes: dict[str, tuple[DataFrame, DataFrame]], writer: str, number: int, keep: int = KEEP) -> Version:
    """Replaces, in one step, the rows of changed keys of each named table (new rows, changed keys)."""
    now = latest(spark, folder)
    if now.applied.get(writer, -1) >= number:
        return now
    run, tables = f"data/{uuid.uuid4()}", dict(now.tables)
    for name, (new, changed) in changes.items():
        of, touched = now.tables[name], now.touched(name, changed)
        made = replace_rows(now.read(name, touched), new, changed, of["key"])
        written = write_buckets(made, folder, f"{run}/{name}", of["key"], of["n"])
        tables[name] = of | {"buckets": {b: at for b, at in of["buckets"].items() if int(b) not in touched} | written}
    publish(made := Version(spark, folder, now.number + 1, now.applied | {writer: number}, tables))
    clean(spark, folder, keep)
    return made
