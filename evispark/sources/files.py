"""Listing of source files by all tasks, and the filters of the scans."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions.scalars import basename, language_of
from evispark.operators.structure import MANIFESTS
from evispark.session import cut_lineage, show_package

#: Entries of a folder that are passed on at once.
ENTRIES = 10_000
# Folders that the scans pass over.
IGNORED = ("node_modules", "oh_modules", "build", ".git", "dist", "target", "vendor", ".hvigor", ".idea", ".codegraph")
IGNORED_BY_MANIFESTS = ("node_modules", "oh_modules", "build", ".git")


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """(file system, folder in it) of a local path or of the address of a store."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def entries(root: str):
    """Over folders (path, relative to root): what each holds directly, (path, is_folder). Links to folders are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                infos = system.get_file_info(fs.FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/") or "/"))
                held = [(f"{folder}/{i.base_name}".lstrip("/"), i.type == fs.FileType.Directory) for i in infos if not (local and i.type == fs.FileType.Directory and os.path.islink(i.path))]
                for a in range(0, len(held), ENTRIES):
                    paths, folders = zip(*held[a : a + ENTRIES])
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], names=["path", "is_folder"])

    return run


def paths_below(spark: SparkSession, root: str) -> DataFrame:
    """(path): all files below a folder that all executors can see, local or of a store, dotfiles included, but for those in
    folders that every scan passes over.

    Folders are listed a level at a time, and the folders found are dealt out to all tasks anew, so one deep tree is listed
    by many tasks. Folders and files go through the shared checkpoint folder and never through the driver.
    """
    show_package(spark)
    level, files = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = cut_lineage(level.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(entries(root), "path string, is_folder boolean"))
        files.append(listed.where("NOT is_folder").select("path"))
        level = listed.where(F.col("is_folder") & ~basename(F.col("path")).isin(*IGNORED_BY_MANIFESTS)).select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, files)


def supported_files(paths: DataFrame, language: str | None = None) -> DataFrame:
    """(path, language) of the files whose language is known, or is the given one, outside the ignored folders, by path."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    inside = F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED)))
    named = paths.where(~F.coalesce(inside, F.lit(False))).select("path", language_of(F.col("path")).alias("language"))
    wanted = F.col("language") == language if language else F.col("language") != "unknown"
    return named.where(wanted).orderBy("path")


def manifest_files(paths: DataFrame) -> DataFrame:
    """The manifests among paths, by path: dot-folders and dotfiles are left out, fewer folders are ignored."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*IGNORED_BY_MANIFESTS))
    return paths.where(basename(F.col("path")).isin(*MANIFESTS) & ~hidden).select("path").orderBy("path")
