"""Session helpers shared by the queries, the benchmark and the tests."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup that may be sent to all tasks.
FEW = 200_000
#: Bytes of a table that may be dealt out anew.
SMALL = 256 << 20
#: Rows of a few numbers that are worth a task.
TASK_ROWS = 50_000


def local_session(name: str = "evispark", cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings that results depend on (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EVISPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def show_package(spark: SparkSession) -> None:
    """Lets Python workers that aren't started from this folder import the package (a cluster has it installed)."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark resolves the path, so any store it can read works."""
    show_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as tasks can run at once, if it is ``SMALL`` and has fewer: a small file is one
    partition, whatever work its rows need. Larger tables stay as they are read, so they are never moved for this."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL
    return df.repartition(tasks) if small and df.rdd.getNumPartitions() < tasks else df


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, whose rows of a few numbers are known to be no more than these, over no more partitions than they are worth, but as
    many as tasks can run at once: each task of an exchange or a checkpoint writes files of its own, however small."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def sent(lookup: DataFrame, rows: int) -> DataFrame:
    """A lookup for a join, sent to all tasks if its rows, which are known to be no more than these, are ``FEW``."""
    return F.broadcast(lookup) if rows <= FEW else lookup


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it.

    Where it is unset, a local master (tests, a laptop) gets a fresh temporary folder for this application; on a
    cluster that would be a folder of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="evispark-checkpoint-")
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so a lost executor never forces a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def located(spark: SparkSession, path: str) -> tuple:
    """(file system, path in it) of a path wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    system, at = located(spark, path)
    system.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, at = located(spark, path)
    return system.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder wherever Spark can read; none where there is no such folder."""
    system, at = located(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small document wherever Spark can write."""
    system, at = located(spark, path)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small document."""
    system, at = located(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a file the name target, unless there is one of that name; whether it has."""
    system, at = located(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    return not system.exists(to) and system.rename(at, to)
