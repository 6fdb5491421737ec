"""Runs over repositories: observe, measure, sample, report; seed a review; evaluate a finished one.

An observation is a store of tables (entities, relations, files) below ``<output>/<repository>/<name>``: all tables of a run
appear at once, and a run that fails leaves those of the run before. Reports are single small JSON documents.
"""

from __future__ import annotations

import datetime
import json
import logging
import os
import threading
import time
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions.keyed import upper_median
from evispark.functions.scalars import language_of
from evispark.operators import diagnostics, graph, metrics, sampling, structure, summary, syntax
from evispark.operators.metrics import Tables
from evispark.plans.config import Config, Repository
from evispark.schema import AST_NODES, FILES, MANIFESTS, SCHEMA_VERSION, UI_LANGUAGE, UNREVIEWED_SEED, conform
from evispark.session import exists, read_text, remove, write_text
from evispark.sources import store
from evispark.sources.json5 import read_manifests

log = logging.getLogger(__name__)
WIDE, NARROW, TRUTH, SAMPLE = "graph-observation", "syntax-observation", "ground-truth", "sample"
ARTEFACT_BUCKETS = 8


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def write_json(path: str, value) -> None:
    """Writes a small document wherever Spark can write; on this machine as a plain file that people may edit."""
    text = json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n"
    if "://" in path:
        write_text(SparkSession.active(), path, text)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8") as f:
        f.write(text)


def read_json(path: str):
    """None where there is no such file; a broken one raises."""
    if "://" in path:
        spark = SparkSession.active()
        return json.loads(read_text(spark, path)) if exists(spark, path) else None
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf8") as f:
        return json.load(f)


def save(tables: Tables, folder: str) -> None:
    keys = {"entities": "file_path", "relations": "file_path", "files": "path"}
    store.create({name: (getattr(tables, name), key) for name, key in keys.items()}, folder, ARTEFACT_BUCKETS)


def load(spark: SparkSession, folder: str) -> Tables:
    held = store.latest(spark, folder)
    return Tables(*[held.read(name) for name in ("entities", "relations", "files")])


def finished(spark: SparkSession, folder: str, *names: str) -> bool:
    """Whether all of these stores have been published."""
    return all(store.numbers(spark, f"{folder}/{name}") for name in names)


def selected_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of the sample that a run has drawn."""
    return store.latest(spark, f"{folder}/{SAMPLE}").read("sample").where("selected").select("path")


def source(spark: SparkSession, repo: Repository, name: str) -> DataFrame:
    return spark.read.parquet(f"{repo.path}/{name}.parquet")


def observe_graph(spark: SparkSession, repo: Repository) -> Tables:
    """The wide observation: a graph store's nodes and edges, completed, with the structure of the manifests."""
    files = conform(source(spark, repo, "files"), FILES)
    entities, relations = graph.build(source(spark, repo, "nodes"), source(spark, repo, "edges"), files.where("is_indexed"), repo.id, repo.path)
    manifests = read_manifests(conform(source(spark, repo, "manifests"), MANIFESTS))
    more = structure.structure(manifests, entities.where("kind = 'file'"), repo.id, repo.path)
    return Tables(entities.unionByName(more[0]), relations.unionByName(more[1]), files)


def observe_syntax(spark: SparkSession, repo: Repository) -> Tables:
    """The narrow observation: syntax trees of one language's files."""
    files = conform(source(spark, repo, "files"), FILES).where(language_of(F.col("path")) == UI_LANGUAGE).withColumn("is_indexed", F.col("is_candidate"))
    found = syntax.extract(conform(source(spark, repo, "ast_nodes"), AST_NODES), files.select("path", "seq"), in_order=True)
    return Tables(found.entities, found.relations, files)


class Timeout:
    """Cancels the Spark jobs started inside after a time limit."""

    def __init__(self, spark: SparkSession, seconds: float):
        self.sc, self.tag = spark.sparkContext, f"timed-{time.monotonic_ns()}"
        self.timer = threading.Timer(seconds, lambda: self.sc.cancelJobsWithTag(self.tag))

    def __enter__(self) -> None:
        self.sc.addJobTag(self.tag)
        self.timer.start()

    def __exit__(self, *_) -> None:
        self.timer.cancel()
        self.sc.removeJobTag(self.tag)


def measure_replacement(spark: SparkSession, tables: Tables, folder: str, trials: int, timeout_ms: float) -> dict:
    """Milliseconds that a stored table needs to take up a change of one file, and their upper median.

    The first indexed file grows by a line in each trial, so its entities end a line later; its evidence is replaced in
    a stored copy of the tables below folder and then restored, which isn't timed.
    """
    first = tables.files.where("is_indexed").orderBy((F.col("language") != UI_LANGUAGE), "path").select(F.col("path").alias("file_path")).limit(1).collect()
    if not first:
        raise ValueError("no indexed file to measure with")
    changed = spark.createDataFrame(first, "file_path string")
    kept = {"entities": tables.entities, "relations": tables.relations}
    store.create({name: (rows, "file_path") for name, rows in kept.items()}, folder)
    before = {name: rows.join(changed, "file_path", "left_semi").select(*rows.columns).persist() for name, rows in kept.items()}
    grown = {**before, "entities": before["entities"].withColumn("end_line", F.col("end_line") + 1)}
    put = lambda held, number: store.change(spark, folder, {name: (rows, changed) for name, rows in held.items()}, "trial", number)
    samples = []
    try:
        for trial in range(trials):
            began = time.perf_counter()
            with Timeout(spark, timeout_ms / 1000):
                put(grown, 2 * trial)
            samples.append((time.perf_counter() - began) * 1000)
            put(before, 2 * trial + 1)
    finally:
        for rows in before.values():
            rows.unpersist()
        remove(spark, folder)
    median = spark.createDataFrame([(x,) for x in samples], "ms double").agg(upper_median("ms")).first()[0]
    return {"samplesMs": samples, "medianMs": median}


def summary_of(tables: Tables) -> dict:
    pairs = lambda rows: {r[0]: r[1] for r in rows.collect()}  # noqa: E731  as many rows as kinds
    counts = summary.relation_counts(tables.relations).collect()
    languages = summary.by_language(tables.files.where("is_indexed"), tables.entities, tables.relations).collect()
    return {
        "entitiesByKind": pairs(summary.count_by(tables.entities, "kind")),
        "relationsByKind": {r["value"]: r["n"] for r in counts if r["measure"] == "kind"},
        "relationsByResolution": {r["value"]: r["n"] for r in counts if r["measure"] == "resolution"},
        "byLanguage": {r["language"]: {k: r[k] for k in ("files", "entities", "relations")} for r in languages},
    }


def lines_of(tables: Tables) -> list[str]:
    return [r["line"] for r in diagnostics.diagnostics(tables.files, tables.entities, tables.relations).orderBy("place").collect()]


def report(spark: SparkSession, repo: Repository, config: Config, wide: Tables, narrow: Tables, truth: Tables | None, status: str, scope: DataFrame | None, timing: dict, selected: list[str]) -> dict:
    figures = metrics.evaluate(wide, truth, scope).withColumn("staleness_ms", F.lit(timing["medianMs"]))
    verdicts = metrics.acceptance(figures, config.limits).select("file_coverage", "entity_recall", "edge_precision", "incremental_staleness", "no_crash")
    agreement = metrics.evaluate(narrow, wide, narrow.files.select("path"))
    return {
        "repository": vars(repo), "groundTruthStatus": status, "generatedAt": now(), "incremental": timing, "sample": selected,
        "graph": {"metrics": figures.drop("staleness_ms").first().asDict(), "acceptance": verdicts.first().asDict(), "summary": summary_of(wide), "diagnostics": lines_of(wide)},
        "syntax": {"summary": summary_of(narrow), "agreement": agreement.first().asDict(), "diagnostics": lines_of(narrow)},
    }


def reviewed(spark: SparkSession, folder: str) -> tuple[Tables | None, list[str], str]:
    """(truth or None, its sampled files, status) of a review."""
    header = read_json(f"{folder}/{TRUTH}/header.json")
    if header is None:
        return None, [], "missing"
    fits = header.get("schemaVersion") == SCHEMA_VERSION and header.get("review", {}).get("status") == "reviewed" and not any(d.startswith(UNREVIEWED_SEED) for d in header.get("diagnostics", []))
    return (load(spark, f"{folder}/{TRUTH}"), header["review"]["sampledFiles"], "reviewed") if fits else (None, [], "unreviewed")


def paths(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "path string")


def run_repository(spark: SparkSession, repo: Repository, config: Config) -> bool:
    """Everything for one repository; a failure is written down and doesn't stop the next. Returns whether it went well."""
    folder, crashed = f"{config.output}/{repo.id}", False
    log.info("[%s] %s: %s", repo.size, repo.id, repo.path)
    try:
        for name, observe in ((WIDE, observe_graph), (NARROW, observe_syntax)):
            save(observe(spark, repo), f"{folder}/{name}")
        wide, narrow = load(spark, f"{folder}/{WIDE}"), load(spark, f"{folder}/{NARROW}")
        timing = measure_replacement(spark, wide, f"{folder}/trial", config.trials, config.timeout_ms)
        write_json(f"{folder}/incremental.json", timing)
        scored = sampling.scores(wide.files.where("is_indexed"), wide.entities, wide.relations, config.seed)
        drawn = sampling.sample(scored, config.samples[repo.size])
        store.create({"sample": (drawn, "path")}, f"{folder}/{SAMPLE}", ARTEFACT_BUCKETS)
        selected = [r["path"] for r in selected_paths(spark, folder).orderBy("path").collect()]  # the report names every one
        truth, sampled, status = reviewed(spark, folder)
        status = status if status == "reviewed" else "missing-or-unreviewed"
        write_json(f"{folder}/report.json", report(spark, repo, config, wide, narrow, truth, status, paths(spark, sampled) if truth else None, timing, selected))
        remove(spark, f"{folder}/crash.json")
    except Exception as error:  # noqa: BLE001  the other repositories still run
        crashed = True
        write_json(f"{folder}/crash.json", {"repository": vars(repo), "error": {"message": str(error), "stack": traceback.format_exc()}})
        log.error("failed: %s", error)
    write_json(f"{folder}/run-status.json", {"crashed": crashed, "completedAt": now()})
    return not crashed


def init_ground_truth(spark: SparkSession, repo: Repository, config: Config) -> bool:
    """Writes the review seed of a finished run, unless there is a review already."""
    folder = f"{config.output}/{repo.id}"
    if read_json(f"{folder}/{TRUTH}/header.json") is not None:
        log.info("kept the existing review of %s", repo.id)
        return False
    if not finished(spark, folder, WIDE, SAMPLE):
        log.info("skipped %s: run it first", repo.id)
        return False
    wide, chosen = load(spark, f"{folder}/{WIDE}"), selected_paths(spark, folder)
    entities, relations = sampling.review_seed(wide.entities, wide.relations, chosen)
    save(Tables(entities, relations, wide.files.join(chosen, "path", "left_semi")), f"{folder}/{TRUTH}")
    names = [r["path"] for r in chosen.orderBy("path").collect()]
    note = f"{UNREVIEWED_SEED}: correct this sampled evidence and set review.status to reviewed."
    write_json(f"{folder}/{TRUTH}/header.json", {"schemaVersion": SCHEMA_VERSION, "repository": repo.id, "generatedAt": now(), "diagnostics": [note], "review": {"status": "unreviewed", "sampledFiles": names}})
    return True


def evaluate_existing(spark: SparkSession, repo: Repository, config: Config) -> bool:
    """Reports again from what a run has left, without observing anew. Without a review the scope is the sample."""
    folder = f"{config.output}/{repo.id}"
    timing = read_json(f"{folder}/incremental.json")
    if timing is None or not finished(spark, folder, WIDE, NARROW, SAMPLE):
        log.info("skipped %s: run it first", repo.id)
        return False
    wide, narrow = load(spark, f"{folder}/{WIDE}"), load(spark, f"{folder}/{NARROW}")
    selected = [r["path"] for r in selected_paths(spark, folder).orderBy("path").collect()]
    truth, sampled, status = reviewed(spark, folder)
    write_json(f"{folder}/report.json", report(spark, repo, config, wide, narrow, truth, status, paths(spark, sampled if truth else selected), timing, selected))
    return True
