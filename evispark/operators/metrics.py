"""Coverage, precision and recall of one observation against another, and acceptance of the figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.scalars import endpoint_name, key_name, ratio
from evispark.operators.structure import applying
from evispark.schema import EVALUATED_KINDS, UNREVIEWED_SEED

#: The bits of ``sides``, which marks the rows of two observations in one table; one column is less to exchange than two.
ACTUAL, TRUTH = 1, 2
ENTITY_KEYS, RELATION_KEYS = ("kind", "file", "name"), ("kind", "source", "target", "resolution")


def scoped_entities(entities: DataFrame, scope: DataFrame) -> DataFrame:
    """Entities of the evaluated kinds that a scope of files concerns."""
    return applying(entities.where(F.col("kind").isin(*EVALUATED_KINDS)), scope)


def scoped_relations(relations: DataFrame, scope: DataFrame) -> DataFrame:
    """Relations whose file is in scope, whatever its case."""
    paths = scope.select(F.lower("path").alias("__path")).distinct()
    return relations.where("file_path <> ''").withColumn("__path", F.lower("file_path")).join(paths, "__path", "left_semi").select(*relations.columns)


def entity_keys(entities: DataFrame, *others: str) -> DataFrame:
    """The columns that make entities equal across observations, and others. Overloads of a file are one key."""
    return entities.select("kind", F.lower("file_path").alias("file"), key_name(F.col("name")).alias("name"), *others)


def relation_keys(relations: DataFrame, *others: str) -> DataFrame:
    """The columns that make relations equal, and others; the file isn't among the keys."""
    return relations.select("kind", endpoint_name(F.col("source_name")).alias("source"), endpoint_name(F.col("target_name")).alias("target"), "resolution", *others)


def sides(actual: Column, truth: Column) -> Column:
    """The bits of a row, from whether it is the actual side's and the truth's; null counts as not."""
    return (F.when(actual, ACTUAL).otherwise(0) + F.when(truth, TRUTH).otherwise(0)).cast("tinyint")


def has(side: int) -> Column:
    return F.col("sides").bitwiseAND(F.lit(side).cast("tinyint")) != 0


def entity_sides(entities: DataFrame, scope: DataFrame) -> DataFrame:
    """The keys of both sides' entities that a scope concerns, with their sides."""
    return entity_keys(scoped_entities(entities.where("sides > 0"), scope), "sides")


def relation_sides(relations: DataFrame, scope: DataFrame) -> DataFrame:
    """The keys of both sides' relations in scope, with their sides. Keys are made first: they are shorter than the names that would meet the scope."""
    return scoped_relations(relation_keys(relations.where("sides > 0"), "file_path", "sides"), scope).drop("file_path")


def overlap(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: n_rows of the actual side, n_actual, n_truth, n_both distinct keys, with precision and recall; one aggregation over both sides."""
    held = rows.groupBy(*keys).agg(F.count_if(has(ACTUAL)).alias("n"), F.bit_or("sides").alias("sides"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = held.agg(total(F.col("n")).alias("n_rows"), F.count_if(has(ACTUAL)).alias("n_actual"), F.count_if(has(TRUTH)).alias("n_truth"), F.count_if(F.col("sides") == ACTUAL + TRUTH).alias("n_both"))
    return counts.withColumns({"precision": ratio(F.col("n_both"), F.col("n_actual")), "recall": ratio(F.col("n_both"), F.col("n_truth"))})


def coverage(files: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """One row: candidate_files, indexed_files, both and file_coverage over files (path, is_candidate, is_indexed), whatever their case.

    No candidates at all count as full coverage.
    """
    held = files.withColumn("path", F.lower("path"))
    if scope is not None:
        held = held.join(scope.select(F.lower("path").alias("path")).distinct(), "path", "left_semi")
    each = held.groupBy("path").agg(F.max(F.col("is_candidate").cast("int")).alias("c"), F.max(F.col("is_indexed").cast("int")).alias("i"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = each.agg(total(F.col("c")).alias("candidate_files"), total(F.col("i")).alias("indexed_files"), total(F.col("c") * F.col("i")).alias("covered_files"))
    return counts.withColumn("file_coverage", F.coalesce(ratio(F.col("covered_files"), F.col("candidate_files")), F.lit(1.0)))


@dataclass(frozen=True)
class Tables:
    """An observation's tables."""

    entities: DataFrame
    relations: DataFrame
    files: DataFrame


def paired(actual: Tables, truth: Tables) -> Tables:
    """Two observations in one set of tables, their rows marked by ``sides``; the files are the actual observation's."""
    mark = lambda rows, side: rows.withColumn("sides", F.lit(side).cast("tinyint"))
    both = lambda a, t: mark(a, ACTUAL).unionByName(mark(t, TRUTH))
    return Tables(both(actual.entities, truth.entities), both(actual.relations, truth.relations), actual.files)


def evaluate(actual: Tables, truth: Tables | None, scope: DataFrame | None = None) -> DataFrame:
    """One row of figures. Without a (reviewed) truth the four ratios are null; coverage and counts are given always.

    The scope is the given files, else all candidates of the actual observation.
    """
    if truth is not None:
        return agreement(paired(actual, truth), scope)
    scope = scope if scope is not None else actual.files.where("is_candidate").select("path")
    nothing = F.lit(None).cast("double")
    parts = [coverage(actual.files, scope).select("file_coverage", "candidate_files", "indexed_files", *[nothing.alias(c) for c in ("entity_recall", "entity_precision", "edge_recall", "edge_precision")])]
    parts += [scoped_entities(actual.entities, scope).agg(F.count("*").alias("entities")), scoped_relations(actual.relations, scope).agg(F.count("*").alias("relations"))]
    return beside(parts)


def agreement(both: Tables, scope: DataFrame | None = None) -> DataFrame:
    """evaluate's figures of two observations that share tables, whose rows ``sides`` marks: each row is read, joined and counted once for both."""
    scope = scope if scope is not None else both.files.where("is_candidate").select("path")
    entities, relations = overlap(entity_sides(both.entities, scope), ENTITY_KEYS), overlap(relation_sides(both.relations, scope), RELATION_KEYS)
    figures = lambda part, rows, name: part.select(F.col("n_rows").alias(rows), F.col("recall").alias(f"{name}_recall"), F.col("precision").alias(f"{name}_precision"))
    out = beside([coverage(both.files, scope).select("file_coverage", "candidate_files", "indexed_files"), figures(entities, "entities", "entity"), figures(relations, "relations", "edge")])
    return out.select("file_coverage", "candidate_files", "indexed_files", "entities", "relations", "entity_recall", "entity_precision", "edge_recall", "edge_precision")


def beside(parts: list[DataFrame]) -> DataFrame:
    """Single rows as one."""
    out = parts[0].withColumn("__one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def is_reviewed(header: DataFrame) -> Column:
    """Whether an observation may serve as truth: current version, reviewed, and no mark of an unreviewed seed."""
    seed = F.exists(F.coalesce("diagnostics", F.array().cast("array<string>")), lambda d: F.startswith(d, F.lit(UNREVIEWED_SEED)))
    return F.coalesce((F.col("schema_version") == 2) & (F.col("review.status") == "reviewed") & ~seed, F.lit(False))


@dataclass(frozen=True)
class Limits:
    """Least coverage, entity recall and edge precision, and longest staleness in milliseconds."""

    file_coverage: float = 0.95
    entity_recall: float = 0.85
    edge_precision: float = 0.90
    staleness_ms: float = 5000.0


def acceptance(figures: DataFrame, limits: Limits = Limits(), staleness: str = "staleness_ms", crashed: str | None = None) -> DataFrame:
    """Verdicts 'pass', 'fail' or 'not-evaluated' on rows of figures; an unmeasured staleness fails."""
    graded = lambda ok: F.when(ok, "pass").otherwise("fail")
    at_least = lambda c, least: F.when(F.col(c).isNull(), "not-evaluated").otherwise(graded(F.col(c) >= least))
    return figures.select(
        *[c for c in figures.columns if c not in (staleness, crashed, "file_coverage", "entity_recall", "edge_precision")],
        graded(F.col("file_coverage") >= limits.file_coverage).alias("file_coverage"),
        at_least("entity_recall", limits.entity_recall).alias("entity_recall"),
        at_least("edge_precision", limits.edge_precision).alias("edge_precision"),
        graded(F.coalesce(F.col(staleness) <= limits.staleness_ms, F.lit(False))).alias("incremental_staleness"),
        graded(~F.col(crashed) if crashed else F.lit(True)).alias("no_crash"),
    )
