"""Observation of a graph: entities from nodes, completed endpoints and files, relations from edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.keyed import first_wins, last_wins
from evispark.functions.scalars import basename, labels, normalize_path, relation_id, stable_id
from evispark.schema import ENTITIES, METADATA, RELATIONS, UI_DECORATORS, UI_LANGUAGE, conform
from evispark.session import cut_lineage

SYNTHETIC = "synthetic"


def entity_kind(kind: Column, language: Column, decorators: Column) -> Column:
    """'component' for a struct or class of the UI language with a UI decorator, else the node's own kind."""
    marked = F.exists(F.coalesce(decorators, F.array().cast("array<string>")), lambda d: F.regexp_replace(d, "^@", "").isin(*UI_DECORATORS))
    return F.when((language == UI_LANGUAGE) & kind.isin("struct", "class") & F.coalesce(marked, F.lit(False)), "component").otherwise(kind)


def project_nodes(nodes: DataFrame, provenance: str) -> DataFrame:
    """Entities from nodes (id, kind, name, qualified_name, file_path, language, lines, decorators, signature, visibility, is_exported, seq)."""
    have = lambda c, kind: F.col(c) if c in nodes.columns else F.lit(None).cast(kind)
    facts = [have("signature", "string"), have("visibility", "string"), have("is_exported", "boolean")]
    metadata = F.when(F.coalesce(*[f.cast("string") for f in facts]).isNotNull(), F.struct(*facts, *[F.lit(None).cast("string")] * 3).cast(METADATA))
    shaped = nodes.withColumns(
        {
            "native_kind": F.col("kind"),
            "kind": entity_kind(F.col("kind"), F.col("language"), have("decorators", "array<string>")),
            "file_path": normalize_path(F.col("file_path")),
            "metadata": metadata,
            "provenance": F.lit(provenance),
        }
    )
    return conform(shaped, ENTITIES)


def repository_entity(entities: DataFrame, repository: str, path: str) -> DataFrame:
    """The one entity that stands for the whole repository, before all others."""
    spark = entities.sparkSession
    row = spark.range(0, 1, 1, 1).select(
        F.concat(F.lit("repository:"), stable_id(F.lit(path))).alias("id"), F.lit("repository").alias("kind"), F.lit(repository).alias("name"), F.lit(repository).alias("qualified_name"),
        F.lit("").alias("file_path"), F.lit("mixed").alias("language"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(SYNTHETIC).alias("provenance"), F.lit(-1).alias("seq"),
    )
    return conform(row, ENTITIES)


def complete_files(entities: DataFrame, files: DataFrame) -> DataFrame:
    """File entities for those files (path, language, seq) that no file entity stands for."""
    known = entities.where("kind = 'file'").select(F.col("file_path").alias("path"))
    missing = first_wins(files.select(normalize_path(F.col("path")).alias("path"), "language", "seq"), ["path"]).join(known, "path", "left_anti")
    shaped = missing.select(
        F.concat(F.lit("file:"), stable_id(F.col("path"))).alias("id"), F.lit("file").alias("kind"), basename(F.col("path")).alias("name"), F.col("path").alias("qualified_name"),
        F.col("path").alias("file_path"), "language", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(SYNTHETIC).alias("provenance"), "seq",
    )
    return conform(shaped, ENTITIES)


def complete_endpoints(entities: DataFrame, edges: DataFrame, ends: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """External symbols for the endpoints of edges (source, target, seq) that are no entities."""
    each = F.explode(F.array(*ends)) if len(ends) > 1 else F.col(ends[0])
    ends = edges.select(each.alias("id"), "seq").groupBy("id").agg(F.min("seq").alias("seq"))
    missing = ends.where("id IS NOT NULL").join(entities.select("id"), "id", "left_anti")
    shaped = missing.select(
        "id", F.lit("external_symbol").alias("kind"), F.col("id").alias("name"), F.col("id").alias("qualified_name"), F.lit("").alias("file_path"),
        F.lit("none").alias("language"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(SYNTHETIC).alias("provenance"), "seq",
    )
    return conform(shaped, ENTITIES)


def visited_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that start at a node; others are never met when nodes are walked."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi")


def project_edges(edges: DataFrame, entities: DataFrame, provenance: str) -> DataFrame:
    """Relations from edges (kind, source, target, seq) whose endpoints are all entities; a target without a file is external."""
    source = entities.select(F.col("id").alias("source"), F.col("qualified_name").alias("source_name"), F.nullif(F.col("file_path"), F.lit("")).alias("file_path"))
    target = entities.select(F.col("id").alias("target"), F.col("qualified_name").alias("target_name"), F.col("file_path").alias("target_file"))
    joined = edges.select("kind", "source", "target", "seq").join(source, "source").join(target, "target")
    resolution = F.when(F.coalesce("target_file", F.lit("")) == "", "external").otherwise("internal")
    shaped = joined.withColumns({"id": relation_id(F.col("kind"), F.col("source"), F.col("target")), "resolution": resolution, "provenance": F.lit(provenance)})
    return conform(shaped, RELATIONS)


def project_visited(edges: DataFrame, entities: DataFrame, provenance: str) -> DataFrame:
    """As project_edges behind complete_endpoints and with one row for each key of a relation, for edges that start at entities.

    What completes a target follows from the target, so completed ones needn't be made first. Edges are made
    distinct before names are met, and entities are one row for each id and name.
    """
    named = entities.select("id", "qualified_name", "file_path").repartition("id").groupBy("id", "qualified_name").agg(F.min("file_path").alias("file_path"))
    source, target = named.toDF("source", "source_name", "source_file"), named.toDF("target_id", "target_name", "target_file")
    once = edges.where("target IS NOT NULL").groupBy("kind", "source", "target").agg(F.min("seq").alias("seq"))
    joined = once.join(source, "source").join(target, F.col("target") == F.col("target_id"), "left")
    shaped = joined.select(
        "kind", "source", "target", "source_name", F.when(F.col("target_id").isNull(), F.col("target")).otherwise(F.col("target_name")).alias("target_name"), F.nullif(F.col("source_file"), F.lit("")).alias("file_path"),
        F.when(F.coalesce("target_file", F.lit("")) == "", "external").otherwise("internal").alias("resolution"), F.lit(provenance).alias("provenance"), "seq",
    )
    return conform(shaped, RELATIONS)


def contain_files(entities: DataFrame, repository: str, path: str) -> DataFrame:
    """The repository contains every file entity."""
    files = entities.where("kind = 'file'").select(F.col("id").alias("target"), F.col("qualified_name").alias("target_name"), "file_path", "seq")
    source = {"source": F.concat(F.lit("repository:"), stable_id(F.lit(path))), "source_name": F.lit(repository)}
    shaped = files.withColumns({**source, "kind": F.lit("contains"), "resolution": F.lit("internal"), "provenance": F.lit(SYNTHETIC)})
    return conform(shaped.withColumn("id", relation_id(F.col("kind"), F.col("source"), F.col("target"))), RELATIONS)


def import_edges(imports: DataFrame, files: DataFrame, provenance: str) -> tuple[DataFrame, DataFrame]:
    """External symbols and relations file -> symbol from import entities (name, file_path, seq) and file entities."""
    symbols = first_wins(imports.select("name", "seq"), ["name"]).select(
        F.concat(F.lit("external:"), stable_id(F.col("name"))).alias("id"), F.lit("external_symbol").alias("kind"), "name", F.col("name").alias("qualified_name"),
        F.lit("").alias("file_path"), F.lit("none").alias("language"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(provenance).alias("provenance"), "seq",
    )
    owners = first_wins(files.where("kind = 'file'").select("file_path", "id", "seq"), ["file_path"]).select("file_path", F.col("id").alias("source"))
    edges = imports.join(owners, "file_path").select(
        F.lit("imports").alias("kind"), "source", F.concat(F.lit("external:"), stable_id(F.col("name"))).alias("target"), F.col("file_path").alias("source_name"),
        F.col("name").alias("target_name"), "file_path", F.lit("external").alias("resolution"), F.lit(provenance).alias("provenance"), "seq",
    )
    last = last_wins(edges, ["kind", "source_name", "target_name"])
    return conform(symbols, ENTITIES), conform(last.withColumn("id", relation_id(F.col("kind"), F.col("source"), F.col("target"))), RELATIONS)


def build_entities(nodes: DataFrame, edges: DataFrame, files: DataFrame, repository: str, path: str, provenance: str = "graph") -> DataFrame:
    """The entities of a graph store's nodes, edges and files, without the manifests' structure."""
    own = last_wins(project_nodes(nodes, provenance), ["id"]).unionByName(repository_entity(nodes, repository, path))
    with_files = own.unionByName(complete_files(own, files))
    return with_files.unionByName(complete_endpoints(with_files, visited_edges(edges, nodes), ("target",)))  # all sources are nodes


def build_relations(nodes: DataFrame, edges: DataFrame, files: DataFrame, repository: str, path: str, provenance: str = "graph") -> DataFrame:
    """The relations between build_entities; what names them is written to the shared checkpoint folder once."""
    own = cut_lineage(last_wins(project_nodes(nodes, provenance).select("id", "kind", "qualified_name", "file_path", "seq"), ["id"]))
    own = own.unionByName(repository_entity(nodes, repository, path).select(*own.columns))
    entities = own.unionByName(complete_files(own, files).select(*own.columns))
    contains = F.col("kind").eqNullSafe(F.lit("contains")) & F.col("source").eqNullSafe(F.lit("repository:" + labels([path])[0]))
    visited = lambda some: project_visited(visited_edges(some, nodes), entities, provenance).drop("id")
    contained = visited(edges.where(contains)).unionByName(contain_files(entities, repository, path).drop("id"))  # only these can be equal
    last = last_wins(contained, ["kind", "source", "target", "source_name", "target_name"])  # two paths can share a label
    relations = visited(edges.where(~contains)).unionByName(last)
    return conform(relations.withColumn("id", relation_id(F.col("kind"), F.col("source"), F.col("target"))), RELATIONS)


def build(nodes: DataFrame, edges: DataFrame, files: DataFrame, repository: str, path: str, provenance: str = "graph") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a graph store's nodes, edges and files, without the manifests' structure."""
    return tuple(made(nodes, edges, files, repository, path, provenance) for made in (build_entities, build_relations))
