"""Modules and packages that manifests declare, and the files below their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.keyed import ancestors, first_wins, strict_ancestors
from evispark.functions.scalars import basename, clean_root, dirname, joined_path, module_root, package_name, relation_id, stable_id
from evispark.schema import ENTITIES, METADATA, RELATIONS, conform
from evispark.session import cut_lineage, sent

# The manifests that are read.
MODULE_MANIFEST, PROFILE = "module.json5", "build-profile.json5"
PACKAGE_MANIFESTS = ("oh-package.json5", "package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml")
MANIFESTS = (MODULE_MANIFEST, PROFILE, *PACKAGE_MANIFESTS)
ECOSYSTEM = "openharmony"


def declared_modules(manifests: DataFrame) -> DataFrame:
    """(root, name, manifest, at) from manifests (path, content, module_name, profile).

    ``module_name``: the string at module.name of a module manifest; ``profile``: the (name, src_path) items of a
    build profile. Both come from the JSON5 reader.
    """
    file = basename(F.col("path"))
    own = manifests.where(file == MODULE_MANIFEST).withColumn("root", module_root(F.col("path")))
    own = own.select("root", F.coalesce("module_name", basename(F.col("root"))).alias("name"), F.col("path").alias("manifest"), F.lit(0).alias("at"))
    items = manifests.where(file == PROFILE).select("path", F.posexplode("profile").alias("at", "m")).where("m.name IS NOT NULL AND m.src_path IS NOT NULL")
    src = F.regexp_replace("m.src_path", r"^\./", "")
    listed = items.select(joined_path(dirname(F.col("path")), src).alias("root"), F.col("m.name").alias("name"), F.col("path").alias("manifest"), "at")
    return own.unionByName(listed).withColumn("root", clean_root(F.col("root")))


def declared_packages(manifests: DataFrame) -> DataFrame:
    """(root, name, manifest, at) from the package manifests."""
    found = manifests.where(basename(F.col("path")).isin(*PACKAGE_MANIFESTS))
    root = F.when(dirname(F.col("path")) == ".", F.lit("")).otherwise(dirname(F.col("path")))
    return found.select(root.alias("root"), package_name(F.col("path"), F.col("content")).alias("name"), F.col("path").alias("manifest"), F.lit(0).alias("at"))


def first_of_root(declared: DataFrame) -> DataFrame:
    """The first declaration of each root, in order of manifest path and place in it."""
    return first_wins(declared.withColumn("seq", F.struct("manifest", "at")), ["root"]).drop("seq", "at")


def contained_files(roots: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of roots (root, ...) joined to the files (file_path, ...) below them; nested roots each hold the file.

    Each file is expanded to the roots that could hold it, so the prefix test is an equality join; where the roots are few
    enough they are sent to the files, so that a file is exchanged for none of the roots that don't exist. The top holds
    every file; its rows (one for each kind of root, as first_of_root leaves them) are always sent.
    """
    roots = cut_lineage(roots)
    expanded = files.withColumn("root", F.explode(ancestors(F.col("file_path")))).where("root <> ''")
    top = F.broadcast(roots.where("root = ''"))
    return expanded.join(sent(roots.where("root <> ''"), roots.count()), "root").select(*roots.columns, *[c for c in files.columns if c != "root"]).unionByName(files.withColumn("root", F.when(F.col("file_path").isNotNull(), "")).join(top, "root").select(*roots.columns, *[c for c in files.columns if c != "root"]))


def structure(manifests: DataFrame, files: DataFrame, repository: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of modules and packages; files: file entities (id, qualified_name, file_path, seq)."""
    modules = first_of_root(declared_modules(manifests)).withColumns({"kind": F.lit("module"), "id": F.concat(F.lit("module:"), stable_id(F.concat_ws(":", "root", "name")))})
    packages = first_of_root(declared_packages(manifests)).withColumns({"kind": F.lit("package"), "id": F.concat(F.lit("package:"), stable_id(F.concat_ws(":", "manifest", "name")))})
    both = modules.unionByName(packages)
    nothing = F.lit(None).cast("string")
    module = F.col("kind") == "module"
    metadata = F.struct(nothing, nothing, F.lit(None).cast("boolean"), F.when(module, F.col("root")), F.col("manifest"), F.when(module, F.lit(ECOSYSTEM))).cast(METADATA)
    shaped = both.withColumns(
        {
            "qualified_name": F.concat(F.lit(f"{repository}::"), F.col("name")), "file_path": F.col("manifest"), "language": F.lit("mixed"),
            "start_line": F.lit(1), "end_line": F.lit(1), "metadata": metadata, "provenance": F.lit("manifest"),
        }
    )
    entities = conform(shaped, ENTITIES)
    owner = F.concat(F.lit("repository:"), stable_id(F.lit(path)))
    fixed = {"relation": F.lit("contains"), "resolution": F.lit("internal"), "provenance": F.lit("manifest")}
    above = entities.select(owner.alias("source"), F.col("id").alias("target"), F.lit(repository).alias("source_name"), F.col("qualified_name").alias("target_name"), "file_path", "seq")
    held = contained_files(both.select("root", F.col("id").alias("source"), F.col("name").alias("source_name")), files.select("file_path", F.col("id").alias("target"), F.col("qualified_name").alias("target_name"), "seq"))
    edges = above.unionByName(held.drop("root")).withColumns(fixed).withColumnRenamed("relation", "kind")
    return entities, conform(edges.withColumn("id", relation_id(F.col("kind"), F.col("source"), F.col("target"))), RELATIONS)


def applying(entities: DataFrame, scope: DataFrame) -> DataFrame:
    """The entities that a scope of files (path) concerns.

    An entity applies through its own file; a module also through any file strictly below its root, a package
    through any below its manifest's folder. An empty root applies if the scope has any file at all.
    """
    lowered = scope.select(F.lower("path").alias("path")).distinct()
    roots = lowered.select(F.explode(strict_ancestors(F.col("path"))).alias("root")).distinct()
    folder = F.when(F.contains("file_path", F.lit("/")), F.regexp_replace(F.lower("file_path"), r"/[^/]*$", "")).otherwise(F.lit(""))
    root = F.when(F.col("kind") == "module", F.lower(F.coalesce("metadata.root", F.lit("")))).when(F.col("kind") == "package", folder)
    keyed = entities.withColumns({"__path": F.when(F.col("file_path") != "", F.lower("file_path")), "__root": root})
    by_path = lowered.select(F.col("path").alias("__path"))
    by_root = roots.select(F.col("root").alias("__root"))
    own = keyed.join(by_path, "__path", "left_semi")  # rows without a file fall out before the exchange
    below = keyed.where(F.col("kind").isin("module", "package")).join(by_path, "__path", "left_anti").join(by_root, "__root", "left_semi")
    return own.select(*entities.columns).unionByName(below.select(*entities.columns))
