"""Entities, containment, imports and calls from parsed syntax trees.

Input is a table of named nodes in preorder (``schema.AST_NODES``), as any parser writes it. A tree's nodes are nested
intervals of that order, so one scan of a file's sorted nodes with a stack of the open ones gives every node its owner,
the nearest classified ancestor, and its decorators. A task holds the open nodes only, as many as a tree is deep, and
passes on those that declare or call something.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from evispark.functions.scalars import basename, import_name, relation_id
from evispark.operators.calls import calls_of, resolve, resolve_in_order
from evispark.operators.graph import import_edges
from evispark.schema import ENTITIES, RELATIONS, UI_DECORATORS, UI_LANGUAGE, conform
from evispark.session import cut_lineage

# Node types and the kinds of entities they declare.
KINDS = {
    "class_declaration": "class", "struct_declaration": "struct", "interface_declaration": "interface", "function_declaration": "function",
    "function_signature": "function", "method_definition": "method", "method_signature": "method", "import_statement": "import", "import_declaration": "import",
    "namespace_declaration": "namespace", "module_declaration": "module", "type_alias_declaration": "type_alias", "enum_declaration": "enum",
}
CALLS = ("call_expression", "new_expression")
MARKED_HEAD, UI_MARK = 300, rf"@({'|'.join(UI_DECORATORS)})\b"


def is_decorator(kind: Column) -> Column:
    return F.contains(kind, F.lit("decorator"))


@dataclass
class Open:
    """A node whose end hasn't been met: who owns what is in it, its row if that is wanted, the decorators right before it,
    those among its children, and those since its last child that is none."""

    node: int | None
    owner: int | None
    row: dict | None = None
    before: list[str] = field(default_factory=list)
    inside: list[str] = field(default_factory=list)
    run: list[str] = field(default_factory=list)


def scanned(schema: pa.Schema):
    """Over nodes sorted by file and preorder, with ``__mark`` (a decorator's text), ``__declares`` and ``__wanted``: the wanted
    nodes, each at its end, with ``owner_node`` and ``decorators`` (null if none). A node whose parent isn't open stands at the
    top of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stack, out = None, [], []

        def close() -> None:
            done = stack.pop()
            if done.row is not None:
                out.append(done.row | {"decorators": done.before + done.inside or None})

        for batch in batches:
            rows = iter(batch.filter(batch.column("__wanted")).select(schema.names[:-2]).to_pylist())
            columns = (batch.column(c).to_pylist() for c in ("file_path", "node_id", "parent_id", "__mark", "__declares", "__wanted"))
            for path, node, parent, mark, declares, wanted in zip(*columns):
                if path != file or not stack:
                    while stack:
                        close()
                    file, stack = path, [Open(None, None)]
                while len(stack) > 1 and stack[-1].node != parent:
                    close()
                above = stack[-1]
                own = Open(node, node if declares else above.owner, next(rows) | {"owner_node": above.owner} if wanted else None)
                if mark is not None:
                    above.inside.append(mark)
                    above.run.append(mark)
                else:
                    own.before, above.run = above.run, []
                stack.append(own)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        while stack:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def walked(nodes: DataFrame) -> DataFrame:
    """The nodes that declare or call something, with ``owner_node`` (null where that is the file) and ``decorators``: those
    right before a node among its siblings, then those among its children."""
    declares, calls = F.col("type").isin(*KINDS), F.col("type").isin(*CALLS)
    mark = F.when(is_decorator(F.col("type")), F.regexp_replace("text", "^@", ""))
    marked = nodes.withColumns({"__mark": mark, "__declares": declares, "__wanted": declares | calls})
    slim = marked.withColumn("text", F.when(F.col("__wanted"), F.col("text")))
    ordered = slim.repartition("file_path").sortWithinPartitions("file_path", "preorder")
    kind = StructType(nodes.schema.fields).add("owner_node", LongType()).add("decorators", ArrayType(StringType()))
    return ordered.mapInArrow(scanned(to_arrow_schema(kind)), kind)


def classified(nodes: DataFrame) -> DataFrame:
    """Adds ``kind``: what a node declares, or null. A struct with a UI mark is a component."""
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    marked = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d.isin(*UI_DECORATORS)) | F.rlike(F.substring("text", 1, MARKED_HEAD), F.lit(UI_MARK))
    component = (F.col("type") == "struct_declaration") & F.coalesce(marked, F.lit(False))
    return nodes.withColumn("kind", F.when(component, "component").otherwise(F.try_element_at(table, F.col("type"))))


@dataclass(frozen=True)
class Extraction:
    """An extraction's tables."""

    entities: DataFrame
    relations: DataFrame


def file_entities(files: DataFrame, provenance: str) -> DataFrame:
    """An entity for each file (path, seq)."""
    shaped = files.select(
        F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), basename(F.col("path")).alias("name"), F.col("path").alias("qualified_name"), F.col("path").alias("file_path"),
        F.lit(UI_LANGUAGE).alias("language"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(provenance).alias("provenance"), "seq",
    )
    return conform(shaped, ENTITIES)


def extract(nodes: DataFrame, files: DataFrame, provenance: str = "syntax", in_order: bool = False) -> Extraction:
    """The graph of syntax trees over files (path, seq). ``in_order`` keeps what a single ordered walk would leave of the calls.

    Entity order is (file, preorder), packed into one number: files must have less than 2^32 nodes.
    """
    numbered = nodes.join(files.select(F.col("path").alias("file_path"), F.col("seq").alias("__file")), "file_path")
    numbered = numbered.withColumn("seq", F.col("__file") * (1 << 32) + F.col("preorder") + 1)
    owned = cut_lineage(classified(walked(numbered)))
    kept = owned.where("kind IS NOT NULL")
    name = F.coalesce("name_text", import_name(F.col("text")), F.concat(F.lit("<anonymous@"), (F.col("start_row") + 1).cast("string"), F.lit(">")))
    named = kept.withColumns({"name": name, "id": F.concat_ws(":", "file_path", "start_index", "kind")})
    above = named.select("file_path", F.col("node_id").alias("owner_node"), F.col("id").alias("owner"), F.col("name").alias("owner_name"), F.col("kind").alias("owner_kind"))
    full = named.join(above, ["file_path", "owner_node"], "left")
    qualified = F.concat(F.col("file_path"), F.lit("::"), F.coalesce(F.concat("owner_name", F.lit(".")), F.lit("")), F.col("name"))
    full = full.withColumns({"qualified_name": qualified, "native_kind": F.col("type"), "language": F.lit(UI_LANGUAGE), "start_line": F.col("start_row") + 1, "end_line": F.col("end_row") + 1, "provenance": F.lit(provenance)})
    own = cut_lineage(conform(full, ENTITIES))
    of_files = file_entities(files, provenance)
    parents = own.select(F.col("id").alias("owner"), F.col("qualified_name").alias("owner_qualified"))
    held = full.select("owner", "id", "qualified_name", "file_path", "seq").join(parents, "owner", "left")
    contains = held.select(
        F.lit("contains").alias("kind"), F.coalesce("owner", F.concat(F.lit("file:"), "file_path")).alias("source"), F.col("id").alias("target"),
        F.coalesce("owner_qualified", "file_path").alias("source_name"), F.col("qualified_name").alias("target_name"), "file_path", F.lit("internal").alias("resolution"), "seq",
    )
    external, imports = import_edges(own.where("kind = 'import'"), of_files, provenance)
    sites = owned.where(F.col("type").isin(*CALLS)).select("file_path", "owner_node", F.coalesce("function_text", "constructor_text").alias("text"), "seq").where("owner_node IS NOT NULL")
    calls = calls_of(sites.join(above, ["file_path", "owner_node"]))
    candidates = own.unionByName(of_files)
    if in_order:
        resolved = resolve_in_order(calls, candidates)
    else:
        resolved = resolve(calls, candidates).withColumn("target", F.coalesce("target", F.concat(F.lit("external:"), "text")))
    speakers = own.select(F.col("id").alias("owner"), F.col("qualified_name").alias("source_name"), "file_path")
    called = resolved.select("owner", "target", "target_name", "resolution", "seq").join(speakers, "owner")
    calling = called.select(F.lit("calls").alias("kind"), F.col("owner").alias("source"), "target", "source_name", "target_name", "file_path", "resolution", "seq")
    relations = contains.unionByName(calling).withColumn("provenance", F.lit(provenance))
    relations = conform(relations.withColumn("id", relation_id(F.col("kind"), F.col("source"), F.col("target"))), RELATIONS).unionByName(imports)
    return Extraction(candidates.unionByName(external), relations)
