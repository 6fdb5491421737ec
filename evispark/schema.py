"""Tables of a code-evidence graph: their schemas and vocabularies.

An observation is what one engine saw of one repository: entities, relations and files, each row keyed by
(repository, engine) where several observations share a table, and ordered by ``seq``, since Spark keeps no row
order and several operators ask for the first or last row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METADATA = "struct<signature:string,visibility:string,exported:boolean,root:string,manifest:string,ecosystem:string>"
ENTITIES = (
    "id string, kind string, native_kind string, name string, qualified_name string, file_path string, language string, "
    f"start_line int, end_line int, decorators array<string>, metadata {METADATA}, provenance string, seq bigint"
)
RELATIONS = "id string, kind string, source string, target string, source_name string, target_name string, file_path string, resolution string, provenance string, seq bigint"
FILES = "path string, language string, is_candidate boolean, is_indexed boolean, seq bigint"
HEADER = (
    "repository string, engine string, schema_version int, generated_at timestamp, diagnostics array<string>, timings_ms map<string,double>, "
    "review struct<status:string,sampled_files:array<string>,reviewer:string,reviewed_at:string,notes:string>"
)
AST_NODES = (
    "file_path string, node_id bigint, parent_id bigint, preorder bigint, type string, text string, start_index int, start_row int, end_row int, "
    "name_text string, function_text string, constructor_text string"
)
MANIFESTS = "path string, content string"

# Vocabularies of the data model.
EVALUATED_KINDS = ("module", "package", "class", "struct", "interface", "function", "method", "import", "component")
UI_DECORATORS = ("Component", "ComponentV2", "Entry")
UI_LANGUAGE = "arkts"
RESOLUTIONS = ("internal", "external", "unresolved")
REVIEW_STATES = ("not-required", "unreviewed", "reviewed")
SCHEMA_VERSION = 2
UNREVIEWED_SEED = "UNREVIEWED SEED"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the columns of a schema, absent ones as null, in its order and types."""
    kinds = [part.strip().split(" ", 1) for part in split_fields(ddl)]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds])


def split_fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string; commas inside angle brackets don't part them."""
    fields, depth, last = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            fields.append(ddl[last:k])
            last = k + 1
    return [*fields, ddl[last:]]
