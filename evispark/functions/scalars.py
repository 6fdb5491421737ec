"""Scalar expressions over names, paths and manifests. All but the labels of relations run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the languages they stand for, and path words of entry, service and test files.
LANGUAGES = {
    "ets": "arkts", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java", "kt": "kotlin",
    "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php",
    "swift": "swift", "scala": "scala", "xml": "xml",
}
ENTRY_PATH = r"(?i)(entry|main|ability|service|controller|router|test)"


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_path(path: Column) -> Column:
    """Forward slashes."""
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder of a path; '.' where it names none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def language_of(path: Column) -> Column:
    """The language that a path's extension stands for, or 'unknown'."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(basename(path), ".", -1))), F.lit("unknown"))


def key_name(name: Column) -> Column:
    """Lower-case ASCII letters, digits, _ and $ of a name."""
    return F.lower(F.regexp_replace(name, r"[^A-Za-z0-9_$]", ""))


def endpoint_name(qualified: Column) -> Column:
    """key_name of the last part behind :: and then behind a dot."""
    return key_name(F.substring_index(F.substring_index(qualified, "::", -1), ".", -1))


def entity_key(kind: Column, file_path: Column, name: Column) -> Column:
    return F.concat_ws("|", kind, F.lower(file_path), key_name(name))


def relation_key(kind: Column, source_name: Column, target_name: Column, resolution: Column) -> Column:
    return F.concat_ws("|", kind, endpoint_name(source_name), endpoint_name(target_name), resolution)


def stable_id(value: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units as 8 hex digits. A label only: too short to join or deduplicate on."""
    # a lambda that named value would evaluate it for each character
    points = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    mix = lambda h, unit: (h.bitwiseXOR(unit) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))
    pair = lambda h, p: mix(mix(h, F.shiftright(p - 0x10000, 10) + 0xD800), (p - 0x10000).bitwiseAND(F.lit(0x3FF).cast("bigint")) + 0xDC00)
    mixed = F.aggregate(points, F.lit(2166136261).cast("bigint"), lambda h, p: F.when(p < 0x10000, mix(h, p)).otherwise(pair(h, p)))
    return F.lpad(F.lower(F.hex(mixed)), 8, "0")


def labels(texts: list[str]) -> list[str]:
    """stable_id of many texts at once, a code unit of all of them at a time."""
    texts = [t.encode("utf-16-le") for t in texts]
    sizes = np.fromiter((len(t) // 2 for t in texts), np.int64, len(texts))
    order = np.argsort(-sizes, kind="stable")
    units = np.frombuffer(b"".join(texts), np.uint16).astype(np.uint32)
    starts, falling = (np.cumsum(sizes) - sizes)[order], sizes[order]
    mixed = np.full(len(texts), 2166136261, np.uint32)
    longer = np.searchsorted(-falling, -np.arange(falling[0] if len(texts) else 0), side="left")  # texts with a unit at each place
    for at, n in enumerate(longer.tolist()):
        mixed[:n] = (mixed[:n] ^ units[starts[:n] + at]) * np.uint32(16777619)
    out = np.empty(len(texts), np.uint32)
    out[order] = mixed
    return [f"{x:08x}" for x in out.tolist()]


def relation_id(kind: Column, source: Column, target: Column) -> Column:
    """A label as stable_id gives, for all relations of a batch at once."""

    @F.arrow_udf("string")
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(labels(batch.to_pylist()), pa.string())

    return F.concat(F.lit("edge:"), labelled(F.concat_ws("|", kind, source, target)))


def jitter(seed: str, path: Column) -> Column:
    """A share of 0 to 1 that a seed gives a path, from the first four digits of its label."""
    digits = F.substring(stable_id(F.concat(F.lit(f"{seed}:"), path)), 1, 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(65535.0)


def ratio(value: Column, total: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(value.cast("double"), total.cast("double"))


def import_name(text: Column) -> Column:
    """What an import statement names: the string behind from, else behind import; null if neither."""
    behind = lambda word: F.nullif(F.regexp_extract(text, word + "\\s+[\"']([^\"']+)[\"']", 1), F.lit(""))
    return F.coalesce(behind("from"), behind("import"))


def string_at(json: Column, *path: str) -> Column:
    """The string at a path of a JSON text; null where the text is broken or the value is no string."""
    value = F.try_variant_get(F.try_parse_json(json), "$." + ".".join(path), "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(json), "$." + ".".join(path), "string"))


def package_name(path: Column, content: Column) -> Column:
    """package.json's name, else the manifest's folder ('.' at the top)."""
    named = F.when(basename(path) == "package.json", string_at(content, "name"))
    return F.coalesce(named, basename(dirname(path)))


def module_root(path: Column) -> Column:
    """The folder that a module manifest describes. A manifest at an unusual place keeps its whole path and so holds no files."""
    return F.regexp_replace(path, r"(?i)/src/main/module\.json5$", "")


def clean_root(root: Column) -> Column:
    """'' for the top, and no trailing slash."""
    return F.regexp_replace(F.when(root == ".", F.lit("")).otherwise(normalize_path(root)), r"/$", "")


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path below a folder, with . and .. resolved; '.' for the top."""
    parts = F.filter(F.split(F.concat_ws("/", folder, normalize_path(relative)), "/"), lambda p: ~p.isin("", "."))
    up = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    resolved = F.aggregate(parts, F.array().cast("array<string>"), up)
    return F.when(F.size(resolved) == 0, F.lit(".")).otherwise(F.array_join(resolved, "/"))


def is_entry_path(path: Column) -> Column:
    return F.rlike(path, F.lit(ENTRY_PATH))
