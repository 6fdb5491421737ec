"""Reader of JSON5 manifests: a lenient parser for a few small files, applied in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n\r]*|/\*.*?\*/)|(?P<mark>[{}\[\]:,])|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<number>[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$]))|(?P<word>[\w$]+)""",
    re.S,
)
WORDS = {"true": True, "false": False, "null": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
MANIFEST = "struct<module_name:string,profile:array<struct<name:string,src_path:string>>>"


def unquoted(text: str) -> str:
    def plain(m: re.Match) -> str:
        c = m[1]
        if c[0] in "ux" and len(c) > 1:
            return chr(int(c[1:], 16))
        return "" if c in ("\n", "\r\n") else ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", plain, text[1:-1], flags=re.S)


def number(text: str) -> float:
    sign, body = (-1, text[1:]) if text[0] == "-" else (1, text.lstrip("+"))
    return sign * (int(body, 16) if body[:2].lower() == "0x" else float(body.replace("Infinity", "inf")))


def loads(text: str):
    """The value of a JSON5 text; ValueError where it is none."""
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    value, at = value_at(tokens, 0, 0)
    if tokens[at][0] != "end":
        raise ValueError(f"unexpected {tokens[at][1]!r}")
    return value


def value_at(tokens: list[tuple[str, str]], at: int, depth: int):
    """(value, place behind it)."""
    kind, text = tokens[at]
    if depth > 200:
        raise ValueError("nested too deeply")
    if kind == "string":
        return unquoted(text), at + 1
    if kind == "number":
        return number(text), at + 1
    if kind == "word" and text in WORDS:
        return WORDS[text], at + 1
    if text not in ("{", "["):
        raise ValueError(f"unexpected {text!r}")
    close, held = ("}", {}) if text == "{" else ("]", [])
    at += 1
    while tokens[at][1] != close or tokens[at][0] != "mark":
        if close == "}":
            kind, name = tokens[at]
            if kind not in ("string", "word", "number") or tokens[at + 1] != ("mark", ":"):
                raise ValueError(f"unexpected {name!r}")
            held[unquoted(name) if kind == "string" else name], at = value_at(tokens, at + 2, depth + 1)
        else:
            item, at = value_at(tokens, at, depth + 1)
            held.append(item)
        if tokens[at] == ("mark", ","):
            at += 1
        elif tokens[at] != ("mark", close):
            raise ValueError(f"unexpected {tokens[at][1]!r}")
    return held, at + 1


def parsed(text: str | None):
    """The value of a text, or None where it is broken or absent."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        return loads(text)
    except ValueError:
        return None


def facts(value) -> dict:
    """The string at module.name, and the modules that have a string name and a string srcPath."""
    held = value if isinstance(value, dict) else {}
    module, modules = held.get("module"), held.get("modules")
    name = module.get("name") if isinstance(module, dict) else None
    items = [m for m in modules if isinstance(m, dict) and isinstance(m.get("name"), str) and isinstance(m.get("srcPath"), str)] if isinstance(modules, list) else []
    return {"module_name": name if isinstance(name, str) else None, "profile": [{"name": m["name"], "src_path": m["srcPath"]} for m in items]}


def manifest_facts(content: Column) -> Column:
    @F.arrow_udf(MANIFEST)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("module_name", pa.string()), ("profile", pa.list_(pa.struct([("name", pa.string()), ("src_path", pa.string())])))])
        for batch in batches:
            yield pa.array([facts(parsed(t)) for t in batch.to_pylist()], kind)

    return read(content)


def read_manifests(manifests: DataFrame) -> DataFrame:
    """Adds module_name and profile to manifests (path, content); broken ones get null and no items."""
    return manifests.withColumn("__facts", manifest_facts(F.col("content"))).select(*manifests.columns, "__facts.module_name", "__facts.profile")
