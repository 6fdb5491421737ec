"""Secret scans: all rules compiled into one automaton that reads every byte once.

The mirrored rules form one minimal automaton; a single pass over the bytes, from the end to the start,
marks where a match of any rule begins. From the marks of a rule the leftmost one is followed forward to its
longest end, the next match begins behind it, and so on: leftmost, non-overlapping matches per rule. A match
that the rule's ``keep`` pattern refuses still uses up its text, but isn't reported.

Defined results: a null or empty text holds no secrets; a NUL character ends every match; repeated rows give
equal results; a column with the name of a result is replaced; an empty table gives an empty table. Very long
texts are read whole. Each row is scanned where it lies, and memory is bounded by one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.arrow import encoded
from evispark.llm.automaton import build

#: Bytes scanned together.
BLOCK = 4_000_000
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """pattern: what a match consumes; keep: what a whole match must look like to be reported ('' for any); more: what
    a match goes on to consume where it stands behind it."""

    kind: str
    pattern: str
    keep: str = ""
    more: str = ""


def caseless(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(caseless(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"(?:{KEYWORDS})" + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""

SPACE = r"(?:[\x09-\x0D\x20]|\x5C[nrt])"
# A private key's fields and body up to its END line; without one, its runs of 16 base64 characters and more.
KEY_FIELDS = rf"(?:{SPACE}*(?:Proc-Type|DEK-Info):[\x20A-Za-z0-9,-]*)*"
KEY_BODY = rf"{KEY_FIELDS}(?:(?:[A-Za-z0-9+/=]|{SPACE})*-----END [A-Z ]*PRIVATE KEY-----|(?:{SPACE}*[A-Za-z0-9+/=]{{16,}})*)"

# The formats of the rules, base rules first.
RULES = (
    Rule("assign", ASSIGN + "+", ASSIGN + "{6,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", more=KEY_BODY),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_(?:live|test)_[A-Za-z0-9]+", "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]):
    """Per worker process: the common automaton, and each rule's own forward automata."""
    return build([r.pattern for r in rules], backward=True), [(build([f"{r.pattern}(?:{r.more})?" if r.more else r.pattern], anchored=True), build([r.keep], anchored=True) if r.keep else None) for r in rules]


def byte_spans(texts: list[bytes], rules: tuple[Rule, ...]) -> Iterator[list[tuple[int, int, int]]]:
    """For each text the (start, rule number, end) of its matches in bytes, by start and rule."""
    common, own = compiled(rules)
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BLOCK):
            size += len(texts[upto]) + 1
            upto += 1
        block = texts[at:upto]
        offsets = np.cumsum([0, *(len(t) + 1 for t in block)])
        blob = np.frombuffer(b"\0".join(block), np.uint8)
        places, states = common.hits(blob[::-1])
        starts, states = (len(blob) - 1 - places)[::-1], states[::-1]
        found: dict[int, list[tuple[int, int, int]]] = {}
        ends: dict[tuple[int, int], int] = {}
        for start, state, k in zip(starts.tolist(), states.tolist(), (np.searchsorted(offsets, starts, "right") - 1).tolist()):
            text, start = block[k], start - int(offsets[k])
            for rule in common.accepts[state // common.width]:
                if start >= ends.get((k, rule), 0):
                    forward, keep = own[rule]
                    ends[k, rule] = end = forward.longest(text, start)
                    if keep is None or keep.longest(text, start) == end:
                        found.setdefault(k, []).append((start, rule, end))
        for k in range(len(block)):
            yield sorted(found.get(k, ()))
        at = upto


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), r, int(before[b])) for a, r, b in spans]


def span_array(rows: list[list[tuple[int, int, int]]], kinds: list[str]) -> pa.Array:
    flat = [s for row in rows for s in row]
    fields = [pa.array([kinds[s[1]] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All secrets of a text: kind, start and end in code points, by start and then by the order of the rules."""

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = encoded(batch)
            yield span_array([code_points(t, s) for t, s in zip(texts, byte_spans(texts, rules))], [r.kind for r in rules])

    return scan(text)


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """Adds the array of secrets found in each row's text."""
    return docs.withColumn(into, secret_spans(F.col(text), rules))


def redacted(text: Column, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> Column:
    """The text with every secret, or run of overlapping secrets, replaced by ``mark``; null stays null."""

    @F.arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out = encoded(batch), []
            for t, spans, valid in zip(texts, byte_spans(texts, rules), batch.is_valid().to_pylist()):
                parts, done = [], 0
                for a, _, b in spans:
                    if a >= done:
                        parts += [t[done:a], mark.encode()]
                    done = max(done, b)
                out.append((b"".join([*parts, t[done:]]) if spans else t).decode() if valid else None)
            yield pa.array(out, pa.string())

    return redact(text)
