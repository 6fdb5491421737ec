"""Token counts with overlap resynchronisation for huge documents.

Texts up to ``chunk`` characters are encoded whole, many in one call. Longer ones are encoded in chunks that
overlap, with offsets. Two neighbours are spliced at a boundary that both have and that is proven stable:

* both encodings have a token boundary there and agree on every token between it and the end of an agreeing
  stretch of at least ``AGREE`` tokens on either side, and
* a character that is no white space stands before it and white space behind it. No token of the tokenizer
  families served here spans such a place, so the text before it can't change the tokens behind it.

Where the overlap has no such boundary it is doubled and both ends are encoded again, until the chunk reaches
the end of the text. Only one chunk's tokens are held at a time, so memory doesn't grow with the document.

Defined results: null counts as an empty text, which has no tokens; special strings inside a text are handled
as the library does by default; repeated rows are counted alike; existing columns with the names of results
are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.arrow import slices, tokenizer_of

#: Characters of a chunk, of the first overlap, and of all texts that one call encodes.
CHUNK, OVERLAP, CALL = 32_768, 256, 1_000_000
AGREE = 2
LIMIT = 512


def stable_boundary(text: str, base: int, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """(position, tokens of left before it, tokens of right before it), or None; tokens are (start, end, id) in text."""
    at_left = {t[0]: k for k, t in enumerate(left)}
    best = None
    for j, (start, _, _) in enumerate(right):
        i = at_left.get(start)
        if i is None or j < AGREE or i < AGREE or start <= base or not text[start].isspace() or text[start - 1].isspace():
            continue
        if i + AGREE < len(left) and left[i - AGREE : i + AGREE] == right[j - AGREE : j + AGREE]:
            best = (start, i, j)
            break
    return best


def chunked_count(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text from overlapping chunks. encode(part) gives the (start, end, id) of part's tokens."""
    shifted = lambda a, b: [(s + a, e + a, t) for s, e, t in encode(text[a:b])]
    n, begin, counted = len(text), 0, 0
    end = min(n, chunk)
    tokens = shifted(begin, end)
    skip = 0  # tokens of this chunk that the one before has counted
    while end < n:
        lap = min(overlap, chunk // 2)
        while True:
            start = max(begin, end - lap)
            upto = min(n, end + max(chunk, lap))
            tail = [t for t in tokens[skip:] if t[0] >= start]
            following = shifted(start, upto)
            if found := stable_boundary(text, start, tail, following):
                counted += len(tokens) - skip - (len(tail) - found[1])
                begin, end, tokens, skip = found[0], upto, following, found[2]
                break
            lap *= 2
            if start == begin:  # the whole chunk is overlap: make it longer instead
                end = min(n, end + lap)
                tokens, skip = shifted(begin, end), 0
                if end == n:
                    break
    return counted + len(tokens) - skip


def token_count(text: Column, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens; ``tokenizer`` is the path of a file that every executor has."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = tokenizer_of(tokenizer)

        def encode(part: str) -> list[tuple[int, int, int]]:
            e = tok.encode(part, add_special_tokens=False)
            return [(s, t, i) for (s, t), i in zip(e.offsets, e.ids)]

        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            out = [0] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            for a, b in slices([len(texts[k]) for k in short], CALL):
                part = short[a:b]
                for k, e in zip(part, tok.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)):
                    out[k] = len(e)
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    out[k] = chunked_count(t, encode, chunk, overlap)
            yield pa.array(out, pa.int64())

    return count(text)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes (of UTF-8), n_tokens and over_limit (more than ``limit`` tokens) to every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": token_count(body, tokenizer)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
