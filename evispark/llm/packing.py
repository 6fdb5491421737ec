"""Packing of documents into training sequences by multiway differencing.

A document's ids end with ``end_id``. Every full sequence length of a document fills a sequence alone; the
rest is cut into pieces of at most ``piece`` ids. Rests are dealt at random into groups of about ``windows``
sequences and ``most_pieces`` pieces at most, which bounds a task's memory however short the documents are, and within a group multiway differencing (Karmarkar-Karp) places them: each piece begins as a
partition of its own, and the two partitions with the largest spread are merged, largest window of one with
smallest of the other, until one partition is left. Its windows are nearly equal; where one exceeds the
capacity, the group is packed again into one window more.

Scale: tokens stay in the task that made them. What moves is a few numbers for each piece, hashed evenly
whatever documents they come from, and written once to the shared checkpoint folder.

Defined results: a null or empty text is the single id ``end_id``; each id lies in exactly one piece; repeated
rows are packed one by one; an empty table gives an empty table; other columns of the input are not returned.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.arrow import Numbers, held, slices, tokenizer_of
from evispark.session import cut_lineage

CAPACITY = 2048
PIECE = 256
#: Sequences of a group, and its pieces where they are so small that they would be more.
WINDOWS, MOST_PIECES = 128, 32_768
#: Bytes whose words are looked up together, and words that a task remembers.
CALL, MEMORY = 1_000_000, 500_000
#: A stem that ends in an ASCII letter or digit or a Latin-1 letter, and closing ASCII punctuation.
CLOSING = frozenset(c for c in range(128) if not chr(c).isalnum())
CLOSED = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([^a-z0-9\x80-\xff]+)", re.S)
PIECES = "struct<doc_tokens:bigint,pieces:array<struct<start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>>>"


class WordEncoder:
    """Ids of texts whose tokenizer drops ASCII white space and lets no token span it: each different word is encoded once.

    Such tokenizers also lower-case and never let a token span the place between a letter or digit and the ASCII
    punctuation behind it, so a word's stem and its closing punctuation are remembered apart. Words that could
    hold a special string stay whole.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|")}
        self.mark, self.mark_id = min(special.items(), default=("", -1))
        self.reset()

    def reset(self) -> None:
        self.words, self.units = Numbers(MEMORY), Numbers(MEMORY)
        self.first, self.second = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        stems, ends = [], []
        for w in words:
            if b"<|" not in w:
                w = w.lower()
                if w and w[-1] in CLOSING and (m := CLOSED.fullmatch(w)):
                    stems.append(m[1])
                    ends.append(m[2])
                    continue
            stems.append(w)
            ends.append(b"")
        units, new = self.units(stems + ends)
        self.first, self.second = np.concatenate([self.first, units[: len(words)]]), np.concatenate([self.second, units[len(words) :]])
        for a in range(0, len(new), 50_000):
            self.encode([w.decode() for w in new[a : a + 50_000]])

    def encode(self, words: list[str]) -> None:
        """Remembers the ids of words. Those that hold no special string are encoded many at a time, parted by one."""
        plain = [k for k, w in enumerate(words) if "<|" not in w] if self.mark else []
        rest = sorted(set(range(len(words))) - set(plain))
        texts = [self.mark.join(words[k] for k in plain[a : a + 200]) + self.mark for a in range(0, len(plain), 200)]
        run = lambda some: np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), np.uint32)
        ids = run(texts)
        marks = np.flatnonzero(ids == self.mark_id)
        lengths = np.empty(len(words), np.int64)
        lengths[plain] = np.diff(marks, prepend=-1) - 1
        alone = [run([words[k]]) for k in rest]
        lengths[rest] = [len(x) for x in alone]
        order = np.array(plain + rest, np.int64)
        starts = np.empty(len(words), np.int64)
        starts[order] = len(self.ids) + np.cumsum(lengths[order]) - lengths[order]
        self.ids = np.concatenate([self.ids, ids[ids != self.mark_id], *alone])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; the words are split and told apart by Arrow, and only different ones are looked up here."""
        if self.words.full() or self.units.full():
            self.reset()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        at, new = self.words([w or b"" for w in words.dictionary.cast(pa.large_binary()).to_pylist()])
        if new:
            self.learn(new)
        at = at[words.indices.to_numpy(zero_copy_only=False)] if len(words) else at[:0]
        units = np.stack([self.first[at], self.second[at]], axis=1).ravel()
        size = self.lengths[units]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        tokens = self.ids[np.arange(total) + np.repeat(self.starts[units] - ends + size, size)]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], ends])[2 * np.cumsum(np.concatenate([[0], counts])).astype(np.int64)]
        return [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def word_encoder(path: str) -> WordEncoder:
    """Per worker process, so that its memory outlives a task, if no other stage's comes between."""
    return held(("words", path), lambda: WordEncoder(path))


def document_ids(text: Column, tokenizer: str, end_id: int, capacity: int, piece: int, with_ids: bool) -> Column:
    """doc_tokens, and the pieces of each text: start, length, checksum, and the ids where they are asked for."""

    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, end = word_encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            texts, rows = pc.fill_null(batch.cast(pa.large_string()), ""), []
            for a, b in slices(pc.binary_length(texts).to_pylist(), CALL):
                for ids in encode(texts[a:b]):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    full = len(ids) // capacity * capacity
                    cuts = [*range(0, full, capacity), *range(full, len(ids), piece), len(ids)]
                    spans = [(s, e, ids[s:e]) for s, e in zip(cuts, cuts[1:]) if e > s]
                    rows.append({"doc_tokens": len(ids), "pieces": [{"start": s, "length": e - s, "ids_crc32": zlib.crc32(x.tobytes()), "ids": x.tolist() if with_ids else None} for s, e, x in spans]})
            kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
            yield pa.array(rows, pa.struct([("doc_tokens", pa.int64()), ("pieces", pa.list_(kind))]))

    return cut(text)


def document_pieces(docs: DataFrame, tokenizer: str, text: str, key: str, end_id: int, capacity: int, piece: int, with_ids: bool) -> DataFrame:
    cut = docs.select(F.col(key).alias("doc_id"), document_ids(F.coalesce(F.col(text), F.lit("")), tokenizer, end_id, capacity, piece, with_ids).alias("cut"))
    rows = cut.select("doc_id", "cut.doc_tokens", F.explode("cut.pieces").alias("p"))
    return rows.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", *(["p.ids"] if with_ids else []))


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece: multiway differencing over partial partitions, kept as sorted sums."""
    heap, merged = [], []
    for k, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-int(size), k, sums))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), n + len(merged) - 1, sums))
    placed = np.empty(n, np.int64)
    todo = [(heap[0][1], np.arange(windows))]
    while todo:
        node, slots = todo.pop()
        if node < n:
            placed[node] = slots[0]
            continue
        a, b, order = merged[node - n]
        unsorted = np.empty(windows, np.int64)
        unsorted[order] = slots
        todo += [(a, unsorted), (b, unsorted[::-1])]
    return placed


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece and the number of windows, none above capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        placed = differencing(sizes, windows)
        if np.bincount(placed, sizes, windows).max() <= capacity:
            return placed, windows
        windows += 1


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, most_pieces: int = MOST_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = cut_lineage(document_pieces(docs, tokenizer, text, key, end_id, capacity, piece, False))
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == capacity).select(*names, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < capacity)
    total, count = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, round(total / (windows * capacity)), round(count / most_pieces))
    grouped = rest.withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(groups)))
    kind = ", ".join(f"{c} {t}" for c, t in rest.select(*names).dtypes)

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        placed, _ = pack_sizes(rows["length"].to_numpy(np.int64), capacity)
        out = rows[names].assign(sequence_id=(int(rows["lot"].iloc[0]) * (1 << 24) + placed) * 2)
        out = out.iloc[np.argsort(placed, kind="stable")]
        return out.assign(offset=out.groupby("sequence_id")["length"].cumsum() - out["length"])

    placed = grouped.groupBy("lot").applyInPandas(place, f"{kind}, sequence_id long, offset long")
    return full.unionByName(placed)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids and starts of their pieces, in order of offset.

    Ids are joined to the packing by document, place and checksum, so equal pieces of repeated rows need be told apart nowhere.
    """
    on = ["doc_id", "start", "length", "ids_crc32"]
    ids = document_pieces(docs, tokenizer, text, key, end_id, capacity, piece, True).dropDuplicates(on).select(*on, "ids")
    left = packed.select(*on, "sequence_id", "offset")
    both = left.alias("l").join(ids.alias("r"), F.expr(" AND ".join(f"l.{c} <=> r.{c}" for c in on))).select("l.sequence_id", "l.offset", "l.doc_id", "r.ids")
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
