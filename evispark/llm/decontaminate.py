"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs without white space and ASCII punctuation. An alignment counts 2 for an equal word and -1
for a changed, added or lost one; an item's score is its best local alignment's share of a whole copy's. From
``threshold`` on the item has leaked. So it has, whatever the share, where the alignment is worth ``excerpt`` equal
words.

Seeds: a text holds a pair of neighbouring words of an item if they follow each other there, or with one word between.
A changed or lost word costs three and spoils two of an item's pairs; an added word costs one, and it takes two to spoil
a pair. So a leak of L words at threshold t spoils at most 4/3 L (1 - t) of them, however it was edited. Of each item's
pairs the rarest are seeds, by the number of documents that hold them: as many as a leak can spoil, and two more (one,
where an item has too few pairs for that). So every leak holds that many seeds. Items of more than
``CHUNK`` pairs choose within each chunk, so that long excerpts hold seeds too. One pass counts the pairs'
documents; a second joins seeds to the documents' pairs where the documents lie, bounds a candidate's score by the
words it shares with the item, and aligns what remains.

Scale: documents never move. Items are taken in blocks of ``block_words`` words (or one longer item), one partition of
the items at a time. One block's index is broadcast for one column; where the items need more, the blocks are
searched one after another, each one's leaks are written to the shared checkpoint folder by hash of the text and its
index is dropped, so memory doesn't grow with the number of items. An alignment holds one row of its table, so its
memory grows with the words around a seed and not with their product.

Defined results: a null or empty text has no leaks; an item of fewer than ``min_words`` words leaks only as a whole
and unchanged, and one of fewer than ``least_words`` (or null) never, as chance would copy it; items without a key
are left out; equal items are reported one by one, a repeated item key once with its best score; keys can have any
type; repeated rows are judged alike; a column with the name of the result is replaced, all others are kept; an empty
table of documents gives an empty table and no items give no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evispark.llm.arrow import slices
from evispark.session import cut_lineage

MIN_WORDS, LEAST_WORDS = 8, 5
THRESHOLD = 0.5
#: More than 100 words: that many of a long item are no leak.
EXCERPT = 101
BLOCK_WORDS = 2_000_000
CALL = 1_000_000
#: Pairs of a long item among which seeds are chosen, and the items that have words for seeds instead of pairs.
CHUNK, SHORT = 32, 4
#: Leaks of all texts that are broadcast to the documents; more are joined by exchange.
FEW = 100_000
PUNCTUATION = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(PUNCTUATION).split()


def no_numbers() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Block:
    """Items in word numbers: all items' words in a row, and where each begins. seeds: sorted keys; first: where each
    one's places begin; item and at: the item of a place, and its word there; need: the seeds that a leak of an item holds."""

    vocabulary: dict[bytes, int]
    keys: list
    ids: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray = field(default_factory=no_numbers)
    first: np.ndarray = field(default_factory=no_numbers)
    item: np.ndarray = field(default_factory=no_numbers)
    at: np.ndarray = field(default_factory=no_numbers)
    need: np.ndarray = field(default_factory=no_numbers)

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1

    @property
    def words_too(self) -> bool:
        return bool((np.diff(self.bounds) < SHORT).any())

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, item and place of every word pair, or of every word where the item is short."""
        sizes = np.diff(self.bounds)
        item = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(item)) - self.bounds[item]
        short = sizes[item] < SHORT
        key = self.ids * np.int64(self.base) + np.where(short, 0, np.append(self.ids[1:], 0))
        kept = short | (at < sizes[item] - 1)
        return key[kept], item[kept], at[kept]

    def plant(self, grams: np.ndarray, documents: np.ndarray, threshold: float, min_words: int) -> None:
        """Makes the rarest pairs of each chunk seeds; documents: how many hold each of the sorted grams."""
        key, item, at = self.places()
        sizes = np.diff(self.bounds)
        spare = np.where(sizes >= min_words, 1 - threshold, 0.0)
        spoilt = np.floor(np.where(sizes < SHORT, sizes * spare, sizes * spare * 4 / 3) + 1e-9)
        pairs = np.where(sizes < SHORT, sizes, sizes - 1)
        self.need = np.clip(pairs - spoilt, 1, 2).astype(np.int64)
        chunk = item * (int(at.max(initial=0)) // CHUNK + 1) + at // CHUNK
        order = np.lexsort((at, documents[np.searchsorted(grams, key)], chunk))
        key, item, at, chunk = key[order], item[order], at[order], chunk[order]
        _, begin, count = np.unique(chunk, return_index=True, return_counts=True)
        rank = np.arange(len(chunk)) - np.repeat(begin, count)
        whole = np.repeat(count, count) + (sizes[item] >= SHORT)
        quota = np.floor(whole * spare[item] * np.where(sizes[item] < SHORT, 1, 4 / 3) + 1e-9) + self.need[item]
        chosen = rank < quota
        key, item, at = key[chosen], item[chosen], at[chosen]
        order = np.argsort(key, kind="stable")
        self.seeds, starts = np.unique(key[order], return_index=True)
        self.first, self.item, self.at = np.append(starts, len(key)), item[order], at[order]


def blocks_of(items: DataFrame, key: str, text: str, least_words: int, block_words: int) -> Iterator[Block]:
    """Blocks of about block_words words, read one partition of the items at a time."""
    vocabulary: dict[bytes, int] = {}
    keys, held, size = [], [], 0

    def block() -> Block:
        return Block(vocabulary, keys, np.concatenate(held), np.cumsum([0, *map(len, held)]))

    for row in items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        words = words_of(row["t"])
        if len(words) < max(1, least_words):
            continue
        keys.append(row["k"])
        held.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
        size += len(words)
        if size >= block_words:
            yield block()
            vocabulary, keys, held, size = {}, [], [], 0
    if held:
        yield block()


def numbered(texts: list[str], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row (0: no item has the word), and where each text begins, with a last end."""
    split = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter(map(vocabulary.get, chain.from_iterable(split), repeat(0)), np.int64, int(sizes.sum()))
    return ids, np.concatenate([[0], np.cumsum(sizes)])


def present(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted array, or -1."""
    if not len(among):
        return np.full(len(keys), -1)
    place = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[place] == keys, place, -1)


def known_grams(ids: np.ndarray, bounds: np.ndarray, block: Block, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts' word pairs (and words) that are among the sorted keys, and their numbers there. A pair's words are
    neighbours or have one word between them."""
    ends = np.zeros(len(ids) + 2, bool)
    ends[bounds] = True
    pair = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & ~ends[1 : len(ids)])
    parted = np.flatnonzero((ids[:-2] > 0) & (ids[2:] > 0) & ~ends[1 : len(ids) - 1] & ~ends[2 : len(ids)])
    at, key = np.append(pair, parted), np.append(ids[pair] * np.int64(block.base) + ids[pair + 1], ids[parted] * np.int64(block.base) + ids[parted + 2])
    if block.words_too:
        word = np.flatnonzero(ids)
        at, key = np.append(at, word), np.append(key, ids[word] * np.int64(block.base))
    number = present(key, among)
    return at[number >= 0], number[number >= 0]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps, row by row: (best score, start, end) within words."""
    columns = np.arange(len(words) + 1)
    score, start, best = np.zeros(len(words) + 1, np.int64), columns, (0, 0, 0)
    for w in item:
        with_word = score[:-1] + np.where(words == w, 2, -1)
        here, begin = score - 1, start.copy()
        better = np.flatnonzero(with_word >= here[1:])
        here[better + 1], begin[better + 1] = with_word[better], start[better]
        none = here <= 0
        here[none], begin[none] = 0, columns[none]
        run = np.maximum.accumulate(here + columns)
        begin = begin[np.maximum.accumulate(np.where(here + columns == run, columns, 0))]
        score, start = run - columns, begin
        k = int(score.argmax())
        if score[k] > best[0]:
            best = int(score[k]), int(start[k]), k
    return best


def shared_words(item: np.ndarray, words: np.ndarray) -> int:
    """Upper bound of the equal words in any alignment."""
    values, counts = np.unique(item, return_counts=True)
    place = present(words, values)
    return int(np.minimum(counts, np.bincount(place[place >= 0], minlength=len(values))).sum())


def best_alignment(ids: np.ndarray, begins: np.ndarray, places: np.ndarray, words: np.ndarray, need: int, least: float, excerpt: int) -> tuple[int, int, int]:
    """The best alignment of an item's words within a text; begins: where the item would begin by each of its seeds."""
    best = (0, 0, 0)
    reach = max(len(words), 2 * (len(words) - excerpt))  # a reported alignment can't hold more gaps, so it lies within reach of its seeds
    cuts = [0, *(np.flatnonzero(np.diff(begins) > reach) + 1).tolist(), len(begins)]
    for lo, hi in zip(cuts, cuts[1:]):
        if len(set(places[lo:hi].tolist())) < need:
            continue
        while lo < hi:  # a text that holds many copies in a row is aligned a stretch at a time
            upto = min(hi, int(np.searchsorted(begins, begins[lo] + 6 * reach, "right")))
            a, b = max(0, int(begins[lo]) - reach), min(len(ids), int(begins[upto - 1]) + len(words) + reach)
            if shared_words(words, ids[a:b]) >= least:
                score, start, end = align(words, ids[a:b])
                if score > best[0]:
                    best = score, a + start, a + end
            lo = upto
    return best


def leaks_of(texts: list[str], block: Block, threshold: float, min_words: int, excerpt: int) -> list[dict]:
    """Item key to (score, start, end), by text."""
    out: list[dict] = [{} for _ in texts]
    ids, bounds = numbered(texts, block.vocabulary)
    at, seed = known_grams(ids, bounds, block, block.seeds)
    count = block.first[seed + 1] - block.first[seed] if len(seed) else seed
    upto = np.cumsum(count)
    place = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(block.first[seed] - upto + count if len(seed) else seed, count)
    item, q = block.item[place], block.at[place]
    doc = np.searchsorted(bounds, np.repeat(at, count), "right") - 1
    begin = np.repeat(at, count) - q - bounds[doc]
    pair = doc * len(block.keys) + item
    order = np.lexsort((q, pair))
    new = np.append(True, (np.diff(pair[order]) != 0) | (np.diff(q[order]) != 0))[: len(order)]
    pairs, which = np.unique(pair[order][new], return_counts=True)  # different seeds of each pair
    open_pairs = pairs[which >= block.need[pairs % len(block.keys)]]
    order = np.lexsort((begin, pair))
    order = order[present(pair[order], open_pairs) >= 0]
    begin, q, pair = begin[order], q[order], pair[order]
    cuts = np.append(np.searchsorted(pair, open_pairs), len(pair)).tolist()
    for p, lo, hi in zip(open_pairs.tolist(), cuts, cuts[1:]):
        d, i = divmod(p, len(block.keys))
        words = block.ids[block.bounds[i] : block.bounds[i + 1]]
        least = threshold if len(words) >= min_words else 1.0
        score, start, end = best_alignment(ids[bounds[d] : bounds[d + 1]], begin[lo:hi], q[lo:hi], words, int(block.need[i]), min(least * len(words), excerpt), excerpt)
        share, key = score / (2 * len(words)), block.keys[i]
        if (share >= least or score >= 2 * excerpt) and share > out[d].get(key, (0.0,))[0]:
            out[d][key] = share, start, end
    return out


def holders(docs: DataFrame, text: str, shared: Broadcast) -> DataFrame:
    """(gram, documents): in how many rows each of the block's grams occurs; a task adds up its own rows first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grams = shared.value
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(list(map(len, texts)), CALL):
                ids, bounds = numbered(texts[a:b], block.vocabulary)
                at, number = known_grams(ids, bounds, block, grams)
                doc = np.searchsorted(bounds, at, "right") - 1
                total += np.bincount(np.unique(doc * len(grams) + number) % len(grams), minlength=len(grams))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("documents"))


def planted(docs: DataFrame, text: str, block: Block, threshold: float, min_words: int) -> Block:
    """The block with its seeds; what reaches the driver is a number for each of the block's pairs at most."""
    grams = np.unique(block.places()[0])
    shared = docs.sparkSession.sparkContext.broadcast((block, grams))
    found = holders(docs, text, shared).toPandas()
    shared.destroy()
    documents = np.zeros(len(grams), np.int64)
    documents[found["gram"].to_numpy(np.int64)] = found["documents"].to_numpy(np.int64)
    block.plant(grams, documents, threshold, min_words)
    return block


def leaks(text: Column, shared: Broadcast, kind, threshold: float, min_words: int, excerpt: int) -> Column:
    """The block's items that leaked into each text, by item key."""
    parts = pa.struct([("item_id", to_arrow_type(kind)), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(leaks_type(kind))
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = shared.value
        for batch in batches:
            texts, rows = [t or "" for t in batch.to_pylist()], []
            for a, b in slices(list(map(len, texts)), CALL):
                rows += [[{"item_id": i, "score": s, "start": x, "end": y} for i, (s, x, y) in sorted(hit.items())] for hit in leaks_of(texts[a:b], block, threshold, min_words, excerpt)]
            yield pa.array(rows, pa.list_(parts))

    return search(text)


def leaks_type(kind) -> str:
    return f"array<struct<item_id:{kind.simpleString()},score:double,start:int,end:int>>"


def in_turn(docs: DataFrame, text: str, first: Block, rest: Iterator[Block], kind, threshold: float, min_words: int, excerpt: int) -> DataFrame:
    """(mark, leaks) of the texts with leaks: block by block, none held longer than its own search."""
    name, found = F.col(f"`{text}`"), None
    for block in chain([first], rest):
        shared = docs.sparkSession.sparkContext.broadcast(planted(docs, text, block, threshold, min_words))
        hits = docs.select(mark_of(name).alias("mark"), leaks(name, shared, kind, threshold, min_words, excerpt).alias("leaks")).where(F.size("leaks") > 0)
        hits = cut_lineage(hits.dropDuplicates(["mark"]).select("mark", F.explode("leaks").alias("leak")))
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    # the best of a repeated item key, as its copies can lie in two blocks
    best = found.groupBy("mark", "leak.item_id").agg(F.max(F.struct("leak.score", (-F.col("leak.start")).alias("back"), "leak.end")).alias("b"))
    leak = F.struct("item_id", "b.score", (-F.col("b.back")).alias("start"), "b.end")
    return cut_lineage(best.groupBy("mark").agg(F.sort_array(F.collect_list(leak)).alias("leaks")))


def mark_of(text: Column) -> Column:
    """Tells texts apart: two hashes and the length."""
    return F.struct(F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), F.octet_length(text).alias("n"))


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", into: str = "leaks", threshold: float = THRESHOLD, min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS, excerpt: int = EXCERPT) -> DataFrame:
    """Adds the array of leaked items (item_id, score, start and end in words) to every row."""
    own, kind, name = [F.col(f"`{c}`") for c in docs.columns if c != into], items.schema[item_key].dataType, F.col(f"`{text}`")
    blocks = blocks_of(items, item_key, item_text, least_words, block_words)
    first, second = next(blocks, None), next(blocks, None)
    none = F.array().cast(leaks_type(kind))
    if first is None:
        return docs.select(*own, none.alias(into))
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(planted(docs, text, first, threshold, min_words))
        return docs.select(*own, leaks(name, shared, kind, threshold, min_words, excerpt).alias(into))
    found = in_turn(docs, text, first, chain([second], blocks), kind, threshold, min_words, excerpt)
    few = (found.agg(F.sum(F.size("leaks"))).first()[0] or 0) <= FEW
    found = found.select(F.col("mark").alias("found mark"), F.col("leaks").alias("found leaks"))
    joined = docs.join(F.broadcast(found) if few else found, mark_of(name) == F.col("found mark"), "left")
    return joined.select(*own, F.coalesce("found leaks", none).alias(into))
