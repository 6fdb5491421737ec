"""Near copies by Jaccard similarity: MinHash candidates, then an exact check of the shingle sets.

A text is the set of its ``shingle``-word runs, each a 64-bit hash; two texts link when their sets' Jaccard
similarity is ``threshold`` at least, and a component is all that links reach. Equal sets are merged first.

Search: SimHash fingerprints of the same runs are linked within operator 7's radius by its covering search, and sets
whose fingerprints that connects share a key (``print_keys``). At similarity 0.8 fingerprints differ in about ten of
64 bits, and covering the radius that holds nearly all such pairs takes 2^19 tables (the README has the figures), so
minima widen the search: ``BANDS`` keys of ``ROWS`` minima each put a pair of similarity 0.8 under a common key with
probability 0.9999 (more similar pairs surely). Sets under a key are joined to its smallest, and what that connects is
a candidate group, whatever the similarity within it. The groups' full sets then meet, and their links are decided
exactly by breadth-first walks. A group with more than ``block`` shingles is dealt out in blocks, each with a copy of
the group's smallest set, the pivot. Sets that a walk within their block joins to the pivot are connected by that;
only the loose ones then meet every block of the group, so a large group of true copies is compared in time linear
in its size, no task holds more than two blocks and no link is lost.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer words than a shingle make one
shingle; texts without words (or null) are copies of each other; repeated rows share a component; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.arrow import encoded, let_go, slices
from evispark.llm.simhash import RADIUS, components, fingerprint_of, join_keyed, links
from evispark.session import cut_lineage, gathered

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 50, 8
#: Shingles of a group that meet in one task; a block holds one set at least.
BLOCK = 20_000
#: Rows of a lookup that are sent to the texts (some 60 bytes each); where there are more, texts are exchanged.
FEW = 500_000
#: Bytes of text whose minima are taken together.
CALL = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each run of n word numbers."""
    key = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        key = (key ^ ids[k : k + len(key)].astype(np.uint64)) * MIX
        key ^= key >> np.uint64(29)
    return key


def shingles_of(text: bytes, shingle: int) -> np.ndarray:
    """The sorted hashes of the different shingles."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(gram_keys(hashes, min(shingle, len(words)))) if words else hashes


def identity(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a set; zero for the empty one."""
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes()), "big", signed=True) if len(hashes) else 0


def band_keys(sets: list[np.ndarray], seed: int = 5) -> np.ndarray:
    """The keys of sets that aren't empty, one row for each."""
    rng = np.random.default_rng(seed)
    factors, terms = rng.integers(0, 1 << 32, (2, BANDS, ROWS), np.uint32)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for band in range(BANDS):
        keys[band] = band + 1
        for a, b in zip(factors[band] | np.uint32(1), terms[band]):
            least = np.minimum.reduceat(values * a + b, starts)
            keys[band] = (keys[band] ^ least.astype(np.uint64)) * MIX
            keys[band] ^= keys[band] >> np.uint64(29)
    return keys.T.copy().view(np.int64)


def signature(text: Column, shingle: int) -> Column:
    """struct of the set's id, its size, operator 7's fingerprint of the text and the set's band keys."""

    @F.arrow_udf("struct<id:bigint,size:bigint,fp:bigint,keys:array<bigint>>")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for batch in batches:
            ids, sizes, prints, keys = [], [], [], [np.zeros(0, np.int64)]
            for a, b in slices(pc.fill_null(pc.binary_length(batch), 0).to_pylist(), CALL):
                texts = encoded(batch.slice(a, b - a))
                sets = [shingles_of(t, shingle) for t in texts]
                ids += map(identity, sets)
                sizes += map(len, sets)
                prints += [fingerprint_of(t, shingle) for t in texts]
                if some := [s for s in sets if len(s)]:
                    keys.append(band_keys(some).ravel())
            ends = np.cumsum([0, *(BANDS if n else 0 for n in sizes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), lists], ["id", "size", "fp", "keys"])

    return signed(text)


def joined_in_place(rows: DataFrame, lookup: DataFrame, n: int, keys: list[str], how: str = "inner") -> DataFrame:
    """rows (which hold texts) joined to a lookup of n rows: where they lie, if those are few enough to be sent to them."""
    return rows.join(F.broadcast(lookup), keys, how) if n <= FEW else rows.hint("merge").join(lookup, keys, how)


def shingle_bytes(text: Column, shingle: int) -> Column:
    @F.arrow_udf("binary")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles_of(t, shingle).tobytes() for t in encoded(batch)], pa.binary())

    return listed(text)


def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over partitions sorted by key and id: each run's smallest id with every other."""
    last = None
    for batch in batches:
        ids, keys = (batch.column(c).to_numpy() for c in ("id", "k"))
        if not len(ids):
            continue
        if last:
            ids, keys = np.append(last[0], ids), np.append(last[1], keys)
        new = np.append(True, keys[1:] != keys[:-1])
        head = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
        last = head[-1], keys[-1]
        other = head != ids
        yield pa.RecordBatch.from_arrays([pa.array(head[other]), pa.array(ids[other])], names=["a", "b"])


def exact_links(sets: list[np.ndarray], threshold: float) -> tuple[list[tuple[int, int]], int]:
    """Places of pairs that connect all that pairs at the threshold connect, and how many of them reach the first set."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]  # by value
    last = np.cumsum(np.bincount(place, minlength=len(values)))
    first = np.append(0, last[:-1])
    out, rest, reached = [], np.ones(len(sets), bool), 0
    for start in range(len(sets)):
        todo = [start] if rest[start] else []
        rest[start] = False
        while todo and rest.any():
            at = todo.pop()
            mine = place[ends[at] - sizes[at] : ends[at]]
            count = last[mine] - first[mine]
            upto = np.cumsum(count)
            shared = np.bincount(holders[np.arange(upto[-1]) + np.repeat(first[mine] - upto + count, count)], minlength=len(sets))
            near = np.flatnonzero(rest & (shared / (sizes + sizes[at] - shared) >= threshold)).tolist()
            rest[near] = False
            out += [(at, x) for x in near]
            todo += near
        reached = reached or len(out) if start == 0 else reached
    return out, reached


def decided(threshold: float):
    """Over partitions sorted by root, left and right: the links (a < b) of each run, and (a, a) for each set that is
    not joined to the run's first one. Only the current run is held."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def links() -> pa.RecordBatch:
            found, reached = exact_links(sets, threshold)
            pairs = [(ids[a], ids[b]) for a, b in found]
            pairs += [(x, x) for x in set(ids) - {ids[0]} - {ids[b] for _, b in found[:reached]}]
            return pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.int64()) for f in (min, max)], names=["a", "b"])

        for batch in batches:
            for root, left, right, at, hashes in zip(*[batch.column(c).to_pylist() for c in ("root", "left", "right", "id", "hashes")]):
                if (root, left, right) != key:
                    if len(ids) > 1:
                        yield links()
                    key, ids, sets = (root, left, right), [], []
                ids.append(at)
                sets.append(np.frombuffer(hashes, np.uint64))
        if len(ids) > 1:
            yield links()

    return walk


def compared(sets: DataFrame, threshold: float) -> DataFrame:
    """decided() over rows (id, hashes, root, left, right), each run's root first."""
    runs = sets.repartition("root", "left", "right").sortWithinPartitions("root", "left", "right", F.col("id") != F.col("root"))
    return runs.select("root", "left", "right", "id", "hashes").mapInArrow(decided(threshold), "a bigint, b bigint")


def upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def exact(docs: DataFrame, text: str, shingle: int, threshold: float, block: int, groups: DataFrame) -> DataFrame:
    """The links within candidate groups: (node, root, size, place) for every set that is in one; place: a text that has it."""
    whole = groups.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / block).cast("int").alias("blocks"))
    total = groups.count()
    members = join_keyed(groups, cut_lineage(whole), "root", total, keep=("n",))
    members = members.select(F.col("node").alias("id"), "place", "root", "size", "n", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("left"))
    named = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("place"), F.col(f"`{text}`").alias("text"))
    texts = joined_in_place(named, cut_lineage(members), total, ["place"]).drop("place").dropDuplicates(["id"])
    sets = cut_lineage(texts.withColumn("hashes", shingle_bytes(F.col("text"), shingle)).drop("text"))
    own = sets.where("id <> root").select("id", "hashes", "root", "left", F.lit(0).alias("right"))
    pivots = sets.where("id = root").select("id", "hashes", "root", upto("blocks").alias("left"), F.lit(0).alias("right"))
    first = cut_lineage(compared(own.unionByName(pivots), threshold).distinct())
    loose = first.where("a = b").select(F.col("a").alias("id")).join(sets.where("blocks > 1"), "id")
    parts = cut_lineage(loose.groupBy("root").agg(F.ceil(F.sum("size") / block).cast("int").alias("parts"), F.first("n").alias("n")))
    held = join_keyed(sets.select("id", "hashes", "root", "left"), parts, "root", total).select("id", "hashes", "root", "left", upto("parts").alias("right"))
    moved = join_keyed(loose.select("id", "hashes", "root", "blocks"), parts, "root", total)
    moved = moved.select("id", "hashes", "root", upto("blocks").alias("left"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("right"))
    second = compared(held.unionByName(moved.select(*held.columns)), threshold)
    return first.unionByName(second).where("a <> b").distinct()


def print_keys(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, k): sets whose fingerprints are in one component of operator 7's links share a key. rows: (id, size, fp)."""
    prints = cut_lineage(rows.where("size > 0").select("id", "fp").distinct())
    total = prints.count()
    prints = gathered(prints, total)
    held = cut_lineage(gathered(prints.groupBy("fp").agg(F.count("*").alias("n")), total))
    roots = components(links(held.select("fp"), radius))
    labels = cut_lineage(gathered(held.join(roots, held.fp == roots.node, "left").select("fp", "n", F.xxhash64(F.coalesce("root", "fp")).alias("k")), total))
    return join_keyed(prints, labels, "fp", total).select("id", "k")


def set_labels(docs: DataFrame, text: str, key: str, shingle: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, place, id) of every row, place being a hash of its text, and (id, first, root, n) of every set: the
    smallest (doc_id, place) of its component, nulls last, and the component's number of sets."""
    own = F.col(f"`{text}`")
    signed = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(own).alias("place"), signature(own, shingle).alias("s"))
    rows = cut_lineage(signed.select("doc_id", "place", "s.id", "s.size", "s.fp", "s.keys"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")
    distinct = cut_lineage(rows.groupBy("id").agg(F.min(row).alias("first"), F.first("size").alias("size")))
    keyed = rows.select("id", "keys").dropDuplicates(["id"]).select("id", F.explode("keys").alias("k")).unionByName(print_keys(rows))
    edges = keyed.repartition("k").sortWithinPartitions("k", "id").mapInArrow(starred, "a bigint, b bigint").distinct()
    groups = components(edges).join(distinct.select(F.col("id").alias("node"), "size", "first.place"), "node")
    roots = components(exact(docs, text, shingle, threshold, block, cut_lineage(groups)))
    named = cut_lineage(distinct.join(roots, distinct.id == roots.node, "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    return rows.select("doc_id", "place", "id"), named


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row (key, component_id) per row of docs; component_id is the smallest key reachable over links.

    Rows with a null key take part and count as larger than all others.
    """
    rows, named = set_labels(docs, text, key, shingle, threshold, block)
    least = cut_lineage(named.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n")))
    labels = join_keyed(named.drop("first"), least, "root", named.count()).select("id", F.col("first.doc_id").alias("component_id"))
    copies = rows.groupBy("id").agg(F.count("*").alias("n"))
    labels = cut_lineage(labels.join(copies, "id"))
    return join_keyed(rows, labels, "id", rows.count()).select(F.col("doc_id").alias(key), "component_id")


def unlike(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay: one of each component, with the smallest key and, of rows that share it, the smallest
    xxhash64 of the text; and all rows with a null key, as those can't be told apart.

    The rows that go are told by key and hash. If they are few enough they are dropped where they lie; of rows that are equal in
    both, all but one go, and only such rows are exchanged. With more, texts are exchanged once.
    """
    rows, named = set_labels(docs, text, key, shingle, threshold, block)
    first = named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.place")
    pairs = cut_lineage(rows.where("doc_id IS NOT NULL").groupBy("doc_id", "place").agg(F.count("*").alias("n")))
    gone = cut_lineage(pairs.join(first, ["doc_id", "place"], "left_anti").select("doc_id", "place"))
    twice = cut_lineage(pairs.where("n > 1").join(first, ["doc_id", "place"], "left_semi").select("doc_id", "place"))
    placed = docs.withColumns({"doc_id ": F.col(f"`{key}`"), "place ": F.xxhash64(F.col(f"`{text}`"))})
    spaced = lambda pairs: pairs.toDF("doc_id ", "place ")  # noqa: E731  names that docs don't have
    on, own = ["doc_id ", "place "], [F.col(f"`{c}`") for c in docs.columns]
    kept = joined_in_place(placed, spaced(gone), gone.count(), on, "left_anti")
    repeated = twice.count()
    if not repeated:
        return kept.select(*own)
    single = joined_in_place(kept, spaced(twice), repeated, on, "left_anti")
    one = joined_in_place(kept, spaced(twice), repeated, on, "left_semi").dropDuplicates(on)
    return single.select(*own).unionByName(one.select(*own))
