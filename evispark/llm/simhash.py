"""SimHash near-duplicates with covering locality-sensitive hashing.

A text's fingerprint holds, for each of 64 bits, whether most of its word shingles' hashes set it. Texts link
when their fingerprints differ in at most ``radius`` bits, and a component is all that links reach.

Search: each bit gets a random code of radius + 1 bits. Table v (one for each non-zero v of radius + 1 bits)
keeps the bits whose code has an odd number of ones in common with v. Any radius differing bits give radius
homogeneous equations over GF(2) in radius + 1 unknowns, so some v other than zero leaves all of them out: every
pair within the radius agrees on the kept bits of some table. Only distinct fingerprints are searched. Those that agree in a table meet in one
sorted run; a run is linked by a breadth-first walk that gives a spanning forest instead of all pairs, and runs
above ``run_limit`` are dealt out as pairs of blocks, so none is held whole by one task and no link is lost.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer words than a shingle make one
shingle; a text without words (or null) has fingerprint zero and links like any other; repeated rows share a
component; columns with the names of results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.session import cut_lineage, gathered

SHINGLE = 4
RADIUS = 4
RUN_LIMIT = 50_000
SEED = 42
#: Keys with more than this part of a table's rows are joined by broadcast, and the least number of rows for that.
HOT_SHARE, HOT_ROWS = 500, 300
#: Crowded runs that are broadcast.
FEW = 100_000


def fingerprint_of(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    hashes = map(xxhash.xxh64_digest, grams, repeat(SEED))
    ones, n = np.zeros(64, np.int64), 0
    while part := b"".join(islice(hashes, 65_536)):  # bounded memory for very long texts
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t or b"", shingle) for t in batch.cast(pa.large_binary()).to_pylist()], pa.int64())

    return hashed(text)


def tables(radius: int, seed: int = 7) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables, as signed 64-bit numbers."""
    codes = np.random.default_rng(seed).integers(0, 1 << (radius + 1), 64)
    kept = ([bin(int(c) & v).count("1") % 2 == 1 for c in codes] for v in range(1, 1 << (radius + 1)))
    return [int.from_bytes(np.packbits(k).tobytes(), "big", signed=True) for k in kept]


def forest(run: np.ndarray, split: int, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect all that links within a run connect; with split, only links across run[:split] and run[split:]."""
    ones = lambda a, b: np.bitwise_count(a ^ b) <= radius
    left, right = [], []
    if not split:
        rest = run
        while len(rest) > 1:
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                at = todo.pop()
                near = ones(rest, at)
                if near.any():
                    new, rest = rest[near], rest[~near]
                    left.append(np.full(len(new), at))
                    right.append(new)
                    todo.extend(new)
        return left, right
    free, other = run[:split], run[split:]
    left_rest, right_rest = free, other
    while len(left_rest) and len(right_rest):  # a walk that changes sides with each step
        todo, left_rest = [(0, left_rest[0])], left_rest[1:]
        while todo:
            side, at = todo.pop()
            rest = left_rest if side else right_rest
            near = ones(rest, at)
            new = rest[near]
            if side:
                left_rest = rest[~near]
            else:
                right_rest = rest[~near]
            if len(new):
                left.append(np.full(len(new), at))
                right.append(new)
                todo.extend((1 - side, x) for x in new)
    return left, right


def linked(radius: int):
    """Over partitions sorted by run and side: the forest of each run. Only the current run is held."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, sides = None, [], []
        out: list[pa.RecordBatch] = []

        def close() -> None:
            run = np.concatenate(parts)
            if len(run) > 1:
                side = np.concatenate(sides)
                split = int((side == 0).sum())
                pairs = forest(run, 0 if split == len(run) else split, radius)
                if pairs[0]:
                    a, b = map(np.concatenate, pairs)
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["a", "b"]))

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("t", "k", "left", "right")])
            if not len(keys):
                continue
            fp, side = batch.column("fp").to_numpy().view(np.uint64), batch.column("side").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(keys[lo].tolist())
                if now != key:
                    if key is not None and sum(map(len, parts)) > 1:
                        close()
                    key, parts, sides = now, [], []
                parts.append(fp[lo:hi])
                sides.append(side[lo:hi])
            yield from out
            out.clear()
        if key is not None:
            close()
        yield from out

    return walk


def with_crowds(keyed: DataFrame, crowded: DataFrame) -> DataFrame:
    """keyed with the size n of each crowded run, null for others.

    Up to FEW crowded runs are broadcast. More are joined by exchange, but for the hot ones, which join_keyed bounds.
    """
    if (runs := crowded.count()) <= FEW:
        return keyed.join(F.broadcast(crowded), ["t", "k"], "left")
    shares = max(HOT_SHARE, 2 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = crowded.agg(F.sum("n")).first()[0] // min(runs, shares)  # so many runs can be larger at most
    hot = F.broadcast(crowded.where(F.col("n") > limit))
    rest = keyed.join(hot.select("t", "k"), ["t", "k"], "left_anti").join(crowded.where(F.col("n") <= limit), ["t", "k"], "left")
    return keyed.join(hot, ["t", "k"]).unionByName(rest)


def links(fingerprints: DataFrame, radius: int = RADIUS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect exactly what links within radius connect."""
    masks = F.array(*[F.lit(m).cast("long") for m in tables(radius)])
    keyed = fingerprints.select("fp", F.posexplode(masks).alias("t", "m")).select("fp", F.col("t").cast("short").alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("k"))
    crowded = cut_lineage(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > run_limit))
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / run_limit).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("left"), F.greatest("own", j).alias("right")))
    dealt = (
        with_crowds(keyed, crowded)
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("fp", "t", "k", "own", F.explode(pairs).alias("p"))
        .select("fp", "t", "k", "p.left", "p.right", (F.col("own") != F.col("p.left")).cast("byte").alias("side"))
    )
    sorted_runs = dealt.repartition("t", "k", "left", "right").sortWithinPartitions("t", "k", "left", "right", "side")
    return sorted_runs.mapInArrow(linked(radius), "a bigint, b bigint").distinct()


def join_keyed(rows: DataFrame, lookup: DataFrame, key: str, total: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows joined to a lookup with one row per key and ``n``, the number of rows that have the key (dropped unless kept).

    A key is hot with more than its share of ``total`` rows: HOT_SHARE of them, or two for each shuffle partition where
    that is more, and HOT_ROWS at least. So hot keys are no more than that, their part of the lookup is broadcast and
    their rows stay where they are; all other keys meet in a shuffled join.
    """
    shares = max(HOT_SHARE, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit, gone = max(HOT_ROWS, total // shares), [] if "n" in keep else ["n"]
    hot = F.broadcast(lookup.where(F.col("n") > limit).drop(*gone))
    cold = lookup.where(F.col("n") <= limit).drop(*gone)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node that links reach.

    Alternating large-star and small-star rounds until one changes nothing; each is written to the shared checkpoint
    folder. The hub of a large component has most of its edges, so hubs' rows are joined apart. A round takes as many tasks
    as its edges are worth, so that many rounds over few edges don't fill the disk with small files.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b"))
    total, mark = edges.count(), None
    while True:
        edges = gathered(edges, total)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_keyed(both, least, "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = gathered(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), total)
        down = cut_lineage(gathered(large.distinct(), total))
        below = down.count()
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_keyed(down, least, "a", below).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
        edges = cut_lineage(gathered(gathered(small.where("a <> b"), 2 * below).distinct(), 2 * below))
        total, now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (total, now) == mark:
            break
        mark = total, now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row (key, fp, component_id) per row of docs; component_id is the smallest key reachable over links.

    Rows with a null key take part and count as larger than all others. Text leaves its partition only as
    fingerprints; equal fingerprints are merged before anything is compared.
    """
    fps = cut_lineage(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), radius, run_limit))
    named = cut_lineage(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut_lineage(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    labels = join_keyed(named, least, "root", named.count()).select("fp", "component_id")
    labels = cut_lineage(labels.join(fps.groupBy("fp").agg(F.count("*").alias("n")), "fp"))
    return join_keyed(fps, labels, "fp", fps.count()).select(F.col("doc_id").alias(key), "fp", "component_id")
