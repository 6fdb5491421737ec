"""Vector codes: product quantisation whose codebooks are trained by Lloyd rounds with Elkan's bounds.

Components become integers, ``floor(scale * x)``, and vectors are cut into equal parts. Each part position has a codebook,
which starts as that part of the first vectors in order of their key. A round assigns every part to its nearest
entry and replaces each entry by the floor of its parts' mean.

Between rounds each row's parts keep their entry, an upper bound of the distance to it and a lower bound of the
distance to each entry. When entries move, a bound is shifted by the way its entry moved. An entry is left out only
where a bound says *strictly* that it is farther than the present one (its lower bound above the upper bound, or the
half distance of the two entries above it); all others are compared by their exact integer squared distances, ties
going to the lower index. So codes are those of a full search.

The bounds are stored beside the vectors in the folder that all executors share, a generation for each round, of
which the one before goes when the next is written. A lower bound takes half a byte: zero, or the upper bound and a
number of twelfths of it, rounded down. Only codebooks (a bounded model) and their sums pass through the driver; the sums
are made in each task first.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped, and so are those whose
length differs from the first kept vector's or can't be cut into equal parts; components beyond the bound that keeps
distances within 64 bits (some 185,000 for 64 components) count as that bound; null keys stand last in the order and
equal keys are ordered by their vectors; with fewer rows than entries a codebook has as many entries as rows; an
empty table gives an empty table and empty codebooks. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.columns import at, by_place
from evispark.llm.simhash import join_keyed
from evispark.session import cut_lineage, remove, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are compared at once, and the steps of a stored lower bound to the upper bound.
ROWS, TWELFTHS, LEVELS = 2048, 12, 15
#: What bounds are widened by, so that no rounding of distances makes one too tight.
SLACK = 1e-6
STATE = "key_ {key}, label_ {label}, v array<int>, code binary, upper binary, lower binary"


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def up(d: np.ndarray) -> np.ndarray:
    return d * (1 + SLACK)


def down(d: np.ndarray) -> np.ndarray:
    return d * (1 - SLACK)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def all_squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * int(most) ** 2 * max(1, x.shape[1]) < 1 << 53:  # whole numbers that doubles hold
        a, b = x.astype(float), book.astype(float)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    return np.stack([squared(x, entry[None]) for entry in book], 1)


def first_assignment(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds) of each row, by a full search."""
    d = all_squared(x, book)
    code = d.argmin(1)  # the first of ties
    roots = np.sqrt(d)
    return code, up(roots[np.arange(len(x)), code]), down(roots)


class Elkan:
    """The next assignment to a part's codebook that has moved, from what is known of the one before."""

    def __init__(self, before: np.ndarray, book: np.ndarray):
        self.book, self.moved = book, up(np.sqrt(squared(before, book)))
        self.half = down(np.sqrt(all_squared(book, book)) / 2)
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(1, initial=np.inf)
        self.compared = 0

    def __call__(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, upper, lower = code.copy(), up(upper + self.moved[code]), down(np.maximum(lower - self.moved, 0))
        open_ = np.flatnonzero(~(upper < self.nearest[code]))
        if not len(open_):
            return code, upper, lower
        own = code[open_]
        best = squared(x[open_], self.book[own])
        upper[open_] = up(np.sqrt(best))
        reach = upper[open_, None]
        near = ~((lower[open_] > reach) | (self.half[own] > reach))
        near[np.arange(len(own)), own] = False
        row, entry = np.nonzero(near)
        self.compared += len(own) + len(row)
        if len(row):
            d = squared(x[open_[row]], self.book[entry])
            lower[open_[row], entry] = down(np.sqrt(d))
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            rows, least = row[starts], np.minimum.reduceat(d, starts)
            is_least = np.flatnonzero(d == np.repeat(least, np.diff(np.append(starts, len(row)))))
            where = entry[is_least[np.searchsorted(is_least, starts)]]  # the first entry of each row that is least
            better = (least < best[rows]) | ((least == best[rows]) & (where < own[rows]))
            rows, least, where = rows[better], least[better], where[better]
            lower[open_[rows], own[rows]] = down(np.sqrt(best[rows]))
            code[open_[rows]], upper[open_[rows]] = where, up(np.sqrt(least))
        return code, upper, lower


def packed(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper bounds as 32-bit numbers, two lower bounds a byte), none of them tighter than it was."""
    upper = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
    wide = upper.astype(float)[:, None]
    steps = np.floor((lower - wide) / np.maximum(wide, 1) * TWELFTHS) + 1
    steps = np.clip(np.nan_to_num(steps), 0, LEVELS).astype(np.uint8)
    if steps.shape[1] % 2:
        steps = np.pad(steps, ((0, 0), (0, 1)))
    return upper, steps[:, ::2] << 4 | steps[:, 1::2]


def unpacked(upper: np.ndarray, packed_lower: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    wide = upper.astype(float)
    steps = np.stack([packed_lower >> 4, packed_lower & 15], 2).reshape(len(upper), -1)[:, :entries]
    lower = wide[:, None] + (steps - 1.0) / TWELFTHS * np.maximum(wide, 1)[:, None]
    return wide, np.where(steps > 0, down(lower), 0.0)


def vectors_of(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """Rows by part and position."""
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(len(batch), parts, width)


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def bytes_of(column: pa.Array, kind: type, rows: int, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, *shape)


def assigned(books: np.ndarray, before: np.ndarray | None):
    """Over rows (key_, label_, v) or rows with the state of the round before: the state of this one."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = None if before is None else [Elkan(a, b) for a, b in zip(before, books)]
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole.slice(start, ROWS)
                n, x = len(batch), vectors_of(batch, parts, width)
                if steps:
                    code = bytes_of(batch.column("code"), np.uint8, n, parts)
                    upper = bytes_of(batch.column("upper"), np.float32, n, parts)
                    lower = bytes_of(batch.column("lower"), np.uint8, n, parts, -1)
                    found = [steps[p](x[:, p], code[:, p].astype(int), *unpacked(upper[:, p], lower[:, p], entries)) for p in range(parts)]
                else:
                    found = [first_assignment(x[:, p], books[p]) for p in range(parts)]
                bounds = [packed(u, low) for _, u, low in found]
                columns = [np.stack([c for c, _, _ in found], 1).astype(np.uint8), np.stack([u for u, _ in bounds], 1), np.concatenate([low for _, low in bounds], 1)]
                yield pa.RecordBatch.from_arrays([batch.column("key_"), batch.column("label_"), batch.column("v"), *map(fixed, columns)], names=["key_", "label_", "v", "code", "upper", "lower"])

    return run


def finished(books: np.ndarray, before: np.ndarray | None):
    """As assigned, with the exact error of the codes in place of the state."""
    states = assigned(books, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in states(batches):
            x, code = vectors_of(batch, len(books), books.shape[2]), bytes_of(batch.column("code"), np.uint8, len(batch), len(books))
            error = sum(squared(x[:, p], books[p][code[:, p]]) for p in range(len(books)))
            yield pa.RecordBatch.from_arrays([batch.column("key_"), batch.column("label_"), batch.column("code"), pa.array(error, pa.int64())], names=["key_", "label_", "code", "error"])

    return run


def sums(parts: int, entries: int, width: int):
    """Over rows (v, code): for each used entry of each part the number and the sum of its parts, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = vectors_of(batch, parts, width)
            at_ = (bytes_of(batch.column("code"), np.uint8, len(batch), parts) + np.arange(parts) * entries).ravel()
            np.add.at(total, at_, x.reshape(len(at_), width))
            n += np.bincount(at_, minlength=parts * entries)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["entry", "n", "s"])

    return run


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry replaced by the floor of its parts' mean."""
    parts, entries, width = books.shape
    held = state.select("v", "code").mapInArrow(sums(parts, entries, width), "entry bigint, n bigint, s array<bigint>")
    counts = dict(held.groupBy("entry").agg(F.sum("n")).collect())  # an entry each
    whole = held.select("entry", F.posexplode("s").alias("pos", "s")).groupBy("entry", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = books.reshape(parts * entries, width).copy()
    for entry, pos, s in whole.collect():  # a component each
        new[entry, pos] = int(s) // counts[entry]
    return new.reshape(books.shape)


def whole_numbers(vectors: DataFrame, embedding: str, key: str, label: str, scale: int) -> DataFrame:
    """(key_, label_, v) of the rows that have a vector of finite components; v as 64-bit integers."""
    held = by_place(vectors).select(at(vectors, key).alias("key_"), at(vectors, label).alias("label_"), at(vectors, embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return held.where(F.col("e").isNotNull() & finite).select("key_", "label_", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def compress(
    vectors: DataFrame, embedding: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks): rows hold key, label, ``code`` (a byte for each part) and ``error``, the squared distance to it."""
    spark, own = vectors.sparkSession, uuid.uuid4()
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte, so a codebook has 1 to 256 entries")
    ordered = [F.asc_nulls_last("key_"), "v"]
    numbers = whole_numbers(vectors, embedding, key, label, scale).where(F.size("v") % parts == 0)
    head = numbers.orderBy(*ordered).limit(1).select(F.size("v")).first()
    width = head[0] if head else 0
    bound = math.isqrt(((1 << 63) - 1) // (4 * max(1, width)))
    held = F.transform("v", lambda x: F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)).cast("int"))
    rows = numbers.where(F.size("v") == width).withColumn("v", held)
    first = [r.v for r in rows.orderBy(*ordered).select("v").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    names = {"key": rows.schema["key_"].dataType.simpleString(), "label": rows.schema["label_"].dataType.simpleString()}
    state, before, folder = rows, None, f"{shared_dir(spark)}/vector-codes-{own}"
    for number in range(rounds if first else 0):
        state.mapInArrow(assigned(books, before), STATE.format(**names)).write.option("compression", "zstd").parquet(f"{folder}/{number}")
        state = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
        before, books = books, moved(state, books)
    coded = state.mapInArrow(finished(books, before), "key_ {key}, label_ {label}, code binary, error bigint".format(**names))
    coded = cut_lineage(coded)
    remove(spark, folder)
    return coded.select(F.col("key_").alias(key), F.col("label_").alias(label), "code", "error"), Codebooks(books)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_error``: the errors summed over equal labels, nulls together; null beyond 64 bits. A label of very many
    rows is summed in each task first, and its rows stay where they are."""
    keyed = coded.withColumn("group_", F.coalesce(F.concat(F.lit("="), F.col(f"`{label}`").cast("string")), F.lit("")))
    total = cut_lineage(keyed.groupBy("group_").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    rows = total.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_keyed(keyed, total, "group_", rows).drop("group_")
