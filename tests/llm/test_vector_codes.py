import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from evispark.llm import vector_codes
from evispark.session import exists, shared_dir

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4, parts=4):
    """(rows (vec_id, code, error, label_error), digest) with Python's whole numbers and a full search."""
    kept = [(k, [math.floor(x * 1024) for x in e], lab) for k, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == width * parts]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    codes = lambda: [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        now = codes()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, now) if code[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    now = codes()
    errors = [sum(dist(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, now)]
    by_label = defaultdict(int)
    for (_, _, lab), err in zip(kept, errors):
        by_label[lab] += err
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(k, bytes(code).hex(), err, by_label[lab]) for (k, _, lab), code, err in zip(kept, now, errors)], digest


def checked(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    stored = [(r.vec_id, r.embedding, r.label) for r in docs.collect()]  # as 32-bit numbers
    coded, books = vector_codes.compress(docs, **options)
    got = [(r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in vector_codes.with_label_error(coded).collect()]
    want, digest = brute(stored, **options)
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert books.sha256() == digest
    return got


@pytest.mark.parametrize("entries,width", [(16, 8), (7, 12), (256, 16)])
def test_equals_a_full_search(spark, entries, width):
    rng = np.random.default_rng(entries)
    centres = rng.normal(size=(9, width))
    rows = [(int(k), (centres[k % 9] * 0.2 + rng.normal(size=width) * 0.05).tolist(), int(k % 3) if k % 5 else None) for k in rng.permutation(300)]
    checked(spark, rows, entries=entries)


def test_ties_go_to_the_lower_entry(spark):
    """Few values a component: most distances are shared by several entries, and many entries are equal."""
    rng = np.random.default_rng(1)
    rows = [(k, (rng.integers(-1, 2, 8) / 1024).tolist(), 0) for k in range(200)]
    checked(spark, rows, entries=40)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.5] * 8, 1), (1, [0.25, -0.25] * 4, None), (2, None, 1), (3, [None] + [0.0] * 7, 1), (4, [nan] + [0.0] * 7, 2), (6, [inf] + [0.0] * 7, 2), (7, [-inf] * 8, None),
        (8, [0.1] * 4, 1), (9, [], 1), (10, [0.1] * 12, 1), (None, [0.125] * 8, None), (5, [0.5] * 8, 1), (5, [0.4] * 8, 3), (11, [-100.0, 100.0] * 4, 3),
    ]
    for entries in (2, 256):
        got = checked(spark, rows, entries=entries)
        assert sorted(r[0] is None or r[0] for r in got) == [1, 1, 5, 5, 5, 11]
    docs = spark.createDataFrame(rows, SCHEMA)
    coded, books = vector_codes.compress(docs.limit(0))
    assert vector_codes.with_label_error(coded).count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    coded, _ = vector_codes.compress(docs.where("vec_id = 2"))
    assert coded.count() == 0
    checked(spark, [(k, [] if k < 3 else [0.5] * 4, k % 2) for k in range(9)])  # vectors without components come first
    clashing = docs.toDF("a.b", "v", "code").selectExpr("*", "1 AS error", "2 AS key_")
    coded, _ = vector_codes.compress(clashing, embedding="v", key="a.b", label="code")
    assert coded.columns == ["a.b", "code", "code", "error"]


def test_huge_components_are_held_at_the_bound(spark):
    rows = [(k, [3e38 if (k + j) % 3 else -3e38 for j in range(8)], k % 2) for k in range(20)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=4)
    most = math.isqrt(((1 << 63) - 1) // 32)
    assert coded.count() == 20 and np.abs(books.entries).max() == most and all(0 <= r.error < 1 << 63 for r in coded.collect())


def test_pruning_is_exact_and_saves_work():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(8, 16))[rng.integers(0, 8, 1500)] * 300 + rng.normal(size=(1500, 16)) * 60).astype(np.int64)
    book = x[:64].copy()
    code, upper, lower = vector_codes.first_assignment(x, book)
    for _ in range(4):
        new = np.array([x[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(64)])
        kept = vector_codes.packed(upper, lower)
        upper_, lower_ = vector_codes.unpacked(*kept, 64)
        assert (upper_ >= upper).all() and (lower_ <= lower).all()  # never tighter than what was known
        step = vector_codes.Elkan(book, new)
        code, upper, lower = step(x, code, upper_, lower_)
        full = vector_codes.all_squared(x, new)
        assert (code == full.argmin(1)).all()
        assert (upper**2 >= full.min(1)).all() and (np.delete(lower**2 - full, [], 1)[np.arange(64) != code[:, None]] <= 0).all()
        assert step.compared < x.shape[0] * 64 * 0.4
        book = new


def test_distances_beyond_doubles_are_exact():
    x = np.array([[1 << 27, 1], [(1 << 27) - 1, 0]])
    book = np.array([[-(1 << 27), 2], [1 << 27, 1]])
    assert vector_codes.all_squared(x, book).tolist() == [[(1 << 56) + 1, 0], [((1 << 28) - 1) ** 2 + 4, 2]]


def test_leaves_no_state_behind(spark):
    seen = []
    keep = vector_codes.remove
    vector_codes.remove = lambda s, path: (seen.append(path), keep(s, path))
    try:
        vector_codes.compress(spark.createDataFrame([(k, [k / 100] * 4, 0) for k in range(30)], SCHEMA), entries=3)
    finally:
        vector_codes.remove = keep
    assert len(seen) == 4 and all(p.startswith(shared_dir(spark)) and not exists(spark, p) for p in seen)
