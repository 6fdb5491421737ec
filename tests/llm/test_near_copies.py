import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from evispark.llm import near_copies
from evispark.session import table
from tests.llm.brute import odd_docs

SF = "/root/testdata/sf0.01"


def jaccard_groups(rows, shingle=5, threshold=0.8):
    """Key to the smallest key reachable over pairs at the threshold, by exact sets of word runs."""
    rows, sets, having, root = sorted(rows), [], defaultdict(list), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, text) in enumerate(rows):
        words = [w.lower() for w in text.split()]
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))})
        shared = Counter()
        for g in sets[k]:
            shared.update(having[g])
            having[g].append(k)
        for other, n in shared.items():
            if n / (len(sets[k]) + len(sets[other]) - n) >= threshold:
                a, b = sorted((top(k), top(other)))
                root[b] = a
    return {rows[k][0]: rows[top(k)][0] for k in range(len(rows))}


def test_stage_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = jaccard_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == sorted(set(want.values()))


def test_groups_in_any_number_of_blocks(spark):
    rng, docs = random.Random(6), []
    for _ in range(8):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(40):
            if rng.random() < 0.5:
                words = [f"n{rng.randrange(4000)}" if rng.random() < 0.01 else w for w in words]  # a chain of edits
            docs.append((len(docs), " ".join(words)))
    want = jaccard_groups(docs)
    assert 8 < len(set(want.values())) < 300
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (256, 7):
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame, block=block).collect()} == want


def test_fingerprints_find_candidates(spark, monkeypatch):
    """Operator 7's covering search is a step of the stage: what it links shares a key, and nothing else does."""
    rng, rows = random.Random(8), [(0, 0, 0)]  # the empty set is no candidate
    for k in range(1, 400):
        near = rows[rng.randrange(len(rows))][2] if k % 2 else rng.getrandbits(64) - (1 << 63)
        for bit in rng.sample(range(63), rng.randrange(7)):
            near ^= 1 << bit
        rows.append((k, 9, near))
    found = defaultdict(set)
    for r in near_copies.print_keys(spark.createDataFrame(rows, "id long, size long, fp long")).collect():
        found[r.k].add(r.id)
    groups, rest = set(), dict((k, fp) for k, size, fp in rows if size)
    while rest:
        todo = [rest.popitem()]
        group = set()
        while todo:
            at, fp = todo.pop()
            group.add(at)
            near = [k for k, x in rest.items() if ((x ^ fp) & (1 << 64) - 1).bit_count() <= 4]
            todo += [(k, rest.pop(k)) for k in near]
        groups.add(frozenset(group))
    assert set(map(frozenset, found.values())) == groups and 50 < len(groups) < 399

    calls, links = [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda *a: calls.append(a) or links(*a))
    corpus_pipeline.near_dedup_stage(spark, table(spark, "/root/testdata/sf0.001", "documents"), SF)
    assert len(calls) == 1


def test_odd_rows(spark):
    docs = odd_docs(spark, "id string, component_id string")
    rows = near_copies.near_copies(docs).collect()
    assert len(rows) == docs.count()
    found = {r.doc_id: r.component_id for r in rows}
    assert [found[k] for k in range(3)] == [0, 0, 0] and found[7] == 3 and found[6] == 3
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_texts_stay_where_they_lie(spark, monkeypatch):
    """No text is sorted, exchanged or broadcast to drop rows; with a bound of none, the same rows stay."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    out = near_copies.unlike(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and not re.search("SortMergeJoin|Exchange hashpartitioning", physical), plan
    kept = sorted(map(tuple, out.collect()))
    monkeypatch.setattr(near_copies, "FEW", 0)
    assert sorted(map(tuple, near_copies.unlike(docs).collect())) == kept


def test_of_repeated_rows_one_stays(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "x"), (2, "a b c d e f", "z"), (3, "other words", "x"), (3, "different", "x"), (None, "a b c d e f", "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "`the id` long, `a.text` string, place string")
    kept = near_copies.unlike(docs, text="a.text", key="the id").collect()
    assert sorted((r["the id"] or 0, r["a.text"] or "") for r in kept) == [(0, ""), (0, "a b c d e f"), (1, "a b c d e f"), (3, "different"), (3, "other words")]
    assert near_copies.unlike(docs.limit(0), text="a.text", key="the id").count() == 0


def test_workers_let_go_of_other_stages(spark):
    """What packing remembers in a worker process isn't there beside near-dedup's own memory."""
    from pyspark.sql import functions as F

    from evispark.llm import arrow, packing

    @F.arrow_udf("long")
    def remembered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([len(arrow._HELD) + len(arrow._TOKENIZERS)] * len(batch), pa.int64())

    docs = spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id long, text string").coalesce(1)
    left = lambda: docs.select(remembered("text").alias("n")).first().n
    packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert left() == 2
    signed = docs.select(near_copies.signature(F.col("text"), 5).alias("s")).collect()
    assert [r.s.size for r in signed] == [1, 0] and left() == 0
