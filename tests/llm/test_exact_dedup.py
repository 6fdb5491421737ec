import hashlib
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evispark.llm import exact_dedup
from evispark.session import table
from tests.llm.brute import odd_docs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest_of(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).digest()


def checked(docs, counters):
    """Every row's results against a dictionary of all digests."""
    groups = defaultdict(list)
    for r in docs.collect():
        groups[digest_of(r.text)].append(r.doc_id)
    least = lambda k: -1 if k is None else k
    rows = exact_dedup.exact_duplicates(docs.select("doc_id", "text"), counters=counters).collect()
    assert Counter((bytes(r.digest), r.doc_id) for r in rows) == Counter((d, k) for d, ids in groups.items() for k in ids)
    for r in rows:
        ids = groups[bytes(r.digest)]
        assert r.keep_id == max(ids, key=least) and r.group_size == len(ids)
    assert Counter(bytes(r.digest) for r in rows if r.kept) == Counter(groups.keys())
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    return groups


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_equals_brute_force_with_any_number_of_counters(spark, counters):
    checked(table(spark, "/root/testdata/sf0.001", "documents"), counters)


@pytest.mark.parametrize("counters", [2, 1024])
def test_odd_rows(spark, counters):
    docs = odd_docs(spark, "keep_id string, `a.b` string")
    groups = checked(docs, counters)
    assert len(groups) == 11  # null and empty are one text, and so are the repeated ones
    out = exact_dedup.exact_duplicates(docs, counters=counters)
    assert out.columns == ["doc_id", "a.b", "keep_id", "group_size", "kept", "digest"]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    kept = exact_dedup.unique_documents(docs, counters=counters)
    assert kept.columns == docs.columns and sorted(digest_of(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.unique_documents(docs.limit(0)).count() == 0


def test_unique_documents_keeps_the_largest_key_of_each_text(spark):
    rows = [(k, "Hot TEXT" if k % 3 else f"Text {k % 50}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = {}
    for k, t in rows:
        want[digest_of(t)] = max(k, want.get(digest_of(t), -1))
    for counters in (2, 1024):
        assert sorted(r.doc_id for r in exact_dedup.unique_documents(docs, counters=counters).collect()) == sorted(want.values())


def test_summaries_hold_all_that_is_frequent():
    rng = random.Random(3)
    rows = [b"%d" % min(int(rng.paretovariate(0.6)), 4000) for _ in range(20_000)]
    for counters in (1, 5, 40):
        parts = [rows[k::5] for k in range(5)]
        total, seen = Counter(), 0
        for part in parts:
            batches = [pa.RecordBatch.from_arrays([pa.array(part[a : a + 700], pa.binary())], names=["digest"]) for a in range(0, len(part), 700)]
            (out,) = exact_dedup.summaries(counters)(iter(batches))
            assert len(out) <= counters + 1
            for d, n in zip(out.column("digest").to_pylist(), out.column("count").to_pylist()):
                if d is None:
                    seen += n
                else:
                    total[d] += n
        assert seen == len(rows)
        for d, n in Counter(rows).items():
            assert n - len(rows) / (counters + 1) <= total[d] <= n
        assert sum(n * (counters + 1) > len(rows) for n in total.values()) <= counters


def test_merged_keeps_ties_or_drops_them_all():
    held, counts = exact_dedup.merged(pa.array([b"a", b"b", b"c"]), np.array([2, 2, 2]), 2)
    assert len(held) == len(counts) == 0
    held, counts = exact_dedup.merged(pa.array([b"a", b"b", b"a"]), np.array([2, 1, 2]), 1)
    assert held.to_pylist() == [b"a"] and counts.tolist() == [3]


def test_rows_of_a_frequent_text_stay_where_they_are(spark):
    docs = spark.createDataFrame([(k, "the same text" if k % 3 else f"text {k}") for k in range(600)], "doc_id long, text string").repartition(6, "doc_id")
    out = exact_dedup.exact_duplicates(docs, counters=8)
    parts = out.where("doc_id % 3 <> 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 200
