import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from evispark.llm import packing, token_counts
from evispark.llm.queries import op4_token_counts, op5_packing
from evispark.session import table
from tests.llm.brute import ODD_TEXTS, odd_docs

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def counts(texts, path):
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark):
    docs = table(spark, SF, "documents").collect()
    want = dict(zip([d.doc_id for d in docs], counts([d.text for d in docs], BYTES)))
    for r, d in zip(sorted(op4_token_counts(spark, SF).collect()), sorted(docs, key=lambda d: d.doc_id)):
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (d.doc_id, len(d.text.encode()), want[r.doc_id], want[r.doc_id] > 512)


def test_chunks_are_spliced_without_error():
    tok = Tokenizer.from_file(BYTES)

    def encode(part):
        e = tok.encode(part, add_special_tokens=False)
        return [(s, t, i) for (s, t), i in zip(e.offsets, e.ids)]

    texts = [t for t in ODD_TEXTS if t] + ["ab" * 3000, "é🙂 " * 500, "a  b   c\n\n d" * 300, "word " * 50 + "y" * 900 + " end " * 40]
    for t in texts:
        whole = len(encode(t))
        for chunk, overlap in ((200, 20), (777, 8), (5000, 256)):
            assert token_counts.chunked_count(t, encode, chunk, overlap) == whole


def test_odd_rows_are_counted(spark):
    docs = odd_docs(spark, "n_tokens string, over_limit string")
    rows = token_counts.token_counts(docs, BYTES).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(counts([r.text for r in rows], BYTES))
    assert token_counts.token_counts(docs.limit(0), BYTES).count() == 0


def whole_packing(rows, texts):
    """Checks that pieces cover every document once and sequences are gapless; returns the share of padding."""
    tok = Tokenizer.from_file(WORDS)
    ids = {k: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for k, spans in pieces.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == len(ids[k])
    for spans in windows.values():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at <= packing.CAPACITY
    return 1 - sum(map(len, ids.values())) / (len(windows) * packing.CAPACITY)


def test_packing_is_whole_and_tight(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert whole_packing(op5_packing(spark, SF).collect(), texts) < 0.02


def test_groups_of_tiny_documents_are_bounded(spark):
    texts = {k: "word " * (k % 3) for k in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(docs, WORDS, most_pieces=500).collect()
    whole_packing(rows, texts)
    groups = defaultdict(int)
    for r in rows:
        groups[r.sequence_id >> 25] += 1
    assert len(groups) == 6 and max(groups.values()) < 700


def test_odd_rows_are_packed(spark):
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string, length string")
    packed = packing.pack(docs, WORDS)
    whole_packing(packed.collect(), dict(enumerate(ODD_TEXTS)))
    assert packing.pack(docs.limit(0), WORDS).count() == 0
    repeated = packing.pack(odd_docs(spark), WORDS)
    assert repeated.where("doc_id = 3 AND start = 0").count() == 3


def test_sequences_hold_the_ids(spark):
    docs = table(spark, SF, "documents")
    packed = packing.pack(docs, WORDS)
    rows = packing.sequences(docs, packed, WORDS).collect()
    lengths = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert {r.sequence_id: len(r.ids) for r in rows} == lengths


def test_differencing_balances():
    sizes = np.array([8, 7, 6, 5, 4] * 20)
    placed = packing.differencing(sizes, 10)
    loads = np.bincount(placed, sizes, 10)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() <= 2
    placed, windows = packing.pack_sizes(np.full(9, 1500), 2048)
    assert windows == 9
