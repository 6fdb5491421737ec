import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import decontaminate
from evispark.llm.queries import op9_decontamination
from evispark.session import table
from tests.llm.brute import odd_docs

SF = "/root/testdata/sf0.001"


def smith_waterman(a, b):
    """Best local score, cell by cell: 2 for an equal word, -1 otherwise and for each gap."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def diagonal_scores(a, texts):
    """The same best scores of one item against many texts at once, along the table's diagonals."""
    number = {w: k for k, w in enumerate(dict.fromkeys(a))}
    item, m = np.array([number[w] for w in a]), max(map(len, texts))
    words = np.full((len(texts), m), -1)
    for k, t in enumerate(texts):
        words[k, : len(t)] = [number.get(w, -1) for w in t]
    before = last = np.zeros((len(texts), len(a) + 1), int)
    best = np.zeros(len(texts), int)
    for diagonal in range(len(a) + m - 1):  # cell (i, j) with i + j = diagonal stands in column i + 1
        now = np.zeros_like(last)
        i = np.arange(max(0, diagonal - m + 1), min(len(a), diagonal + 1))
        equal = words[:, diagonal - i] == item[i]
        now[:, i + 1] = np.maximum(np.maximum(before[:, i] + np.where(equal, 2, -1), np.maximum(last[:, i], last[:, i + 1]) - 1), 0)
        best = np.maximum(best, now.max(1))
        before, last = last, now
    return best


def brute(docs, items):
    """(doc, item) to score of all pairs that leak, by aligning every item with every text."""
    out, texts = {}, [decontaminate.words_of(t or "") for _, t in docs]
    for i, item in items:
        a = decontaminate.words_of(item or "")
        if len(a) < decontaminate.LEAST_WORDS:
            continue
        for (d, _), score in zip(docs, diagonal_scores(a, texts).tolist()):
            if score >= 2 * len(a) * (decontaminate.THRESHOLD if len(a) >= decontaminate.MIN_WORDS else 1):
                out[d, i] = round(score / (2 * len(a)), 6)
    return out


def test_the_brute_force_by_cells():
    rng = random.Random(1)
    for _ in range(60):
        a = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 12))]
        texts = [[f"w{rng.randrange(12)}" for _ in range(rng.randrange(20))] for _ in range(5)] + [["w1"]]
        assert diagonal_scores(a, texts).tolist() == [smith_waterman(a, t) for t in texts]


def got(frame, key="doc_id"):
    return {(r[key], r.item_id): round(r.score, 6) for r in frame.select(key, F.explode("leaks").alias("x")).select(key, "x.*").collect()}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    rows = op9_decontamination(spark, SF).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 6) for r in rows} == brute(docs, items)


def edited(words, rng, share):
    out = []
    for w in words:
        if rng.random() < share:
            kind = rng.randrange(3)
            out += [] if kind == 0 else ["new" + w] if kind == 1 else [w, "more"]
        else:
            out.append(w)
    return out


def test_edited_copies_in_any_number_of_blocks(spark):
    rng = random.Random(8)
    common, rare = [f"w{k}" for k in range(12)], [f"r{k}" for k in range(3000)]
    some = lambda n: [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n)]
    items = [(k, " ".join(some(rng.randrange(5, 60)))) for k in range(30)] + [(100, None), (101, ""), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    docs = []
    for d in range(120):
        words = some(rng.randrange(200))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(items[rng.randrange(30)][1].split(), rng, rng.choice((0, 0.1, 0.2)))
        docs.append((d, ", ".join(words).title()))
    table_of_docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leaks string")
    table_of_items = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for (d, i), s in brute(docs, items).items():
        want[d, i] = max(s, want.get((d, i), 0))
    for words in (2_000_000, 100):
        assert got(decontaminate.find_leaks(table_of_docs, table_of_items, block_words=words)) == want


def test_every_alignment_is_the_best(spark):
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(n)] for n in (rng.randrange(1, 20), rng.randrange(1, 60)))
        score, start, end = decontaminate.align(np.array(a), np.array(b))
        assert score == smith_waterman(a, b) == smith_waterman(a, b[start:end])


def swapped(words, rng, share):
    out, k = [], 0
    while k < len(words):
        step = 2 if k + 1 < len(words) and rng.random() < share else 1
        out += words[k : k + step][::-1]
        k += step
    return out


def test_recall_of_edited_copies(spark):
    """Against the alignment of all pairs, for edits of ten to thirty percent and of every fourth word, for words inserted
    behind half of the words to all of them, for neighbours that change places, and for some of each."""
    rng = random.Random(9)
    common, rare = [f"c{k}" for k in range(40)], [f"r{k}" for k in range(2000)]
    some = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = [(k, some(rng.randrange(8, 31))) for k in range(150)]
    kinds = {share: (lambda w, s=share: edited(w, rng, s)) for share in (0.1, 0.15, 0.2, 0.25, 0.3)}
    kinds[4] = lambda w: [f"x{x}" if k % 4 == 3 else x for k, x in enumerate(w)]
    parted = lambda w, s: [y for x in w for y in ([x, rng.choice(common + rare)] if rng.random() < s else [x])]
    kinds |= {f"insert {s}": (lambda w, s=s: parted(w, s)) for s in (0.5, 0.7, 0.8, 1)}
    kinds |= {f"swap {s}": (lambda w, s=s: swapped(w, rng, s)) for s in (0.3, 0.6)}
    kinds["mixed"] = lambda w: parted(edited(swapped(w, rng, 0.1), rng, 0.1), 0.3)
    docs, made = [], {}
    for kind, change in kinds.items():
        for i, words in items:
            made[len(docs)] = kind
            docs.append((len(docs), " ".join(some(30) + change(words) + some(30))))
    texts = [(i, " ".join(w)) for i, w in items]
    want = brute(docs, texts)
    found = got(decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string")))
    assert set(found) <= set(want)
    for kind in kinds:
        true = [p for p in want if made[p[0]] == kind]
        assert len(true) > 15 and sum(found.get(p) == want[p] for p in true) >= 0.99 * len(true), kind


@pytest.mark.parametrize("block_words", [2_000_000, 10])
def test_items_of_any_length_and_key(spark, block_words):
    """Short items leak as a whole and unchanged; with least_words and min_words of 1 every length is searched."""
    words = [f"v{k}" for k in range(9)]
    items = spark.createDataFrame([(f"k{n}", " ".join(words[:n])) for n in range(1, 8)] + [("k7", " ".join(words[1:8])), (None, "v1 v2 v3 v4 v5")], "`the id` string, `t.x` string")
    rows = [("0", " ".join(words[:5])), ("1", " ".join(words[:4] + ["other"] + words[5:7])), ("2", "v0 v1"), ("2", "v0 v1"), ("3", None), ("4", " ".join(words))]
    docs = spark.createDataFrame([(*r, "kept", "gone") for r in rows], "doc_id string, `a.text` string, mark string, leaks string")

    def found(**kw):
        out = decontaminate.find_leaks(docs, items, text="a.text", item_key="the id", item_text="t.x", block_words=block_words, **kw)
        assert out.columns == ["doc_id", "a.text", "mark", "leaks"] and out.where("mark = 'kept'").count() == len(rows)
        return set(got(out))

    assert found() == {("0", "k5"), ("4", "k5"), ("4", "k6"), ("4", "k7")}
    every = found(least_words=1, min_words=1)
    want = brute_any(rows, [(f"k{n}", words[:n]) for n in range(1, 8)] + [("k7", words[1:8])])
    assert every == want


def brute_any(docs, items):
    return {(d, i) for i, a in items for d, t in docs if t and smith_waterman(a, t.split()) >= len(a)}


def test_long_items(spark):
    words = [f"v{k}" for k in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words[1024:1536])), (2, " ".join(words)), (3, " ".join(words[:100]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert set(got(decontaminate.find_leaks(docs, items))) == {(1, 7), (2, 7)}


def test_odd_rows(spark):
    docs = odd_docs(spark, "leaks string, item_id string")
    items = spark.createDataFrame([(1, "long words and lines long words and lines"), (None, "a b c d e f g h i")], "item_id long, text string")
    rows = decontaminate.find_leaks(docs, items).collect()
    assert len(rows) == docs.count()
    assert {r.text[:10] for r in rows if r.leaks} == {"long words"}
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert all(not r.leaks for r in decontaminate.find_leaks(docs, items.limit(0)).collect())


def test_runs_of_one_seed_are_found(spark):
    """Against the alignment of all pairs, whether or not they share a longer run."""
    rng = random.Random(12)
    items = [(k, [f"i{k}w{j}" for j in range(rng.randrange(30, 60))]) for k in range(12)]
    docs = [(k, [f"d{k}w{j}" for j in range(50)] + [f"new{k}w{j}" if j % 5 == 4 else w for j, w in enumerate(words)]) for k, words in items]
    docs += [(100 + k, items[k][1][3:7]) for k in range(12)]  # other n-grams stand in documents, and are as rare
    scores = {(d, i): round(smith_waterman(a, b) / (2 * len(a)), 6) for i, a in items for d, b in docs}
    want = {p: s for p, s in scores.items() if s >= decontaminate.THRESHOLD}
    assert len(want) == 12
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{key} long, text string") for rows, key in ((docs, "doc_id"), (items, "item_id"))]
    assert got(decontaminate.find_leaks(*frames)) == want


def test_long_excerpts_leak_whatever_their_share(spark):
    sizes = {1: 450, 2: 512, 3: 1300, 4: 1032}
    items = {k: [f"i{k}w{j}" for j in range(n)] for k, n in sizes.items()}
    cuts = {1: (items[1][100:300], 1), 2: (items[2][200:450], 2), 3: (items[3][450:580], 3), 4: (items[4][-8:], None), 5: (items[1][:100], None)}
    docs = spark.createDataFrame([(d, " ".join(["other"] * 30 + words)) for d, (words, _) in cuts.items()], "doc_id long, text string")
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert set(got(decontaminate.find_leaks(docs, frame))) == {(d, i) for d, (_, i) in cuts.items() if i}
