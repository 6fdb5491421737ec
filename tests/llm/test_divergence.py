import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evispark.llm import divergence
from tests.llm.brute import ODD_TEXTS

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms_of(text))
        docs[lang].update(set(terms_of(text)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            more = [(-f(p[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            out |= {(lang, s, "pair", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(more)[:top])}
    return out


def checked(spark, rows, **options):
    got = [tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, SCHEMA), **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, **{k: v for k, v in options.items() if k != "held"})
    return got


def made(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{''.join(rng.choices('abcé漢', k=3))}" for _ in range(60)] + ["The", "the", "ß", "Ä"]
    text = lambda s: " ".join(rng.choice(words[: 10 + 7 * s]) + rng.choice(["", "!", "3", "_"]) for _ in range(rng.randrange(30)))
    rows = []
    for k in range(n):
        s = rng.randrange(8)
        rows.append((k, rng.choice([text(s)] * 9 + [None]), rng.choice(["en", "de", None]), f"s{s}" if rng.random() > 0.1 else None))
    return rows + [(n, "", "en", "no terms"), (n + 1, "123", "xx", "alone"), (n + 2, "few few", "yy", "a"), (n + 3, "few", "yy", "b")]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"held": 5}), (3, {"top": 4, "least": 1})])
def test_equals_brute_force(spark, seed, options):
    got = checked(spark, made(seed), **options)
    assert {r[3] for r in got if r[:3] == ("yy", "a", "pair")} == {"b"}
    assert ("en", "no terms") in {r[:2] for r in got} and "xx" not in {r[0] for r in got}


def test_groups_joined_by_exchange(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", 0)
    checked(spark, made(4))


def test_odd_rows(spark):
    rows = [(k if k != 5 else None, t, "x", f"y{j % 3}") for j in range(7) for k, t in enumerate(ODD_TEXTS)]
    checked(spark, rows)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text AS `a.b`", "lang AS term", "source AS slot", "1 AS text", "2 AS lang", "3 AS source", "4 AS n")
    assert {tuple(r) for r in divergence.divergences(docs, text="a.b", lang="term", source="slot").collect()} == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.divergences(empty).collect() == []


def test_ties_stand_in_the_order_of_bytes(spark):
    rows = [(k, f"same{c} b{c}", "en", "s" if k % 2 else "t") for k, c in enumerate("zé漢Aaß🙂q" * 6)]
    checked(spark, rows, top=3)


def test_long_texts_are_split_between_terms():
    rng = random.Random(7)
    text = "".join(rng.choice("ab é9\n") for _ in range(3000)) + "x" * 500 + " tail"
    for chunk in (1, 7, 100, 5000):
        assert [t.decode() for part in divergence.pieces(text.encode(), chunk) for t in part] == terms_of(text)


def test_tasks_hold_few_terms():
    rows = {"lang": ["a"] * 50, "source": ["b", "c"] * 25, "text": [f"t{'x' * (k % 20)} common" for k in range(50)]}
    batches = [pa.RecordBatch.from_pydict({k: v[a : a + 5] for k, v in rows.items()}) for a in range(0, 50, 5)]
    outs = list(divergence.counted(held=4)(iter(batches)))
    assert max(len(b) for b in outs) <= 12
    assert sum(sum(b.column("n").to_pylist()) for b in outs) == 100
    assert sum(n for b in outs for t, n in zip(b.column("term").to_pylist(), b.column("docs").to_pylist()) if t == "common") == 50


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(0, 1), (10**13, 10**14 + 7), (10**15 + 3, 10**15 + 4), (7, 10**15)]
    df = spark.createDataFrame(cases, "n long, total long").select("n", "total", F.expr(divergence.share("n", "total")).alias("p"))
    assert all(r.p == 1 + 1_000_000_000 * (r.n + 1) // r.total for r in df.collect())
