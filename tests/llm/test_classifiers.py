import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evispark.llm import language_id, quality_classifier
from evispark.llm.queries import op3_quality_classifier, op6_language_id
from evispark.session import table
from tests.llm.brute import odd_docs

SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_rows(spark):
    rows = op3_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 60
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_positive_unlabelled_learning_finds_the_prior():
    rng = np.random.default_rng(1)
    good = lambda n: rng.normal(1.0, 0.5, (n, quality_classifier.MEASURES))
    bad = lambda n: rng.normal(-1.0, 0.5, (n, quality_classifier.MEASURES))
    model = quality_classifier.fit(good(1500), np.concatenate([good(1800), bad(1200)]))
    assert abs(model.prior - 0.6) < 0.08
    assert (model.score(good(500)) >= 0.7).mean() > 0.95 and (model.score(bad(500)) < 0.7).mean() > 0.95


def test_partitions_do_not_change_a_model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    good = table(spark, "/root/testdata/sf0.01", "labels").where("quality = 1").select("doc_id")
    one, two = (quality_classifier.learn(docs.repartition(n), good, positives=200, unlabelled=300) for n in (3, 7))
    assert one.prior == two.prior and (one.weights == two.weights).all()


def test_the_risk_is_minimised():
    """Against plain gradient descent on the non-negative risk, which the prior must part as calibrated."""
    rng = np.random.default_rng(4)
    good = lambda n: rng.normal(0.5, 0.5, (n, quality_classifier.MEASURES))
    bad = lambda n: rng.normal(-0.5, 0.5, (n, quality_classifier.MEASURES))
    p, u = good(120), np.concatenate([good(90), bad(60)])
    model = quality_classifier.fit(p, u, prior=0.6)
    xp, xu = model.features(p), model.features(u)
    loss = lambda z: np.log1p(np.exp(-z))
    ridge = quality_classifier.DECAY / len(p)

    def risk(w):
        return 0.6 * loss(xp @ w).mean() + max(0.0, loss(-(xu @ w)).mean() - 0.6 * loss(-(xp @ w)).mean()) + ridge * (w @ w) / 2

    w = np.zeros(xp.shape[1])
    for _ in range(4000):
        s, t = 1 / (1 + np.exp(-(xp @ w))), 1 / (1 + np.exp(-(xu @ w)))
        rest = loss(-(xu @ w)).mean() - 0.6 * loss(-(xp @ w)).mean()
        of_rest = xu.T @ t / len(xu) - 0.6 * xp.T @ s / len(xp)
        w -= 0.05 * ((of_rest - 0.6 * xp.T @ (1 - s) / len(xp) if rest >= 0 else -of_rest) + ridge * w)
    assert abs((model.score(u) >= 0.7).mean() - 0.6) < 0.01
    mine = model.weights.copy()
    mine[0] += min(np.linspace(-8, 8, 1601), key=lambda shift: risk(mine + np.eye(1, len(mine))[0] * shift))  # the fit before its calibration
    assert risk(mine) <= risk(w) * 1.03
    assert ((xu @ mine > 0) == (xu @ w > 0)).mean() > 0.97


def test_odd_rows_are_scored(spark):
    docs = odd_docs(spark, "score string, predicted string")
    untaught = quality_classifier.learn(docs, docs.select("doc_id").limit(0))
    assert {r.score for r in quality_classifier.classify(docs, untaught).collect()} == {0.5}
    taught = quality_classifier.learn(docs, docs.select("doc_id"))
    rows = quality_classifier.classify(docs, taught).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.classify(docs.limit(0), taught).count() == 0


def test_language_of_held_out_rows(spark):
    rows = op6_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def letters_of(text):
    """Words by the characters' categories: a letter, then letters and marks."""
    words, word = [], ""
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        elif word:
            words.append(word)
            word = ""
    return [*words, word] if word else words


def brute_language(rows, temperature=0.5, longest=5):
    """text -> (language, score) learned from (language, text) rows, with plain dictionaries."""
    names, tables = sorted({name for name, _ in rows}), [Counter() for _ in range(longest + 1)]
    for name, text in rows:
        for w in letters_of(text.lower()):
            tables[0][w, name] += 1
            for n in range(1, longest + 1):
                m = f"^{w}$"
                for i in range(max(1, len(m) - n + 1)):
                    tables[n if len(m) >= n else len(m)][m[i : i + n], name] += 1
    known = [{item for item, _ in t} for t in tables]
    total = [{name: sum(n for (_, x), n in t.items() if x == name) for name in names} for t in tables]
    per = Counter(name for name, _ in rows)

    def log(n, item, name):
        return math.log((tables[n][item, name] + 0.5) / (total[n][name] + 0.5 * len(known[n])))

    def predict(text):
        words, sums = letters_of((text or "").lower()), {name: math.log(per[name] / len(rows)) for name in names}
        for w in words:
            if w in known[0]:
                n, found = 0, [w]
            else:
                m = f"^{w}$"
                n, found = next(((n, f) for n in range(min(longest, len(m)), 0, -1) if (f := [m[i : i + n] for i in range(len(m) - n + 1) if m[i : i + n] in known[n]])), (0, []))
            for name in names:
                sums[name] += sum(log(n, x, name) for x in found) / max(1, len(found))
        if not words:
            return "und", 0.0
        best = max(names, key=sums.get)
        return best, 1 / sum(math.exp((sums[name] - sums[best]) / len(words) ** temperature) for name in names)

    return predict


def test_query_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    predict = brute_language([(r.lang, r.text) for r in docs if r.lang is not None and r.text is not None and not held(r)])
    got = {r.doc_id: r for r in op6_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        want, score = predict(r.text)
        assert got[r.doc_id].lang_pred == want and abs(got[r.doc_id].score - score) < 1e-3 and got[r.doc_id].held_out == held(r)


def test_backing_off_and_letters(spark):
    rows = [("en", "the cat sat on the mat here"), ("fr", "le chat est sur la table ici"), ("hi", "यह एक बिल्ली है")]
    docs = spark.createDataFrame([(k, t, x) for k in range(40) for x, t in rows], "`the.id` long, text string, lang string")
    model = language_id.learn(docs.withColumn("the.id", F.monotonically_increasing_id()), key="the.id")
    predict = brute_language([r for r in rows for _ in range(40)])
    texts = ["the cats", "chats sur, tables!", "zzz", "qqq1x the", "", "123", "le\x85chat é", "½ ²", "Ⅳ ①", "है ½", None]
    found = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), model).orderBy("id").collect()
    for r in found:
        want, score = predict(r.text)
        assert r.lang_pred == want and abs(r.score - score) < 1e-3, r.text
    assert [r.lang_pred for r in found][7:9] == ["und", "und"] and found[9].lang_pred == "hi"


def test_every_word_of_the_sample_is_learned(spark):
    """Two languages of 60,000 words each that differ in nothing but their words, most of which occur once."""
    rng = random.Random(11)
    words = [f"{'abcdefgh'[k % 8]}{k:05}".translate(str.maketrans("0123456789", "ijklmnopqr")) for k in range(120_000)]
    rng.shuffle(words)
    own = {"x": words[:60_000], "y": words[60_000:]}
    rows = [(x, " ".join(w[k : k + 100])) for x, w in own.items() for k in range(0, 60_000, 100)]
    model = language_id.learn(spark.createDataFrame([(k, x, t) for k, (x, t) in enumerate(rows)], "doc_id long, lang string, text string"))
    assert sum(item[0] == " " for item in model.items) == 120_000
    texts = [w for x in own for w in rng.sample(own[x], 300)]
    found = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), model).orderBy("id").collect()
    predict = brute_language(rows)
    assert [r.lang_pred for r in found] == [predict(t)[0] for t in texts] == ["x"] * 300 + ["y"] * 300


def test_rare_languages_keep_their_words(spark):
    """A language with a few rows among many others' keeps its vocabulary, and every language is learned."""
    rng = random.Random(3)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)] for k in range(230)}
    rows = [(f"l{k:03}", " ".join(rng.choices(words[f"l{k:03}"], k=8))) for k in range(230) for _ in range(200 if k == 0 else 3)]
    docs = spark.createDataFrame([(k, x, t) for k, (x, t) in enumerate(rows)], "doc_id long, lang string, text string")
    model = language_id.learn(docs, sample_rows=20)
    assert model.languages == sorted(words)
    got = language_id.identify(docs, model).where("lang <> 'l000'").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_odd_rows_get_a_language(spark):
    docs = odd_docs(spark, "lang string, score string")
    model = language_id.learn(docs)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.lang_pred == ("x" if letters_of(r.text or "") else "und")
    untaught = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, untaught).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0
