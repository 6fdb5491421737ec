import random
import time

import numpy as np

from evispark.llm import boosting, pii
from evispark.llm.queries import op8_pii
from evispark.session import table
from tests.llm.brute import odd_docs, personal_base, spans_digest

SF = "/root/testdata/sf0.01"


def test_query_holds_the_base_spans(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op8_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = personal_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        assert r.base_sha256 == spans_digest(base, pii.BASE)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_random_texts_against_regular_expressions():
    rng = random.Random(7)
    bits = ["1", "23", "4111111111111111", "255", "256", ".", "..", "@", "a", "b-c", "+", "+1", " ", "-", "(", ")", "é", "x@y.z", "00", "\n", "4539 5787 6362 1486", "5555-5555-5555-4444"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert sorted((k, a, b) for a, b, k in pii.base_spans(text)) == sorted(personal_base(text)), text


def test_trees_part_personal_data_from_look_alikes():
    model = pii.learned()
    x, y = pii.examples(3000, 77)
    margin = model.trees.margin(x)
    for k, kind in enumerate(pii.EXTRA):
        mine = x[:, 0] == k
        hit = margin[mine] >= model.thresholds[kind]
        assert y[mine][hit].mean() > 0.97 and y[mine][hit].sum() / y[mine].sum() > 0.75


def test_thresholds_rise_by_what_the_judged_proposals_need():
    model = pii.Model(None, {"ssn": 1.0, "iban": 2.0, "national_phone": 0.5, "email_text": float("inf")})
    s = pii.STEPS
    judged = [("ssn", 3 * s, 99, 0), ("ssn", 2 * s, 0, 1), ("ssn", s, 0, 50), ("ssn", 0, 0, 900), ("iban", 5 * s, 0, 1), ("iban", 3 * s, 40, 0), ("national_phone", s, 5, 0), ("email_text", s, 0, 3)]
    got = pii.raised(model, judged, 0.99).thresholds
    assert got == {"ssn": 2.0, "iban": 5.0 + 1 / s, "national_phone": 0.5, "email_text": float("inf")}


def planted(count, seed):
    """Sentences of documents' own words with generated personal data or look-alikes, and the span and kind of the former."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        kind, personal = rng.choice(pii.EXTRA), rng.random() < 0.5
        lead, body = pii.written(rng, kind, personal)
        words = lambda: " ".join("".join(rng.choice("aeinorstçé") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 20)))
        head = f"{words()} {lead} "
        out.append((head + body + " " + words(), (kind, len(head), len(head) + len(body)) if personal else None))
    return out


def test_calibration_counts_whole_texts_of_all_rows(spark):
    rows = planted(3000, 5)
    docs = spark.createDataFrame([(t,) for t, _ in rows] + [(None,), ("",)], "`a.text` string")
    model = pii.learned()
    counts = {}
    for text, _ in rows:
        for span in pii.open_proposals(text, pii.base_spans(text)):
            said = pii.verdict(text, span)
            step = int(np.floor(np.clip(model.trees.margin(np.array([pii.features(text, span)], float))[0], -pii.REACH, pii.REACH) * pii.STEPS))
            if said:
                counts.setdefault((span[2], step), [0, 0])[said < 0] += 1
    want = pii.raised(model, [(k, step, yes, no) for (k, step), (yes, no) in counts.items()], pii.PRECISION).thresholds
    got = pii.calibrated(docs.repartition(3), "a.text")
    assert got.thresholds == want and all(got.thresholds[k] >= model.thresholds[k] for k in pii.EXTRA)
    base = [pii.base_spans(t) for t, _ in rows]
    found = pii.extra_spans([t for t, _ in rows], base, got)
    truth = [true for _, true in rows if true]
    caught = sum(true is not None and (true[1], true[2], true[0]) in spans for (_, true), spans in zip(rows, found))
    assert caught >= 0.97 * sum(map(len, found)) and caught >= 0.6 * len(truth)
    assert pii.calibrated(docs.limit(0), "a.text").thresholds == model.thresholds


#: Sentences written by hand, none by the generator of the examples, and what is personal in them.
SENTENCES = [
    ("Reach me at john dot smith at gmail dot com", "john dot smith at gmail dot com"), ("Her number is 555-123-4567", "555-123-4567"), ("Rufen Sie uns an: 030 1234567", "030 1234567"),
    ("Mobil 0151 23456789", "0151 23456789"), ("Appelez le 01 23 45 67 89 demain", "01 23 45 67 89"), ("Mi teléfono: 912 345 678, gracias", "912 345 678"),
    ("write to anna [at] web [dot] de please", "anna [at] web [dot] de"), ("Schreiben Sie an info at firma dot de, danke", "info at firma dot de"), ("Escriba a juan.perez (at) correo (dot) es", "juan.perez (at) correo (dot) es"),
    ("You can call me on (212) 555-0187 after six", "(212) 555-0187"), ("Bitte auf das Konto DE89 3704 0044 0532 0130 00 zahlen", "DE89 3704 0044 0532 0130 00"), ("virement au compte FR14 2004 1010 0505 0001 3M02 606", "FR14 2004 1010 0505 0001 3M02 606"),
    ("my social security number is 536-90-4399", "536-90-4399"), ("fax 0221-4710815", "0221-4710815"),
    ("Order number 555-123-4567 shipped", None), ("we met at noon dot then we left", None), ("Bestellung 030 1234567 ist da", None), ("Rechnung Nummer 0301234567", None), ("isbn 978-3-16-148410-0", None),
    ("look at the end dot it was a dot com", None), ("version 10.20.2023 of the build", None), ("pedido 912 345 678 enviado", None), ("Total 1234 5678 9012", None), ("page 12-34-5678", None),
]


def test_sentences_that_the_generator_did_not_write():
    model, right, missed = pii.learned(), 0, []
    for text, want in SENTENCES:
        found = [text[a:b] for a, b, _ in pii.extra_spans([text], [pii.base_spans(text)], model)[0]]
        right += found == ([want] if want else [])
        missed += [(text, found)] if found != ([want] if want else []) else []
    assert right >= 0.9 * len(SENTENCES), missed


def test_overlaps_against_all_pairs():
    rng, model = random.Random(6), pii.learned()
    for _ in range(300):
        text = " ".join(rng.choice(["call", "555-123-4567", "a at b dot com", "+1 555 123 4567", "x dot y at z dot de", "4111 1111 1111 1111", "123-45-6789", "iban", "DE89370400440532013000", "the"]) for _ in range(rng.randrange(12)))
        base = pii.base_spans(text)
        free = [s for s in pii.proposals(text, text.lower()) if not any(a < s[1] and s[0] < b for a, b, _ in base)]
        assert pii.open_proposals(text, base) == free
        chosen = []
        margin = model.trees.margin(np.array([pii.features(text, s) for s in free], float)) if free else []
        for i in np.argsort(-np.array(margin), kind="stable"):
            a, b, kind = free[i]
            if margin[i] >= model.thresholds[kind] and not any(x < b and a < y for x, y, _ in chosen):
                chosen.append(free[i])
        assert pii.extra_spans([text], [base], model)[0] == chosen


def test_documents_without_such_data_are_left_alone(spark):
    docs = table(spark, SF, "documents")
    found = pii.find_personal_data(docs, model=pii.calibrated(docs))
    assert sum(s.kind in pii.EXTRA for r in found.select("personal").collect() for s in r.personal) == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((boosting.fit(x, y).margin(x) > 0) == y).mean() > 0.97


def test_odd_rows(spark):
    docs = odd_docs(spark, "personal string, spans string")
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert sorted((s.kind, s.start, s.end) for s in r.personal if s.kind in pii.BASE) == sorted(personal_base(r.text))
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a@" + "x" * 300_000, "1.1." * 80_000, "@" * 300_000, "x dot " + "y" * 300_000):
        pii.base_spans(text)
        pii.proposals(text, text.lower())
    text, began = " ".join(f"call 555-{k % 900 + 100}-{k % 9000 + 1000}" for k in range(40_000)), time.perf_counter()
    assert len(pii.extra_spans([text], [pii.base_spans(text)], pii.learned())[0]) == 40_000 and time.perf_counter() - began < 60


def test_redaction(spark):
    docs = spark.createDataFrame([("é mail a.b@c.de now",), (None,), ("call +1 (555) 555-2485.",)], "text string")
    found = pii.find_personal_data(docs)
    assert [r[0] for r in found.select(pii.redacted(found.text, found.personal)).collect()] == ["é mail [EMAIL] now", None, "call [PHONE]."]
