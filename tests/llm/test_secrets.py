import random
import re

from evispark.llm import secrets
from evispark.llm.automaton import build
from evispark.llm.queries import op2_secret_scans
from evispark.session import table
from tests.llm.brute import odd_docs, secrets_base, spans_digest

SF = "/root/testdata/sf0.01"


def test_query_holds_the_base_spans(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op2_secret_scans(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = secrets_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.BASE)
        assert r.base_sha256 == spans_digest(base, secrets.BASE)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_random_texts_against_regular_expressions():
    rng = random.Random(5)
    bits = ["password", "PassWd", "api_key", "apikey", "APIKEY", "secret", "Token", "=", ":", " ", "  ", '"', "'", "AKIA", "A1B2", "0123456789abcdef", "ff", "é", "-", "zz", "\n", "==", "ghp_" + "a1" * 18]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(3000)]
    found = [secrets.code_points(t.encode(), s) for t, s in zip(texts, secrets.byte_spans([t.encode() for t in texts], secrets.RULES))]
    for text, spans in zip(texts, found):
        got = [(secrets.RULES[r].kind, a, b) for a, r, b in spans]
        assert sorted(s for s in got if s[0] in secrets.BASE) == sorted(secrets_base(text))
        github = [("github", m.start(), m.end()) for m in re.finditer(r"gh[pousr]_[A-Za-z0-9]+", text) if len(m[0]) >= 40]
        assert [s for s in got if s[0] == "github"] == github


def test_automaton_is_minimal_and_finds_every_pattern():
    a = build(["abc|xbc"])
    assert len(a.accepts) == len(build(["[ax]bc"]).accepts)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = secrets.scan_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert sorted((s.kind, s.start, s.end) for s in r.secrets if s.kind in secrets.BASE) == sorted(secrets_base(r.text))
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([("é password=abcdef1 b",), (None,), ("clean",)], "text string")
    assert [r[0] for r in docs.select(secrets.redacted(docs.text)).collect()] == ["é [SECRET] b", None, "clean"]


def test_private_keys_are_masked_whole(spark):
    body, kind = "\n".join(["MIIEpAIBAAKCAQEA7bq+/9Zk" * 2] * 3 + ["Qx3="]), "RSA PRIVATE KEY-----"
    key = f"-----BEGIN {kind}\n{body}\n-----END {kind}"
    fields = f"-----BEGIN {kind}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n{body}\n-----END {kind}"
    cut = f"-----BEGIN {kind}\n" + "MIIEpAIBAAKCAQEA7bq+/9Zk\n" * 3 + "Then some words."
    texts = [f"a {key}. b", "k: " + key.replace("\n", "\\n") + "!", f"{fields} {key}", cut, f"no -----BEGIN {kind} here"]
    want = ["a [SECRET]. b", "k: [SECRET]!", "[SECRET] [SECRET]", "[SECRET]\nThen some words.", "no [SECRET] here"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    assert [r[0] for r in docs.orderBy("id").select(secrets.redacted(docs.text)).collect()] == want
