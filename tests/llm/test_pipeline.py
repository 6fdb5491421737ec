"""Every stage against a plain version of it, each over what the stage before kept."""

import corpus_pipeline
from evispark.llm import secrets
from evispark.llm.queries import ORACLE_SQL
from evispark.session import table
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_copies import jaccard_groups
from tests.llm.test_tokens import whole_packing
from tests.oracle import rows_of_sql

SF = "/root/testdata/sf0.001"


def masked(text):
    spans = sorted((m for m in secrets.byte_spans([text.encode()], secrets.RULES)), key=len)[0]
    out, done, data = b"", 0, text.encode()
    for a, _, b in spans:
        if a >= done:
            out += data[done:a] + b"[SECRET]"
        done = max(done, b)
    return (out + data[done:]).decode()


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = docs.collect()
    names, rows = rows_of_sql(SF, ORACLE_SQL["op1_quality_rules"])
    kept = {r[names.index("doc_id")]: r[names.index("lost_chars")] for r in rows if r[names.index("kept")]}
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    first = held["quality_rules"]
    assert {r.doc_id for r in first} == set(kept)
    bare = lambda t: len(t.replace("\n", ""))
    assert all(bare(texts[r.doc_id]) - bare(r.text) == kept[r.doc_id] and r.n_chars == len(r.text) for r in first)

    second = held["near_dedup"]
    assert sorted(r.doc_id for r in second) == sorted(set(jaccard_groups([(r.doc_id, r.text) for r in first]).values()))

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaked = {d for d, _ in brute([(r.doc_id, r.text) for r in second], items)}
    third = held["decontamination"]
    assert leaked and {r.doc_id for r in third} == {r.doc_id for r in second} - leaked

    fourth = held["secret_scans"]
    assert {r.doc_id: r.text for r in fourth} == {r.doc_id: masked(r.text) for r in third}
    assert whole_packing(held["packing"], {r.doc_id: r.text for r in fourth}) < 0.02


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_odd_documents_pass_every_stage(spark, tmp_path):
    text = "\n".join(f"Line {k} has alpha{k} beta{k} gamma{k} delta{k} epsilon{k} zeta{k}." for k in range(12))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert [r.doc_id for r in docs.orderBy("doc_id").collect()] == ([None, 1, 1] if k == 0 else [None, 1])
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SF).count() == 0
