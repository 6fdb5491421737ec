from evispark.llm import quality_rules
from tests.llm.brute import ODD_TEXTS, odd_docs

GOOD = "\n".join(f"Line {k} has alpha{k} beta{k} gamma{k} delta{k} epsilon{k} zeta{k}." for k in range(12))


def plain_base(text):
    """The base counts of one text, straight from their definitions."""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in (k, k + 1, k + 2)} if len(words) < 5_000 else None
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), twice and len(twice) or 0


def test_odd_rows(spark):
    docs = odd_docs(spark, "`__words` string, kept string")
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == docs.count() and rows[0]["__words"] == "x"
    assert quality_rules.quality_rules(docs).columns == ["doc_id", "text", "__words", *quality_rules.RESULTS]
    for r in rows:
        want = plain_base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        if r.n_words < 5_000:
            assert r.n_repeat_words == want[4] and r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.kept and r.base_failed) and r.cleaned is not None
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0 and quality_rules.kept_documents(docs.limit(0)).columns == docs.columns


def test_columns_of_any_name_are_kept(spark):
    rows = [(1, GOOD, "a", "b", "c", "d"), (1, GOOD, "a", "b", "c", "d"), (2, "home\n" + GOOD + "\nAll rights reserved.", None, None, None, None), (3, ODD_TEXTS[0], "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, `my.text` string, `__x` string, kept string, `a.b` string, cleaned string")
    kept = quality_rules.kept_documents(docs, "my.text").orderBy("doc_id").collect()
    assert [tuple(r) for r in kept] == [rows[0], rows[1], (2, GOOD, None, None, None, None)]
    judged = quality_rules.quality_rules(docs, "my.text")
    assert judged.columns == ["doc_id", "my.text", "__x", "a.b", *quality_rules.RESULTS]
    assert [r.kept for r in judged.orderBy("doc_id").collect()] == [True, True, True, False]


def test_lines_are_judged_first(spark):
    rows = [(1, GOOD + "\n" + "\n".join(["no point here " * 30] * 20)), (2, GOOD + "\nno point here")]
    found = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].cleaned == found[2].cleaned == GOOD
    assert not found[1].kept and found[2].kept and found[2].n_lines_removed == 1
