import random

from pyspark.sql import functions as F

from evispark.llm import chat_format


def python_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return any(w in text for w in ("Python", "Pandas", "Arrow"))


def formatted(df, key="conv_id"):
    out = df.withColumns({"turns": chat_format.read_back(F.col("formatted")), "loss": chat_format.under_mask(F.col("formatted"), F.col("loss_spans"))})
    return {r[key]: r for r in out.collect()}


def test_control_strings_survive_the_round_trip(spark):
    rng = random.Random(3)
    bits = ["<", "|", "\\", "im_start", "im_end", "|>", "<|im_end|>\n", "<|im_start|>", "\n", "é", "🙂", " a", "$1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(300)]
    roles = lambda k: "assistant" if k % 3 == 1 else "".join(rng.choice([*bits, "<|lf|>", "\n", "user"]) for _ in range(rng.randrange(6)))
    rows = [(k // 3, k, roles(k), t) for k, t in enumerate(texts)]
    out = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert not python_of(out)
    got = formatted(out)
    for c in range(100):
        mine = rows[3 * c : 3 * c + 3]
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2], r[3]) for r in mine]
        assert got[c].loss == "".join(r[3] for r in mine if r[2] == "assistant")


def test_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "gpt", ""), (None, 1, "assistant", "x" * 200_000), (2, 5, "human", "q"), (2, 5, "human", "q")]
    turns = spark.createDataFrame([(*r, "z", "y") for r in rows], "conv_id long, turn long, role string, text string, key string, formatted string")
    got = formatted(chat_format.format_turns(turns))
    assert [(t.role, t.text) for t in got[1].turns] == [("gpt", ""), ("", ""), ("user", "a"), ("user", "b")]
    assert got[None].loss == "x" * 200_000
    assert len(got[2].turns) == 2 and got[2].loss == ""
    assert chat_format.format_turns(turns.limit(0)).count() == 0


def test_layouts_are_told_apart_row_by_row(spark):
    message = "array<struct<role:string,content:string>>"
    schema = f"id int, prompt string, completion string, response string, instruction string, input string, output string, question string, answer string, system string, messages {message}, conversations array<struct<`from`:string,value:string>>, layout string"
    fields = [f.name for f in spark.createDataFrame([], schema).schema]

    def row(k, **given):
        return tuple({"id": k, **given}.get(f) for f in fields)

    rows = [
        row(1, prompt="p", completion="c"),
        row(2, system="s", prompt="p", response="r"),
        row(3, instruction="i", input="x", output="o"),
        row(4, instruction="i", output="o"),
        row(5, question="q", answer="a"),
        row(6, messages=[("user", "u"), ("assistant", "v")]),
        row(7, conversations=[("human", "h"), ("gpt", "g")]),
        row(8, prompt="only"),
        row(9),
    ]
    out = chat_format.format_records(spark.createDataFrame(rows, schema).drop("layout"), "id")
    assert not python_of(out)
    got = formatted(out.withColumn("loss_spans", F.coalesce("loss_spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))), "id")
    turns = {k: (r.layout, [(t.role, t.text) for t in r.turns]) for k, r in got.items()}
    assert turns == {
        1: ("prompt", [("user", "p"), ("assistant", "c")]),
        2: ("response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        3: ("instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        4: ("instruction", [("user", "i"), ("assistant", "o")]),
        5: ("question", [("user", "q"), ("assistant", "a")]),
        6: ("messages", [("user", "u"), ("assistant", "v")]),
        7: ("conversations", [("user", "h"), ("assistant", "g")]),
        8: (None, []),
        9: (None, []),
    }


def test_the_query_selects_mappings_by_fingerprint(spark, tmp_path):
    """The query's own path over a table of its layout, and over one that mixes the layouts of turn tables."""
    from evispark.llm.queries import op10_chat_format

    out = op10_chat_format(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "__fingerprint" in plan and not python_of(out)
    schema = "conv_id long, turn long, role string, text string, content string, `from` string, value string"
    rows = [
        (1, 0, "human", "kept", None, None, None),
        (1, 1, "developer", None, "canonical", None, None),
        (1, 2, None, None, None, "gpt", "said"),
        (1, 3, None, None, None, None, None),
        (1, 4, "user", None, None, None, "no layout"),
        (1, 5, "x\ny", "two lines", None, None, None),
    ]
    got = formatted(chat_format.format_turns(spark.createDataFrame(rows, schema)))
    assert [(t.role, t.text) for t in got[1].turns] == [("human", "kept"), ("system", "canonical"), ("assistant", "said"), ("", ""), ("", ""), ("x\ny", "two lines")]
    assert got[1].loss == "said"
