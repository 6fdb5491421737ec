"""Counts kept by a stream equal counts of everything after each batch."""

import random

import pyarrow as pa

from evispark.sources import store
from evispark.streaming import counts


def evidence(rng, path):
    kinds, languages = ["class", "function", "method", None], ["ts", "py"]
    made = [(path, "entity", rng.choice(kinds), None, rng.choice(languages)) for _ in range(rng.randrange(6))]
    return made + [(path, "relation", rng.choice(["calls", "imports"]), rng.choice(["internal", "external"]), None) for _ in range(rng.randrange(6))]


def rows(df):
    return sorted(map(tuple, df.select("measure", "value", "n").collect()), key=repr)


def test_counts_follow_the_stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", counts.PROVIDER)
    try:
        rng, at, held = random.Random(4), f"{tmp_path}/c", {}
        counts.create(spark, at)
        for batch in range(3):
            names = [f"f{k}" for k in (range(9) if not batch else rng.sample(range(12), 4))]
            new = {name: [] if rng.random() < 0.25 else evidence(rng, name) for name in names}
            held |= new
            sent = [r for name, made in new.items() for r in [*made, (name, None, None, None, None)]]
            spark.createDataFrame(sent, counts.EVIDENCE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query = counts.start(spark.readStream.schema(counts.EVIDENCE).parquet(f"{tmp_path}/in"), at, f"{tmp_path}/check")
            query.processAllAvailable()
            query.stop()
            every = spark.createDataFrame([r for made in held.values() for r in made], counts.EVIDENCE)
            assert rows(store.latest(spark, at).read("counts")) == rows(counts.counted(every))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Shared:
    """A value state that counts what it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked, self.value = self.asked + 1, value

    def clear(self):
        self.asked, self.value = self.asked + 1, None


def test_files_share_states_and_rows_are_counted_first():
    """A hundred files of ten rows ask their state twice; what they gain and lose is right, also for files that go."""
    schema = pa.schema([(c, pa.string()) for c in ("file_path", "part", "kind", "resolution", "language")])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
    rows = [(f"f{k}", "entity", "class", None, None) for k in range(100) for _ in range(10)]
    state, deltas = Shared(), counts.Deltas()
    deltas.init(state)

    def sent(rows):
        found = [r for b in counts.combined([batch(rows)]) for r in b.to_pylist()]
        gained = {(r.measure, r.value): r.n for r in deltas.handleInputRows((0,), iter(found), None)}
        return len(found), gained

    assert sent(rows) == (200, {("entities_by_kind", "class"): 1000, ("entities_by_language", None): 1000}) and state.asked == 2
    assert sent(rows) == (200, {}) and state.asked == 3
    assert sent([("f0", None, None, None, None), ("f1", "entity", None, None, "ts")]) == (3, {("entities_by_kind", "class"): -20, ("entities_by_kind", None): 1, ("entities_by_language", None): -19 - 1, ("entities_by_language", "ts"): 1})
    assert sent([(f"f{k}", None, None, None, None) for k in range(1, 100)])[1] == {("entities_by_kind", "class"): -980, ("entities_by_kind", None): -1, ("entities_by_language", None): -980, ("entities_by_language", "ts"): -1}
    assert state.value is None
