"""Versions of stored tables, calls kept resolved, and the streams that change them."""

import random

import pytest

from evispark.operators import calls, incremental
from evispark.sources import store
from evispark.streaming import changes

KIND = "file_path string, id string, v int"


def rows(version, name="rows"):
    return sorted(map(tuple, version.read(name).collect()))


@pytest.fixture
def held(spark, tmp_path):
    made = [(f"f{k}", f"x{k}", k) for k in range(40)]
    store.create({"rows": (spark.createDataFrame(made, KIND), "file_path"), "more": (spark.createDataFrame([("f1", 1), ("f3", 3)], "file_path string, n int"), "file_path")}, f"{tmp_path}/t", 64)
    return made


def files(path):
    return {p: p.stat().st_mtime_ns for p in (path / "t" / "data").rglob("*.parquet")}


def test_a_change_rewrites_the_touched_buckets_of_all_tables_at_once(spark, tmp_path, held):
    at, before = f"{tmp_path}/t", files(tmp_path)
    old = store.latest(spark, at)
    new = spark.createDataFrame([("f3", "y", 0), ("f39", "z", 1), ("f7", "not changed", 2)], KIND)
    changed = spark.createDataFrame([("f3",), ("f39",), ("f5",)], "file_path string")
    want = sorted([(f"f{k}", f"x{k}", k) for k in range(40) if k not in (3, 5, 39)] + [("f3", "y", 0), ("f39", "z", 1)])
    made = store.change(spark, at, {"rows": (new, changed), "more": (spark.createDataFrame([("f3", 9)], "file_path string, n int"), changed)}, "w", 0)
    assert rows(made) == want and rows(made, "more") == [("f1", 1), ("f3", 9)] and rows(store.latest(spark, at)) == want
    assert rows(old) == sorted(held) and rows(old, "more") == [("f1", 1), ("f3", 3)]  # who has begun to read goes on
    assert all(files(tmp_path).get(p) == t for p, t in before.items())
    assert store.change(spark, at, {"rows": (new.limit(0), changed)}, "w", 0).number == 1  # made before
    assert store.change(spark, at, {"rows": (new.limit(0), changed)}, "other", 0).number == 2
    gone = store.change(spark, at, {"rows": (new.limit(0), spark.createDataFrame(held, KIND))}, "w", 5)
    assert rows(gone) == [] and rows(gone, "more") == [("f1", 1), ("f3", 9)] and gone.read("rows").schema == spark.createDataFrame(held, KIND).schema
    assert len({p.parent for p in files(tmp_path)}) <= len(before) and store.numbers(spark, at) == [2, 3]


@pytest.mark.parametrize("step", ["write_buckets", "write_text", "renamed", "clean"])
def test_a_change_that_stops_at_any_step_can_be_made_again(spark, tmp_path, held, monkeypatch, step):
    at, kept = f"{tmp_path}/t", getattr(store, step)
    changed, new = spark.createDataFrame([("f3",)], "file_path string"), spark.createDataFrame([("f3", "y", 0)], KIND)
    want = sorted([r for r in held if r[0] != "f3"] + [("f3", "y", 0)])

    def stops(*args, **named):
        if step in ("write_buckets", "write_text"):
            kept(*args, **named)
        raise KeyboardInterrupt

    monkeypatch.setattr(store, step, stops)
    with pytest.raises(KeyboardInterrupt):
        store.change(spark, at, {"rows": (new, changed)}, "w", 0)
    monkeypatch.setattr(store, step, kept)
    assert rows(store.latest(spark, at)) == (want if step == "clean" else sorted(held))
    assert rows(store.change(spark, at, {"rows": (new, changed)}, "w", 0)) == want
    store.clean(spark, at, keep=1)
    used = {f"{at}/{p}" for t in store.latest(spark, at).tables.values() for p in t["buckets"].values()}
    assert {str(p.parent) for p in files(tmp_path)} == used
    assert rows(store.latest(spark, at)) == want


def test_a_second_writer_of_a_version_fails(spark, tmp_path, held):
    now = store.latest(spark, f"{tmp_path}/t")
    after = store.Version(spark, now.folder, 1, {}, now.tables)
    store.publish(after)
    with pytest.raises(RuntimeError):
        store.publish(after)


def test_stream_of_changes(spark, tmp_path, held):
    spark.createDataFrame([("f1", "a2", 5), ("f1", "a3", 6), ("f2", None, None)], KIND).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = changes.start(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert rows(store.latest(spark, f"{tmp_path}/t")) == sorted([("f1", "a2", 5), ("f1", "a3", 6), *[r for r in held if r[0] not in ("f1", "f2")]])


NAMES = ["a", "b", "a.b", "c.a.b", "b.c", "d", "x.d", "", "only"]
ENTITY, CALL = "id string, name string, qualified_name string, file_path string, seq long", "owner string, text string, file_path string, seq long"


def drawn(rng, path, place):
    """Entities and calls of one file; places of entities stay within the file's own stretch."""
    ents = [(f"{path}:{k}", n := rng.choice(NAMES[:6]), f"{path}::{n}", path, place * 100 + k) for k in rng.sample(range(50), rng.randrange(4))]
    return ents, [(f"{path}:o{k}", rng.choice([*NAMES, None]), path, place * 100 + 50 + k) for k in range(rng.randrange(5))]


def graph(spark, files):
    ents, sites = ([r for pair in files.values() for r in pair[k]] for k in (0, 1))
    met = spark.createDataFrame([(o, "function", t, p, s) for o, t, p, s in sites], "owner string, owner_kind string, text string, file_path string, seq long")
    return spark.createDataFrame(ents, ENTITY), calls.calls_of(met).select("owner", "text", "file_path", "seq")


def rebuilt(spark, files):
    ents, sites = graph(spark, files)
    return {tuple(r) for r in calls.resolve(sites, ents).select("owner", "text", "target", "target_name", "resolution", "pass").collect()}


def kept(version):
    return {tuple(r) for r in version.read("resolved").select("owner", "text", "target", "target_name", "resolution", "pass").collect()}


def test_calls_kept_resolved_equal_a_rebuild(spark, tmp_path):
    rng, at = random.Random(2), f"{tmp_path}/g"
    files = {f"f{k}": drawn(rng, f"f{k}", k) for k in range(12)}
    incremental.keep_resolved(*graph(spark, files), at, buckets=8)
    for number in range(3):
        was, names = rebuilt(spark, files), rng.sample(range(16), 3)
        for k in names:
            files[f"f{k}"] = ([], []) if rng.random() < 0.3 else drawn(rng, f"f{k}", k)
        changed = spark.createDataFrame([(f"f{k}",) for k in names], "file_path string")
        new = graph(spark, {f: v for f, v in files.items() if int(f[1:]) in names})
        again = incremental.replace_files(spark, at, changed, *new, "w", number)
        now = rebuilt(spark, files)
        assert kept(store.latest(spark, at)) == now
        others = lambda held: {r for r in held if int(r[0][1 : r[0].index(":")]) not in names}
        renewed = {(r.owner, r.text) for r in again.collect()}
        assert renewed >= {r[:2] for r in others(now) - others(was)}  # and no text whose first entity stayed:
        moved = {t for _, t in renewed}
        assert all(r[1] in moved for r in others(now) - others(was))
        assert incremental.replace_files(spark, at, changed, *new, "w", number).count() == 0


def test_stream_of_changed_files(spark, tmp_path):
    rng, at = random.Random(5), f"{tmp_path}/g"
    files = {f"f{k}": drawn(rng, f"f{k}", k) for k in range(8)}
    incremental.keep_resolved(*graph(spark, files), at, buckets=8)
    kind = "file_path string, id string, owner string, name string, qualified_name string, text string, seq long"
    for batch in range(2):
        out = [("f7", None, None, None, None, None, None)]
        for k in (batch, 4):
            files[f"f{k}"] = drawn(rng, f"f{k}", k)
            ents, sites = files[f"f{k}"]
            out += [(f"f{k}", i, None, n, q, None, s) for i, n, q, _, s in ents] + [(f"f{k}", None, o, None, None, t, s) for o, t, _, s in sites if t]
            out += [(f"f{k}", None, None, None, None, None, None)]
        spark.createDataFrame(out, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        files["f7"] = ([], [])
        query = changes.start_calls(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), at, f"{tmp_path}/check")
        query.processAllAvailable()
        query.stop()
        assert kept(store.latest(spark, at)) == rebuilt(spark, files)


def test_a_change_aggregates_postings_once(spark, tmp_path, monkeypatch):
    """The first entity of a text before and after a change comes of one aggregation; the first goes, moves and stays away."""
    from evispark.operators import calls as call_ops
    from evispark.operators import incremental

    entity, call = "id string, name string, qualified_name string, file_path string, seq long", "owner string, text string, file_path string, seq long"
    old = [("a1", "x", "a::x", "a", 1), ("b1", "x", "b::x", "b", 2), ("a2", "y", "a::m.y", "a", 3), ("c1", "z", "c::z", "c", 4)]
    new = [("a3", "w", "a::w", "a", 5), ("a4", "z", "a::z", "a", 0)]
    sites = [("o", t, "b", 10 + k) for k, t in enumerate(("x", "y", "z", "w", "b::x", "none"))]
    frame = spark.createDataFrame
    incremental.keep_resolved(frame(old, entity), frame(sites, call), f"{tmp_path}/s", buckets=2)
    monkeypatch.setattr(incremental, "first_of", None)
    again = incremental.replace_files(spark, f"{tmp_path}/s", frame([("a",)], "file_path string"), frame(new, entity), frame([("n", "w", "a", 20)], call), "t", 0)
    assert sorted(r.text for r in again.collect()) == ["w", "x", "y", "z"]
    held = store.latest(spark, f"{tmp_path}/s").read("resolved")
    now = call_ops.resolve(frame([*sites, ("n", "w", "a", 20)], call), frame([r for r in old if r[3] != "a"] + new, entity))
    assert sorted(map(repr, held.select(*now.columns).collect())) == sorted(map(repr, now.collect()))
