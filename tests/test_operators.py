"""Operators on small hand-made inputs, quirks included."""

import math
import random

from pyspark.sql import functions as F

from evispark.functions import keyed, scalars
from evispark.operators import calls, diagnostics, graph, metrics, sampling, structure, syntax
from evispark.schema import AST_NODES, ENTITIES, FILES, RELATIONS, conform
from evispark.sources import files, json5, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def entities(spark, rows):
    """rows: (id, kind, name, qualified_name, file_path, seq)."""
    return conform(spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string, seq long"), ENTITIES)


def fnv(text):
    h, data = 2166136261, text.encode("utf-16-be")
    for k in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[k : k + 2], "big")) * 16777619 & 0xFFFFFFFF
    return f"{h:08x}"


def test_labels_are_fnv_over_utf16(spark):
    texts = ["", "calls|a|b", "é漢", "🙂 astral", "x" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.stable_id(F.col("t"))).collect()
    assert [r[0] for r in got] == [fnv(t) for t in texts] and got[1][0] == "443cffcb"


def test_scalar_quirks(spark):
    lit = F.lit
    assert one(spark, scalars.endpoint_name(lit("a/Index.ets"))) == "ets"
    assert one(spark, scalars.endpoint_name(lit("f.ets::Page.build"))) == "build"
    assert one(spark, scalars.key_name(lit("Ünï-$_9"))) == "n$_9"
    assert one(spark, scalars.package_name(lit("package.json"), lit("{}"))) == "."
    assert one(spark, scalars.package_name(lit("a/b/pom.xml"), lit(None).cast("string"))) == "b"
    assert one(spark, scalars.module_root(lit("m/src/ohosTest/module.json5"))) == "m/src/ohosTest/module.json5"
    assert one(spark, scalars.clean_root(scalars.joined_path(lit("a/b"), lit("../c/./d/")))) == "a/c/d"
    assert one(spark, scalars.clean_root(scalars.joined_path(lit("."), lit(".")))) == ""
    assert one(spark, scalars.ratio(lit(1), lit(0))) is None
    assert one(spark, scalars.string_at(lit('{"a":{"b":"c"}}'), "a", "b")) == "c"
    assert one(spark, scalars.string_at(lit('{"a":{"b":5}}'), "a", "b")) is None
    assert one(spark, scalars.string_at(lit("{broken"), "a")) is None
    assert one(spark, scalars.is_entry_path(lit("src/MAINpage/x.ts")))


def test_upper_median(spark):
    for values in ([1], [1, 2], [4, 1, 3, 2], [5, 5, 1], []):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        want = sorted(values)[math.floor(len(values) / 2)] if values else None
        assert df.agg(keyed.upper_median("v")).first()[0] == want


def test_last_write_keeps_the_first_place(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("a", 3, 30)], "k string, seq long, v int")
    assert sorted(map(tuple, keyed.last_wins(rows, ["k"]).collect())) == [("a", 1, 30), ("b", 2, 20)]
    assert sorted(map(tuple, keyed.first_wins(rows, ["k"]).collect())) == [("a", 1, 10), ("b", 2, 20)]


def test_built_graph_has_both_endpoints(spark):
    nodes = spark.createDataFrame([("n1", "function", "f", "a.ts::f", "a.ts", "typescript", 1), ("n2", "class", "C", "b.ts::C", "b.ts", "typescript", 2)], "id string, kind string, name string, qualified_name string, file_path string, language string, seq long")
    edges = spark.createDataFrame([("calls", "n1", "n2", 1), ("calls", "n1", "lib", 2), ("calls", "ghost", "n1", 3), ("calls", "n1", "n2", 4)], "kind string, source string, target string, seq long")
    listed = spark.createDataFrame([("a.ts", "typescript", 1), ("b.ts", "typescript", 2)], "path string, language string, seq long")
    ents, rels = graph.build(nodes, edges, listed, "repo", "/repo")
    assert diagnostics.orphan_edges(rels, ents).count() == 0
    got = {(r.kind, r.target_name, r.resolution) for r in rels.collect()}
    assert got == {("calls", "b.ts::C", "internal"), ("calls", "lib", "external"), ("contains", "a.ts", "internal"), ("contains", "b.ts", "internal")}
    assert {r.kind for r in ents.collect()} == {"function", "class", "repository", "file", "external_symbol"}


def test_edges_are_dealt_out_once_for_names(spark):
    """A built graph's relations don't complete the endpoints again, and equal edges, also those that a store has of the repository, are one."""
    own = "repository:" + scalars.labels(["/repo"])[0]
    held = [("n1", "function", "f", "a.ts::f", "a.ts", "typescript", 1), ("n2", "class", "C", None, "b.ts", "typescript", 2), (own, "repository", "repo", "repo", "", "mixed", 3), ("n1", "method", "g", "a.ts::g", "a.ts", "typescript", 4)]
    nodes = spark.createDataFrame(held, "id string, kind string, name string, qualified_name string, file_path string, language string, seq long")
    a, b = ("file:" + scalars.labels([p])[0] for p in ("a.ts", "b.ts"))
    pairs = [("calls", "n1", "n2"), ("calls", "n1", "lib"), ("calls", "n1", "n2"), ("calls", "n1", None), (None, "n2", "n1"), ("contains", own, a), ("contains", own, "n1"), ("uses", own, b), ("calls", "ghost", "n1")]
    edges = spark.createDataFrame([(*p, k) for k, p in enumerate(pairs, 10)], "kind string, source string, target string, seq long")
    listed = spark.createDataFrame([("a.ts", "typescript", 1), ("b.ts", "typescript", 2)], "path string, language string, seq long")
    ents, rels = graph.build(nodes, edges, listed, "repo", "/repo")
    projected = graph.project_edges(graph.visited_edges(edges, nodes), ents, "graph").unionByName(graph.contain_files(ents, "repo", "/repo"))
    want = keyed.last_wins(projected.drop("id"), ["kind", "source", "target", "source_name", "target_name"])
    names = ["kind", "source", "target", "source_name", "target_name", "resolution", "seq"]
    assert sorted(map(repr, rels.select(*names).collect())) == sorted(map(repr, want.select(*names).collect()))
    assert sorted(r.name for r in ents.where("kind = 'external_symbol'").collect()) == ["lib"]
    assert rels._jdf.queryExecution().optimizedPlan().toString().count("external_symbol") == 0


def test_metrics_of_two_files(spark):
    listed = conform(spark.createDataFrame([("a.ets", True, True, 1), ("b.ets", True, False, 2)], "path string, is_candidate boolean, is_indexed boolean, seq long"), FILES)
    ents = entities(spark, [("1", "class", "Page", "a.ets::Page", "a.ets", 1)])
    side = metrics.Tables(ents, conform(spark.createDataFrame([], RELATIONS), RELATIONS), listed)
    scope = listed.where("path = 'a.ets'").select("path")
    unreviewed = metrics.evaluate(side, None, scope).first()
    assert unreviewed.entity_recall is None and unreviewed.file_coverage == 1
    reviewed = metrics.evaluate(side, side, scope).first()
    assert (reviewed.file_coverage, reviewed.entity_recall, reviewed.entity_precision, reviewed.edge_recall) == (1, 1, 1, None)
    assert metrics.evaluate(side, None).first().file_coverage == 0.5
    assert metrics.coverage(listed.limit(0)).first().file_coverage == 1.0


def test_agreement_of_shared_tables_is_that_of_separate_ones(spark):
    listed = conform(spark.createDataFrame([("A.ets", True, True, 1), ("b.ets", True, False, 2)], "path string, is_candidate boolean, is_indexed boolean, seq long"), FILES)
    marks = [(True, True), (True, False), (False, True), (True, None), (None, True), (False, False), (None, None)]
    flags = metrics.sides(F.element_at(F.lit([a for a, _ in marks]), F.col("seq").cast("int")), F.element_at(F.lit([t for _, t in marks]), F.col("seq").cast("int")))
    ents = entities(spark, [(str(k), "class", f"Page{k // 3}", f"x::Page{k // 3}", "a.ets" if k < 7 else "b.ets", k) for k in range(1, 8)]).withColumn("sides", flags)
    ends = [("calls", "a.ets::f", "m.g()", "a.ets"), ("calls", "b.ets::f", "n.g", "A.ETS"), ("calls", "a.ets::f", "h", "a.ets"), (None, "a.ets::f", "h", "a.ets"), (None, "a.ets::f", "h", "a.ets"), ("calls", "a.ets::f", "i", "a.ets"), ("calls", "a.ets::f", "g", "")]
    rows = [(*e, "internal", k) for k, e in enumerate(ends, 1)] + [("calls", "b.ets::f", "out", "b.ets", "internal", 1)]
    rels = spark.createDataFrame(rows, "kind string, source_name string, target_name string, file_path string, resolution string, seq long")
    rels = conform(rels, RELATIONS).withColumn("sides", flags)
    both = metrics.Tables(ents, rels, listed)
    actual, truth = (metrics.Tables(ents.where(metrics.has(side)).drop("sides"), rels.where(metrics.has(side)).drop("sides"), listed) for side in (metrics.ACTUAL, metrics.TRUTH))
    scope = listed.where("is_indexed").select("path")
    got = metrics.agreement(both, scope).first()
    assert got == metrics.evaluate(actual, truth, scope).first()
    assert (got.candidate_files, got.indexed_files, got.entities, got.relations) == (1, 1, 3, 3)  # a repeated key counts as a row each time
    assert (got.entity_recall, got.entity_precision, got.edge_recall, got.edge_precision) == (1.0, 1.0, 2 / 3, 1.0)
    empty = metrics.agreement(metrics.Tables(ents.limit(0), rels.limit(0), listed), scope).first()
    assert (empty.entities, empty.relations, empty.entity_recall, empty.edge_precision) == (0, 0, None, None)


def test_modules_apply_strictly_below_their_root(spark):
    rows = entities(spark, [("p", "package", "p", "p", "lib/package.json", 1), ("q", "package", "q", "q", "package.json", 2), ("c", "class", "c", "c", "Lib/A.ts", 3), ("d", "class", "d", "d", "z.ts", 4)])
    scope = spark.createDataFrame([("lib/a.ts",)], "path string")
    assert {r.id for r in structure.applying(rows, scope).collect()} == {"p", "q", "c"}
    assert structure.applying(rows, scope.limit(0)).count() == 0


def test_sample_ignores_row_order_and_respects_size(spark):
    rng = random.Random(1)
    listed = [(f"f{k}/main{k % 3}.ts", k) for k in range(40)]
    ents = [(f"e{k}", "component" if k % 9 == 0 else "function", "n", "q", f"f{k % 40}/main{k % 40 % 3}.ts", k) for k in range(120)]
    none = conform(spark.createDataFrame([], RELATIONS), RELATIONS)
    results = []
    for _ in range(2):
        rng.shuffle(listed)
        rng.shuffle(ents)
        scored = sampling.scores(spark.createDataFrame(listed, "path string, seq long"), entities(spark, ents), none, "s")
        results.append({r.path for r in sampling.sample(scored, 7).where("selected").collect()})
    assert results[0] == results[1] and len(results[0]) == 7
    every = sampling.sample(scored, 0).collect()
    assert len(every) == 40 and all(r.selected and r.reasons == ["all files selected"] for r in every)
    assert all(r.selected for r in sampling.sample(scored, 40).collect())


def walked(ents, sites):
    """Calls resolved one by one in order, as a single pass and a forward pass would."""
    events = [(e[-1], 0, e) for e in ents] + [(s[-1], 1, s) for s in sites]
    known, edges = [], {}
    fits = lambda e, text: e[1] == text or e[2].endswith("." + text)
    for _, kind, x in sorted(events, key=lambda v: v[:2]):
        if kind == 0:
            known.append(x)
            continue
        owner, text = x[0], x[1]
        hit = next((e for e in known if fits(e, text)), None)
        if hit is None:
            known.append((f"external:{text}", text, text, "", 0))
        edges[owner, hit[0] if hit else f"external:{text}"] = (text, "internal" if hit else "unresolved")
    for (owner, target), (text, resolution) in list(edges.items()):
        hit = next((e for e in known if e[3] and fits(e, text)), None) if resolution == "unresolved" else None
        if hit:
            del edges[owner, target]
            edges[owner, hit[0]] = (hit[2], "internal")
    return {(o, t, n, r) for (o, t), (n, r) in edges.items()}


def test_ordered_walk_equals_brute_force(spark):
    rng = random.Random(6)
    for _ in range(4):
        names = ["a", "b", "a.b", "c.a.b", "b.c", "d", "x.d", "e.x.d"]
        places = rng.sample(range(400), 150)
        ents = [(f"e{p}", n := rng.choice(names[:6]), f"f.ts::{n}", "f.ts", p) for p in places[:25]]
        sites = [(f"o{rng.randrange(12)}", rng.choice(names), p) for p in places[25:]]
        table = spark.createDataFrame(ents, "id string, name string, qualified_name string, file_path string, seq long")
        met = spark.createDataFrame([(o, "function", o, t, "f.ts", p) for o, t, p in sites], "owner string, owner_kind string, owner_name string, text string, file_path string, seq long")
        got = {(r.owner, r.target, r.target_name, r.resolution) for r in calls.resolve_in_order(calls.calls_of(met), table).collect()}
        assert got == walked(ents, sites)


def test_texts_of_thirty_dots_are_settled_in_one_round(spark, monkeypatch):
    rng, rounds = random.Random(3), []
    cut = calls.cut_lineage
    monkeypatch.setattr(calls, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    full = ".".join(rng.choice("abc") for _ in range(31))
    names = [full[2 * k :] for k in range(31)] + [f"z.{full[2 * k :]}" for k in range(0, 31, 3)]
    places = rng.sample(range(900), 240)
    ents = [(f"e{p}", n := rng.choice(names), f"f.ts::{n}", "f.ts", p) for p in places[:12]]
    sites = [(f"o{rng.randrange(9)}", rng.choice(names), p) for p in places[12:]]
    table = spark.createDataFrame(ents, "id string, name string, qualified_name string, file_path string, seq long")
    met = spark.createDataFrame([(o, "function", o, t, "f.ts", p) for o, t, p in sites], "owner string, owner_kind string, owner_name string, text string, file_path string, seq long")
    got = {(r.owner, r.target, r.target_name, r.resolution) for r in calls.resolve_in_order(calls.calls_of(met), table).collect()}
    assert got == walked(ents, sites) and len(rounds) == 2


TREE = [
    # node, parent, type, text, start, row, name, function
    (1, None, "program", "...", 0, 0, None, None),
    (2, 1, "import_statement", 'import router from "@ohos.router"', 0, 0, None, None),
    (3, 1, "decorator", "@Entry", 10, 1, None, None),
    (4, 1, "decorator", "@Component", 20, 2, None, None),
    (5, 1, "struct_declaration", "struct Index {...}", 30, 3, "Index", None),
    (6, 5, "block", "{...}", 40, 3, None, None),
    (7, 6, "method_definition", "build() {...}", 50, 4, "build", None),
    (8, 7, "block", "{...}", 60, 4, None, None),
    (9, 8, "expression", "...", 65, 4, None, None),
    (10, 9, "call_expression", "greeting()", 70, 5, None, "greeting"),
    (11, 9, "call_expression", "router.push()", 75, 5, None, "router.push"),
    (12, 1, "function_declaration", "function greeting() {...}", 80, 8, "greeting", None),
    (13, 12, "call_expression", "formatGreeting()", 90, 9, None, "formatGreeting"),
    (14, 1, "function_declaration", "function formatGreeting() {}", 100, 12, "formatGreeting", None),
    (15, 1, "struct_declaration", "struct Plain {}", 120, 14, "Plain", None),
]


def test_syntax_trees(spark):
    rows = [("p.ets", n, p, n, t, x, s, r, r, name, call, None) for n, p, t, x, s, r, name, call in TREE]
    listed = spark.createDataFrame([("p.ets", 1)], "path string, seq long")
    for in_order in (False, True):
        out = syntax.extract(spark.createDataFrame(rows, AST_NODES), listed, in_order=in_order)
        ents = {r.qualified_name: r for r in out.entities.collect()}
        assert {(q, r.kind) for q, r in ents.items()} == {
            ("p.ets", "file"), ("p.ets::@ohos.router", "import"), ("@ohos.router", "external_symbol"), ("p.ets::Index", "component"), ("p.ets::Index.build", "method"),
            ("p.ets::greeting", "function"), ("p.ets::formatGreeting", "function"), ("p.ets::Plain", "struct"),
        }
        assert ents["p.ets::Index"].decorators == ["Entry", "Component"] and ents["p.ets::Plain"].decorators is None
        edges = {(r.kind, r.source_name, r.target_name, r.resolution) for r in out.relations.collect()}
        assert {e for e in edges if e[0] == "calls"} == {
            ("calls", "p.ets::Index.build", "p.ets::greeting", "internal"), ("calls", "p.ets::greeting", "p.ets::formatGreeting", "internal"), ("calls", "p.ets::Index.build", "router.push", "unresolved"),
        }
        assert ("imports", "p.ets", "@ohos.router", "external") in edges and ("contains", "p.ets::Index", "p.ets::Index.build", "internal") in edges


def test_structure_from_manifests(spark):
    manifests = spark.createDataFrame(
        [
            ("entry/src/main/module.json5", "{module: {name: 'entry', type: 'entry'},}"),
            ("build-profile.json5", "{ // profile\n modules: [{name: 'again', srcPath: './entry'}, {name: 'lib', srcPath: './lib'}, {name: 5, srcPath: 'x'}] }"),
            ("package.json", '{"name": 7}'),
            ("lib/oh-package.json5", "broken {"),
        ],
        "path string, content string",
    )
    own = entities(spark, [("f1", "file", "a", "entry/a.ets", "entry/a.ets", 1), ("f2", "file", "b", "lib/b.ets", "lib/b.ets", 2), ("f3", "file", "c", "c.ets", "c.ets", 3)])
    ents, rels = structure.structure(json5.read_manifests(manifests), own, "repo", "/repo")
    got = {(r.kind, r.name, r.metadata.root) for r in ents.collect()}
    # the build profile comes first by path, so its names win
    assert got == {("module", "again", "entry"), ("module", "lib", "lib"), ("package", ".", None), ("package", "lib", None)}
    held = {(r.source_name, r.target_name) for r in rels.collect() if r.source_name != "repo"}
    assert held == {("again", "entry/a.ets"), ("lib", "lib/b.ets"), (".", "entry/a.ets"), (".", "lib/b.ets"), (".", "c.ets")}


def test_json5():
    assert json5.loads("{a: 'x\\'y', \"b\": [+1, 0x1F, .5,], /* c */ d: null, // e\n}") == {"a": "x'y", "b": [1, 31, 0.5], "d": None}
    for bad in ("", "{a 1}", "[1 2]", "{a: }", "{", "nul", "'x"):
        assert json5.parsed(bad) is None


def test_folder_source(spark, tmp_path):
    for name in ("a.ts", ".hidden.py", "lib/b.py", "lib/node_modules/c.py", "build/d.py", "lib/dist/e.py", "x.unknown", "lib/package.json", ".dot/pom.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    paths = files.paths_below(spark, str(tmp_path))
    assert [r.path for r in files.supported_files(paths).collect()] == [".dot/pom.xml", ".hidden.py", "a.ts", "lib/b.py"]
    assert [r.path for r in files.supported_files(paths, "typescript").collect()] == ["a.ts"]
    assert [r.path for r in files.manifest_files(paths).collect()] == ["lib/package.json"]


def test_one_deep_tree_is_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    want = []
    for k in range(6):
        for name in (f"src/a{k}/b/c/d{k}.py", f"src/a{k}/.x", f"src/a{k}/.git/no.py", f"src/e{k}.ts"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text("x")
            want += [name] * (".git" not in name)
    (tmp_path / "src" / "empty").mkdir()
    (tmp_path / "src" / "loop").symlink_to(tmp_path, target_is_directory=True)
    assert sorted(r.path for r in files.paths_below(spark, str(tmp_path)).collect()) == sorted(want)
    assert sorted(r.path for r in files.paths_below(spark, f"file://{tmp_path}").collect()) == sorted(want)
    tasks = []
    cut = files.cut_lineage
    monkeypatch.setattr(files, "cut_lineage", lambda df: tasks.append(df.where("NOT is_folder").select(F.spark_partition_id()).distinct().count()) or cut(df))
    files.paths_below(spark, str(tmp_path))
    assert len(tasks) == 5 and max(tasks) > 2


def test_the_seed_reads_entities_and_relations_once(spark, tmp_path, monkeypatch):
    """And without bounds for what is sent to them, it is the same."""
    ents = entities(spark, [(f"e{k}", "class", f"n{k}", f"n{k}", f"f{k % 9}.ts", k) for k in range(60)] + [("e3", "class", "other", "other", "", 99)])
    edges = conform(spark.createDataFrame([("calls", f"e{k}", f"e{(7 * k) % 61}", f"n{k}", f"n{(7 * k) % 61}", f"f{k % 9}.ts", "internal", k) for k in range(60)], "kind string, source string, target string, source_name string, target_name string, file_path string, resolution string, seq long"), RELATIONS)
    ents.write.parquet(f"{tmp_path}/e")
    edges.write.parquet(f"{tmp_path}/r")
    chosen, plans, cut = spark.createDataFrame([("f1.ts",), ("f2.ts",)], "path string"), [], sampling.cut_lineage
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(sampling, "cut_lineage", lambda df: planned(df) or cut(df))
    out = [sampling.review_seed(spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/r"), chosen)]
    for df in out[0]:
        planned(df)
    assert sum(p.count("FileScan parquet") for p in plans) == 2
    assert not any("Exchange hashpartitioning(file_path" in p or "SortMergeJoin" in p for p in (plans[1], plans[3]))
    monkeypatch.setattr("evispark.session.FEW", -1)
    out.append(sampling.review_seed(ents, edges, chosen))
    rows = [[sorted(map(str, df.collect())) for df in pair] for pair in out]
    assert rows[0] == rows[1] and len(rows[0][1]) == 14
    paths = {"f1.ts", "f2.ts"}
    mine = [e for e in edges.collect() if e.file_path in paths]
    ends = {(i, n) for e in mine for i, n in ((e.source, e.source_name), (e.target, e.target_name))}
    assert {r.id for r in out[0][0].collect()} == {e.id for e in ents.collect() if e.file_path in paths or (e.id, e.qualified_name) in ends}


def test_incremental_replacement(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file_path string, v int")
    new = spark.createDataFrame([("a", 10), ("a", 11), ("c", 30)], "file_path string, v int")
    changed = spark.createDataFrame([("a",), ("b",)], "file_path string")
    assert sorted(map(tuple, store.replace_rows(old, new, changed, "file_path").collect())) == [("a", 10), ("a", 11), ("c", 3)]


def test_paths_that_share_a_label_are_told_apart(spark, monkeypatch):
    """Labels of 32 bits collide; here all do. No relation, language or endpoint may be lost or mixed up by that."""
    from evispark.operators import summary

    monkeypatch.setattr(graph, "stable_id", lambda value: F.lit("00000000"))
    nodes = spark.createDataFrame([("n1", "function", "f", "f", "a.ts", "typescript", 1)], "id string, kind string, name string, qualified_name string, file_path string, language string, seq long")
    edges = spark.createDataFrame([], "kind string, source string, target string, seq long")
    files = spark.createDataFrame([("a.ts", "typescript", 1), ("b.py", "python", 2), ("c.py", "python", 3)], "path string, language string, seq long")
    entities, relations = graph.build(nodes, edges, files, "repo", "/repo")
    held = {(r.target, r.target_name) for r in relations.collect()}
    assert held == {("file:00000000", p) for p in ("a.ts", "b.py", "c.py")}
    back = relations.select("kind", F.col("target").alias("source"), F.col("target_name").alias("source_name"), "resolution", "file_path")
    counts = {r.language: r.relations for r in summary.by_language(files, entities, back).collect()}
    assert (counts["typescript"], counts["python"]) == (1, 2)
    chosen = spark.createDataFrame([("b.py",)], "path string")
    kept, edges = sampling.review_seed(entities, relations, chosen)
    assert sorted(r.name for r in kept.collect()) == ["b.py", "repo"] and edges.count() == 1
    imports = spark.createDataFrame([("x", p, k) for k, p in enumerate(("a.ts", "b.py", "c.py"))] + [("y", "a.ts", 9)], "name string, file_path string, seq long")
    found = graph.import_edges(imports, entities, "syntax")[1].collect()
    assert sorted((r.source_name, r.target_name) for r in found) == [("a.ts", "x"), ("a.ts", "y"), ("b.py", "x"), ("c.py", "x")]


def test_labels_evaluate_their_text_once(spark):
    """A text that is an expression isn't evaluated again for each of its characters."""
    plan = spark.range(1).select(scalars.stable_id(F.concat(F.lit("text"), F.col("id").cast("string"))).alias("label"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat(text") == 1


def test_labels_of_many_texts(spark):
    texts = ["", "a", "ä€", "\U0001f600x", "x\U00010000", "a\0b", "￿", "long " * 3000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.stable_id(F.col("t")).alias("label"), scalars.relation_id(F.lit("calls"), F.col("t"), F.lit("y")).alias("id"), scalars.stable_id(F.concat_ws("|", F.lit("calls"), "t", F.lit("y"))).alias("own")).collect()
    assert [r.label for r in rows] == scalars.labels(texts) and rows[1].label == "e40c292c" and all(r.id == f"edge:{r.own}" for r in rows)
    assert scalars.labels([]) == []
