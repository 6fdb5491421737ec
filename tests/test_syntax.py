"""The scan of syntax trees against a recursive walk, and the parser of pages."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from evispark.fixtures import Pages
from evispark.operators import syntax
from evispark.schema import AST_NODES
from evispark.session import show_package
from evispark.sources.parsers import Markup, parsed

TYPES = ["block", "expression", "class_declaration", "method_definition", "struct_declaration", "call_expression", "decorator", "decorator", "call_decorator_list"]


def tree(rng, path, size):
    """Nodes (path, node, parent, preorder, type, text) of a random tree; numbers of nodes in no order."""
    ids, out = rng.sample(range(10_000), size), []

    def grow(parent, room):
        while room > 0:
            node, inside = ids[len(out)], rng.randrange(room)
            out.append((path, node, parent, len(out), rng.choice(TYPES), f"@t{node}" if rng.random() < 0.8 else f"u{node}"))
            grow(node, inside)
            room -= inside + 1

    grow(None, size)
    return out


def plainly(nodes):
    """(node, owner, decorators) of nodes that declare or call, by parents and siblings alone."""
    by, out = {n[1]: n for n in nodes}, set()
    mark = lambda n: n[5].removeprefix("@")
    for n in nodes:
        if n[4] not in syntax.KINDS and n[4] not in syntax.CALLS:
            continue
        owner = n[2]
        while owner is not None and by[owner][4] not in syntax.KINDS:
            owner = by[owner][2]
        before = []
        for s in reversed([s for s in nodes if s[2] == n[2] and s[3] < n[3]]):
            if "decorator" not in s[4]:
                break
            before.insert(0, mark(s))
        inside = [mark(s) for s in nodes if s[2] == n[1] and "decorator" in s[4]]
        out.add((n[0], n[1], owner, tuple(before + inside) or None))
    return out


def test_scan_equals_a_recursive_walk(spark):
    rng = random.Random(8)
    trees = [tree(rng, f"p{k}", rng.choice([1, 2, 9, 60])) for k in range(25)]
    rows = [(p, n, up, k, t, x, 0, 0, 0, None, None, None) for nodes in trees for p, n, up, k, t, x in nodes]
    rng.shuffle(rows)
    got = syntax.walked(spark.createDataFrame(rows, AST_NODES)).collect()
    want = set().union(*map(plainly, trees))
    assert len(got) == len(want)
    assert {(r.file_path, r.node_id, r.owner_node, tuple(r.decorators) if r.decorators else None) for r in got} == want
    assert syntax.walked(spark.createDataFrame([], AST_NODES)).collect() == []


def test_scan_goes_on_over_batches_and_holds_open_nodes_only():
    deep = [("p", k, k - 1 if k else None, k, "class_declaration") for k in range(3000)] + [("p", 3000 + k, 0, 3000 + k, "decorator" if k % 2 else "call_expression") for k in range(10)]
    kinds = {"file_path": pa.string(), "node_id": pa.int64(), "parent_id": pa.int64(), "owner_node": pa.int64(), "decorators": pa.list_(pa.string())}
    columns = list(zip(*deep))
    table = pa.table({"file_path": columns[0], "node_id": pa.array(columns[1], pa.int64()), "parent_id": pa.array(columns[2], pa.int64()),
                      "__mark": [f"m{n}" if t == "decorator" else None for _, n, _, _, t in deep], "__declares": [t == "class_declaration" for *_, t in deep], "__wanted": [t != "decorator" for *_, t in deep]})
    out = [r for b in syntax.scanned(pa.schema(kinds))(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert len(out) == 3005 and all(r["owner_node"] == r["node_id"] - 1 for r in out if 0 < r["node_id"] < 3000)
    assert out[-1]["node_id"] == 0 and out[-1]["decorators"] == [f"m{n}" for n in range(3001, 3010, 2)]
    assert {r["node_id"]: r["decorators"] for r in out}[3004] == ["m3003"]


def test_markup():
    page = "<!DOCTYPE html>\n<html><!-- <b> --><nav><a href='x'>To there</a><br/><p>One<p>Two</nav></x><script>if (a<b) '</p>'</script>\n<div>Ad</div><article><h1>Head line</h1><b>open"
    nodes = {n.node_id: n for n in Pages().nodes("p", page)}
    line = [(n.type, None if n.parent_id is None else nodes[n.parent_id].type, n.name_text, n.function_text) for n in nodes.values()]
    assert line == [
        ("html", None, None, None), ("namespace_declaration", "html", None, None), ("call_expression", "namespace_declaration", None, "To"), ("br", "namespace_declaration", None, None),
        ("p", "namespace_declaration", None, None), ("p", "p", None, None), ("script", "html", None, None), ("decorator", "html", None, None), ("struct_declaration", "html", None, None),
        ("method_definition", "struct_declaration", "Head", None), ("b", "struct_declaration", None, None),
    ]
    at = {n.type: n for n in nodes.values()}
    assert at["decorator"].text == "<div>Ad</div>" and at["html"].text is None and (at["html"].start_row, at["html"].end_row, at["decorator"].start_row) == (1, 2, 2)
    assert at["struct_declaration"].text.endswith("<b>open") and at["namespace_declaration"].text.endswith("</nav>")
    for odd in ("", "<", "</p>", "<p", "<script>", "<!-- x", "plain", "<é>"):
        assert len(list(Markup().nodes("p", odd))) == (odd == "<script>")


def test_pages_become_tables(spark):
    show_package(spark)
    files = spark.createDataFrame([("a", "<nav><a>f x</a></nav><h1>f</h1>", 1), ("b", None, 2), ("c", "", 3)], "path string, content string, seq long")
    nodes = parsed(files, Pages)
    assert nodes.where("file_path = 'a'").count() == 3 and nodes.where("file_path <> 'a'").count() == 0
    assert [c for c in nodes.columns] == [part.split(" ")[0] for part in AST_NODES.split(", ")]
    out = syntax.extract(nodes, files.select("path", "seq"))
    assert [(r.source_name, r.target_name, r.resolution) for r in out.relations.where("kind = 'calls'").collect()] == [("a::<anonymous@1>", "a::f", "internal")]
    assert out.entities.where(F.col("kind") != "file").count() == 2
