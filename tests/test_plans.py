"""The commands over a small repository."""

import json

import pytest
from pyspark.sql import functions as F

from evispark.plans import config, run
from evispark.schema import AST_NODES, FILES
from tests.test_operators import TREE

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, decorators array<string>, seq long"


@pytest.fixture
def settings(spark, tmp_path):
    for name in ("small", "medium", "large"):
        at = f"{tmp_path}/in/{name}"
        if name == "large":
            continue  # its tables are missing, so its run fails
        path = "entry/main/p.ets"
        nodes = [("n1", "struct", "Index", f"{path}::Index", path, "arkts", 4, 9, ["@Entry"], 1), ("n2", "method", "build", f"{path}::Index.build", path, "arkts", 5, 6, None, 2), ("n3", "function", "greeting", f"{path}::greeting", path, "arkts", 9, 9, None, 3)]
        spark.createDataFrame(nodes, NODES).write.parquet(f"{at}/nodes.parquet")
        spark.createDataFrame([("calls", "n2", "n3", 1), ("contains", "n1", "n2", 2), ("calls", "n3", "lib", 3)], "kind string, source string, target string, seq long").write.parquet(f"{at}/edges.parquet")
        spark.createDataFrame([(path, "arkts", True, True, 1), ("entry/b.ets", "arkts", True, False, 2)], FILES).write.parquet(f"{at}/files.parquet")
        spark.createDataFrame([("entry/src/main/module.json5", "{module: {name: 'entry'}}")], "path string, content string").write.parquet(f"{at}/manifests.parquet")
        rows = [(path, n, p, n, t, x, s, r, r, who, call, None) for n, p, t, x, s, r, who, call in TREE]
        spark.createDataFrame(rows, AST_NODES).write.parquet(f"{at}/ast_nodes.parquet")
    raw = {"repositories": [{"id": n, "size": n, "path": f"in/{n}"} for n in ("small", "medium", "large")], "outputDirectory": "out", "incremental": {"trials": 1}}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    return config.load(str(tmp_path / "c.json"))


def test_run_review_and_evaluate(spark, settings):
    small, large = settings.repository("small"), settings.repository("large")
    assert run.run_repository(spark, small, settings) and not run.run_repository(spark, large, settings)
    out = f"{settings.output}/small"
    assert run.read_json(f"{settings.output}/large/run-status.json")["crashed"] and "message" in run.read_json(f"{settings.output}/large/crash.json")["error"]
    first = run.read_json(f"{out}/report.json")
    assert first["groundTruthStatus"] == "missing-or-unreviewed" and first["graph"]["metrics"]["file_coverage"] == 0.5
    assert first["graph"]["metrics"]["entity_recall"] is None and first["graph"]["acceptance"]["entity_recall"] == "not-evaluated"
    assert first["graph"]["summary"]["entitiesByKind"]["component"] == 1 and first["graph"]["summary"]["entitiesByKind"]["module"] == 1
    assert first["syntax"]["agreement"]["entity_precision"] is not None and first["sample"] == ["entry/main/p.ets"]
    kinds = first["graph"]["summary"]["entitiesByKind"]
    assert sum(kinds.values()) == sum(v["entities"] for v in first["graph"]["summary"]["byLanguage"].values())
    assert run.init_ground_truth(spark, small, settings) and not run.init_ground_truth(spark, small, settings)
    assert run.evaluate_existing(spark, small, settings)
    assert run.read_json(f"{out}/report.json")["groundTruthStatus"] == "unreviewed"
    header = run.read_json(f"{out}/ground-truth/header.json")
    header["review"]["status"], header["diagnostics"] = "reviewed", []
    run.write_json(f"{out}/ground-truth/header.json", header)
    assert run.evaluate_existing(spark, small, settings)
    last = run.read_json(f"{out}/report.json")
    assert last["groundTruthStatus"] == "reviewed" and last["graph"]["metrics"]["entity_recall"] == 1 and last["graph"]["metrics"]["file_coverage"] == 1
    assert not run.evaluate_existing(spark, large, settings)
    with pytest.raises(ValueError):
        settings.repository("other")


def test_a_failed_run_leaves_the_last_ones_tables(spark, settings, monkeypatch):
    small = settings.repository("small")
    out = f"{settings.output}/small"
    assert run.run_repository(spark, small, settings)
    before = [sorted(map(str, t.collect())) for t in vars(run.load(spark, f"{out}/{run.WIDE}")).values()]

    def fails(spark, repo):
        found = kept(spark, repo)
        found.relations = found.relations.withColumn("seq", F.raise_error(F.lit("broken")).cast("long"))
        return found

    kept = run.observe_graph
    monkeypatch.setattr(run, "observe_graph", fails)
    assert not run.run_repository(spark, small, settings)
    assert run.read_json(f"{out}/crash.json") and run.read_json(f"{out}/run-status.json")["crashed"]
    assert [sorted(map(str, t.collect())) for t in vars(run.load(spark, f"{out}/{run.WIDE}")).values()] == before
    monkeypatch.setattr(run, "observe_graph", kept)
    assert run.run_repository(spark, small, settings)
    assert run.read_json(f"{out}/crash.json") is None and not run.read_json(f"{out}/run-status.json")["crashed"]


def test_config_is_checked(tmp_path):
    for raw in ({}, {"repositories": []}, {"repositories": [{"id": "a", "size": "huge", "path": "x"}] * 3}, {"repositories": [{"id": "a", "size": "small", "path": "x"}] * 3, "acceptance": {"fileCoverage": 2}}):
        (tmp_path / "c.json").write_text(json.dumps(raw))
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c.json"))


def test_json_behind_a_file_system(spark, tmp_path):
    at = f"file://{tmp_path}/deep/x.json"
    assert run.read_json(at) is None
    run.write_json(at, {"a": ["é", None]})
    assert run.read_json(at) == {"a": ["é", None]} and run.read_json(f"{tmp_path}/deep/x.json") == {"a": ["é", None]}
