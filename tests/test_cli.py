"""A source tree end to end: scan, audit, gates, baseline, reports, trend and stream."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.operators import history
from plumbline.sinks import reports
from plumbline.sources import files
from plumbline.streaming.snapshots import audit_stream


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    tree = {
        "src/ui/Screen.kt": "import src.core.Engine\nimport org.lib.Other\n",
        "src/ui/Button.kt": "import src.ui.Screen\n",
        "src/core/Engine.kt": "import src.data.Store\n",
        "src/core/Util.kt": "import src.ui.Screen\n// plumbline:ignore\nimport src.data.Store\n",
        "src/data/Store.kt": "",
        "build/Out.kt": "import src.data.Store\n",
    }
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    store = str(tmp_path_factory.mktemp("store"))
    settings = str(root / "settings.json")
    assert cli.main(["init", "--settings", settings]) == 0
    for snapshot in ("s1", "s2"):
        assert cli.main(["scan", str(root), "--store", store, "--settings", settings, "--snapshot", snapshot]) == 0
    return store, settings, tmp_path_factory.mktemp("out")


def test_audit_and_gates(spark, project, capsys):
    store, settings, _ = project
    common = ["--store", store, "--settings", settings]
    assert cli.main(["audit", *common]) == 0
    text = capsys.readouterr().out
    assert "5 modules" in text and "1 circular" in text and "src/core -> src/ui -> src/core" in text
    assert cli.main(["audit", *common, "--fail-below", "99.9"]) == 1


def test_baseline(spark, project, capsys):
    store, settings, out = project
    common = ["--store", store, "--settings", settings, "--baseline", str(out / "b.json")]
    assert cli.main(["baseline", *common]) == 0
    saved = json.loads((out / "b.json").read_text())
    assert saved["violation_count"] == len(saved["fingerprints"]) == 4 and "circular:2:core->ui->core" in saved["fingerprints"]
    assert cli.main(["audit", *common, "--fail-on-new"]) == 0
    (out / "b.json").write_text(json.dumps(saved | {"fingerprints": saved["fingerprints"][1:]}))
    assert cli.main(["audit", *common, "--fail-on-new"]) == 1


def test_all_reports(spark, project):
    store, settings, out = project
    assert cli.main(["report", "all", "--store", store, "--settings", settings, "--out", str(out)]) == 0
    data = json.loads((out / "audit.json").read_text())
    assert data["total_modules"] == 5 and data["circular"] == 1 and data["external"] == [{"snapshot_id": "s2", "module_path": "src/ui/Screen.kt", "count": 1}]
    assert json.loads((out / "sonar.json").read_text())["issues"]
    assert (out / "graph.mmd").read_text().startswith("graph LR") and "-.->" in (out / "graph.mmd").read_text()
    assert (out / "graph.dot").read_text().startswith("digraph")
    assert (out / "markdown" / "src" / "index.md").exists() and (out / "html" / "src" / "ui" / "index.html").exists()
    for name in ("audit.xml", "bundle.html", "dashboard.html", "strategy.html", "pr.md", "briefing.md", "audit.txt"):
        assert (out / name).stat().st_size > 50


def test_documents_hold_every_row(spark, project, monkeypatch):
    monkeypatch.setattr(reports, "SHOWN", 1)
    store, settings, out = project
    assert cli.main(["report", "all", "--store", store, "--settings", settings, "--out", str(out / "few")]) == 0
    few = out / "few"
    for name in ("audit.json", "sonar.json", "audit.xml", "graph.dot", "graph.mmd", "bundle.html", "markdown/src/index.md"):
        assert (few / name).read_text() == (out / name).read_text(), name
    data = json.loads((few / "audit.json").read_text())
    assert len(data["violations"]) == 4
    assert len(json.loads((few / "sonar.json").read_text())["issues"]) == 4
    page = (few / "bundle.html").read_text()
    assert len(json.loads(page.split("const data=")[1].split(";document")[0])["edges"]) == 3


def test_history_follows_the_sequence_not_the_names(spark):
    scores = spark.createDataFrame([("v9", 50.0), ("v10", 70.0), ("v11", 60.0)], "snapshot_id string, score double")
    order = spark.createDataFrame([("v9", 1), ("v10", 2), ("v11", 3)], "snapshot_id string, snap_seq long")
    assert {r.snapshot_id: r.delta for r in history.trend(scores, order=order).collect()} == {"v9": None, "v10": 20.0, "v11": -10.0}
    assert (history.headline(scores, order=order).first().first_score, history.headline(scores, order=order).first().last_score) == (50.0, 60.0)
    by_module = scores.select("snapshot_id", F.lit("m").alias("module"), "score")
    assert {r.snapshot_id: r.arrow for r in history.module_trend(by_module, order=order).collect()} == {"v9": None, "v10": "up", "v11": "down"}
    assert history.trajectories(by_module, scores, order).first().slope == pytest.approx(5.0)


def test_trend(spark, project, capsys):
    store, settings, _ = project
    assert cli.main(["trend", "--store", store, "--settings", settings]) == 0
    assert "s1" in capsys.readouterr().out


def test_one_snapshot_is_read_alone(spark, project):
    modules, deps = files.read_snapshot(spark, project[0], "s1")
    assert modules.count() == 5 and {r.snapshot_id for r in deps.collect()} == {"s1"}
    assert "PartitionFilters" in modules._jdf.queryExecution().toString()


def test_stream_of_snapshots(spark, project, tmp_path):
    seen = {}
    query = audit_stream(spark, project[0], str(tmp_path / "c"), lambda a, n: seen.update({r.snapshot_id: r.n_modules for r in a.scores().collect()}), available_now=True)
    assert query.awaitTermination(120)
    assert seen == {"s1": 5, "s2": 5}


def test_gate():
    reports.gate(90.0, 80.0, 3, False)
    with pytest.raises(reports.GateFailed):
        reports.gate(70.0, 80.0)
