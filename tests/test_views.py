"""What reports are made of, on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.languages import Adapter
from plumbline.functions.paths import common_ancestor, relative_label
from plumbline.operators import actions, imports, reach, rollup
from plumbline.plans import audit as audits
from plumbline.plans import monorepo
from plumbline.plans.settings import ModuleConfig
from plumbline.sinks import reports
from plumbline.sources import files

from .test_graph import graph


def roots(spark, *paths):
    rows = spark.createDataFrame([("s", p) for p in paths], "snapshot_id string, path string")
    return tuple(rollup.common_roots(rows).first())[1:]


def test_common_roots(spark):
    assert roots(spark, "a/b/c/x.kt", "a/b/d/y.kt") == ("a/b", "a", "a/b")
    assert roots(spark, "a/x.kt", "a/b/y.kt") == ("a", "a", "a")
    assert roots(spark, "ab/x.kt", "abc/y.kt") == ("", "", "ab")
    assert roots(spark, "x.kt", "a/y.kt") == ("", "", "")
    assert roots(spark, "a/b/x.kt") == ("a/b", "a", "a/b")
    assert roots(spark, "x.kt") == ("", "", "")
    assert rollup.common_roots(spark.createDataFrame([], "snapshot_id string, path string")).count() == 0


def test_common_ancestor_and_label(spark):
    rows = spark.createDataFrame([(["a/b/x", "a/b/c/y"],), (["a/x", "ab/y"],), (["a/b/x"],), ([],)], "p array<string>")
    assert [r[0] for r in rows.select(common_ancestor(F.col("p"))).collect()] == ["a/b", "", "a/b", ""]
    cases = [("a/b/x", "a", "b: x"), ("a/b/x", "a/b", "x"), ("a/b/x", "", "a/b: x"), ("x", "", "x"), ("ab/x", "a", "ab: x")]
    made = spark.createDataFrame([c[:2] for c in cases], "p string, d string").select(relative_label(F.col("p"), F.col("d"))).collect()
    assert [r[0] for r in made] == [c[2] for c in cases]


def test_level_cycles_keep_crossing_hops(spark):
    g = graph(spark, {"1": "a/p/x.kt", "2": "b/q/y.kt", "3": "b/r/z.kt"}, [("1", "2", 1), ("1", "2", 2), ("2", "1", 1), ("2", "3", 1), ("3", "2", 1)])
    v = audits.raw_violations(g)
    (top,) = rollup.level_cycles(v, 1).collect()
    assert (top.directory, top.cycle_path, [tuple(h) for h in top.hops]) == ("", ["a", "b", "a"], [("a", "b", 2, False), ("b", "a", 1, True)])
    (below,) = rollup.level_cycles(v, 2).collect()
    assert (below.directory, [tuple(h) for h in below.hops]) == ("b", [("b/q", "b/r", 1, True), ("b/r", "b/q", 1, False)])
    assert rollup.level_cycles(v, 3).count() == 0 == rollup.level_cycles(v.limit(0), 1).count()


def test_promoted_hints_and_types(spark):
    g = graph(spark, {str(i): f"d{i}/x.kt" for i in range(7)}, [("0", str(i), n) for i in range(1, 7) for n in range(i)] + [("1", "0", 1)])
    v = audits.raw_violations(g)
    rows = {(r.dir_a, r.dir_b): (r.place, r.promoted) for r in rollup.promoted(v).collect()}
    assert rows["d0", "d6"] == (1, True) and rows["d0", "d2"] == (5, True) and rows["d0", "d1"] == (6, False) and len(rows) == 7
    (hint,) = rollup.direction_hints(v).collect()
    assert (hint.wrong_from, hint.wrong_to) == ("d1", "d0")
    equal = v.where("is_circular").unionByName(v.where("is_circular").withColumns({"dir_a": F.col("dir_b"), "dir_b": F.col("dir_a")}))
    assert [r.wrong_from for r in rollup.direction_hints(equal).collect()] == [None, None]
    (types,) = rollup.violation_types(v, g.modules).collect()
    assert (types.violations, types.circular, types.coupled) == (8, 1, 7)
    assert tuple(rollup.violation_types(v.limit(0), g.modules).first())[1:] == (0, 0, 0, 0)


def test_radius_of_some_equals_that_of_all(spark):
    g = graph(spark, {str(i): f"d/{i}.kt" for i in range(6)}, [("0", "1", 1), ("1", "2", 1), ("2", "0", 1), ("3", "2", 1), ("4", "3", 1), ("4", "4", 1)])
    whole = {(r.path, r.blast_radius) for r in reach.blast_radius(g.edges(), g.modules).collect()}
    assert {(r.path, r.blast_radius) for r in reach.radius_of(g.edges(), g.modules).collect()} == whole
    assert reach.radius_of(g.edges(), g.modules.limit(0)).count() == 0


def test_projected(spark):
    scores = spark.createDataFrame([("s", 50.0), ("t", 99.0), ("u", 10.0)], "snapshot_id string, score double")
    todo = spark.createDataFrame([("s", "rule", str(i), "", "", float(i)) for i in range(1, 6)] + [("s", "hotspot", "h", "", "", 40.0), ("t", "rule", "r", "", "", 5.0)], "snapshot_id string, category string, title string, detail string, action string, impact double")
    assert {r.snapshot_id: r.projected for r in actions.projected(scores, todo).collect()} == {"s": 62.0, "t": 100.0, "u": 10.0}


def test_monorepo(spark):
    g = graph(spark, {"1": "core/a/x.kt", "2": "core/b/y.kt", "3": "app/z.kt", "4": "loose.kt"}, [("1", "2", 1), ("1", "3", 4), ("3", "1", 2), ("4", "1", 1)])
    each, crossings = monorepo.audit_modules(g, [ModuleConfig("core", "core", []), ModuleConfig("app", "app", ["core"])])
    found = {r.name: r for r in each.collect()}
    assert found["core"].files == 2 and found["core"].violations == 1 and found["app"].score == 100.0 and crossings.count() == 1
    core = 100 * (1 - 1 / 3 / 2)  # one import at depth 2, two files
    assert found["core"].score == pytest.approx(core) and found["app"].overall == pytest.approx((core * 2 + 100.0) / 3 - 100.0 / 3)
    text = reports.to_monorepo_text(each, crossings)
    assert text.startswith("Overall score 55.6") and "core -> app  core/a/x.kt:4 -> app/z.kt" in text
    empty = monorepo.audit_modules(g, [ModuleConfig("none", "none", [])])
    assert reports.to_monorepo_text(*empty).startswith("Overall score 100.0")


def test_adapters_of_ones_own(spark):
    toml = Adapter(("need",), lambda s: [(x, n) for n, x in enumerate(s.split("\n"), 1) if x], lambda name, path: [("exact", name)])
    sources = spark.createDataFrame([("a.need", "b.py\n\nnowhere"), ("b.py", "import c\n"), ("c.py", "")], "path string, text string")
    deps, external, _ = imports.scan(sources, adapters=[toml])
    assert sorted(map(tuple, deps.collect())) == [("a.need", "b.py", 1), ("b.py", "c.py", 1)]
    assert [tuple(r) for r in external.collect()] == [("a.need", 1)]
    assert imports.scan(sources)[0].count() == 1


def test_snapshots_and_children(spark):
    import datetime

    when = datetime.datetime(2020, 1, 1)
    table = spark.createDataFrame([("v9", when, "r", 0, None, None, 1), ("v10", when, "r", 0, None, None, 2)], files.SNAPSHOTS)
    assert files.latest_snapshot(table).id == "v10" and files.snapshot_by_id(table, "v9").snap_seq == 1
    assert files.snapshot_by_id(table, "none") is None and files.latest_snapshot(table.limit(0)) is None
    modules = spark.createDataFrame([("d", "s", None, "d", "d", "DIR", 1), ("x", "s", "d", "x", "d/x", "FILE", 2), ("x", "t", "d", "x", "d/x", "FILE", 2)], files.MODULES)
    assert [r.id for r in files.children(modules, "s", "d").collect()] == ["x"] and [r.id for r in files.children(modules, "s", None).collect()] == ["d"]
