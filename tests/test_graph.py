"""Graph operators on small literal graphs, and against brute force on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import coupling, metrics, reach, rules, scoring
from plumbline.plans import audit as audits
from plumbline.plans.settings import Layer, ModuleConfig, Rule, Settings, glob_to_regex
from plumbline.sources.graph import Graph


def graph(spark, modules, deps):
    return Graph(
        spark.createDataFrame([("s", i, p) for i, p in modules.items()], "snapshot_id string, id string, path string"),
        spark.createDataFrame([("s", a, b, n) for a, b, n in deps], "snapshot_id string, from_id string, to_id string, line_number int"),
    )


def test_one_import_between_siblings(spark):
    g = graph(spark, {"1": "a/x.kt", "2": "b/y.kt"}, [("1", "2", 3)])
    (v,) = audits.raw_violations(g).collect()
    assert (v.dir_a, v.dir_b, v.depth, v.weight, v.severity, v.from_module, v.line_number) == ("a", "b", 0, 1, 1.0, "a/x.kt", 3)


def test_deep_siblings_and_files_at_the_root(spark):
    g = graph(spark, {"1": "p/q/a/x.kt", "2": "p/q/b/c/y.kt", "3": "root.kt", "4": "p/q/z.kt"}, [("1", "2", 1), ("1", "2", 2), ("3", "1", 1), ("1", "3", 1), ("4", "1", 1)])
    (v,) = audits.raw_violations(g).collect()
    assert (v.dir_a, v.dir_b, v.depth, v.weight) == ("p/q/a", "p/q/b", 3, 2) and v.severity == pytest.approx(0.5)


def test_mutual_cycle_and_scores(spark):
    g = graph(spark, {"1": "a/x.kt", "2": "b/y.kt"}, [("1", "2", 1), ("2", "1", 1), ("2", "1", 2)])
    a = audits.audit(g)
    loop = [v for v in a.violations.collect() if v.is_circular]
    assert len(loop) == 1 and loop[0].cycle_path == ["a", "b", "a"] and list(loop[0].cycle_hop_counts) == [1, 2]
    assert loop[0].weakest_link == "a -> b (1 import)" and loop[0].rri == 30.0
    s = a.scores().first()
    assert s.tri == 42.0 and s.score == s.tri_score == 0.0


def test_three_cycle_without_mutual_pair(spark):
    g = graph(spark, {"1": "a/x.kt", "2": "b/y.kt", "3": "c/z.kt"}, [("1", "2", 1), ("2", "3", 1), ("3", "1", 1)])
    (loop,) = [v for v in audits.raw_violations(g).collect() if v.is_circular]
    assert loop.cycle_order == 3 and sorted(loop.cycle_path[:3]) == ["a", "b", "c"] and loop.cycle_path[0] == loop.cycle_path[-1]


def test_empty_graph(spark):
    g = graph(spark, {"1": "a/x.kt"}, [])
    a = audits.audit(g)
    assert a.violations.count() == 0 and a.scores().first().score == 100.0
    assert a.critical_path().first().max_depth == 0


def brute_pairs(paths, deps):
    found = {}
    for a, b, _ in deps:
        x, y = paths[a].split("/")[:-1], paths[b].split("/")[:-1]
        for n in range(min(len(x), len(y))):
            if x[:n] == y[:n] and x[n] != y[n]:
                key = ("/".join(x[: n + 1]), "/".join(y[: n + 1]))
                found[key] = found.get(key, 0) + 1
    return found


def brute_depth(successors):
    def reaches_cycle(n, seen=()):
        return n in seen or any(reaches_cycle(m, (*seen, n)) for m in successors[n])

    settled = {n for n in successors if not reaches_cycle(n)}

    def depth(n):
        return max([1 + depth(m) for m in successors[n] if m in settled], default=0)

    return {n: depth(n) for n in successors}


def test_random_graphs(spark):
    rng = random.Random(5)
    modules, deps, expected, reached = [], [], {}, {}
    for s in range(6):
        paths = {f"{s}.{i}": "/".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) + ("/" if rng.random() < 0.8 else "") + f"f{i}.kt" for i in range(12)}
        paths = {k: p.lstrip("/") for k, p in paths.items()}
        edges = sorted({(rng.choice(list(paths)), rng.choice(list(paths)), rng.randint(1, 3)) for _ in range(16)})
        modules += [(f"s{s}", i, p) for i, p in paths.items()]
        deps += [(f"s{s}", *e) for e in edges]
        expected |= {(f"s{s}", *k): n for k, n in brute_pairs(paths, edges).items()}
        successors = {p: {paths[b] for a, b, _ in edges if paths[a] == p} for p in paths.values()}
        for p in paths.values():
            seen, todo = set(), [p]
            while todo:
                n = todo.pop()
                for q in successors:
                    if n in successors[q] and q not in seen:
                        seen.add(q)
                        todo.append(q)
            reached[(f"s{s}", p)] = len(seen - {p})
        assert reach.settled_depths(successors) == brute_depth(successors)
    g = Graph(spark.createDataFrame(modules, "snapshot_id string, id string, path string"), spark.createDataFrame(deps, "snapshot_id string, from_id string, to_id string, line_number int"))
    edges = g.edges()
    assert {(r.snapshot_id, r.dir_a, r.dir_b): r.weight for r in coupling.sibling_pairs(edges).collect()} == expected
    for limit in (2_000_000, 0):  # whole snapshots, and the loop for large ones
        assert {(r.snapshot_id, r.path): r.blast_radius for r in reach.blast_radius(edges, g.modules, limit).collect()} == reached


def test_strong_components_and_loops():
    assert coupling.strong_components({"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a"]})[0] == ["c", "b", "a"]
    assert coupling.loop_from("c", {"a", "b", "c"}, {"a": ["b"], "b": ["c"], "c": ["a"]}) == ["c", "a", "b", "c"]


def test_fan_cohesion_independence(spark):
    g = graph(spark, {"1": "a/x.kt", "2": "a/y.kt", "3": "b/z.kt", "4": "b/w.kt"}, [("1", "2", 1), ("1", "3", 2), ("1", "1", 3)])
    e = g.edges()
    fans = {r.path: (r.fan_in, r.fan_out, r.instability) for r in metrics.fan_metrics(e, g.modules).collect()}
    assert fans["a/x.kt"] == (1, 3, 0.75) and fans["b/w.kt"] == (0, 0, 0.0)
    assert {r.directory: r.cohesion for r in metrics.cohesion(e, g.modules).collect()} == {"a": 1.0, "b": 0.0}
    assert {r.module: r.independence for r in metrics.independence(e, g.modules).collect()} == {"a": pytest.approx(2 / 3), "b": 1.0}


def test_wells_use_the_upper_median(spark):
    rows = [("s", "m1", "m2", "sibling", 10.0), ("s", "m1", "m3", "sibling", 10.0), ("s", "m4", "m5", "sibling", 1.0)]
    v = spark.createDataFrame(rows, "snapshot_id string, from_module string, to_module string, direction string, rri double")
    # totals 20, 10, 10, 1, 1: the upper median is 10, and 20 is not above twice that
    assert scoring.gravity_wells(v).count() == 0
    more = v.unionByName(spark.createDataFrame([("s", "m6", "m7", "sibling", 1.0), ("s", "m8", "m9", "circular", 1.0)], v.schema))
    (well,) = scoring.gravity_wells(more).collect()
    assert (well.module_path, well.total_rri, well.relationship_count, well.direction_count) == ("m1", 20.0, 2, 1)


@pytest.mark.parametrize(("glob", "path", "fits"), [("**/build/**", "build/x.kt", True), ("**/build/**", "a/build/x/y.kt", True), ("**/build/**", "rebuild/x.kt", False), ("src/*.kt", "src/a/b.kt", True), ("a/{b,c}/?.kt", "a/c/d.kt", True), ("a/[!b].kt", "a/b.kt", False)])
def test_globs(spark, glob, path, fits):
    assert spark.range(1).select(F.lit(path).rlike(glob_to_regex(glob)).alias("x")).first().x is fits


def test_malformed_globs_match_nothing(spark):
    assert glob_to_regex("a/[b") is None and glob_to_regex("{a") is None
    g = graph(spark, {"1": "a/x.kt", "2": "b/y.kt"}, [("1", "2", 1)])
    assert rules.layer_violations(g.edges(), [Layer("bad", "[")]).count() == 0
    assert rules.rule_violations(g.edges(), [Rule("[", "**")]).count() == 0


def test_layers_rules_and_modules(spark):
    g = graph(spark, {"1": "ui/x.kt", "2": "db/y.kt", "3": "db/z.kt"}, [("2", "1", 1), ("1", "2", 2), ("2", "3", 3)])
    layers = [Layer("ui", "ui/**"), Layer("db", "db/**")]
    (up,) = rules.layer_violations(g.edges(), layers).collect()
    assert (up.from_layer, up.to_layer, up.line_number) == ("db", "ui", 1)
    a = audits.audit(g, Settings(layers=layers))
    assert a.severity_is_final and {(v.dir_a, v.dir_b) for v in a.violations.collect() if not v.is_circular} == {("db", "ui")}
    assert [r.message for r in rules.rule_violations(g.edges(), [Rule("ui/**", "db/**")]).collect()] == ["Forbidden dependency: ui/** -> db/**"]
    mods = [ModuleConfig("ui", "ui", ["db"]), ModuleConfig("db", "db/", [])]
    assert [(r.from_name, r.to_name) for r in rules.cross_module_violations(g.edges(), mods).collect()] == [("db", "ui")]


def test_settings_round_trip(tmp_path):
    s = Settings(layers=[Layer("a", "a/**")], dependency_rules=[Rule("a/**", "b/**", message="no")], modules=[ModuleConfig("m", "m")], coupling_mode="actionable")
    s.save(tmp_path / "s.json")
    assert Settings.load(tmp_path / "s.json") == s
    (tmp_path / "part.json").write_text('{"thresholds": {"minimum_severity": 0.5, "coupling_mode": "strict"}, "coupling_mode": "actionable", "risk_weights": {"sibling": 1.0}}')
    part = Settings.load(tmp_path / "part.json")
    assert part.min_severity == 0.5 and part.coupling_mode == "actionable" and part.risk_weights["circular"] == 10.0 and part.risk_weights["sibling"] == 1.0
    assert Settings.load(tmp_path / "none.json") == Settings()
