"""Queries over all orders, against brute force on small tables of their own."""

import datetime
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.operators import reach

from .test_graph import brute_depth

#: A brand and a type for each part; loops of three within and between brands, and a mutual pair.
PARTS = {n: (f"Brand#{1 + n % 4}", "ABC"[n // 4 % 3]) for n in range(24)}
CHAINS = {
    "1999": [[0, 1], [1, 2], [2, 0], [3, 7], [7, 11], [11, 3], [4, 8, 12, 16], [20, 5]],
    "2000": [[0, 4], [4, 8], [8, 0], [1, 5], [5, 1], [0, 1, 2], [3, 2], [9, 13, 17, 21], [2, 6], [6, 10], [10, 2]],
    "2001": [[n, (n * 5 + 7) % 24] for n in range(24)],
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    orders, lines, key = [], [], 1
    for year, chains in CHAINS.items():
        for chain in chains:
            key += 1 + (key % 10 == 9)  # none divisible by ten, so a thinned graph is empty
            orders.append((key, year))
            lines += [(key, n, 1, i) for i, n in enumerate(chain, 1)]
    pq.write_table(pa.table({"p_partkey": list(PARTS), "p_brand": [b for b, _ in PARTS.values()], "p_type": [t for _, t in PARTS.values()]}), at / "part.parquet")
    pq.write_table(pa.table({"o_orderkey": [k for k, _ in orders], "o_orderdate": [datetime.date(int(y), 5, 1) for _, y in orders]}), at / "orders.parquet")
    pq.write_table(pa.table({c: [r[i] for r in lines] for i, c in enumerate(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))}), at / "lineitem.parquet")
    return str(at)


def path(n):
    return f"{PARTS[n][0]}/{PARTS[n][1]}/P{n}.kt"


def imports(year):
    return sorted({(a, b, i) for chain in CHAINS[year] for i, (a, b) in enumerate(zip(chain, chain[1:]), 1)})


def files(year):
    return {n for chain in CHAINS[year] for n in chain}


def pairs(year):
    found = Counter()
    for a, b, _ in imports(year):
        if PARTS[a] != PARTS[b]:
            between = PARTS[a][0] != PARTS[b][0]
            found[("", PARTS[a][0], PARTS[b][0]) if between else (PARTS[a][0], "/".join(PARTS[a]), "/".join(PARTS[b]))] += 1
    return found


def loops(year):
    """(parent, members) of strong components of siblings that hold no mutual pair."""
    found = set()
    groups = defaultdict(set)
    for parent, a, b in pairs(year):
        groups[parent].add((a, b))
    for parent, steps in groups.items():
        to = set(steps)
        while more := {(a, d) for a, b in to for c, d in to if b == c} - to:
            to |= more
        for n in {a for a, _ in to}:
            members = {m for m in {b for _, b in to} if (n, m) in to and (m, n) in to}
            if len(members) > 1 and not any((b, a) in steps for a, b in steps if {a, b} <= members):
                found.add((parent, frozenset(members)))
    return found


def severities(year):
    """(first directory, severity) of each violation: pairs, mutual pairs and longer loops."""
    found, n = [], len(files(year))
    for (parent, a, b), w in pairs(year).items():
        depth = 2 if parent else 0
        found.append((a, w / (depth + 1)))
        if a < b and (parent, b, a) in pairs(year):
            found.append((a, n / (depth + 1) / 10))
    for parent, members in loops(year):  # simple loops: their first directory is the one that imports the smallest
        (first,) = [a for a in members if (parent, a, min(members)) in pairs(year)]
        found.append((first, n / ((2 if parent else 0) + 1) / 10))
    return found


def module_scores(year):
    n, s = Counter(PARTS[f][0] for f in files(year)), Counter()
    for first, severity in severities(year):
        s[first.split("/")[0]] += severity
    return {m: max(0.0, 100.0 * (1 - s[m] / n[m])) for m in n}


def radius(year):
    users = defaultdict(set)
    for a, b, _ in imports(year):
        users[b].add(a)
    out = {}
    for n in files(year):
        seen, todo = set(), [n]
        while todo:
            for u in users[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        out[path(n)] = len(seen - {n})
    return out


def rows(spark, tables, name):
    return catalog.QUERIES[name](spark, tables).collect()


def test_loops_of_all_orders(spark, tables):
    found = {(r.snapshot_id, r.parent, frozenset(r.cycle_path.split(">"))) for r in rows(spark, tables, "n_cycles")}
    assert found == {(y, *x) for y in CHAINS for x in loops(y)} and found


def test_blast_radius_of_all_orders(spark, tables):
    expected = {y: radius(y) for y in CHAINS}
    assert {(r.snapshot_id, r.path): r.blast_radius for r in rows(spark, tables, "blast_radius")} == {(y, p): n for y, x in expected.items() for p, n in x.items()}
    head = sorted(expected["2000"].items(), key=lambda x: (-x[1], x[0]))[:5]
    assert sorted((r.path, r.blast_radius, r.previous) for r in rows(spark, tables, "risk_concentration")) == sorted((p, n, expected["1999"].get(p)) for p, n in head)


def test_module_history_of_all_orders(spark, tables):
    expected = {(y, m): s for y in CHAINS for m, s in module_scores(y).items()}
    assert {(r.snapshot_id, r.module): r.score for r in rows(spark, tables, "trend_by_module")} == pytest.approx(expected, abs=1e-6)
    lines = {}
    for m in {m for _, m in expected}:
        points = [(x, expected[y, m]) for x, y in enumerate(sorted(CHAINS)) if (y, m) in expected]
        mx, my = (sum(v) / len(points) for v in zip(*points))
        spread = sum((x - mx) ** 2 for x, _ in points)
        lines[m] = (sum((x - mx) * (y - my) for x, y in points) / spread if spread else 0.0, len(points))
    assert {r.module: (pytest.approx(r.slope, abs=1e-5), r.points) for r in rows(spark, tables, "trajectory")} == lines


def test_reaching_counts_by_blocks(monkeypatch):
    rng = random.Random(8)
    users = {str(n): [str(rng.randrange(60)) for _ in range(rng.randint(0, 2))] for n in range(60)}
    expected = {}
    for n in users:
        seen, todo = set(), [n]
        while todo:
            for u in set(users[todo.pop()]) - seen:
                seen.add(u)
                todo.append(u)
        expected[n] = len(seen - {n})
    for block in (4096, 3):
        monkeypatch.setattr(reach, "BLOCK", block)
        assert reach.reaching(users) == expected


def test_reaching_in_arrays():
    rng = random.Random(9)
    for n, degree in ((60, 2), (300, 1), (300, 3)):
        users = {i: [u for u in (rng.randrange(n) for _ in range(rng.randint(0, degree))) if u != i] for i in range(n)}
        steps = [(7 * u + 5, 7 * i + 5) for i, us in users.items() for u in us]
        steps += steps[:20]  # repeated imports
        nodes, totals = reach.reaching_of(*(np.array(x) for x in zip(*steps)))
        expected = reach.reaching({str(i): [str(u) for u in us] for i, us in users.items()})
        assert dict(zip(nodes.tolist(), totals.tolist())) == {7 * int(i) + 5: r for i, r in expected.items() if 7 * int(i) + 5 in set(nodes.tolist())}


def test_blast_radius_of_a_large_snapshot_makes_no_pairs(spark, monkeypatch):
    n = 2_000_001  # one import more than were searched whole before
    edges = spark.range(n).selectExpr("'s' snapshot_id", "id % 1500000 from_id", "if(id < 1500000, (id + 1) % 1500000, id * 7 % 1500000) to_id", "'' || from_id from_path", "'' || to_id to_path")
    modules = spark.range(1_500_001).selectExpr("'s' snapshot_id", "id", "'' || id path")  # a ring, and one module apart
    monkeypatch.setattr(reach, "reachable_pairs", lambda _: pytest.fail("pairs were made"))
    found = {(r.blast_radius, r.n) for r in reach.blast_radius(edges, modules).groupBy("blast_radius").agg(F.count("*").alias("n")).collect()}
    assert found == {(1_499_999, 1_500_000), (0, 1)}


def test_blast_radius_where_ids_and_paths_differ(spark):
    edges = spark.createDataFrame([("s", 1, 2, "a", "b", 1), ("s", 2, 3, "b", "c", 1), ("s", 4, 1, "d", "a", 1), ("s", 1, 4, "e", "a", 1)], "snapshot_id string, from_id long, to_id long, from_path string, to_path string, line_number int")
    modules = spark.createDataFrame([("s", 1, "a"), ("s", 1, "e"), ("s", 2, "b"), ("s", 3, "c"), ("s", 4, "d")], "snapshot_id string, id long, path string")
    for limit in (100, 0):
        assert {r.path: r.blast_radius for r in reach.blast_radius(edges, modules, limit).collect()} == {"a": 2, "b": 3, "c": 4, "d": 0, "e": 0}


def test_scores_count_longer_loops(spark, tables):
    scores = {y: max(0.0, 100.0 * (1 - sum(x for _, x in severities(y)) / len(files(y)))) for y in CHAINS}
    assert {r.snapshot_id: r.score for r in rows(spark, tables, "trend")} == pytest.approx(scores, abs=1e-6)
    (r,) = rows(spark, tables, "headline")
    assert (r.first_score, r.last_score, r.snapshots) == (pytest.approx(scores["1999"], abs=1e-6), pytest.approx(scores["2001"], abs=1e-6), 3)
    kept = {y: sum(x for _, x in severities(y) if x >= 0.2) for y in CHAINS}  # the audit's least severity
    assert {r.snapshot_id: r.severity_score for r in rows(spark, tables, "health_score")} == pytest.approx({y: max(0.0, 100.0 * (1 - kept[y] / len(files(y)))) for y in CHAINS}, abs=1e-6)


def test_history_knows_longer_loops(spark, tables):
    old, new = ({frozenset(d.split("/")[-1] for d in m) for _, m in loops(y)} for y in ("1999", "2000"))  # fingerprints have base names
    changes = [r.fingerprint for r in rows(spark, tables, "baseline_compare") if r.fingerprint.startswith("circular:") and not r.fingerprint.startswith("circular:2:")]
    assert len(changes) == len(old ^ new) > 0
    ages = [r for r in rows(spark, tables, "violation_age") if not r.from_module.endswith(".kt")]
    mutual = [k for k in pairs("2000") if k[1] < k[2] and (k[0], k[2], k[1]) in pairs("2000")]
    assert len(ages) == len(loops("2000")) + len(mutual)


def test_imports_of_all_lines_are_resolved(spark, tables):
    expected = sorted({(path(a), f"{PARTS[b][1]}.P{b}", n, path(b)) for y in CHAINS for a, b, n in imports(y)})
    assert sorted(tuple(r) for r in rows(spark, tables, "resolve_imports")) == expected and {n for _, _, n, _ in expected} > {1}


def test_critical_depth_of_cyclic_graphs(spark, tables):
    expected = {y: max(brute_depth({n: {b for a, b, _ in imports(y) if a == n} for n in files(y)}).values()) for y in CHAINS}
    assert {r.snapshot_id: r.max_depth for r in rows(spark, tables, "critical_depth")} == expected and max(expected.values()) >= 3
