"""Reachability and longest chains over the module graph, one snapshot per group."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.coupling import strong_components
from plumbline.plans.runtime import cut, release, stored


#: Components that are followed at once, as the bits of one number.
BLOCK = 4096


def reaching(users: dict[str, list[str]]) -> dict[str, int]:
    """How many others reach each node over ``users``.

    Nodes of one strong component have the same answer; see ``_totals``.
    """
    parts = strong_components(users)
    at = {n: i for i, part in enumerate(parts) for n in part}
    total = _totals([{at[u] for n in part for u in users[n]} - {i} for i, part in enumerate(parts)], [len(part) for part in parts])
    return {n: total[i] for n, i in at.items()}


def _totals(above: Sequence[Iterable[int]], sizes: Sequence[int]) -> list[int]:
    """How many nodes other than itself reach a node of each component.

    Components come users first, so one pass over them hands on which
    components of a block, all of one size, lie above each.
    """
    total = [size - 1 for size in sizes]
    by_size: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        by_size.setdefault(size, []).append(i)
    for size, group in by_size.items():
        for first in range(0, len(group), BLOCK):
            bit = {c: 1 << k for k, c in enumerate(group[first : first + BLOCK])}
            seen = [0] * len(sizes)
            for c in range(group[first], len(sizes)):
                now = 0
                for u in above[c]:
                    now |= seen[u]
                if now:
                    total[c] += size * now.bit_count()
                seen[c] = now | bit.get(c, 0)
    return total


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorts ``values`` where they are, as ``np.unique`` takes several times the memory."""
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def reaching_of(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, how many others reach each) of the imports ``source`` -> ``target``, whole numbers; ``reaching`` in arrays of 4 bytes a node or import."""
    nodes = _distinct(np.concatenate([_distinct(source.copy()), _distinct(target.copy())]))
    n = len(nodes)
    steps = np.searchsorted(nodes, target)
    steps *= n
    steps += np.searchsorted(nodes, source)
    steps = _distinct(steps)
    imported, user = (steps // n).astype(np.int32), (steps % n).astype(np.int32)
    del source, target, steps
    heads = array("i", user.tobytes())
    ends = np.searchsorted(imported, np.arange(n), side="right").astype(np.int32)
    end, at = array("i", ends.tobytes()), array("i", np.concatenate([[0], ends[:-1]]).astype(np.int32).tobytes())
    number, low, part = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", np.full(n, -1, np.int32).tobytes())
    count = parts = 0
    stack: list[int] = []
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        stack.append(root)
        work = [root]
        while work:
            v = work[-1]
            if at[v] < end[v]:
                w = heads[at[v]]
                at[v] += 1
                if not number[w]:
                    count += 1
                    number[w] = low[w] = count
                    stack.append(w)
                    work.append(w)
                elif part[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == number[v]:
                while True:
                    w = stack.pop()
                    part[w] = parts
                    if w == v:
                        break
                parts += 1
    del heads, end, at, number, low
    part_of = np.frombuffer(part, np.int32)
    apart = part_of[imported] != part_of[user]
    joined = _distinct(part_of[imported[apart]].astype(np.int64) * parts + part_of[user[apart]])
    first = np.searchsorted(joined // parts, np.arange(parts + 1))
    over = (joined % parts).tolist()
    above = [over[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
    total = _totals(above, np.bincount(part_of, minlength=parts).tolist())
    return nodes, np.array(total, np.int64)[part_of]


def _numbered(edges: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot_id, source, target) of imports between different modules, and (snapshot_id, path, node): by ids if these are whole numbers, one for each path, else by numbers given to paths."""
    plain = modules.select("snapshot_id", "id", "path")
    if dict(edges.dtypes)["from_id"] in ("int", "bigint") and dict(modules.dtypes)["id"] in ("int", "bigint"):
        clash = [plain.groupBy("snapshot_id", c).agg(F.count("*").alias("n")).where("n > 1") for c in ("id", "path")]
        if all(x.isEmpty() for x in clash):
            return edges.where("from_id <> to_id").select("snapshot_id", F.col("from_id").cast("long").alias("source"), F.col("to_id").cast("long").alias("target")), plain.select("snapshot_id", "path", F.col("id").cast("long").alias("node"))
    pairs = stored(edges.where("from_path <> to_path").select("snapshot_id", "from_path", "to_path").distinct())
    ends = pairs.select("snapshot_id", F.col("from_path").alias("path")).unionByName(pairs.select("snapshot_id", F.col("to_path").alias("path"))).distinct()
    names = stored(ends.withColumn("node", F.monotonically_increasing_id()))
    for column, path in (("source", "from_path"), ("target", "to_path")):
        pairs = pairs.join(names.select("snapshot_id", F.col("path").alias(path), F.col("node").alias(column)), ["snapshot_id", path]).drop(path)
    return pairs.select("snapshot_id", "source", "target"), names


def blast_radius(edges: DataFrame, modules: DataFrame, group_rows: int = 8_000_000) -> DataFrame:
    """(snapshot_id, path, blast_radius): how many other modules reach each one over imports.

    Snapshots of at most ``group_rows`` imports are searched whole, each in one
    task that holds them as numbers. Larger ones go
    through ``reachable_pairs``, whose size is the answer's.
    """
    steps, names = _numbered(edges, modules)
    steps = stored(steps)
    release(edges.sparkSession)
    sizes = cut(steps.groupBy("snapshot_id").agg(F.count("*").alias("_n")))
    small = steps.join(F.broadcast(sizes.where(F.col("_n") <= group_rows)), "snapshot_id", "left_semi")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        nodes, totals = reaching_of(*(table.column(c).to_numpy() for c in ("source", "target")))
        return pa.table({"snapshot_id": pa.array([key[0].as_py()] * len(nodes), pa.string()), "node": nodes, "blast_radius": totals})

    found = small.groupBy("snapshot_id").applyInArrow(count, "snapshot_id string, node long, blast_radius long")
    large = sizes.where(F.col("_n") > group_rows)
    if not large.isEmpty():
        pairs = reachable_pairs(steps.join(large, "snapshot_id", "left_semi").select("snapshot_id", F.col("source").alias("from_path"), F.col("target").alias("to_path")).distinct())
        found = found.unionByName(pairs.groupBy("snapshot_id", F.col("dst").alias("node")).agg(F.count("*").alias("blast_radius")))
    found = names.join(found, ["snapshot_id", "node"]).select("snapshot_id", "path", "blast_radius")
    return modules.select("snapshot_id", "path").join(found, ["snapshot_id", "path"], "left").select("snapshot_id", "path", F.coalesce("blast_radius", F.lit(0)).cast("long").alias("blast_radius"))


def radius_of(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(snapshot_id, path, blast_radius) of the few modules ``of`` (snapshot_id, path): a search from them alone against the imports.

    Each round joins the imports with what the last one found, checkpointed; all
    that is held is (module of ``of``, one that reaches it).
    """
    step = cut(edges.select("snapshot_id", F.col("to_path").alias("mid"), F.col("from_path").alias("src")).where("mid <> src").distinct())
    known = cut(of.select("snapshot_id", "path", F.col("path").alias("src")).distinct())
    fresh = known
    while not fresh.isEmpty():
        wider = fresh.withColumnRenamed("src", "mid").join(step, ["snapshot_id", "mid"]).select("snapshot_id", "path", "src").distinct()
        fresh = cut(wider.join(known, ["snapshot_id", "path", "src"], "left_anti"))
        known = known.unionByName(fresh)
    return known.groupBy("snapshot_id", "path").agg((F.count("*") - 1).alias("blast_radius"))


def reachable_pairs(edges: DataFrame) -> DataFrame:
    """(snapshot_id, src, dst), src other than dst, of all pairs joined by a chain of imports: a semi-naive loop, checkpointed each round."""
    step = edges.select("snapshot_id", F.col("from_path").alias("mid"), F.col("to_path").alias("dst"))
    known = cut(edges.select("snapshot_id", F.col("from_path").alias("src"), F.col("to_path").alias("dst")))
    fresh = known
    while not fresh.isEmpty():
        wider = fresh.withColumnRenamed("dst", "mid").join(step, ["snapshot_id", "mid"]).select("snapshot_id", "src", "dst").where("src <> dst").distinct()
        fresh = cut(wider.join(known, ["snapshot_id", "src", "dst"], "left_anti"))
        known = cut(known.unionByName(fresh))
    return known


def settled_depths(successors: dict[str, set[str]]) -> dict[str, int]:
    """The longest chain of imports from each module.

    A module is settled if it can't reach a cycle; only settled modules pass
    their depth on, but any module that imports a settled one is one deeper.
    """
    users: dict[str, list[str]] = {}
    for a, bs in successors.items():
        for b in bs:
            users.setdefault(b, []).append(a)
    open_ = {a: len(bs) for a, bs in successors.items()}
    depth = dict.fromkeys(successors, 0)
    ready = deque(sorted(a for a, n in open_.items() if not n))
    while ready:
        node = ready.popleft()
        for user in users.get(node, ()):
            depth[user] = max(depth[user], depth[node] + 1)
            open_[user] -= 1
            if not open_[user]:
                ready.append(user)
    return depth


CRITICAL = "snapshot_id string, max_depth long, critical_path array<string>"


def critical_path(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(snapshot_id, max_depth, critical_path): the longest chain of imports, of equal ones the smallest by paths.

    Snapshots without a chain have depth 0 and an empty path. One task holds one
    snapshot's distinct imports.
    """

    def longest(pdf: pd.DataFrame) -> pd.DataFrame:
        successors: dict[str, set[str]] = {}
        for a, b in zip(pdf["from_path"], pdf["to_path"]):
            successors.setdefault(a, set()).add(b)
            successors.setdefault(b, set())
        depth = settled_depths(successors)
        settled = {n for n in depth if not successors[n]}
        changed = deque(settled)
        open_ = {a: len(bs) for a, bs in successors.items()}
        users: dict[str, list[str]] = {}
        for a, bs in successors.items():
            for b in bs:
                users.setdefault(b, []).append(a)
        while changed:
            for user in users.get(changed.popleft(), ()):
                open_[user] -= 1
                if not open_[user]:
                    settled.add(user)
                    changed.append(user)
        most = max(depth.values(), default=0)
        path: list[str] = []
        if most:
            node = min(n for n, d in depth.items() if d == most)
            path = [node]
            while depth[node]:
                node = min(n for n in successors[node] if n in settled and depth[n] == depth[node] - 1)
                path.append(node)
        return pd.DataFrame([[pdf["snapshot_id"].iloc[0], most, path]], columns=["snapshot_id", "max_depth", "critical_path"])

    found = edges.select("snapshot_id", "from_path", "to_path").distinct().groupBy("snapshot_id").applyInPandas(longest, CRITICAL)
    return modules.select("snapshot_id").distinct().join(found, "snapshot_id", "left").select("snapshot_id", F.coalesce("max_depth", F.lit(0)).cast("long").alias("max_depth"), F.coalesce("critical_path", F.array().cast("array<string>")).alias("critical_path"))
