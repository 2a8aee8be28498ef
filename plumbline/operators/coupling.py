"""Sibling coupling and cycles between directories.

An import joins exactly one ordered pair of siblings: the components just below
the longest common prefix of both directories. So one projection per import and
one aggregation replace any search over pairs of directories.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import common_length, dir_parts


def sibling_pairs(edges: DataFrame) -> DataFrame:
    """(snapshot_id, parent, dir_a, dir_b, depth, weight, from_module, to_module, line_number): imports from dir_a to its sibling dir_b.

    The representative import is the smallest by (from, to, line).
    """
    a, b = dir_parts(F.col("from_path")), dir_parts(F.col("to_path"))
    split = edges.withColumns({"_a": a, "_b": b}).withColumn("_n", common_length(F.col("_a"), F.col("_b")))
    apart = split.where((F.size("_a") > F.col("_n")) & (F.size("_b") > F.col("_n")))
    named = apart.select(
        "snapshot_id",
        F.array_join(F.slice("_a", 1, F.col("_n")), "/").alias("parent"),
        F.array_join(F.slice("_a", 1, F.col("_n") + 1), "/").alias("dir_a"),
        F.array_join(F.slice("_b", 1, F.col("_n") + 1), "/").alias("dir_b"),
        F.when(F.col("_n") == 0, 0).otherwise(F.col("_n") + 1).alias("depth"),
        F.struct("from_path", "to_path", "line_number").alias("import"),
    )
    return named.groupBy("snapshot_id", "parent", "dir_a", "dir_b", "depth").agg(F.count("*").alias("weight"), F.min("import").alias("_first")).select(
        "snapshot_id", "parent", "dir_a", "dir_b", "depth", "weight", F.col("_first.from_path").alias("from_module"), F.col("_first.to_path").alias("to_module"), F.col("_first.line_number").alias("line_number")
    )


CYCLE = "snapshot_id string, parent string, depth int, cycle_path array<string>, cycle_hop_counts array<long>, cycle_hop_files array<struct<from:string,to:string,line:int>>"


def mutual_cycles(pairs: DataFrame) -> DataFrame:
    """Siblings that import each other, as closed paths [a, b, a] with a before b; see ``CYCLE``."""
    back = pairs.select("snapshot_id", F.col("dir_a").alias("dir_b"), F.col("dir_b").alias("dir_a"), F.col("weight").alias("_w"), F.struct(F.col("from_module").alias("from"), F.col("to_module").alias("to"), F.col("line_number").alias("line")).alias("_back"))
    there = F.struct(F.col("from_module").alias("from"), F.col("to_module").alias("to"), F.col("line_number").alias("line"))
    return pairs.where("dir_a < dir_b").join(back, ["snapshot_id", "dir_a", "dir_b"]).select(
        "snapshot_id", "parent", "depth", F.array("dir_a", "dir_b", "dir_a").alias("cycle_path"), F.array("weight", "_w").alias("cycle_hop_counts"), F.array(there, F.col("_back")).alias("cycle_hop_files")
    )


def strong_components(successors: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, each in the order its nodes leave the stack; without recursion.

    Nodes and successors are visited in ascending order.
    """
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on_stack: set[str] = set()
    found = []
    for root in sorted(successors):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        on_stack.add(root)
        work = [(root, iter(successors[root]))]
        while work:
            node, rest = work[-1]
            child = next(rest, None)
            if child is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        on_stack.discard(part[-1])
                    found.append(part)
            elif child not in number:
                number[child] = low[child] = len(number)
                stack.append(child)
                on_stack.add(child)
                work.append((child, iter(successors.get(child, []))))
            elif child in on_stack:
                low[node] = min(low[node], number[child])
    return found


def loop_from(start: str, inside: set[str], successors: dict[str, list[str]]) -> list[str] | None:
    """The first closed path found from ``start`` within ``inside``, depth first in ascending order."""
    path, visited, work = [start], {start}, [iter(successors[start])]
    while work:
        step = next(work[-1], None)
        if step is None:
            work.pop()
            path.pop()
        elif step == start and len(path) > 1:
            return [*path, start]
        elif step in inside and step not in visited:
            visited.add(step)
            path.append(step)
            work.append(iter(successors.get(step, [])))
    return None


def long_cycles(pairs: DataFrame) -> DataFrame:
    """One loop for each strong component of siblings in which no two import each other; see ``CYCLE``.

    Groups whose siblings can't form such a loop are dropped before they are
    gathered: a sibling must both import and be imported. A group is one
    directory's children, bounded by the width of a directory.
    """
    inner = pairs.join(pairs.select("snapshot_id", "parent", F.col("dir_b").alias("dir_a")).distinct(), ["snapshot_id", "parent", "dir_a"], "left_semi")
    inner = inner.join(pairs.select("snapshot_id", "parent", F.col("dir_a").alias("dir_b")).distinct(), ["snapshot_id", "parent", "dir_b"], "left_semi")

    def loops(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {(r.dir_a, r.dir_b): r for r in pdf.itertuples()}
        successors: dict[str, list[str]] = {}
        for a, b in sorted(rows):
            successors.setdefault(a, []).append(b)
            successors.setdefault(b, [])
        out = []
        for part in strong_components(successors):
            members = set(part)
            if len(part) < 2 or any(a in members and b in members and (b, a) in rows for a, b in rows):
                continue
            if path := loop_from(part[0], members, successors):
                hops = [rows[h] for h in zip(path, path[1:])]
                first = pdf.iloc[0]
                out.append([first.snapshot_id, first.parent, int(first.depth), path, [int(h.weight) for h in hops], [{"from": h.from_module, "to": h.to_module, "line": int(h.line_number)} for h in hops]])
        return pd.DataFrame(out, columns=[x.split()[0] for x in CYCLE.split(", ")])

    return inner.groupBy("snapshot_id", "parent").applyInPandas(loops, CYCLE)


def violations(pairs: DataFrame, modules: DataFrame, cycles: DataFrame) -> DataFrame:
    """Coupled pairs and cycles as one table of violations.

    A coupled pair's severity is its imports over depth plus one; a cycle's is
    a tenth of the snapshot's modules over depth plus one. The weakest hop of a
    cycle is the first of the fewest imports, and its imports are the cost of
    breaking the cycle.
    """
    size = modules.groupBy("snapshot_id").agg(F.count("*").alias("n_modules"))
    nothing = {"cycle_path": F.array().cast("array<string>"), "cycle_hop_counts": F.array().cast("array<bigint>"), "cycle_hop_files": F.array().cast("array<struct<from:string,to:string,line:int>>")}
    coupled = pairs.withColumns({"severity": F.col("weight") / (F.col("depth") + 1.0), "direction": F.lit("sibling"), "is_circular": F.lit(False), "cycle_order": F.lit(0).cast("long"), "weakest_link": F.lit(None).cast("string"), "break_cost": F.lit(0).cast("long"), **nothing})
    least = F.array_min("cycle_hop_counts")
    at = F.array_position("cycle_hop_counts", least).cast("int")
    path = F.col("cycle_path")
    text = F.concat(F.get(path, at - 1), F.lit(" -> "), F.get(path, at), F.lit(" ("), least.cast("string"), F.when(least == 1, " import)").otherwise(" imports)"))
    looped = cycles.join(size, "snapshot_id").select(
        "snapshot_id",
        "parent",
        F.get(path, F.lit(0)).alias("dir_a"),
        F.element_at(path, -2).alias("dir_b"),
        "depth",
        F.lit(0).cast("long").alias("weight"),
        F.get(path, F.lit(0)).alias("from_module"),
        F.element_at(path, -2).alias("to_module"),
        F.lit(0).alias("line_number"),
        (F.col("n_modules") / (F.col("depth") + 1.0) / 10.0).alias("severity"),
        F.lit("circular").alias("direction"),
        F.lit(True).alias("is_circular"),
        (F.size(path) - 1).cast("long").alias("cycle_order"),
        text.alias("weakest_link"),
        least.alias("break_cost"),
        "cycle_path",
        "cycle_hop_counts",
        "cycle_hop_files",
    )
    return coupled.unionByName(looped)
