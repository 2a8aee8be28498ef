"""Modules of a monorepo: each audited by itself, and what they owe each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import rules, scoring
from plumbline.plans.audit import raw_violations
from plumbline.plans.runtime import cut
from plumbline.plans.settings import ModuleConfig
from plumbline.sources.graph import Graph


def module_graph(g: Graph, modules: list[ModuleConfig]) -> Graph:
    """One snapshot with each configured module as a snapshot of its own; what lies between modules is left out."""
    own = rules.with_module(g.modules, "path", modules, "name").where("name is not null").select(F.col("name").alias("snapshot_id"), "id", "path")
    source = own.select("snapshot_id", F.col("id").alias("from_id"))
    target = own.select("snapshot_id", F.col("id").alias("to_id"))
    deps = g.deps.drop("snapshot_id").join(source, "from_id").join(target, ["snapshot_id", "to_id"])
    return Graph(own, deps.select("snapshot_id", "from_id", "to_id", "line_number"))


def audit_modules(g: Graph, modules: list[ModuleConfig]) -> tuple[DataFrame, DataFrame]:
    """(scores, crossings) of one snapshot and its configured modules.

    scores: (name, files, violations, score, overall), each module audited
    before any setting applies; ``overall`` is their mean score by files, less
    100 times the undeclared imports per file, 0 at least. crossings: see
    ``rules.cross_module_violations``. Modules without files have no row.
    """
    own = module_graph(g, modules)
    found = raw_violations(own)
    crossings = cut(rules.cross_module_violations(g.edges(), modules))
    counts = found.groupBy("snapshot_id").agg(F.count("*").alias("violations"))
    each = cut(scoring.severity_score(found, own.modules).join(counts, "snapshot_id", "left").select(F.col("snapshot_id").alias("name"), F.col("n_modules").alias("files"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), F.col("severity_score").alias("score")))
    whole = each.agg((F.sum(F.col("score") * F.col("files")) / F.sum("files")).alias("_s"), F.sum("files").alias("_n")).join(crossings.agg(F.count("*").alias("_x")))
    overall = whole.select(F.greatest(F.lit(0.0), F.col("_s") - 100.0 * F.col("_x") / F.col("_n")).alias("overall"))
    return each.join(F.broadcast(overall)), crossings
