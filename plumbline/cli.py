"""Command line: init, scan, baseline, audit, trend, report, hook.

    python -m plumbline.cli scan SOURCE_TREE --store STORE
    python -m plumbline.cli report json --store STORE

A store is a folder of Parquet tables, partitioned by snapshot.
"""

from __future__ import annotations

import argparse
import datetime
import os
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import history, imports, rollup, scoring
from plumbline.plans import audit as audits
from plumbline.plans import monorepo
from plumbline.plans.runtime import cut
from plumbline.plans.settings import Settings
from plumbline.sinks import reports
from plumbline.sources import files
from plumbline.sources.graph import Graph

FORMATS = "text json xml sonar mermaid dot markdown html bundle dashboard pr briefing strategy".split()


def scan(spark: SparkSession, root: str, store: str, settings: Settings, snapshot_id: str, base: str | None = None) -> None:
    """Append a snapshot of the tree ``root`` to ``store``."""
    sources = cut(files.source_tree(spark, root, settings))
    deps, external, suppressed = imports.scan(sources, settings.allow_inline_suppression)
    snap = F.lit(snapshot_id).alias("snapshot_id")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    modules = sources.select(F.col("path").alias("id"), snap, F.lit(None).cast("string").alias("parent_id"), name, "path", F.lit("FILE").alias("module_type"), "depth")
    rows = deps.select(F.col("from_path").alias("from_module_id"), F.col("to_path").alias("to_module_id"), "line_number", snap)
    files.append_snapshot(modules, rows, store)
    external.select(snap, F.col("path").alias("module_path"), "count").write.mode("append").partitionBy("snapshot_id").parquet(f"{store}/external")
    changed = files.changed_files(root, base) if base else None
    n = suppressed.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    row = (snapshot_id, datetime.datetime.now(), root, n, base, changed, int(datetime.datetime.now().timestamp() * 1e6))
    spark.createDataFrame([row], files.SNAPSHOTS).write.mode("append").parquet(f"{store}/snapshots")


def load(spark: SparkSession, store: str) -> tuple[Graph, DataFrame]:
    """All snapshots of a store as one graph, and the table of snapshots."""
    modules = spark.read.schema(files.MODULES).parquet(f"{store}/modules").select("snapshot_id", "id", "path")
    deps = spark.read.schema(files.DEPENDENCIES).parquet(f"{store}/dependencies").select("snapshot_id", F.col("from_module_id").alias("from_id"), F.col("to_module_id").alias("to_id"), "line_number")
    return Graph(modules, deps), files.read_snapshots(spark, store)


def only(graph: Graph, snapshot_id: str, module: str | None = None) -> Graph:
    """One snapshot, or the part of it at or below the path ``module``."""
    here = F.col("snapshot_id") == snapshot_id
    modules, deps = graph.modules.where(here), graph.deps.where(here)
    if module:
        modules = modules.where((F.col("path") == module) | F.col("path").startswith(module.rstrip("/") + "/"))
    return Graph(modules, deps)


def render(audit: audits.Audit, graph: Graph, s: reports.Summary, form: str, order: DataFrame | None = None) -> Iterable[tuple[str, str | Iterator[str]]]:
    """(file name, text or its pieces) of the documents of one format; ``s`` is the audit's summary of its snapshot."""
    settings = audit.settings
    if form == "sonar":
        return [("sonar.json", reports.to_sonar(rollup.sonar_issues(audit.violations)))]
    if form in ("mermaid", "dot"):
        return [(f"graph.{'mmd' if form == 'mermaid' else 'dot'}", (reports.to_mermaid if form == "mermaid" else reports.to_dot)(rollup.directory_graph(audit.violations)))]
    if form == "bundle":
        return [("bundle.html", reports.to_bundle(audit, s.snapshot_id))]
    if form == "strategy":
        raw = audits.raw_violations(graph)
        scores = scoring.severity_score(raw, graph.modules).select("snapshot_id", F.col("severity_score").alias("score"))
        return [("strategy.html", reports.to_strategy(scores, raw, graph.modules, order))]
    if form == "markdown":
        return reports.to_markdown(s)
    if form == "html":
        return reports.to_html(s, settings.green_score, settings.yellow_score)
    if form == "pr":
        return [("pr.md", reports.to_pull_request(s, None))]
    one = {"text": ("audit.txt", reports.to_text), "json": ("audit.json", reports.to_json), "xml": ("audit.xml", reports.to_xml), "dashboard": ("dashboard.html", reports.to_dashboard), "briefing": ("briefing.md", reports.to_briefing)}
    name, make = one[form]
    return [(name, make(s))]


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = parser.add_subparsers(dest="verb", required=True)
    for verb in ("init", "scan", "baseline", "audit", "trend", "report", "hook"):
        p = sub.add_parser(verb)
        p.add_argument("--store", default=".plumbline")
        p.add_argument("--settings", default="plumbline.json")
        p.add_argument("--snapshot")
        if verb == "scan":
            p.add_argument("root")
            p.add_argument("--diff-base")
        if verb in ("baseline", "audit", "report"):
            p.add_argument("--baseline")
        if verb == "audit":
            p.add_argument("--fail-below", type=float)
            p.add_argument("--fail-on-new", action="store_true")
        if verb == "trend":
            p.add_argument("--last", type=int, default=20)
            p.add_argument("--by-module", action="store_true")
        if verb == "report":
            p.add_argument("format", choices=[*FORMATS, "all"])
            p.add_argument("--out", default="report")
            p.add_argument("--module")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = _arguments(sys.argv[1:] if argv is None else argv)
    if args.verb == "init":
        Settings().save(args.settings)
        return 0
    if args.verb == "hook":
        print("#!/bin/sh\npython -m plumbline.cli scan . && python -m plumbline.cli audit --fail-on-new --baseline baseline.json")
        return 0
    settings = Settings.load(args.settings)
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "scan":
        scan(spark, os.path.abspath(args.root), args.store, settings, args.snapshot or datetime.datetime.now().strftime("%Y%m%dT%H%M%S%f"), args.diff_base)
        return 0
    graph, snapshots = load(spark, args.store)
    newest = files.latest_snapshot(snapshots)
    snapshot_id = args.snapshot or newest["id"]
    order = snapshots.select(F.col("id").alias("snapshot_id"), "snap_seq")
    if args.verb == "trend":
        raw = audits.raw_violations(graph)
        if args.by_module:
            history.module_trend(history.module_scores(raw, graph.modules), order=order).orderBy("module", "snapshot_id").show(200, False)
        else:
            history.trend(scoring.severity_score(raw, graph.modules).select("snapshot_id", F.col("severity_score").alias("score")), args.last, order).join(order, "snapshot_id").orderBy("snap_seq").drop("snap_seq").show(args.last, False)
        return 0
    one = only(graph, snapshot_id, getattr(args, "module", None))
    audit = audits.audit(one, settings)
    if args.verb == "baseline":
        print(reports.save_baseline(audit, snapshot_id, args.baseline or "baseline.json", datetime.datetime.now().isoformat()))
        return 0
    if changed := newest["diff_changed_files"]:
        audit = audit.only_changed(spark.createDataFrame([(x,) for x in changed], "file string"))
    new = 0
    if args.baseline:
        audit = audit.beyond_baseline(files.read_baseline(spark, args.baseline))
        new = audit.violations.count()
    audit = audit.held()
    summary = reports.summarise(audit, snapshot_id, spark.read.schema(files.EXTERNAL).parquet(f"{args.store}/external"))
    if args.verb == "audit":
        if settings.modules:
            print(reports.to_monorepo_text(*monorepo.audit_modules(one, settings.modules)))
        print(reports.to_text(summary))
        try:
            reports.gate(summary.scores.score, args.fail_below, new, args.fail_on_new)
        except reports.GateFailed as failed:
            print(failed, file=sys.stderr)
            return 1
        return 0
    failures = 0
    for form in FORMATS if args.format == "all" else [args.format]:
        try:
            for name, text in render(audit, graph, summary, form, order):
                path = os.path.join(args.out, form if form in ("markdown", "html") else "", name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w") as f:
                    f.writelines([text] if isinstance(text, str) else text)
        except OSError as error:
            failures += 1
            print(f"{form}: {error}", file=sys.stderr)
    return min(failures, 1)


if __name__ == "__main__":
    sys.exit(main())
