"""Documents from an audit.

Documents for machines (JSON, XML, issues, graphs, the bundle) and the pages of
directories hold every row: they are written piece by piece as the rows come, so
the driver holds one row at a time. Documents for people show the worst of each
table and state the totals.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from plumbline.operators import actions, history, metrics, rollup, rules
from plumbline.plans.audit import Audit
from plumbline.plans.runtime import cut

#: Rows of one table that a document for people chooses from; all of its lists are shorter.
SHOWN = 1000


class Table:
    """An ordered table of one snapshot: its first rows at hand, and all of them one after another."""

    def __init__(self, df: DataFrame, *order):
        self.df, self.order = df, order

    @cached_property
    def head(self) -> list[Row]:
        return self.df.orderBy(*self.order).limit(SHOWN).collect()

    def rows(self) -> Iterator[Row]:
        return self.df.orderBy(*self.order).toLocalIterator()


@dataclass
class Summary:
    """One snapshot's results: figures, and tables by name."""

    snapshot_id: str
    scores: Row
    totals: dict[str, int]
    tables: dict[str, Table]
    critical: Row | None

    def head(self, name: str) -> list[Row]:
        """The first rows of a table, for people."""
        return self.tables[name].head


def summarise(audit: Audit, snapshot_id: str, external: DataFrame | None = None) -> Summary:
    """What the documents need of one snapshot, each table with the worst first."""

    def here(df: DataFrame) -> DataFrame:
        return df.where(F.col("snapshot_id") == snapshot_id)

    v = audit.violations
    radius = cut(audit.blast_radius())
    fans = audit.fans().join(radius, ["snapshot_id", "path"], "left")
    lay = rules.layer_violations(audit.edges, audit.settings.layers)
    rule = rules.rule_violations(audit.edges, audit.settings.dependency_rules)
    independence = metrics.independence(audit.edges, audit.graph.modules)
    every = actions.all_actions(v, lay, rule, audit.fans(), radius)
    counts = here(v).agg(F.count("*").alias("violations"), F.count_if("is_circular").alias("circular"), F.count_if(F.col("severity") >= audit.settings.critical_severity).alias("critical_violations")).first().asDict()
    xs = here(audit.total_xs).first()
    tables = {
        "violations": (v, F.col("severity").desc(), F.col("parent"), F.col("is_circular").desc(), "dir_a", "dir_b"),
        "fans": (fans.where("fan_in > 0"), F.col("fan_in").desc(), "path"),
        "cohesion": (metrics.cohesion(audit.edges, audit.graph.modules), "cohesion", "directory"),
        "independence": (independence, "independence", "module"),
        "wells": (audit.gravity_wells(), F.col("total_rri").desc(), "module_path"),
        "flags": (audit.red_flags(), F.col("rri").desc(), "dir_a", "dir_b"),
        "layers": (lay, "from_module", "line_number"),
        "rules": (rule, "from_module", "line_number"),
        "actions": (every, F.col("roi").desc(), "category", "title", "detail", "action"),
        "directories": (rollup.directory_rollup(audit.graph.modules, v), "directory"),
        "card": (rollup.scorecard(audit.graph.modules, v, independence, audit.fans(), radius), "module"),
    }
    if external is not None:
        tables["external"] = (external, F.col("count").desc(), "module_path")
    return Summary(snapshot_id, here(audit.scores()).first(), counts | {"total_xs": xs["total_xs"] if xs else 0}, {k: Table(here(x[0]), *x[1:]) for k, x in tables.items()}, here(audit.critical_path()).first())


def _plain(x):
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    return [_plain(i) for i in x] if isinstance(x, (list, tuple)) else x


def figures(s: Summary) -> dict:
    return {
        "snapshot_id": s.snapshot_id,
        "score": s.scores.score,
        "severity_score": s.scores.severity_score,
        "tri": s.scores.tri,
        "total_modules": s.scores.n_modules,
        **s.totals,
        "max_depth": s.critical.max_depth if s.critical else 0,
        "critical_path": list(s.critical.critical_path) if s.critical else [],
    }


def _listed(rows: Iterator[Row], indent: str = "  ") -> Iterator[str]:
    """A JSON array of rows, piece by piece."""
    between = "["
    for r in rows:
        yield f"{between}\n{indent}{json.dumps(_plain(r))}"
        between = ","
    yield "[]" if between == "[" else "\n" + indent[2:] + "]"


def to_json(s: Summary) -> Iterator[str]:
    yield json.dumps(figures(s), indent=2)[:-2]
    for name, table in s.tables.items():
        yield f',\n  "{name}": '
        yield from _listed(table.rows(), "    ")
    yield "\n}"


def to_text(s: Summary) -> str:
    out = [f"Score {s.scores.score:.1f}  ({s.scores.n_modules} modules, {s.totals['violations']} violations, {s.totals['circular']} circular, {s.totals['total_xs']} excess imports)"]

    def part(title: str, rows: list, line) -> None:
        if rows:
            out.append(f"\n{title}")
            out.extend("  " + line(r) for r in rows)

    part("Violations", s.head("violations")[:20], lambda r: f"{r.severity:6.2f}  {' -> '.join(r.cycle_path) if r.is_circular else f'{r.dir_a} -> {r.dir_b}'}  [{r.direction}]  {r.weakest_link or f'{r.from_module}:{r.line_number}'}")
    part("Hotspots", s.head("fans")[:10], lambda r: f"{r.fan_in:5d} in {r.fan_out:5d} out  instability {r.instability:.2f}  {r.path}")
    part("Zone of pain", [r for r in s.head("fans") if r.instability < 0.3 and r.fan_in >= 5][:10], lambda r: f"{r.path} ({r.fan_in} in)")
    part("Blast radius", sorted((r for r in s.head("fans") if r.blast_radius), key=lambda r: (-r.blast_radius, r.path))[:10], lambda r: f"{r.blast_radius:5d}  {r.path}")
    part("Low cohesion", [r for r in s.head("cohesion") if r.cohesion < 0.1 and r.file_count >= 3][:10], lambda r: f"{r.cohesion:.2f}  {r.directory}")
    part("Dependent modules", [r for r in s.head("independence") if r.independence < 0.7][:10], lambda r: f"{r.independence:.2f}  {r.module}")
    part("Gravity wells", s.head("wells")[:10], lambda r: f"{r.total_rri:8.1f}  {r.module_path}")
    part("Red flags", s.head("flags")[:10], lambda r: f"{r.rri:8.1f}  {r.kind}: {r.dir_a} -> {r.dir_b}")
    part("Layer violations", s.head("layers")[:20], lambda r: f"{r.from_layer} -> {r.to_layer}  {r.from_module}:{r.line_number}")
    part("Rule violations", s.head("rules")[:20], lambda r: f"{r.message}  {r.from_module}:{r.line_number}")
    part("External imports", s.head("external")[:5] if "external" in s.tables else [], lambda r: f"{r['count']:5d}  {r.module_path}")
    part("Next actions", s.head("actions")[:5], lambda r: f"{r.title}: {r.action}")
    return "\n".join(out)


def to_monorepo_text(scores: DataFrame, crossings: DataFrame) -> str:
    """The modules of a monorepo with their scores, and the first of the imports that aren't declared; see ``monorepo.audit_modules``."""
    each = scores.orderBy("name").collect()
    out = [f"Overall score {each[0].overall if each else 100.0:.1f}  ({sum(r.files for r in each)} files in {len(each)} modules)", ""]
    out += [f"  {r.name:<20} {r.score:6.1f} {r.files:8d} files {r.violations:8d} violations" for r in each]
    if n := crossings.count():
        worst = crossings.orderBy("from_name", "to_name", "from_module", "line_number", "to_module").limit(SHOWN).collect()
        out += ["", f"Imports that are not declared: {n}", *(f"  {r.from_name} -> {r.to_name}  {r.from_module}:{r.line_number} -> {r.to_module}" for r in worst[:20])]
    return "\n".join(out)


def to_xml(s: Summary) -> Iterator[str]:
    attributes = " ".join(f"{k}={quoteattr(str(v))}" for k, v in figures(s).items() if not isinstance(v, list))
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<audit {attributes}>\n'
    for name, table in s.tables.items():
        opened = False
        for r in map(_plain, table.rows()):
            yield ("" if opened else f"  <{name}>\n") + f"    <row {' '.join(f'{k}={quoteattr(json.dumps(v) if isinstance(v, (list, dict)) else str(v))}' for k, v in r.items() if v is not None)}/>\n"
            opened = True
        if opened:
            yield f"  </{name}>\n"
    yield "</audit>"


def to_sonar(issues: DataFrame) -> Iterator[str]:
    """Generic issues from ``rollup.sonar_issues``, all of them; Spark writes the text of each."""
    place = F.struct(F.col("message"), F.col("file").alias("filePath"), F.struct(F.col("line").alias("startLine")).alias("textRange"))
    issue = F.struct(F.lit("plumbline").alias("engineId"), F.col("rule").alias("ruleId"), "severity", F.lit("CODE_SMELL").alias("type"), F.col("effort_minutes").alias("effortMinutes"), place.alias("primaryLocation"))
    between = ""
    yield '{"issues": ['
    for r in issues.orderBy("file", "line", "message").select(F.to_json(issue).alias("issue")).toLocalIterator():
        yield f"{between}\n  {r.issue}"
        between = ","
    yield "\n]}"


def _node(name: str) -> str:
    return "".join("_" if c in "-. " else c for c in name)


def to_mermaid(graph: DataFrame) -> Iterator[str]:
    """From ``rollup.directory_graph``; edges on cycles are dotted."""
    yield "graph LR"
    for r in graph.orderBy("source", "target").toLocalIterator():
        yield f'\n  {_node(r.source)}["{r.source}"] {"-.->" if r.circular else "-->"}|{r.violations}| {_node(r.target)}["{r.target}"]'


def to_dot(graph: DataFrame) -> Iterator[str]:
    yield "digraph dependencies {\n  rankdir=LR;"
    for r in graph.orderBy("source", "target").toLocalIterator():
        yield f'\n  "{r.source}" -> "{r.target}" [label="{r.violations}"{", color=red, style=dashed" if r.circular else ""}];'
    yield "\n}"


def _directories(s: Summary) -> Iterator[tuple[Row, list[Row], list[Row]]]:
    """Each directory with its child directories and its own violations, one directory at a time.

    Two sorted tables are read side by side: the directories, and rows of
    children and violations under the directory that they belong to.
    """
    dirs, violations = s.tables["directories"].df, s.tables["violations"].df
    parent = F.when(F.col("directory").contains("/"), F.regexp_extract("directory", "^(.*)/[^/]*$", 1)).otherwise("")
    children = dirs.where("directory <> ''").select(parent.alias("at"), F.lit(0).alias("kind"), F.col("directory").alias("a"), F.lit(None).cast("string").alias("b"), "score", F.lit(None).cast("string").alias("note"))
    own = violations.select(F.col("parent").alias("at"), F.lit(1).alias("kind"), F.col("dir_a").alias("a"), F.col("dir_b").alias("b"), F.col("severity").alias("score"), F.when(F.col("weight") > 0, F.col("weight").cast("string")).otherwise(F.col("weakest_link")).alias("note"))
    rows = children.unionByName(own).orderBy("at", "kind", F.when(F.col("kind") == 1, -F.col("score")), "a", "b").toLocalIterator()
    grouped = groupby(rows, key=lambda r: r["at"])
    at, some = next(grouped, (None, iter(())))
    for d in dirs.orderBy("directory").toLocalIterator():
        while at is not None and at < d.directory:
            at, some = next(grouped, (None, iter(())))
        here = list(some) if at == d.directory else []
        yield d, [r for r in here if r["kind"] == 0], [r for r in here if r["kind"] == 1]


def to_markdown(s: Summary) -> Iterator[tuple[str, str]]:
    """(path, page) of each directory: its figures, its violations and links to its children."""
    for d, children, own in _directories(s):
        lines = [f"# {d.directory or 'Project'}", "", f"Score {d.score:.1f}, {d.module_count} modules, {d.direct_files} files here, {d.violations} violations, {d.circular} circular.", ""]
        lines += [f"- [{c.a}](./{c.a.rpartition('/')[2]}/index.md)" for c in children] + [""]
        lines += ["| severity | from | to | imports |", "|---|---|---|---|", *(f"| {v.score:.2f} | {v.a} | {v.b} | {v.note} |" for v in own)] if own else []
        yield f"{d.directory}/index.md".lstrip("/"), "\n".join(lines)


def colour(score: float, green: float, yellow: float) -> str:
    return "green" if score >= green else "yellow" if score >= yellow else "red"


def to_html(s: Summary, green: float = 90.0, yellow: float = 70.0, promoted: int = 5) -> Iterator[tuple[str, str]]:
    """The same pages as HTML; the first violations stand in the open, the rest are folded away."""
    for d, children, own in _directories(s):
        items = "".join(f"<li class={colour(c.score, green, yellow)}><a href={quoteattr(c.a.rpartition('/')[2] + '/index.html')}>{html.escape(c.a)}</a> {c.score:.1f}</li>" for c in children)
        rows = [f"<tr class={'critical' if v.score >= 0.5 else 'minor'}><td>{v.score:.2f}</td><td>{html.escape(v.a)}</td><td>{html.escape(v.b)}</td></tr>" for v in own]
        more = f"<details><summary>{len(rows) - promoted} more</summary><table>{''.join(rows[promoted:])}</table></details>" if len(rows) > promoted else ""
        name = html.escape(d.directory or "Project")
        yield f"{d.directory}/index.html".lstrip("/"), f"<!DOCTYPE html><meta charset=utf-8><title>{name}</title><h1 class={colour(d.score, green, yellow)}>{name}: {d.score:.1f}</h1><ul>{items}</ul><table>{''.join(rows[:promoted])}</table>{more}"


def _page(title: str, data: dict) -> str:
    body = json.dumps(data).replace("</", "<\\/")
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><pre id=view></pre><script>const data={body};document.getElementById('view').textContent=JSON.stringify(data,null,1)</script>"


def to_bundle(audit: Audit, snapshot_id: str) -> Iterator[str]:
    """The sunburst's data: import edges between directories, those behind violations, and directories on cycles."""
    tables = {"edges": (rollup.bundle_edges(audit.edges), "from_path", "to_path"), "violations": (rollup.violation_edges(audit.violations), "from_path", "to_path"), "cycle_directories": (rollup.cycle_ancestors(audit.violations), "directory")}
    head, tail = _page("Bundle", {}).split("const data={}")
    yield head + "const data={"
    for n, (name, (df, *order)) in enumerate(tables.items()):
        yield f'{"," if n else ""}"{name}":'
        for piece in _listed(df.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id").orderBy(*order).toLocalIterator()):
            yield piece.replace("</", "<\\/")
    yield "}" + tail


def to_dashboard(s: Summary) -> str:
    whole = s.tables["card"].df.agg(F.sum(F.col("score") * F.col("files")).alias("s"), F.sum("files").alias("n")).first()
    score = whole.s / whole.n if whole.n else 100.0
    todo = s.tables["actions"].df
    largest = [r.impact for r in todo.where("category <> 'hotspot'").orderBy(F.col("impact").desc()).limit(3).collect()]
    return _page("Dashboard", {"score": score, "projected": actions.projected_score(score, largest), "card": _plain(s.head("card")), "quick_wins": _plain(actions.quick_wins(todo).collect()), "lowest_independence": next((r.module for r in s.head("independence")), None)})


def to_pull_request(s: Summary, before: float | None, new: int = 0, resolved: int = 0) -> str:
    delta = None if before is None else s.scores.score - before
    arrow = "" if delta is None else f" {'▲' if delta > 0.05 else '▼' if delta < -0.05 else '='} {delta:+.1f}"
    return "\n".join([f"## Architecture score {s.scores.score:.1f}{arrow}", "", f"{new} new and {resolved} resolved violations, {s.totals['circular']} circular.", "", *(f"- {r.title}: {r.action}" for r in s.head("actions")[:5])])


def to_briefing(s: Summary) -> str:
    return "\n".join([f"# Briefing: score {s.scores.score:.1f}", "", *(f"{n}. {r.title} ({r.category}, cost {r.cost}, impact {r.impact:.1f})\n   {r.detail}\n   {r.action}" for n, r in enumerate(s.head("actions")[:10], 1))])


def to_strategy(scores: DataFrame, violations: DataFrame, modules: DataFrame, order: DataFrame | None = None) -> Iterator[str]:
    """History as data: scores, velocity, trajectories and the headline."""
    by_module = history.module_scores(violations, modules)
    head, tail = _page("Strategy", {}).split("const data={}")
    yield head + "const data={" + f'"headline":{json.dumps(_plain(history.headline(scores, order=order).first()))}'
    tables = {"scores": (history.trend(scores, 1 << 30, order), "snapshot_id"), "velocity": (history.velocity(violations, modules, order), "snapshot_id"), "trajectories": (history.trajectories(by_module, modules, order), "slope", "module")}
    for name, (df, *by) in tables.items():
        yield f',"{name}":'
        for piece in _listed(df.orderBy(*by).toLocalIterator()):
            yield piece.replace("</", "<\\/")
    yield "}" + tail


def save_baseline(audit: Audit, snapshot_id: str, path: str, timestamp: str) -> int:
    """Write the snapshot's fingerprints as a baseline file, one after another; how many there are."""
    prints = cut(audit.fingerprints().where(F.col("snapshot_id") == snapshot_id).select("fingerprint").distinct())
    n = prints.count()
    with open(path, "w") as f:
        f.write(json.dumps({"version": 1, "timestamp": timestamp, "violation_count": n}, indent=2)[:-2] + ',\n  "fingerprints": [')
        for k, r in enumerate(prints.orderBy("fingerprint").toLocalIterator()):
            f.write(("," if k else "") + "\n    " + json.dumps(r.fingerprint))
        f.write("\n  ]\n}")
    return n


class GateFailed(Exception):
    """A score below its threshold, or new violations where none are allowed."""


def gate(score: float, fail_below: float | None = None, new_violations: int = 0, fail_on_new: bool = False) -> None:
    if fail_below is not None and score < fail_below:
        raise GateFailed(f"score {score:.1f} is below {fail_below:.1f}")
    if fail_on_new and new_violations:
        raise GateFailed(f"{new_violations} new violations")
