"""The audit: from a module graph to scored violations, in a fixed order of steps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import fingerprint
from plumbline.operators import coupling, metrics, reach, rules, scoring
from plumbline.plans.runtime import cut
from plumbline.plans.settings import Settings
from plumbline.sources.graph import Graph


@dataclass
class Audit:
    """Results of an audit, each keyed by snapshot_id. ``score`` says which of the two scores of ``scores`` is final."""

    graph: Graph
    edges: DataFrame
    violations: DataFrame
    coupling_metrics: DataFrame
    total_xs: DataFrame
    settings: Settings = field(default_factory=Settings)
    severity_is_final: bool = False

    def held(self) -> Audit:
        """The same audit with its tables computed and written to the checkpoint folder, for many questions to come."""
        graph = Graph(cut(self.graph.modules), self.graph.deps)
        return replace(self, graph=graph, edges=cut(self.edges), violations=cut(self.violations), coupling_metrics=cut(self.coupling_metrics), total_xs=cut(self.total_xs))

    def scores(self) -> DataFrame:
        """(snapshot_id, n_modules, severity_score, tri, tri_score, score)."""
        both = scoring.severity_score(self.violations, self.graph.modules).join(scoring.health(self.violations, self.graph.modules, self.settings.risk_weights), "snapshot_id")
        return both.withColumn("score", F.col("severity_score" if self.severity_is_final else "tri_score"))

    def all_violations(self) -> DataFrame:
        return self.violations.unionByName(self.coupling_metrics)

    def gravity_wells(self) -> DataFrame:
        return scoring.gravity_wells(self.all_violations())

    def red_flags(self) -> DataFrame:
        return scoring.red_flags(self.all_violations())

    def fans(self) -> DataFrame:
        return metrics.fan_metrics(self.edges, self.graph.modules)

    def blast_radius(self) -> DataFrame:
        return reach.blast_radius(self.edges, self.graph.modules)

    def critical_path(self) -> DataFrame:
        return reach.critical_path(self.edges, self.graph.modules)

    def fingerprints(self) -> DataFrame:
        f = fingerprint(F.col("is_circular"), F.col("cycle_order"), F.col("cycle_path"), F.col("from_module"), F.col("to_module"))
        return self.violations.select("snapshot_id", f.alias("fingerprint"))

    def only_changed(self, changed: DataFrame) -> Audit:
        """The audit of a change: violations that touch it; the severity score becomes final."""
        return Audit(self.graph, self.edges, scoring.touching_changes(self.violations, changed), self.coupling_metrics, self.total_xs, self.settings, True)

    def beyond_baseline(self, baseline: DataFrame) -> Audit:
        """Only violations that ``baseline`` (fingerprint) lacks; the severity score becomes final."""
        f = fingerprint(F.col("is_circular"), F.col("cycle_order"), F.col("cycle_path"), F.col("from_module"), F.col("to_module"))
        new = self.violations.withColumn("fingerprint", f).join(baseline, "fingerprint", "left_anti").drop("fingerprint")
        return Audit(self.graph, self.edges, new, self.coupling_metrics, self.total_xs, self.settings, True)


def raw_violations(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """All violations before any setting applies.

    The sibling pairs are written first, as they are used four times and are few
    whatever the number of imports; the violations are, as audits ask them many questions.
    """
    pairs = cut(coupling.sibling_pairs(graph.edges() if edges is None else edges))
    cycles = coupling.mutual_cycles(pairs).unionByName(coupling.long_cycles(pairs))
    return cut(coupling.violations(pairs, graph.modules, cycles))


def audit(graph: Graph, settings: Settings | None = None, edges: DataFrame | None = None) -> Audit:
    """Violations, severity filter, coupling mode, risk weights, layer weights and layer filter, in this order.

    With layers the severity score is final, otherwise the risk score. ``edges``:
    the graph's, if they have been stored for many questions.
    """
    settings = settings or Settings()
    edges = graph.edges() if edges is None else edges
    raw = raw_violations(graph, edges)
    kept, metric_rows = scoring.split_actionable(scoring.by_severity(raw, settings.min_severity), settings.coupling_mode)
    kept, metric_rows = (scoring.with_rri(x, settings.risk_weights) for x in (kept, metric_rows))
    kept, metric_rows = (rules.apply_layer_weights(x, settings.layers) for x in (kept, metric_rows))
    xs = scoring.total_xs(kept if settings.coupling_mode == "actionable" else raw)
    return Audit(graph, edges, rules.filter_by_layers(kept, settings.layers), metric_rows, xs, settings, bool(settings.layers))
