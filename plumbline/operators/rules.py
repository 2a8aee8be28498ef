"""Layers, dependency rules and monorepo modules: configured patterns against the graph.

Configurations are short lists from a settings file, so they become CASE
expressions rather than joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import parent_dir
from plumbline.plans.settings import Layer, ModuleConfig, Rule, glob_to_regex


def _first_match(tests: list[Column]) -> Column:
    """The place of the first true test, null if there is none."""
    return reduce(lambda rest, x: F.when(x[1], F.lit(x[0])).otherwise(rest), reversed(list(enumerate(tests))), F.lit(None).cast("int"))


def layer_index(path: Column, layers: list[Layer], loose: bool = False) -> Column:
    """The first layer whose glob matches; malformed globs match nothing.

    ``loose`` also takes a layer whose pattern's text contains the path's
    directory, as layer weights do (a file at the root is in the first layer).
    """
    tests = []
    for layer in layers:
        regex = glob_to_regex(layer.pattern)
        test = path.rlike(regex) if regex else F.lit(False)
        tests.append(test | F.lit(layer.pattern).contains(parent_dir(path)) if loose and regex else test)
    return _first_match(tests)


def _name(index: Column, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), index)


def layer_violations(edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """Imports from a lower layer into a higher one (layers are listed from the top): (snapshot_id, from_module, to_module, from_layer, to_layer, line_number)."""
    if not layers:
        return edges.limit(0).select("snapshot_id", F.col("from_path").alias("from_module"), F.col("to_path").alias("to_module"), F.lit("").alias("from_layer"), F.lit("").alias("to_layer"), "line_number")
    names = [x.name for x in layers]
    met = edges.withColumns({"_f": layer_index(F.col("from_path"), layers), "_t": layer_index(F.col("to_path"), layers)}).where("_t < _f")
    return met.select("snapshot_id", F.col("from_path").alias("from_module"), F.col("to_path").alias("to_module"), _name(F.col("_f"), names).alias("from_layer"), _name(F.col("_t"), names).alias("to_layer"), "line_number")


def filter_by_layers(violations: DataFrame, layers: list[Layer]) -> DataFrame:
    """Without the coupled pairs that import downwards from one layer into a later one."""
    if not layers:
        return violations
    f, t = (layer_index(F.col(c), layers) for c in ("from_module", "to_module"))
    return violations.where(F.col("is_circular") | ~F.coalesce(f < t, F.lit(False)))


def apply_layer_weights(violations: DataFrame, layers: list[Layer]) -> DataFrame:
    """Sibling rows inside one layer that allows siblings get that layer's reduced weight."""
    if not layers:
        return violations
    f, t = (layer_index(F.col(c), layers, loose=True) for c in ("from_module", "to_module"))
    reduced = F.get(F.array(*(F.lit(x.reduced_sibling_weight if x.allow_sibling else None).cast("double") for x in layers)), f)
    applies = (F.col("direction") == "sibling") & (f == t) & reduced.isNotNull()
    return violations.withColumn("rri", F.when(applies, reduced * F.greatest(F.lit(1), F.col("weight"))).otherwise(F.col("rri")))


def rule_violations(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per forbidding rule and import whose ends both match: (snapshot_id, from_module, to_module, message, line_number)."""
    tests = []
    for rule in rules:
        source, target = glob_to_regex(rule.source), glob_to_regex(rule.target)
        if not rule.allow and source and target:
            message = rule.message or f"Forbidden dependency: {rule.source} -> {rule.target}"
            tests.append(F.when(F.col("from_path").rlike(source) & F.col("to_path").rlike(target), F.lit(message)))
    hits = F.filter(F.array(*tests), lambda m: m.isNotNull()) if tests else F.array().cast("array<string>")
    return edges.select("snapshot_id", F.col("from_path").alias("from_module"), F.col("to_path").alias("to_module"), F.explode(hits).alias("message"), "line_number")


def module_index(path: Column, modules: list[ModuleConfig]) -> Column:
    """The first configured module whose path is the file or holds it."""
    return _first_match([(path == m.path) | path.startswith(m.path.rstrip("/") + "/") for m in modules])


def cross_module_violations(edges: DataFrame, modules: list[ModuleConfig]) -> DataFrame:
    """Imports between configured modules that the importing one doesn't declare: (snapshot_id, from_name, to_name, from_module, to_module, line_number)."""
    names = [m.name for m in modules]
    allowed = F.array(*(F.array(*map(F.lit, m.depends_on)).cast("array<string>") for m in modules))
    met = edges.withColumns({"_f": module_index(F.col("from_path"), modules), "_t": module_index(F.col("to_path"), modules)}).where("_f <> _t")
    met = met.withColumns({"from_name": _name(F.col("_f"), names), "to_name": _name(F.col("_t"), names)})
    return met.where(~F.array_contains(F.get(allowed, F.col("_f")), F.col("to_name"))).select("snapshot_id", "from_name", "to_name", F.col("from_path").alias("from_module"), F.col("to_path").alias("to_module"), "line_number")


def with_module(table: DataFrame, path: str, modules: list[ModuleConfig], name: str) -> DataFrame:
    """``table`` with the name of the configured module that holds ``path``; rows outside all of them have null."""
    return table.withColumn(name, _name(module_index(F.col(path), modules), [m.name for m in modules]))
