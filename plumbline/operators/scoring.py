"""Scores, risk indexes and the filters of the audit's settings pipeline."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.runtime import broadcast_if_small
from plumbline.plans.settings import DIRECTION_WEIGHTS


def severity_score(violations: DataFrame, modules: DataFrame) -> DataFrame:
    """(snapshot_id, n_modules, severity_score): 100 less severities per module, 0 at least; 100 for an empty snapshot."""
    size = modules.groupBy("snapshot_id").agg(F.count("*").alias("n_modules"))
    sums = violations.groupBy("snapshot_id").agg(F.sum("severity").alias("_s"))
    return size.join(sums, "snapshot_id", "left").select("snapshot_id", "n_modules", F.greatest(F.lit(0.0), 100.0 * (1.0 - F.coalesce("_s", F.lit(0.0)) / F.col("n_modules"))).alias("severity_score"))


def _weight(weights: dict[str, float]) -> Column:
    table = F.create_map(*map(F.lit, chain(*weights.items())))
    return F.try_element_at(table, F.col("direction"))


def with_rri(violations: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``violations`` with ``rri``: the direction's weight times the imports behind it, one at least."""
    hops = F.aggregate("cycle_hop_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    density = F.when(F.col("is_circular"), F.greatest(F.lit(1), hops)).otherwise(F.greatest(F.lit(1), F.col("weight")))
    return violations.withColumn("rri", _weight(weights or DIRECTION_WEIGHTS) * density.cast("double"))


def health(violations: DataFrame, modules: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(snapshot_id, tri, tri_score): the sum of risks, and 100 less its share of the largest weight per module, from 0 to 100."""
    most = max((weights or DIRECTION_WEIGHTS).values())
    size = modules.groupBy("snapshot_id").agg(F.count("*").alias("_n"))
    sums = violations.groupBy("snapshot_id").agg(F.sum("rri").alias("_t"))
    tri = F.coalesce("_t", F.lit(0.0))
    return size.join(sums, "snapshot_id", "left").select("snapshot_id", tri.alias("tri"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1.0 - tri / (F.col("_n") * F.lit(most))))).alias("tri_score"))


def total_xs(violations: DataFrame) -> DataFrame:
    """(snapshot_id, total_xs): imports to remove, before any filter."""
    return violations.groupBy("snapshot_id").agg(F.sum(F.when(F.col("is_circular"), F.col("break_cost")).otherwise(F.col("weight"))).alias("total_xs"))


def by_severity(violations: DataFrame, least: float = 0.2) -> DataFrame:
    return violations.where(F.col("is_circular") | (F.col("severity") >= least))


def split_actionable(violations: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(violations, coupling metrics): in mode ``actionable`` coupled pairs are metrics only; otherwise nothing is."""
    if mode != "actionable":
        return violations, violations.limit(0)
    return violations.where("is_circular"), violations.where("not is_circular")


def gravity_wells(violations: DataFrame) -> DataFrame:
    """Paths with twice or more relations and risk above twice the upper median of all paths (and 1).

    (snapshot_id, module_path, total_rri, relationship_count, downward_rri, sibling_rri, upward_rri, circular_rri, direction_count)
    """
    ends = violations.select("snapshot_id", "direction", "rri", F.explode(F.array("from_module", "to_module")).alias("module_path")).where("module_path <> ''")

    def of(*names: str) -> Column:
        return F.sum(F.when(F.col("direction").isin(*names), F.col("rri")).otherwise(0.0))

    risks = ends.groupBy("snapshot_id", "module_path").agg(F.sum("rri").alias("total_rri"), F.count("*").alias("relationship_count"), of("downward").alias("downward_rri"), of("sibling", "external", "transitive").alias("sibling_rri"), of("upward").alias("upward_rri"), of("circular").alias("circular_rri"))
    n = sum((F.when(F.col(f"{d}_rri") > 0, 1).otherwise(0) for d in ("downward", "sibling", "upward", "circular")), F.lit(0))
    return above_twice_upper_median(risks, "total_rri", 1.0).where("relationship_count >= 2").withColumn("direction_count", n.cast("long"))


def above_twice_upper_median(rows: DataFrame, column: str, floor: float) -> DataFrame:
    """The rows whose ``column`` exceeds both ``floor`` and twice its upper median within the snapshot.

    The median is read from a table of distinct values with their counts, so no
    snapshot's values are gathered in one place.
    """
    counts = rows.groupBy("snapshot_id", column).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("snapshot_id").orderBy(column)
    whole = Window.partitionBy("snapshot_id")
    ranked = counts.select("snapshot_id", column, F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    median = ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy("snapshot_id").agg(F.min(column).alias("_median"))
    return rows.join(median, "snapshot_id").where(F.col(column) > F.greatest(F.lit(floor), 2.0 * F.col("_median"))).drop("_median")


def red_flags(violations: DataFrame) -> DataFrame:
    """(snapshot_id, kind, dir_a, dir_b, weight, rri): siblings with far more imports than usual, and children that import upwards.

    A fused sibling needs more imports than twice the upper median (and 2), and
    a snapshot with two sibling rows at least.
    """
    siblings = violations.where("direction = 'sibling'").withColumn("_w", F.greatest(F.lit(1), F.col("weight")))
    several = siblings.groupBy("snapshot_id").agg(F.count("*").alias("_n")).where("_n >= 2")
    fused = above_twice_upper_median(siblings.join(several, "snapshot_id", "left_semi"), "_w", 2.0).select("snapshot_id", F.lit("fused_sibling").alias("kind"), "dir_a", "dir_b", "weight", "rri")
    trapped = violations.where("direction = 'upward'").select("snapshot_id", F.lit("trapped_child").alias("kind"), "dir_a", "dir_b", "weight", "rri")
    return fused.unionByName(trapped)


def touching_changes(violations: DataFrame, changed: DataFrame) -> DataFrame:
    """Violations with an import that ends in a changed file, or a changed file that ends in the import's path; cycles by any hop.

    ``changed``: (file), a list that a person hands over; each end is matched
    on the last path component first, so the join is by key.
    """
    ends = violations.select("snapshot_id", "dir_a", "dir_b", "is_circular", F.explode(F.when(F.col("is_circular"), F.flatten(F.transform("cycle_hop_files", lambda h: F.array(h["from"], h["to"])))).otherwise(F.array("from_module", "to_module"))).alias("_end"))
    files = changed.select("file", F.substring_index("file", "/", -1).alias("_base")).distinct()
    suffix = F.col("_end").endswith(F.col("file")) | F.col("file").endswith(F.col("_end"))
    hit = ends.withColumn("_base", F.substring_index("_end", "/", -1)).join(files, "_base").where(suffix).drop("_base", "file")
    # a name without a directory may also be the tail of a longer name
    bare = broadcast_if_small(files.where("file not like '%/%'").drop("_base"))
    hit = hit.unionByName(ends.join(bare, F.col("_end").endswith(F.col("file"))).drop("file"))
    return violations.join(hit.select("snapshot_id", "dir_a", "dir_b", "is_circular").distinct(), ["snapshot_id", "dir_a", "dir_b", "is_circular"], "left_semi")
