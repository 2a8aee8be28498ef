"""Per-module and per-directory figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import parent_dir, top_level


def fan_metrics(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(snapshot_id, path, fan_in, fan_out, instability): import rows into and out of each module; self-imports count both ways."""
    both = edges.select("snapshot_id", F.explode(F.array(F.struct(F.col("to_path").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_path").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    counts = both.groupBy("snapshot_id", "x.path").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))
    met = modules.select("snapshot_id", "path").join(counts, ["snapshot_id", "path"], "left")
    i, o = F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0))
    return met.select("snapshot_id", "path", i.cast("long").alias("fan_in"), o.cast("long").alias("fan_out"), F.when(i + o > 0, o / (i + o)).otherwise(0.0).alias("instability"))


def cohesion(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(snapshot_id, directory, file_count, internal_deps, cohesion) of directories with two files or more: internal import rows over n (n - 1)."""
    files = modules.select("snapshot_id", parent_dir("path").alias("directory")).where("directory <> ''").groupBy("snapshot_id", "directory").agg(F.count("*").alias("file_count")).where("file_count >= 2")
    inside = edges.select("snapshot_id", parent_dir("from_path").alias("directory"), parent_dir("to_path").alias("_to")).where("directory = _to").groupBy("snapshot_id", "directory").agg(F.count("*").alias("internal_deps"))
    n = F.col("file_count")
    return files.join(inside, ["snapshot_id", "directory"], "left").select("snapshot_id", "directory", "file_count", F.coalesce("internal_deps", F.lit(0)).alias("internal_deps"), (F.coalesce("internal_deps", F.lit(0)) / (n * (n - 1))).alias("cohesion"))


def independence(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(snapshot_id, module, file_count, internal_deps, external_deps, independence) of top-level directories with two files or more."""
    files = modules.select("snapshot_id", top_level(F.col("path")).alias("module")).where("module is not null").groupBy("snapshot_id", "module").agg(F.count("*").alias("file_count")).where("file_count >= 2")
    ends = edges.select("snapshot_id", top_level(F.col("from_path")).alias("module"), top_level(F.col("to_path")).alias("_to")).where("module is not null")
    same = F.col("module").eqNullSafe(F.col("_to"))
    counts = ends.groupBy("snapshot_id", "module").agg(F.count(F.when(same, 1)).alias("internal_deps"), F.count(F.when(~same, 1)).alias("external_deps"))
    met = files.join(counts, ["snapshot_id", "module"], "left").fillna(0, ["internal_deps", "external_deps"])
    total = F.col("internal_deps") + F.col("external_deps")
    return met.withColumn("independence", F.when(total > 0, F.col("internal_deps") / total).otherwise(1.0))
