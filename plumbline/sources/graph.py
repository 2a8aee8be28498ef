"""The module graph as views over the benchmark tables.

A part is a source file ``brand/type/P<key>.kt``; within an order each line
imports the next one's part. A snapshot is a year of orders, or all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Graph:
    """modules (snapshot_id, id, path) and deps (snapshot_id, from_id, to_id, line_number)."""

    modules: DataFrame
    deps: DataFrame

    def edges(self) -> DataFrame:
        """(snapshot_id, from_id, to_id, from_path, to_path, line_number); rows of unknown modules are left out."""
        m = self.modules.select("snapshot_id", "id", "path")
        return (
            self.deps.join(m.select("snapshot_id", F.col("id").alias("from_id"), F.col("path").alias("from_path")), ["snapshot_id", "from_id"])
            .join(m.select("snapshot_id", F.col("id").alias("to_id"), F.col("path").alias("to_path")), ["snapshot_id", "to_id"])
            .select("snapshot_id", "from_id", "to_id", "from_path", "to_path", "line_number")
        )


def load(spark: SparkSession, sf_dir: str, by_year: bool = False) -> Graph:
    """The graph of all orders, as one snapshot ``all`` or one per year."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(".kt"))).alias("path"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    if by_year:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.year("o_orderdate").cast("string").alias("snapshot_id"))
        lines = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).drop("o_orderkey")
    else:
        lines = lines.withColumn("snapshot_id", F.lit("all"))
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    raw = lines.select("snapshot_id", F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(within).alias("to_id"), F.col("l_linenumber").alias("line_number"))
    deps = raw.where("to_id is not null").distinct()
    seen = lines.select("snapshot_id", F.col("l_partkey").alias("id")).distinct() if by_year else parts.select(F.lit("all").alias("snapshot_id"), F.col("p_partkey").alias("id"))
    modules = seen.join(parts, seen["id"] == parts["p_partkey"]).select("snapshot_id", "id", "path")
    return Graph(modules, deps)
