"""Source trees, snapshots and baselines on storage."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.paths import ancestors
from plumbline.plans.settings import Settings, glob_to_regex

MODULES = "id string, snapshot_id string, parent_id string, name string, path string, module_type string, depth int"
DEPENDENCIES = "from_module_id string, to_module_id string, line_number int, snapshot_id string"
SNAPSHOTS = "id string, timestamp timestamp, root_path string, suppressed_count long, diff_base string, diff_changed_files array<string>, snap_seq long"
EXTERNAL = "snapshot_id string, module_path string, count long"
BASELINE = "version int, timestamp string, violation_count long, fingerprints array<string>"


def kept_by(settings: Settings):
    """The condition on ``path`` for files that discovery keeps: a source extension, and no ignored path or directory above."""
    regexes = [glob_to_regex(g) for g in settings.ignore_patterns]
    if None in regexes:
        raise ValueError("an ignore pattern is malformed")
    extension = F.regexp_extract("path", r"\.([^./]+)$", 1).isin(settings.source_extensions)
    if not regexes:
        return extension
    ignored = "|".join(f"(?:{r})" for r in regexes)
    above = F.exists(ancestors("path"), lambda d: d.rlike(ignored) | F.concat(d, F.lit("/x")).rlike(ignored))
    return extension & ~F.col("path").rlike(ignored) & ~above


def source_tree(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """(path, text, depth) of the source files below ``root``, paths relative to it; texts that aren't UTF-8 are null."""
    settings = settings or Settings()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]

    def relative(column: str):
        plain = F.url_decode(F.regexp_replace(F.regexp_replace(F.col(column), r"^[a-z]+:/*", "/"), r"\+", "%2B"))
        return F.substring(plain, F.lit(len(base) + 2), F.length(plain))

    # the reader passes over empty files, so the listing (which the driver holds anyway) says what there is
    listed = spark.createDataFrame([(x,) for x in raw.inputFiles()], "uri string").select(relative("uri").alias("path")).where(kept_by(settings))
    read = raw.select(relative("path").alias("path"), "content")
    text = F.when(F.col("content").isNull(), "").when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return listed.join(read, "path", "left").select("path", text.alias("text"), F.size(F.split("path", "/")).alias("depth"))


def append_snapshot(modules: DataFrame, dependencies: DataFrame, store: str) -> None:
    """Append one scan to a store of Parquet tables, partitioned by snapshot."""
    modules.write.mode("append").partitionBy("snapshot_id").parquet(f"{store}/modules")
    dependencies.write.mode("append").partitionBy("snapshot_id").parquet(f"{store}/dependencies")


def read_snapshot(spark: SparkSession, store: str, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """(modules, dependencies) of one snapshot; only its partitions are read."""
    return tuple(spark.read.schema(schema).parquet(f"{store}/{name}").where(F.col("snapshot_id") == snapshot_id) for name, schema in (("modules", MODULES), ("dependencies", DEPENDENCIES)))


def read_snapshots(spark: SparkSession, store: str) -> DataFrame:
    """The store's table of snapshots, oldest first."""
    return spark.read.schema(SNAPSHOTS).parquet(f"{store}/snapshots").orderBy("snap_seq", "id")


def snapshot_by_id(snapshots: DataFrame, snapshot_id: str) -> Row | None:
    return snapshots.where(F.col("id") == snapshot_id).first()


def latest_snapshot(snapshots: DataFrame) -> Row | None:
    """The snapshot taken last; None in an empty store."""
    return snapshots.orderBy(F.col("snap_seq").desc(), F.col("id").desc()).first()


def children(modules: DataFrame, snapshot_id: str, parent_id: str | None) -> DataFrame:
    """The modules of a snapshot right below the module ``parent_id``; for None those that have no parent."""
    return modules.where((F.col("snapshot_id") == snapshot_id) & F.col("parent_id").eqNullSafe(F.lit(parent_id)))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint) of a baseline file; an error if there is none."""
    return spark.read.schema(BASELINE).option("multiLine", True).json(path).select(F.explode("fingerprints").alias("fingerprint"))


def changed_files(repository: str, base: str) -> list[str]:
    """Files that differ from ``base`` in a git work tree."""
    out = subprocess.run(["git", "-C", repository, "diff", "--name-only", f"{base}...HEAD"], capture_output=True, text=True, check=True).stdout
    return [x for x in out.splitlines() if x.strip()]
