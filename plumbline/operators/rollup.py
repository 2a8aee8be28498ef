"""Directory roll-ups and the edge tables behind the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.paths import ancestors, base_name, common_length, common_prefix, dir_parts, parent_dir


def directory_tree(modules: DataFrame) -> DataFrame:
    """(snapshot_id, directory, children): every directory with subdirectories, the root included, and their sorted paths."""
    dirs = modules.select("snapshot_id", F.explode(ancestors("path")).alias("child")).distinct()
    return dirs.select("snapshot_id", parent_dir("child").alias("directory"), "child").groupBy("snapshot_id", "directory").agg(F.sort_array(F.collect_list("child")).alias("children"))


def common_roots(modules: DataFrame) -> DataFrame:
    """(snapshot_id, common, above, textual): three readings of the directory that all files of a snapshot share.

    ``common`` is the whole of it; ``above`` leaves its last component to be
    shown if there are several; ``textual`` is the deepest directory above the
    smallest path whose text begins the directory of every file, be it in the
    middle of a name (``ab`` for ``ab/x`` and ``abc/y``). What a set of sorted
    values shares, its least and greatest share, so no snapshot is gathered.
    """
    own = parent_dir("path")
    ends = modules.groupBy("snapshot_id").agg(*(f(x).alias(n) for n, f, x in (("_a", F.min, dir_parts(F.col("path"))), ("_b", F.max, dir_parts(F.col("path"))), ("_s", F.min, own), ("_t", F.max, own), ("_p", F.min, "path"))))
    shared = F.slice("_a", 1, common_length(F.col("_a"), F.col("_b")))
    above = F.when(F.size(shared) > 1, F.slice(shared, 1, F.size(shared) - 1)).otherwise(shared)
    begins = F.filter(F.concat(ancestors("_p"), F.array(F.lit(""))), lambda d: F.col("_s").startswith(d) & F.col("_t").startswith(d))
    textual = F.aggregate(begins, F.lit(""), lambda best, d: F.when(F.length(d) > F.length(best), d).otherwise(best))
    return ends.select("snapshot_id", F.array_join(shared, "/").alias("common"), F.array_join(above, "/").alias("above"), textual.alias("textual"))


def directory_rollup(modules: DataFrame, violations: DataFrame) -> DataFrame:
    """(snapshot_id, directory, module_count, direct_files, violations, circular, score, has_violations) of every directory.

    A violation counts at the directory that both of its sides share;
    ``has_violations`` also holds above it. The score is 100 less severities
    there per module below, from 0.
    """
    files = modules.select("snapshot_id", "path", parent_dir("path").alias("_own"), F.explode(F.concat(F.array(F.lit("")), ancestors("path"))).alias("directory"))
    counts = files.groupBy("snapshot_id", "directory").agg(F.count("*").alias("module_count"), F.count(F.when(F.col("_own") == F.col("directory"), 1)).alias("direct_files"))
    at = violations.select("snapshot_id", "severity", "is_circular", common_prefix(F.col("dir_a"), F.col("dir_b")).alias("directory"))
    own = at.groupBy("snapshot_id", "directory").agg(F.count("*").alias("violations"), F.count(F.when(F.col("is_circular"), 1)).alias("circular"), F.sum("severity").alias("_s"))
    above = own.select("snapshot_id", F.explode(F.concat(F.array(F.lit("")), ancestors("directory"), F.array("directory"))).alias("directory")).distinct().withColumn("has_violations", F.lit(True))
    met = counts.join(own, ["snapshot_id", "directory"], "left").join(above, ["snapshot_id", "directory"], "left")
    zero = F.lit(0).cast("long")
    return met.select("snapshot_id", "directory", "module_count", "direct_files", F.coalesce("violations", zero).alias("violations"), F.coalesce("circular", zero).alias("circular"), F.greatest(F.lit(0.0), 100.0 * (1.0 - F.coalesce("_s", F.lit(0.0)) / F.col("module_count"))).alias("score"), F.coalesce("has_violations", F.lit(False)).alias("has_violations"))


def scorecard(modules: DataFrame, violations: DataFrame, independence: DataFrame, fans: DataFrame, radius: DataFrame | None = None) -> DataFrame:
    """One row per top-level directory: (snapshot_id, module, files, score, violations, circular, xs, independence, instability, max_blast_radius).

    Violations belong to the directory they start in; without figures
    independence is 1 and instability 0.5; the radius is null where none is given.
    """
    def top(column: str):
        return F.substring_index(column, "/", 1)

    inside = modules.where("path like '%/%'").select("snapshot_id", "path", top("path").alias("module"))
    own = violations.groupBy("snapshot_id", top("dir_a").alias("module")).agg(F.count("*").alias("violations"), F.count(F.when(F.col("is_circular"), 1)).alias("circular"), F.sum(F.when(F.col("is_circular"), F.col("break_cost")).otherwise(F.col("weight"))).alias("xs"), F.sum("severity").alias("_s"))
    files = inside.groupBy("snapshot_id", "module").agg(F.count("*").alias("files"))
    shaky = fans.withColumn("module", top("path")).groupBy("snapshot_id", "module").agg(F.avg("instability").alias("instability"))
    met = files.join(own, ["snapshot_id", "module"], "left").join(independence.select("snapshot_id", "module", "independence"), ["snapshot_id", "module"], "left").join(shaky, ["snapshot_id", "module"], "left")
    if radius is not None:
        met = met.join(radius.withColumn("module", top("path")).groupBy("snapshot_id", "module").agg(F.max("blast_radius").alias("max_blast_radius")), ["snapshot_id", "module"], "left")
    else:
        met = met.withColumn("max_blast_radius", F.lit(None).cast("long"))
    zero = F.lit(0).cast("long")
    score = F.greatest(F.lit(0.0), 100.0 * (1.0 - F.coalesce("_s", F.lit(0.0)) / F.col("files")))
    return met.select("snapshot_id", "module", "files", score.alias("score"), *(F.coalesce(c, zero).alias(c) for c in ("violations", "circular", "xs")), F.coalesce("independence", F.lit(1.0)).alias("independence"), F.coalesce("instability", F.lit(0.5)).alias("instability"), "max_blast_radius")


def weighted_score(card: DataFrame) -> DataFrame:
    """(snapshot_id, score, files): the scorecard's mean score by files."""
    return card.groupBy("snapshot_id").agg((F.sum(F.col("score") * F.col("files")) / F.sum("files")).alias("score"), F.sum("files").alias("files"))


def bundle_edges(edges: DataFrame) -> DataFrame:
    """(snapshot_id, from_path, to_path): distinct imports between different directories."""
    return edges.where(parent_dir("from_path") != parent_dir("to_path")).select("snapshot_id", "from_path", "to_path").distinct()


def violation_edges(violations: DataFrame) -> DataFrame:
    """(snapshot_id, from_path, to_path): the imports behind violations, each hop of a cycle included, distinct."""
    pairs = violations.where("not is_circular").select("snapshot_id", F.col("from_module").alias("from_path"), F.col("to_module").alias("to_path"))
    hops = violations.where("is_circular").select("snapshot_id", F.explode("cycle_hop_files").alias("h")).select("snapshot_id", F.col("h.from").alias("from_path"), F.col("h.to").alias("to_path"))
    return pairs.unionByName(hops).where("from_path <> '' and to_path <> ''").distinct()


def cycle_ancestors(violations: DataFrame) -> DataFrame:
    """(snapshot_id, directory): the directories on cycles, and all directories above them and above the cycles' files."""
    loops = violations.where("is_circular")
    files = F.flatten(F.transform("cycle_hop_files", lambda h: F.array(h["from"], h["to"])))
    named = loops.select("snapshot_id", F.explode(F.concat("cycle_path", files)).alias("p"), F.col("cycle_path").alias("_c"))
    above = named.select("snapshot_id", F.explode(F.concat(ancestors("p"), "_c")).alias("directory"))
    return above.distinct()


def level_edges(edges: DataFrame, depth: int) -> DataFrame:
    """(snapshot_id, from_dir, to_dir, imports): imports between different directories ``depth`` components deep."""
    def at(column: str):
        p = F.split(column, "/")
        return F.when(F.size(p) > depth, F.array_join(F.slice(p, 1, depth), "/"))

    met = edges.select("snapshot_id", at("from_path").alias("from_dir"), at("to_path").alias("to_dir")).where("from_dir <> to_dir")
    return met.groupBy("snapshot_id", "from_dir", "to_dir").agg(F.count("*").alias("imports"))


def level_cycles(violations: DataFrame, depth: int) -> DataFrame:
    """(snapshot_id, directory, cycle_path, hops) of the cycles still seen between the entries ``depth`` components deep.

    ``directory`` holds the entries. A hop counts if it joins two entries of one
    directory; a cycle, if it has two such hops there. ``hops`` are (from, to,
    imports, weakest) in the cycle's order; the first of fewest imports is the weakest.
    """
    def entry(path):
        p = F.split(path, "/")
        return F.when(F.size(p) >= depth, F.array_join(F.slice(p, 1, depth), "/"))

    hops = violations.where("is_circular").select("snapshot_id", "parent", "cycle_path", F.posexplode(F.arrays_zip(F.col("cycle_hop_files").alias("files"), F.col("cycle_hop_counts").alias("imports"))).alias("n", "h"))
    seen = hops.select("snapshot_id", "parent", "cycle_path", "n", entry(F.col("h.files.from")).alias("from"), entry(F.col("h.files.to")).alias("to"), "h.imports").where((F.col("from") != F.col("to")) & (parent_dir("from") == parent_dir("to")))
    kept = seen.groupBy("snapshot_id", parent_dir("from").alias("directory"), "parent", "cycle_path").agg(F.sort_array(F.collect_list(F.struct("n", "from", "to", "imports"))).alias("_h")).where(F.size("_h") >= 2)
    weakest = F.array_min(F.transform("_h", lambda h: F.struct(h["imports"], h["n"])))["n"]
    marked = F.transform("_h", lambda h: F.struct(h["from"].alias("from"), h["to"].alias("to"), h["imports"].alias("imports"), (h["n"] == weakest).alias("weakest")))
    return kept.select("snapshot_id", "directory", "cycle_path", marked.alias("hops"))


def promoted(violations: DataFrame, shown: int = 5) -> DataFrame:
    """(snapshot_id, parent, dir_a, dir_b, severity, place, promoted): the coupled pairs of each directory, the worst ``shown`` to stand in the open."""
    worst = Window.partitionBy("snapshot_id", "parent").orderBy(F.col("severity").desc(), "dir_a", "dir_b")
    return violations.where("not is_circular").select("snapshot_id", "parent", "dir_a", "dir_b", "severity", F.row_number().over(worst).alias("place")).withColumn("promoted", F.col("place") <= shown)


def direction_hints(violations: DataFrame) -> DataFrame:
    """(snapshot_id, dir_a, dir_b, wrong_from, wrong_to) of circular rows: the way that fewer of a snapshot's circular rows run, which is likely the wrong one; null if neither does."""
    counts = violations.where("is_circular").groupBy("snapshot_id", "dir_a", "dir_b").agg(F.count("*").alias("_n"))
    back = counts.select("snapshot_id", F.col("dir_b").alias("dir_a"), F.col("dir_a").alias("dir_b"), F.col("_n").alias("_back"))
    less, more = F.col("_n") < F.coalesce("_back", F.lit(0)), F.col("_n") > F.coalesce("_back", F.lit(0))
    found = counts.join(back, ["snapshot_id", "dir_a", "dir_b"], "left").select("snapshot_id", "dir_a", "dir_b", F.when(less, F.col("dir_a")).when(more, F.col("dir_b")).alias("wrong_from"), F.when(less, F.col("dir_b")).when(more, F.col("dir_a")).alias("wrong_to"))
    return violations.where("is_circular").select("snapshot_id", "dir_a", "dir_b").join(found, ["snapshot_id", "dir_a", "dir_b"])


def violation_types(violations: DataFrame, modules: DataFrame, critical: float = 0.5) -> DataFrame:
    """(snapshot_id, violations, circular, coupled, critical) of every snapshot, those without violations too."""
    counts = violations.groupBy("snapshot_id").agg(F.count("*").alias("violations"), F.count_if("is_circular").alias("circular"), F.count_if(~F.col("is_circular")).alias("coupled"), F.count_if(F.col("severity") >= critical).alias("critical"))
    return modules.select("snapshot_id").distinct().join(counts, "snapshot_id", "left").na.fill(0)


def directory_graph(violations: DataFrame) -> DataFrame:
    """(snapshot_id, source, target, violations, circular) between short directory names; each hop of a cycle counts once."""
    pairs = violations.where("not is_circular").select("snapshot_id", base_name("dir_a").alias("source"), base_name("dir_b").alias("target"), F.lit(False).alias("c"))
    path = F.col("cycle_path")
    hops = violations.where("is_circular").select("snapshot_id", F.explode(F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("a"), F.slice(path, 2, F.size(path) - 1).alias("b"))).alias("h"))
    named = hops.select("snapshot_id", base_name("h.a").alias("source"), base_name("h.b").alias("target"), F.lit(True).alias("c"))
    return pairs.unionByName(named).groupBy("snapshot_id", "source", "target").agg(F.count("*").alias("violations"), F.bool_or("c").alias("circular"))


def sonar_issues(violations: DataFrame) -> DataFrame:
    """(snapshot_id, rule, severity, effort_minutes, file, line, message) by the issue format's five severities."""
    risk = F.coalesce("rri", F.col("severity") * 10)
    bands = ((160, "BLOCKER", 60), (80, "CRITICAL", 30), (40, "MAJOR", 20), (10, "MINOR", 10))
    level, effort = F.lit("INFO"), F.lit(5)
    for least, name, minutes in reversed(bands):
        level, effort = F.when(risk >= least, name).otherwise(level), F.when(risk >= least, minutes).otherwise(effort)
    message = F.when(F.col("is_circular"), F.concat(F.lit("Circular dependency: "), F.array_join("cycle_path", " -> "))).otherwise(F.concat(F.lit("Sibling coupling: "), F.col("dir_a"), F.lit(" -> "), F.col("dir_b")))
    return violations.select("snapshot_id", F.when(F.col("is_circular"), "circular-dependency").otherwise("sibling-coupling").alias("rule"), level.alias("severity"), effort.cast("long").alias("effort_minutes"), F.col("from_module").alias("file"), F.greatest(F.lit(1), F.col("line_number")).cast("long").alias("line"), message.alias("message"))
