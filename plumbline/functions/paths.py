"""Column functions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column | str) -> Column:
    return F.split(path, "/")


def parent_dir(path: Column | str) -> Column:
    """The directory of a file; empty for one at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column | str) -> Column:
    """All directories above a path, from the top; none for one at the root."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def dir_depth(directory: Column) -> Column:
    """Number of components; -1 for the root."""
    return F.when(directory == "", F.lit(-1)).otherwise(F.size(F.split(directory, "/")))


def top_level(path: Column) -> Column:
    """First component of a path that has several, else null."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1))


def dir_parts(path: Column) -> Column:
    """Components of a file's directory; an empty array at the root."""
    p = parts(path)
    return F.slice(p, 1, F.size(p) - 1)


def common_length(a: Column, b: Column) -> Column:
    """How many leading components two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differing = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | (F.get(a, i) != F.get(b, i)))
    return F.element_at(differing, 1)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest directory that two paths share, as a path."""
    pa, pb = parts(a), parts(b)
    return F.array_join(F.slice(pa, 1, common_length(pa, pb)), "/")


def common_ancestor(paths: Column) -> Column:
    """The deepest directory that holds every file of an array; empty at the root and for an empty array."""
    dirs = F.transform(paths, dir_parts)
    rest = F.slice(dirs, 2, F.greatest(F.size(dirs) - 1, F.lit(0)))
    shared = F.aggregate(rest, F.get(dirs, F.lit(0)), lambda acc, d: F.slice(acc, 1, common_length(acc, d)))
    return F.coalesce(F.array_join(shared, "/"), F.lit(""))


def relative_label(path: Column, directory: Column) -> Column:
    """A file as the page of ``directory`` names it: its place below (or its whole directory, if it lies elsewhere), a colon and its name."""
    own = parent_dir(path)
    below = F.when(own == directory, "").otherwise(strip_prefix(own, directory))
    return F.when(below == "", base_name(path)).otherwise(F.concat(below, F.lit(": "), base_name(path)))


def strip_prefix(path: Column, prefix: Column) -> Column:
    inside = path.startswith(F.concat(prefix, F.lit("/")))
    return F.when((prefix != "") & inside, F.substr(path, F.length(prefix) + 2)).otherwise(path)


def fold_relative(path: Column) -> Column:
    """``.`` and ``..`` resolved within the path; ``..`` at the root is dropped."""
    return F.array_join(
        F.aggregate(
            parts(path),
            F.array().cast("array<string>"),
            lambda acc, x: F.when(x.isin(".", ""), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x))),
        ),
        "/",
    )


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(\p{Lu})", "_$1"))


def effort(cost: Column) -> Column:
    """How much work a cost stands for."""
    return F.when(cost <= 1, "trivial").when(cost <= 5, "small").when(cost <= 20, "medium").when(cost <= 50, "large").otherwise("very large")


def fingerprint(is_circular: Column, order: Column, cycle: Column, source: Column, target: Column) -> Column:
    """What a violation is recognised by from one scan to the next."""
    short = F.array_join(F.transform(cycle, base_name), "->")
    return F.when(is_circular, F.concat(F.lit("circular:"), order.cast("string"), F.lit(":"), short)).otherwise(F.concat(F.lit("coupling:"), source, F.lit(":"), target))
