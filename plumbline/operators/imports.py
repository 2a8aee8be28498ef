"""From source texts to dependency rows: extraction, inline suppression, resolution, external imports."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import languages
from plumbline.functions.paths import base_name
from plumbline.plans.runtime import stored

MARKER = "plumbline:ignore"
_IMPORTS = "path string, import_path string, line_number int, tries array<struct<how:string,text:string>>"


def extract(sources: DataFrame, adapters: Iterable[languages.Adapter] = ()) -> DataFrame:
    """(path, import_path, line_number, tries) of each import statement of ``sources`` (path, text); null texts have none.

    ``adapters`` come before the languages that are built in.
    """
    further = languages.adapters_by_extension(adapters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                extension = path.rpartition(".")[2]
                own = further.get(extension)
                for name, line in own.parse(text or "") if own else languages.parse(extension, text or ""):
                    tries = own.candidates(name, path) if own else languages.candidates(extension, name, path)
                    out.append((path, name, line, [{"how": h, "text": t} for h, t in tries]))
            yield pd.DataFrame(out, columns=["path", "import_path", "line_number", "tries"])

    return sources.select("path", "text").mapInPandas(run, _IMPORTS)


def suppressed_lines(sources: DataFrame, marker: str = MARKER) -> DataFrame:
    """(path, line_number) of the lines that hold the marker, or follow a comment line that does."""
    lines = sources.select("path", F.posexplode(F.split("text", "\n")).alias("_n", "line"))
    before = F.lag("line").over(Window.partitionBy("path").orderBy("_n"))
    has = F.col("line").contains(marker)
    above = F.coalesce(before.contains(marker) & F.trim(before).rlike(r"^(//|#|--)"), F.lit(False))
    return lines.withColumn("_hit", has | above).where("_hit").select("path", (F.col("_n") + 1).alias("line_number"))


def resolve(imports: DataFrame, known: DataFrame) -> DataFrame:
    """``imports`` with ``to_path``: the first module of ``known`` (path) that the first fitting candidate names; null if none does."""
    keys = ["path", "import_path", "line_number"]
    tried = imports.select(*keys, F.posexplode("tries").alias("priority", "_t")).select(*keys, "priority", "_t.how", "_t.text")
    return imports.join(first_fits(tried, known, keys).hint("merge"), keys, "left")


def form_of() -> Column:
    """Which join finds the candidate (how, text); null for ways that there are none of."""
    components = F.size(F.split("text", "/"))
    return F.when(F.col("how") == "suffix", F.when(components > 2, "deep").when(components == 2, "near").otherwise("bare")).when(F.col("how").isin("exact", "within"), F.col("how"))


def first_fits(tried: DataFrame, known: DataFrame, keys: list[str], forms: set[str] | None = None, lengths: list[int] | None = None) -> DataFrame:
    """(*keys, to_path): the first module of ``known`` (path) that fits the first of ``tried`` (*keys, priority, how, text) that any fits.

    Every way of fitting is an equi-join: exact paths on the path; suffixes of
    three components and more on the last two, which have to be whole; shorter
    ones on the tails of the file's last components, spelt out; and Go packages
    on the directories that a file lies below. So names that every directory has
    (``__init__.py``, ``mod.rs``) meet only where their directories do.

    Tails are far larger than the files that Spark judges them by, so all joins
    are merge joins and nothing is broadcast. ``forms`` and ``lengths`` spare
    work: the forms (``form_of``) that ``tried`` has, and the lengths of its ``bare`` texts.
    """
    names = known.select(F.col("path").alias("to_path"), base_name("path").alias("_base"))
    texts = tried.withColumn("_form", form_of())
    keep = [*keys, "priority", "to_path"]

    def of(form: str) -> DataFrame:
        return texts.where(F.col("_form") == form).drop("_form", "how")

    def tails(name, rest):
        return F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substr(name, i), rest))

    def exact() -> DataFrame:
        return of("exact").join(names.drop("_base").hint("merge"), F.col("text") == F.col("to_path")).select(keep)

    def deep() -> DataFrame:
        two = names.select("to_path", F.substring_index("to_path", "/", -2).alias("_two"))
        return of("deep").withColumn("_two", F.substring_index("text", "/", -2)).join(two.hint("merge"), "_two").where(F.col("to_path").endswith(F.col("text"))).select(keep)

    def near() -> DataFrame:
        asked = of("near").select(base_name("text").alias("_base")).distinct()
        above = F.element_at(F.split("to_path", "/"), -2)
        inside = names.where("to_path like '%/%'").join(asked.hint("merge"), "_base", "left_semi").select("to_path", F.explode(tails(above, F.concat(F.lit("/"), "_base"))).alias("text"))
        return of("near").join(inside.hint("merge"), "text").select(keep)

    def bare() -> DataFrame:
        some = tails(F.col("_base"), F.lit("")) if lengths is None else F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_base")), lambda n: F.right("_base", n))
        return of("bare").join(names.select("to_path", F.explode(some).alias("text")).hint("merge"), "text").select(keep)

    def within() -> DataFrame:
        p, q = F.split("to_path", "/"), F.col("_folder")
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size(q)), lambda i: F.transform(F.sequence(F.lit(1), F.size(q) + 1 - i), lambda n: F.array_join(F.slice(q, i, n), "/"))))
        least = F.min(F.struct(F.split("to_path", "/").alias("_o"), "to_path")).alias("_b")  # others of a folder or span can't be first
        folders = names.where(F.col("to_path").endswith(".go") & (F.size(p) > 2)).groupBy(F.slice(p, 1, F.size(p) - 1).alias("_folder")).agg(least).select("_folder", "_b.to_path")
        below = folders.select("to_path", F.explode(F.array_distinct(spans)).alias("text")).groupBy("text").agg(least).select("text", "_b.to_path")
        return of("within").join(below.hint("merge"), "text").select(keep)

    ways = {"exact": exact, "deep": deep, "near": near, "bare": bare, "within": within}
    none = texts.where("false").withColumn("to_path", F.lit("")).select(keep)
    fits = reduce(DataFrame.unionByName, [way() for form, way in ways.items() if forms is None or form in forms], none)
    best = fits.groupBy(*keys).agg(F.min(F.struct("priority", F.split("to_path", "/").alias("_o"), "to_path")).alias("_b"))
    return best.select(*keys, F.col("_b.to_path").alias("to_path"))


def _marked(text: str) -> set[int]:
    """The line numbers that ``suppressed_lines`` gives for one text."""
    lines = text.split("\n") if MARKER in text else []
    has = [MARKER in line for line in lines]
    return {n for n, (line, hit) in enumerate(zip(lines, has), 1) if hit or n > 1 and has[n - 2] and lines[n - 2].strip(" ").startswith(("//", "#", "--"))}


def _packed(tries: list[tuple[str, str]]) -> str:
    return "".join([f"{how}:{len(text)}:{text}" for how, text in tries])


def _unpacked(packed: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(packed):
        how, n, _ = packed[at:].split(":", 2)
        at += len(how) + len(n) + 2
        yield how, packed[at : at + int(n)]
        at += int(n)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.binary()), ("priority", pa.int32()), ("how", pa.string()), ("text", pa.string())])
    for batch in batches:
        ids, lists = batch.column("id").to_pylist(), batch.column("tries").to_pylist()
        rows = [(i, n, how, text) for i, packed in zip(ids, lists) for n, (how, text) in enumerate(_unpacked(packed))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


#: Checksum bits for each name, and at most 2 to the power of so many in all (32 MB); with fewer, more candidates are joined in vain.
NAME_BITS, MOST_BITS = 32, 28
#: 64-bit words of the bitmap that come to the driver as one compressed row.
BLOCK_WORDS = 1 << 13


def _block(key: tuple[pa.Scalar, ...], words: pa.Table) -> pa.Table:
    """The words (at, bits) of a block as one row of compressed bytes."""
    bits = np.zeros(BLOCK_WORDS, "<i8")
    bits[words["at"].to_numpy()] = words["bits"].to_numpy()
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})


def name_checksums(known: DataFrame) -> bytearray:
    """A bitmap of the checksums of what ``may_fit`` looks up: the paths of ``known`` (path), and the trailing components of each, two at least and not all.

    Executors pack it; the driver holds it once, and besides it a partition's blocks, compressed.
    """
    p = F.split("path", "/")
    n = known.agg(F.sum(F.size(p))).first()[0] or 0
    power = min(MOST_BITS, max(10, (NAME_BITS * n).bit_length()))
    size = F.size(p)
    names = F.transform(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0))), lambda i: F.when(i == 0, F.concat(F.lit("="), "path")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(p, i + 1, size - i), "/"))))
    at = known.where("path is not null").select(F.explode(names).alias("_name")).select(F.crc32("_name").bitwiseAND(F.lit((1 << power) - 1)).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("bits"))
    blocks = words.select(F.floor(F.col("word") / BLOCK_WORDS).alias("block"), (F.col("word") % BLOCK_WORDS).alias("at"), "bits").groupBy("block").applyInArrow(_block, "block long, bits binary")
    bitmap = bytearray(1 << power - 3)
    for row in blocks.toLocalIterator():
        start = row.block * BLOCK_WORDS * 8
        part = zlib.decompress(row.bits)[: len(bitmap) - start]  # a small bitmap is less than a block
        bitmap[start : start + len(part)] = part
    return bitmap


def may_fit(how: str, text: str, checksums: bytearray) -> bool:
    """False only for candidates that no module of ``name_checksums`` fits: exact ones, and suffixes whose whole components no path ends with."""
    if how == "exact":
        name = f"={text}"
    elif how == "suffix" and text.count("/") > 1:
        name = text[text.index("/") :]
    else:
        return True
    at = zlib.crc32(name.encode()) & (len(checksums) * 8 - 1)
    return bool(checksums[at >> 3] >> (at & 7) & 1)


def scan(sources: DataFrame, allow_suppression: bool = True, adapters: Iterable[languages.Adapter] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dependencies, external, suppressed) of ``sources`` (path, text), whose paths differ.

    Dependencies are distinct (from_path, to_path, line_number); external is
    (path, count) of unresolved imports, one each; suppressed is (path, count)
    of imports on marked lines, which are dropped before resolution.

    Texts are parsed once. Files import the same things again and again, so only
    the distinct lists of candidates are resolved, known by their digest. What
    is sought beside the importing file differs from folder to folder; most of
    it is nowhere, and is left out of the lists by the checksums of the names.
    """
    further = languages.adapters_by_extension(adapters)
    known = sources.sparkSession.sparkContext.broadcast(name_checksums(sources.select("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums = known.value
        for batch in batches:
            out: dict[str, list] = {"path": [], "line_number": [], "marked": [], "alone": [], "tries": []}
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                extension = path.rpartition(".")[2]
                own = further.get(extension)
                found = own.parse(text) if own else languages.parse(extension, text)
                marked = _marked(text) if allow_suppression else set()
                on = Counter(line for _, line in found)
                for name, line in found:
                    out["path"].append(path)
                    out["line_number"].append(line)
                    out["marked"].append(line in marked)
                    out["alone"].append(on[line] == 1)
                    tries = own.candidates(name, path) if own else languages.candidates(extension, name, path)
                    out["tries"].append(_packed([t for t in tries if may_fit(*t, checksums)]))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("path", pa.string()), ("line_number", pa.int32()), ("marked", pa.bool_()), ("alone", pa.bool_()), ("tries", pa.string())]))

    imports = stored(sources.select("path", "text").mapInArrow(run, "path string, line_number int, marked boolean, alone boolean, tries string"))
    known.destroy()  # else the driver keeps it until it happens to collect its garbage
    kept = imports.where("not marked")
    digest = F.unhex(F.md5("tries")).alias("id")
    tried = stored(kept.select("tries").distinct().select(digest, "tries").mapInArrow(_tries, "id binary, priority int, how string, text string"))
    asked = tried.select(form_of().alias("form"), F.when(form_of() == "bare", F.length("text")).alias("n")).distinct().collect()  # at most as many as names have lengths
    fits = first_fits(tried, sources.select("path"), ["id"], {r.form for r in asked}, sorted(r.n for r in asked if r.n))
    found = stored(kept.select("path", "line_number", "alone", digest).join(fits.hint("merge"), "id", "left").drop("id"))
    deps = found.where("to_path is not null").select(F.col("path").alias("from_path"), "to_path", "line_number", "alone")
    deps = deps.where("alone").drop("alone").unionByName(deps.where("not alone").drop("alone").distinct())  # one import on a line is distinct as it is
    external = found.where("to_path is null").groupBy("path").agg(F.count("*").alias("count"))
    return deps, external, imports.where("marked").groupBy("path").agg(F.count("*").alias("count"))
