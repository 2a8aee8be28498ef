"""The module graph over the benchmark tables as source texts, in each language that imports are read from.

Every part is a file; it imports the parts that follow it in an order, one on
each line from the second on, by key. Before them stands a commented-out import,
behind them an import of something that isn't there, and an import on a line
that is marked to be ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.imports import MARKER
from plumbline.sources.graph import load


@dataclass(frozen=True)
class Language:
    """How a language writes an import: {b}, {t} and {p} stand for a part's brand, type and file, capitals for capitalised names."""

    extension: str
    statement: str
    absent: str
    comment: str = "//"
    other: str | None = None  # for parts of an even key
    capitals: bool = False


LANGUAGES = {
    "kotlin": Language("kt", "import src.{b}.{t}.{p}", "import org.absent.Thing"),
    "java": Language("java", "import src.{b}.{t}.{p};", "import org.absent.Thing;", other="import static src.{b}.{t}.{p}.member;"),
    "csharp": Language("cs", "using src.{b}.{t}.{p};", "using System.Text;"),
    "dart": Language("dart", "import 'package:app/{b}/{t}/{p}.dart';", "import 'package:absent/thing.dart';"),
    "go": Language("go", 'import "src/{b}/{t}/{p}"', 'import "fmt"', other='import x "src/{b}/{t}/{p}"'),
    "haskell": Language("hs", "import qualified Src.{B}.{T}.{P} as X", "import Data.List", "--", "import Src.{B}.{T}.{P} (x)", True),
    "javascript": Language("js", "import x from '../../{b}/{t}/{p}';", "import y from 'absent';", other="import '../../{b}/{t}/{p}';"),
    "typescript": Language("ts", "import {{ x }} from '../../{b}/{t}/{p}';", "import y from 'absent';", other="import type x from \"../../{b}/{t}/{p}\";"),
    "python": Language("py", "from src.{b}.{t}.{p} import x", "import os", "#", "from ...{b}.{t}.{p} import x"),
    "rust": Language("rs", "use crate::{b}::{t}::{p};", "use std::io;", other="use super::super::super::{b}::{t}::{p}::Thing;"),
    "swift": Language("swift", "import {p}", "import Foundation", other="@testable import {p}"),
    "zig": Language("zig", 'const x = @import("../../{b}/{t}/{p}.zig");', 'const std = @import("std");'),
    "php": Language("php", "use src\\{b}\\{t}\\{p};", "use Absent\\Thing;", other="require_once 'src/{b}/{t}/{p}.php';"),
    "ruby": Language("rb", "require 'src/{b}/{t}/{p}'", "require 'json'", "#"),
    "elixir": Language("ex", "alias Src.{B}.{T}.{P}", "alias Absent.Thing", "#"),
    "scala": Language("scala", "import src.{b}.{t}.{p}", "import org.absent.Thing"),
}


def _named(template: str, part: dict[str, Column]) -> Column:
    out = F.lit(template.replace("{{", "{").replace("}}", "}"))
    for name, value in part.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def source_texts(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, text) of every part's file in ``language``."""
    how = LANGUAGES[language]
    number, kind = F.substring("p_brand", 7, 9), F.lower("p_type")
    names = {"b": F.concat(F.lit("b"), number), "t": kind, "p": F.concat(F.lit("p"), F.col("p_partkey").cast("string"))}
    names |= {k.upper(): F.initcap(v) for k, v in names.items()}
    place = "Src/{B}/{T}/{P}." if how.capitals else "src/{b}/{t}/{p}."
    statement = F.when(F.col("p_partkey") % 2 == 0, _named(how.other or how.statement, names)).otherwise(_named(how.statement, names))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), _named(place + how.extension, names).alias("path"), statement.alias("line"))
    steps = load(spark, sf_dir).deps.select("from_id", F.col("to_id").alias("id")).distinct().join(parts.drop("path").hint("merge"), "id")  # names spelt out are far larger than the file Spark judges them by
    lists = steps.groupBy("from_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("some")).select(F.col("from_id").alias("id"), F.col("some.line").alias("some"))
    several = F.coalesce("some", F.array().cast("array<string>"))
    marked = F.when(F.size(several) > 0, F.array(F.lit(f"{how.comment} {MARKER}"), several[0])).otherwise(F.array().cast("array<string>"))
    head, tail = F.array(F.lit(f"{how.comment} {how.absent}")) if language != "zig" else F.array(F.lit("// a file")), F.array(F.lit(how.absent))
    return parts.drop("line").join(lists.hint("merge"), "id", "left").select("path", F.array_join(F.concat(head, several, tail, marked), "\n").alias("text"))
