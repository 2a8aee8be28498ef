"""Names that stay clear of the columns of a table, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(stem: str, *frames: DataFrame) -> str:
    """``stem``, with underscores behind it until no column of ``frames`` has the name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def clear_of(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` with each column that has one of ``names`` renamed to ``<name>_input`` (with underscores until that is free)."""
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            df = df.withColumnRenamed(c, fresh(f"{c}_input", df))
    return df
