"""Flags: one data-quality issue on one cell, gathered per row in an array and exploded to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAG = "struct<row_index:bigint,field:string,issue:string,current_value:string,confidence:double,alternatives:array<string>,message:string>"


def flag(when: Column, field: str, issue: str | Column, value: Column, message: str | Column = "") -> Column:
    """The flag of a row where `when` holds, else null: field, issue, value and message."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.array(F.lit(field), text(issue), value.cast("string"), text(message)))


def add_flags(df: DataFrame, *flags: Column) -> DataFrame:
    """Appends the flags that are not null to the column `flags`, which is made if absent."""
    before = F.col("flags") if "flags" in df.columns else F.expr(f"cast(array() as array<{FLAG}>)")
    if not flags:
        return df.withColumn("flags", before)
    rows = df.withColumn("_flags", F.array_compact(F.array(*flags)))
    whole = "named_struct('row_index', cast(row_index as bigint), 'field', f[0], 'issue', f[1], 'current_value', f[2], 'confidence', cast(null as double), 'alternatives', cast(array() as array<string>), 'message', f[3])"
    return rows.withColumn("flags", F.concat(before, F.expr(f"transform(_flags, f -> {whole})"))).drop("_flags")


def flags_table(df: DataFrame) -> DataFrame:
    """One row per flag.

    Rows without flags are dropped after the explosion: to drop them before, Spark would copy all that makes the flags into
    a filter of its own.
    """
    return df.select(F.explode_outer("flags").alias("f")).filter("f is not null").select("f.*")


def drop_flags(flags: DataFrame, done: DataFrame) -> DataFrame:
    """Flags without those of the (row_index, field) cells in `done`."""
    return flags.join(done.select("row_index", "field").distinct(), ["row_index", "field"], "left_anti").select(flags.columns)
