"""Policy identity and numbering of locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sovara.flags import add_flags, flag
from sovara.functions.text import blank_to_null
from sovara.operators.cleaning import fill_blank
from sovara.rules import Rules


def uniform_policy(df: DataFrame, rules: Rules = Rules(), column: str = "PolicyID", source: DataFrame | None = None) -> DataFrame:
    """One policy id on all rows: the configured one, else the first in row order that is not blank.

    The first id is a one-row aggregate joined to every row, not a window over the whole table. It is taken from `source`, an
    earlier form of df with the same row_index and policies, if there is one: what was done since is then done once.
    """
    if rules.policy_id.strip():
        return df.withColumn(column, F.lit(rules.policy_id.strip()))
    filled = blank_to_null(F.col(column))
    first = (df if source is None else source).agg(F.min_by(filled, F.when(filled.isNotNull(), F.col("row_index"))).alias("_policy"))
    rows = df.crossJoin(F.broadcast(first))  # one row
    rows = add_flags(rows, flag(F.col("_policy").isNull(), column, "missing_policy_id", F.lit(None)))
    return rows.withColumn(column, F.coalesce("_policy", column)).drop("_policy")


def serial_numbers(df: DataFrame, policy: str = "PolicyID", out: str = "LocationID", range_rows: int = 500_000, source: DataFrame | None = None) -> DataFrame:
    """Numbers 1..n within each policy in row order; rows without policy are one group.

    A policy may hold a large part of all rows, so its rows are ranked within ranges of row_index of about range_rows rows and
    the sizes of the ranges before are added: no task needs a whole policy. Bounds and sizes come from `source`, an earlier
    form of df with the same row_index and policies, if there is one.
    """
    source = df if source is None else source
    bounds = source.agg(F.min("row_index").alias("low"), F.max("row_index").alias("high"), F.count("row_index").alias("rows"))
    parts = F.greatest(F.ceil(F.col("rows") / range_rows), F.lit(64))
    step = F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / parts), F.lit(1))
    bounds = bounds.select("low", step.alias("step"))  # one row

    def placed(table: DataFrame) -> DataFrame:
        rows = table.withColumn("_policy", F.coalesce(blank_to_null(F.col(policy)), F.lit(""))).crossJoin(F.broadcast(bounds))
        return rows.withColumn("_part", F.floor((F.col("row_index") - F.col("low")) / F.col("step"))).drop("low", "step")

    rows = placed(df)
    sizes = placed(source.select("row_index", policy)).groupBy("_policy", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_policy").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_policy", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_policy", "_part").orderBy("row_index")
    return rows.withColumn("_rank", F.row_number().over(within)).join(sizes, ["_policy", "_part"]).withColumn(out, F.col("_rank") + F.col("_before")).drop("_policy", "_part", "_rank", "_before")


def identity_pass(df: DataFrame, rules: Rules = Rules(), target: str = "AIR", source: DataFrame | None = None) -> DataFrame:
    """Policy id, insured name and location numbers. source: an earlier form of df with the same row_index and policies."""
    policy, location = ("PolicyID", "LocationID") if target == "AIR" else ("ACCNTNUM", "LOCNUM")
    narrow = (df if source is None else source).select("row_index", policy)
    rows = uniform_policy(df, rules, policy, narrow)
    if target == "AIR" and rules.insured_name.strip():
        rows = fill_blank(rows, {"InsuredName": rules.insured_name.strip()})
    return serial_numbers(rows, policy, location, source=uniform_policy(narrow, rules, policy, narrow).drop("flags"))
