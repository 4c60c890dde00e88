"""Comparison and review: step differences, corrections, quality counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.functions.text import blank_to_null

FAMILIES = ("year", "stor", "value", "currency", "coordinates", "zip", "state", "count", "area")


def step_diff(before: DataFrame, after: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cells before and after a step, joined by row_index; rows with nothing in any cell are left out."""
    old = before.select("row_index", *[F.col(a).cast("string").alias(f"before_{a}") for a, _ in pairs])
    new = after.select("row_index", *[F.col(b).cast("string").alias(f"after_{b}") for _, b in pairs])
    cells = [f"before_{a}" for a, _ in pairs] + [f"after_{b}" for _, b in pairs]
    return old.join(new, "row_index").filter(F.exists(F.array(*cells), lambda x: blank_to_null(x).isNotNull()))


def diff_sample(diff: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows of a difference."""
    return diff.orderBy("row_index").limit(rows)


def filled_counts(df: DataFrame) -> DataFrame:
    """Filled cells per column."""
    names = [c for c in df.columns if c not in ("row_index", "flags")]
    counts = df.agg(*[F.count_if(blank_to_null(F.col(c).cast("string")).isNotNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "filled")


def changed_counts(before: DataFrame, after: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cells that differ as trimmed text, per column."""
    diff = before.select("row_index", *[F.col(a).cast("string").alias(f"_b{i}") for i, (a, _) in enumerate(pairs)]).join(after.select("row_index", *[F.col(b).cast("string").alias(f"_a{i}") for i, (_, b) in enumerate(pairs)]), "row_index")
    counts = diff.agg(*[F.count_if(~F.trim(f"_b{i}").eqNullSafe(F.trim(f"_a{i}"))).alias(b) for i, (_, b) in enumerate(pairs)])
    return counts.unpivot([], [b for _, b in pairs], "column_name", "changed")


def flag_families(flags: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Flags by issue family; one flag may count in several."""
    counts = flags.agg(*[F.count_if(F.col("issue").contains(f)).alias(f) for f in families])
    return counts.unpivot([], list(families), "family", "flags")


def quality_summary(df: DataFrame, low: float = 0.70) -> DataFrame:
    """Quality counts of a cleaned table in one pass over it, as label and value."""
    has = lambda c: c in df.columns
    issue = lambda text: F.exists("flags", lambda f: f["issue"].contains(text))
    counts = {
        "rows": F.count("*"), "geocode_failures": F.count_if(~F.col("Geocode_Status").isin("provided", "geocoded")) if has("Geocode_Status") else F.lit(0),
        "low_occupancy_confidence": F.count_if(F.coalesce("Occupancy_Confidence", F.lit(1.0)) < low) if has("Occupancy_Confidence") else F.lit(0),
        "low_construction_confidence": F.count_if(F.coalesce("Construction_Confidence", F.lit(1.0)) < low) if has("Construction_Confidence") else F.lit(0),
        "currency_conflicts": F.count_if("Currency_Conflicts") if has("Currency_Conflicts") else F.lit(0),
        "bad_years": F.count_if(issue("year")), "flagged_rows": F.count_if(F.size("flags") > 0), "flags": F.coalesce(F.sum(F.size("flags")), F.lit(0)),
    }
    return df.agg(*[v.cast("bigint").alias(k) for k, v in counts.items()]).unpivot([], list(counts), "label", "value")


def apply_corrections(df: DataFrame, corrections: DataFrame, fields: list[str]) -> DataFrame:
    """Writes corrections (row_index, field, new_value, and optionally at) to their cells and drops the cells' flags."""
    last = F.max_by("new_value", F.struct(F.col("at") if "at" in corrections.columns else F.lit(0), "new_value"))
    wide = corrections.filter(F.col("field").isin(fields)).groupBy("row_index").pivot("field", fields).agg(last)
    wide = wide.select("row_index", *[F.col(f).alias(f"_new_{f}") for f in fields])
    rows = df.join(wide, "row_index", "left")
    kinds = dict(df.dtypes)
    rows = rows.withColumns({f: F.coalesce(F.col(f"_new_{f}").try_cast(kinds[f]), F.col(f)) for f in fields})
    if "flags" in df.columns:
        done = reduce(lambda a, b: F.array_append(a, b), [F.when(F.col(f"_new_{f}").isNotNull(), F.lit(f)) for f in fields], F.array().cast("array<string>"))
        rows = rows.withColumn("_done", F.array_compact(done)).withColumn("flags", F.filter("flags", lambda x: ~F.array_contains(F.col("_done"), x["field"]))).drop("_done")
    return rows.drop(*[f"_new_{f}" for f in fields])
