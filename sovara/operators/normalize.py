"""The cleaning jobs as one pass, and the secondary modifiers of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.flags import add_flags, flag
from sovara.functions.text import first_valid
from sovara.operators import cleaning
from sovara.operators.cells import by_distinct
from sovara.operators.codes import modifier_codes
from sovara.operators.identity import identity_pass
from sovara.rules import Rules

# Section of the modifier dictionary and highest code, by column.
SECTIONS = {
    "AIR": {"RoofGeometry": ("roof_cover", 11), "WallSiding": ("wall_type", 9), "WallType": ("wall_type", 9), "FoundationType": ("foundation_type", 12), "SoftStory": ("soft_story", 2)},
    "RMS": {"ROOFGEOM": ("rms_roofsys", 9), "CLADDING": ("rms_cladsys", 10), "WALLTYPE": ("rms_cladsys", 10), "FOUNDATION": ("foundation_type", 12), "SOFTSTORY": ("soft_story", 2)},
}


def clean_modifiers(df: DataFrame, aliases: DataFrame, tokens: DataFrame, target: str = "AIR") -> DataFrame:
    """Codes for the modifier columns of the table. Each column's distinct texts are coded once and joined back; cells that
    are null stay null; a flag keeps the original text unless it was a code already."""
    out = df
    for column, (section, highest) in SECTIONS[target].items():
        if column not in df.columns:
            continue
        found = modifier_codes(df.select(first_valid(F.col(column)).alias("text")).filter("text is not null"), section, highest, aliases, tokens)
        found = found.select(F.col("text").alias("_text"), F.col("code").alias("_code"), F.col("method").alias("_method"))
        rows = out.withColumn("_own", first_valid(F.col(column))).join(found, F.col("_own") == F.col("_text"), "left")
        rows = add_flags(rows, flag(F.col(column).isNotNull() & ~F.coalesce("_method", F.lit("empty")).isin("integer", "empty"), column, "mapped_modifier", F.col(column), F.col("_method")))
        out = rows.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("_code", F.lit(0)))).drop("_own", "_text", "_code", "_method")
    return out


def clean_rows(df: DataFrame, rules: Rules = Rules(), target: str = "AIR") -> DataFrame:
    """The stateless jobs in their order; they also run on streams."""
    jobs = (
        lambda d: cleaning.clean_years(d, rules, target), lambda d: cleaning.clean_stories(d, rules, target), lambda d: cleaning.clean_count(d, target), lambda d: cleaning.clean_area(d, rules, target),
        lambda d: cleaning.clean_values(d, rules, target), cleaning.clean_currency, lambda d: cleaning.clean_sprinkler(d, target), lambda d: cleaning.clean_location_name(d, target),
    )
    for job in jobs:
        df = df.transform(job)
    return df


def normalize_all(df: DataFrame, rules: Rules = Rules(), target: str = "AIR", aliases: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """All cleaning jobs, the modifiers if their dictionary is given, then policy id and location numbers.

    What cells say is read once per distinct text; the jobs then decide row by row.
    """
    rows = df if df.isStreaming else by_distinct(df, cleaning.cell_uses(df, rules, target))
    rows = clean_rows(rows, rules, target)
    if aliases is not None and tokens is not None:
        rows = clean_modifiers(rows, aliases, tokens, target)
    rows = cleaning.fill_blank(rows, {"LineOfBusiness": rules.default_line_of_business}) if target == "AIR" else rows
    return identity_pass(rows, rules, target, df)
