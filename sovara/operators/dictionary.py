"""Dictionaries of codes as tables: overlays, duplicates, edits, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.functions.text import blank_to_null


def overlay(entries: DataFrame) -> DataFrame:
    """Current entries of versioned ones (code, version, description, keywords): keywords are united in order of first
    mention, the latest description that is not blank holds."""
    ordered = F.array_sort(F.collect_list(F.struct("version", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))))
    filled = blank_to_null(F.col("description")).isNotNull()
    return entries.filter(~F.col("code").startswith("_")).groupBy("code").agg(
        F.max_by(F.when(filled, F.col("description")), F.when(filled, F.col("version"))).alias("description"), F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["keywords"]))).alias("keywords"), F.max("version").alias("version"),
    )


def add_keywords(codes: DataFrame, more: DataFrame) -> DataFrame:
    """Keywords of `more` (code, keywords) appended where they are new."""
    extra = more.groupBy("code").agg(F.flatten(F.array_sort(F.collect_list("keywords"))).alias("_more"))
    none = F.array().cast("array<string>")
    return codes.join(extra, "code", "left").withColumn("keywords", F.array_distinct(F.concat(F.coalesce("keywords", none), F.coalesce("_more", none)))).drop("_more")


def first_category(entries: DataFrame) -> DataFrame:
    """One entry per code: that of the category with the lowest priority number."""
    rest = [c for c in entries.columns if c not in ("code", "priority")]
    return entries.groupBy("code").agg(F.min_by(F.struct(*rest), F.struct("priority", *rest)).alias("e")).select("code", "e.*")


def internal_duplicates(entries: DataFrame) -> DataFrame:
    """Codes that collide after trimming and upper case."""
    return entries.groupBy(F.upper(F.trim("code")).alias("key")).agg(F.count("*").alias("entries"), F.array_join(F.array_sort(F.collect_set("code")), "|").alias("codes")).filter("entries > 1")


def duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New entries whose code exists already."""
    old = existing.groupBy(F.upper(F.trim("code")).alias("_key")).agg(F.min_by("description", F.struct("code", "description")).alias("existing_description"))
    return new.join(old, F.upper(F.trim("code")) == F.col("_key")).drop("_key")


def clean_entries(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New entries whose code does not exist yet."""
    old = existing.select(F.upper(F.trim("code")).alias("_key")).distinct()
    return new.join(old, F.upper(F.trim("code")) == F.col("_key"), "left_anti")


def upsert(entries: DataFrame, change: DataFrame) -> DataFrame:
    """Replaces description and keywords of existing codes and appends new ones, as a new version."""
    now = change.select("code", F.col("description").alias("_d"), F.col("keywords").alias("_k"))
    return entries.join(now, "code", "full").select("code", F.coalesce("_d", "description").alias("description"), F.coalesce("_k", "keywords").alias("keywords"), (F.coalesce("version", F.lit(0)) + F.when(F.col("_d").isNotNull() | F.col("_k").isNotNull(), 1).otherwise(0)).alias("version"))


def delete(entries: DataFrame, codes: DataFrame) -> DataFrame:
    return entries.join(codes.select("code").distinct(), "code", "left_anti")


def aliases_of(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("section", "code").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def section_filter(entries: DataFrame, target: str) -> DataFrame:
    """Sections of the modifier dictionary that a target reads."""
    common = ("foundation_type", "soft_story")
    return entries.filter(F.col("section").isin(*(("roof_cover", "wall_type", *common) if target == "AIR" else ("rms_roofsys", "rms_cladsys", *common))))


def validate_upload(rows: DataFrame) -> DataFrame:
    """Uploaded rows (Code, Description, Keywords) as entries with an array `errors`; rows with no cell filled are skipped."""
    code, text = blank_to_null(F.col("Code")), blank_to_null(F.col("Description"))
    keywords = F.filter(F.transform(F.split(F.coalesce("Keywords", F.lit("")), "[;,]"), F.trim), lambda k: k != "")
    errors = F.array_compact(F.array(F.when(code.isNull(), F.lit("missing_code")), F.when(text.isNull(), F.lit("missing_description"))))
    return rows.filter(F.coalesce(code, text, blank_to_null(F.col("Keywords"))).isNotNull()).select(code.alias("code"), text.alias("description"), keywords.alias("keywords"), errors.alias("errors"))


def split_upload(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries with errors, entries that exist already, and clean ones."""
    checked = validate_upload(rows)
    good = checked.filter("size(errors) = 0")
    return checked.filter("size(errors) > 0"), duplicates(good, existing), clean_entries(good, existing)


def export_table(entries: DataFrame, most: int = 10) -> DataFrame:
    """Entries as flat text rows with at most `most` keywords."""
    return entries.select("code", F.coalesce("description", F.lit("")).alias("description"), F.array_join(F.slice("keywords", 1, most), "; ").alias("keywords"))
