"""Portfolio aggregations and the exceedance curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sovara.functions.text import blank_to_null, lenient_number

YEAR_BANDS = ("Pre 1995", "1995 – 2001", "2002 – 2010", "2011 – 2017", "Post 2017", "Unknown")
STORY_BANDS = ("1", "2–3", "4–7", "7+", "Unknown")
RETURN_PERIODS = (10, 25, 50, 100, 250, 500, 1000)


def row_tiv(df: DataFrame, tiv: str = "TIV", parts: tuple[str, ...] = ("BuildingValue", "ContentsValue", "TimeElementValue")) -> DataFrame:
    """Insured value of a row: the given total if positive, else the sum of its parts. Adds `tiv`."""
    at = lambda c: lenient_number(F.col(c)) if c in df.columns else F.lit(0.0)
    total = sum([at(c) for c in parts[1:]], at(parts[0]))
    return df.withColumn("tiv", F.when(at(tiv) > 0, at(tiv)).otherwise(total))


def totals(df: DataFrame) -> DataFrame:
    """Sums of the coverages; the total is that of the TIV column if positive, else that of the parts."""
    at = lambda c: F.sum(lenient_number(F.col(c)).cast("decimal(38,2)")) if c in df.columns else F.lit(0).cast("decimal(38,2)")
    sums = df.agg(at("BuildingValue").alias("building"), at("ContentsValue").alias("contents"), at("TimeElementValue").alias("bi"), at("TIV").alias("given"), F.count("*").alias("locations"))
    parts = F.col("building") + F.col("contents") + F.col("bi")
    return sums.select("locations", "building", "contents", "bi", F.when(F.col("given") > 0, F.col("given")).otherwise(parts).alias("total"))


def _label(c: str, blank: str) -> Column:
    return F.coalesce(blank_to_null(F.col(c)), F.lit(blank))


def tiv_by(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Locations and insured value by (column, label for blanks), largest first."""
    keys = [_label(c, blank).alias(c) for c, blank in columns]
    out = df.groupBy(*keys).agg(F.count("*").alias("locations"), F.sum(F.col("tiv").cast("decimal(38,2)")).alias("tiv"))
    return out.orderBy(F.desc("tiv"), *[c for c, _ in columns])


def tiv_rollup(df: DataFrame, country: str, state: str) -> DataFrame:
    """Country by state with subtotals; level 0 is the detail, 1 a country, 3 everything."""
    rows = df.select(_label(country, "Unknown").alias("country"), _label(state, "NA").alias("state"), "tiv")
    return rows.rollup("country", "state").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("locations"), F.sum(F.col("tiv").cast("decimal(38,2)")).alias("tiv"))


def year_band(year: Column) -> Column:
    return F.when(F.coalesce(year, F.lit(0)) <= 0, YEAR_BANDS[5]).when(year < 1995, YEAR_BANDS[0]).when(year <= 2001, YEAR_BANDS[1]).when(year <= 2010, YEAR_BANDS[2]).when(year <= 2017, YEAR_BANDS[3]).otherwise(YEAR_BANDS[4])


def story_band(stories: Column) -> Column:
    return F.when(F.coalesce(stories, F.lit(0)) <= 0, STORY_BANDS[4]).when(stories <= 1, STORY_BANDS[0]).when(stories <= 3, STORY_BANDS[1]).when(stories <= 7, STORY_BANDS[2]).otherwise(STORY_BANDS[3])


def tiv_by_band(df: DataFrame, band: Column, order: tuple[str, ...]) -> DataFrame:
    """Every band in its fixed order, empty ones too."""
    sums = df.groupBy(band.alias("band")).agg(F.count("*").alias("locations"), F.sum(F.col("tiv").cast("decimal(38,2)")).alias("tiv"))
    bands = df.sparkSession.createDataFrame(list(enumerate(order)), "ordinal int, band string")
    return bands.join(sums, "band", "left").select("ordinal", "band", F.coalesce("locations", F.lit(0)).alias("locations"), F.coalesce("tiv", F.lit(0).cast("decimal(38,2)")).alias("tiv")).orderBy("ordinal")


def top_locations(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("tiv"), "row_index").limit(n).select("row_index", *columns, "tiv")


def method_counts(df: DataFrame, method: str) -> DataFrame:
    return df.groupBy(F.col(method).alias("method")).count()


def code_distribution(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent codes among distinct pairs, with samples of their texts."""
    return pairs.groupBy("code").agg(F.count("*").alias("pairs"), F.array_join(F.slice(F.array_sort(F.collect_set("value")), 1, 6), "|").alias("samples")).orderBy(F.desc("pairs"), "code").limit(n)


def exceedance_curve(losses: DataFrame, years: int, periods: tuple[int, ...] = RETURN_PERIODS) -> DataFrame:
    """Losses at return periods from a year-loss table (year, loss), by yearly maximum (OEP) and yearly sum (AEP).

    With n years, the loss of return period r is the one of rank n / r; only that many of the largest years are ranked, so
    the window sees at most n / min(r) rows of a table with one row per year.
    """
    yearly = losses.groupBy("year").agg(F.max("loss").alias("oep"), F.sum(F.col("loss").cast("decimal(38,2)")).cast("double").alias("aep"))
    out = None
    for kind in ("oep", "aep"):
        top = yearly.select(F.col(kind).alias("loss")).orderBy(F.desc("loss")).limit(max(1, years // min(periods)))
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("loss"))))
        points = losses.sparkSession.createDataFrame([(r, max(1, years // r)) for r in periods], "return_period int, rank int")
        curve = points.join(F.broadcast(ranked), "rank", "left").select("return_period", F.lit(kind).alias("curve"), F.bround(F.lit(1.0) / F.col("return_period"), 6).alias("exceedance_probability"), F.coalesce("loss", F.lit(0.0)).alias("loss_amount"))
        out = curve if out is None else out.unionByName(curve)
    return out
