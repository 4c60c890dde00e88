"""Output layouts: fixed columns, perils, years, account files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.functions.text import blank_to_null

# Column order of the two layouts and the layers of an account.
AIR_COLUMNS = [
    "PolicyID", "InsuredName", "LocationID", "LocationName", "Street", "City", "Area", "PostalCode", "CountryISO", "Latitude", "Longitude", "ConstructionCodeType", "ConstructionCode",
    "OccupancyCodeType", "OccupancyCode", "RiskCount", "NumberOfStories", "GrossArea", "YearBuilt", "YearRetrofitted", "SprinklerSystem", "RoofGeometry", "FoundationType", "WallSiding",
    "SoftStory", "WallType", "BuildingValue", "ContentsValue", "TimeElementValue", "Currency", "LineOfBusiness",
]
PERILS = ("WS", "TO", "FL", "TR", "FR")
RMS_COLUMNS = [
    "ACCNTNUM", "LOCNUM", "LOCNAME", "STREETNAME", "CITY", "STATECODE", "POSTALCODE", "CNTRYCODE", "Latitude", "Longitude", "BLDGSCHEME", "BLDGCLASS", "OCCSCHEME", "OCCTYPE", "NUMBLDGS",
    "NUMSTORIES", "FLOORAREA", "YEARBUILT", "YEARUPGRAD", "SPRINKLER", "ROOFGEOM", "FOUNDATION", "CLADDING", "SOFTSTORY", "WALLTYPE",
    *[f"{p}CV{i}{k}" for k in ("VAL", "LCUR") for p in ("EQ", *PERILS) for i in (1, 2, 3)],
]
REQUIRED = {"AIR": ("OccupancyCode", "ConstructionCode", "LineOfBusiness"), "RMS": ("OCCTYPE", "BLDGCLASS")}
AIR_LAYERS = (("1", "PEA"), ("2", "PSH"), ("3", "PWX"), ("4", "PFL"), ("5", "PWB"), ("6", "PWB"))
RMS_LAYERS = (("EQ", "1"), ("HU", "2"), ("SCS", "3"), ("FL", "4"), ("FR", "5"), ("TR", "6"))


def fixed_layout(df: DataFrame, target: str, *keep: str) -> DataFrame:
    """The target's columns as text, in order; absent columns and nulls are empty. Columns to keep stay with an underscore."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return df.select([cell(c).alias(c) for c in (AIR_COLUMNS if target == "AIR" else RMS_COLUMNS)] + [F.col(c).alias(f"_{c}") for c in keep])


def clone_perils(df: DataFrame) -> DataFrame:
    """Values and currencies of the first peril where another peril has none."""
    at = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.withColumns({f"{p}CV{i}{k}": F.coalesce(at(f"{p}CV{i}{k}"), at(f"EQCV{i}{k}")) for p in PERILS for i in (1, 2, 3) for k in ("VAL", "LCUR")})


def format_years(df: DataFrame, low: int = 1700, high: int = 2026) -> DataFrame:
    """Years as first of January; 9999 as the last day of that year."""
    year = lambda c: F.col(c).cast("string")
    new = lambda c: F.when(year(c) == "9999", "12/31/9999").when(year(c).try_cast("int").between(low, high), F.concat(F.lit("01/01/"), year(c))).otherwise(year(c))
    return df.withColumns({c: new(c) for c in ("YEARBUILT", "YEARUPGRAD") if c in df.columns})


def account_rows(df: DataFrame, target: str) -> DataFrame:
    """Six layers for each contract; one placeholder contract if the table names none."""
    if target == "RMS":
        key, names, layers = "ACCNTNUM", ("POLICYNUM", "POLICYTYPE"), RMS_LAYERS
        own = df.select(blank_to_null(F.col(key)).alias(key)).filter(f"{key} is not null").distinct().withColumn("ACCNTNAME", F.col(key))
        spare = ("ACC_1", "ACC_1")
    else:
        key, names, layers = "ContractID", ("LayerID", "LayerPerils"), AIR_LAYERS
        contract = blank_to_null(F.col("PolicyID")).alias(key)
        own = df.select(contract, "row_index", "InsuredName").filter(f"{key} is not null").groupBy(key).agg(F.coalesce(F.min_by("InsuredName", "row_index"), F.lit("")).alias("InsuredName"))
        spare = ("CONT_1", "Unknown Insured")
    some = own.limit(1).agg(F.count("*").alias("n"))
    placeholder = some.filter("n = 0").select(*[F.lit(v).alias(c) for c, v in zip(own.columns, spare, strict=True)])
    layer = F.explode(F.array(*[F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1])) for a, b in layers]))
    return own.unionByName(placeholder).withColumn("layer", layer).select(*own.columns, "layer.*")
