"""The registered queries over the driver's tables, each an operator on the exposure view or on a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sovara.operators import address, cleaning, codes, dictionary, identity, layout, mapping, normalize, portfolio, review
from sovara.flags import drop_flags, flags_table
from sovara.operators.cells import by_distinct
from sovara.functions.text import expand_words
from sovara.plans.exposure import exposure
from sovara.rules import PRESETS, Rules
from sovara.sources import dictionaries, files, stages
from sovara.sources.scratch import shared_folder
from sovara.streaming import ingest

RULES = Rules(max_building_value=400_000)

# Small dictionaries of the queries; the same rows stand in the SQL.
ISO = [("0", "100", 0, None), ("1", "101", 0, None), ("2", "F2", 0, "ISF"), ("3", "F3", 0, "ISF"), ("4", "F4", 0, "ISF"), ("5", "F5", 0, "ISF"), ("6", "F6", 0, "ISF")]
RMS = [("1", "101", 0, None), ("2", "F2", 0, "ISF"), ("3", "F3", 0, "ISF"), ("4", "111", 1, None), ("4", "F4", 0, "ISF"), ("7", "152", 0, None), ("8", "155", 0, None)]
CLASS = "key string, code string, rank int, scheme_override string"
SEGMENTS = [("BUILDING", "311", 0.95), ("machinery", "321", 0.9), ("Household", "301", 0.85)]
KEYWORDS = [
    ("K1", "steel goods", ["steel", "small steel", "steel rod"], 1), ("K2", "hot", ["hot", "hot bolt economy"], 2), ("K3", "promo goods", ["promo", "rod promo"], 3),
    ("K4", "blue rod", ["blue", "large blue rod"], 4), ("K5", "economy goods", ["economy", "old ring economy", "ring"], 5),
]
ALIASES = [("rms_roofsys", "clay tiles", 6), ("rms_roofsys", "single ply membrane", 3)]
TOKENS = [("rms_roofsys", "slate", 1, 1), ("rms_roofsys", "wood", 9, 2), ("rms_roofsys", "wood shingles", 7, 3)]


def portfolio_totals(s: SparkSession, d: str) -> DataFrame:
    return portfolio.totals(exposure(s, d))


def _tiv(s: SparkSession, d: str) -> DataFrame:
    return portfolio.row_tiv(exposure(s, d))


def tiv_by_country_state(s: SparkSession, d: str) -> DataFrame:
    return portfolio.tiv_by(_tiv(s, d), ("Nation", "Unknown"), ("Area", "NA"))


def tiv_rollup(s: SparkSession, d: str) -> DataFrame:
    return portfolio.tiv_rollup(_tiv(s, d), "Nation", "Area")


def tiv_by_occupancy(s: SparkSession, d: str) -> DataFrame:
    return portfolio.tiv_by(_tiv(s, d), ("segment", "Unknown"))


def tiv_by_construction(s: SparkSession, d: str) -> DataFrame:
    return portfolio.tiv_by(_tiv(s, d), ("priority", "Unknown"))


def tiv_by_year_band(s: SparkSession, d: str) -> DataFrame:
    return portfolio.tiv_by_band(_tiv(s, d), portfolio.year_band(F.col("order_year")), portfolio.YEAR_BANDS)


def tiv_by_story_band(s: SparkSession, d: str) -> DataFrame:
    return portfolio.tiv_by_band(_tiv(s, d), portfolio.story_band(F.col("stories_number")), portfolio.STORY_BANDS)


def top_locations(s: SparkSession, d: str) -> DataFrame:
    return portfolio.top_locations(_tiv(s, d), ["InsuredName", "Nation", "segment"])


def serial_numbers(s: SparkSession, d: str) -> DataFrame:
    return identity.serial_numbers(exposure(s, d)).select("row_index", "PolicyID", F.col("LocationID").cast("bigint").alias("LocationID"))


def uniform_policy(s: SparkSession, d: str) -> DataFrame:
    return identity.uniform_policy(exposure(s, d)).select("row_index", "PolicyID")


def account_file(s: SparkSession, d: str) -> DataFrame:
    return layout.account_rows(exposure(s, d), "AIR")


def contract_file(s: SparkSession, d: str) -> DataFrame:
    return layout.account_rows(exposure(s, d).withColumnRenamed("PolicyID", "ACCNTNUM"), "RMS")


def _rms(s: SparkSession, d: str) -> DataFrame:
    return exposure(s, d).select("row_index", F.col("PolicyID").alias("ACCNTNUM"), F.when(F.col("row_index") % 3 == 0, F.col("price")).alias("EQCV1VAL"), F.when(F.col("row_index") % 4 == 0, F.lit(7).cast("bigint")).alias("WSCV1VAL"),
                                F.lit("USD").alias("EQCV1LCUR"), F.when(F.col("row_index") % 5 == 0, F.lit(9999)).otherwise(F.col("order_year")).alias("YEARBUILT"), F.when(F.col("row_index") % 2 == 0, F.lit(1500)).alias("YEARUPGRAD"))


def peril_clone(s: SparkSession, d: str) -> DataFrame:
    return layout.clone_perils(_rms(s, d)).select("row_index", "EQCV1VAL", "WSCV1VAL", "FRCV1VAL", "TRCV1LCUR")


def rms_layout(s: SparkSession, d: str) -> DataFrame:
    return layout.fixed_layout(layout.format_years(layout.clone_perils(_rms(s, d))), "RMS").select("ACCNTNUM", "LOCNAME", "YEARBUILT", "YEARUPGRAD", "EQCV1VAL", "TOCV1VAL", "FLCV1LCUR")


def column_map_apply(s: SparkSession, d: str) -> DataFrame:
    rows = exposure(s, d).select("row_index", "Street", "City", "Area")
    return mapping.apply_column_map(rows, {"City": "Place", "Street": "Place", "Area": "Street"})


def _headers(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("u"), (F.col("l_orderkey") % 97).cast("string")).alias("upload_id"), F.concat(F.lit("col "), (F.col("l_partkey") % 13).cast("string")).alias("source_col"),
                                                          F.when(F.col("l_linenumber") < 5, F.concat(F.lit("C"), (F.col("l_suppkey") % 11).cast("string"))).alias("canonical")).distinct()


def mapping_conflicts(s: SparkSession, d: str) -> DataFrame:
    return mapping.mapping_conflicts(_headers(s, d)).select("upload_id", "canonical", F.array_join("sources", "|").alias("sources"))


def missing_required(s: SparkSession, d: str) -> DataFrame:
    headers = _headers(s, d)
    return mapping.missing_required(headers, s.createDataFrame([("C1",), ("C7",), ("Z9",)], "canonical string"), headers)


def clean_years(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_years(exposure(s, d), RULES).select("row_index", "YearBuilt", "YearRetrofitted", F.array_join("flags.issue", "|").alias("issues"))


def clean_stories(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_stories(exposure(s, d), RULES).select("row_index", "NumberOfStories", F.array_join("flags.issue", "|").alias("issues"))


def clean_count(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_count(exposure(s, d)).select("row_index", "RiskCount", F.array_join("flags.issue", "|").alias("issues"))


def clean_area(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_area(exposure(s, d), RULES).select("row_index", "GrossArea", F.array_join("flags.issue", "|").alias("issues"))


def clean_values(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_values(exposure(s, d).drop("Currency"), RULES).select("row_index", "BuildingValue", "ContentsValue", "Currency", F.array_join(F.filter("flags.issue", lambda i: i != "unparseable_value"), "|").alias("issues"))


def clean_currency(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_currency(exposure(s, d)).select("row_index", "Currency", "EQCV1LCUR", "EQCV2LCUR", "Currency_Conflicts", F.array_join("flags.issue", "|").alias("issues"))


def clean_sprinkler(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_sprinkler(exposure(s, d)).select("row_index", "SprinklerSystem", F.size("flags").alias("n_flags"))


def clean_name(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_location_name(exposure(s, d)).select("row_index", "LocationName", F.array_join("flags.issue", "|").alias("issues"))


def clean_postal(s: SparkSession, d: str) -> DataFrame:
    return exposure(s, d).select("row_index", address.postal(F.col("PostalCode"), F.lit("US")).alias("postal"))


def clean_state(s: SparkSession, d: str) -> DataFrame:
    return exposure(s, d).select("row_index", address.state(F.col("State"), F.lit("US")).alias("state")).withColumn("label", address.state_label(F.col("state")))


def clean_country(s: SparkSession, d: str) -> DataFrame:
    return exposure(s, d).select("row_index", address.country(F.col("CountryISO")).alias("country"))


def clean_coordinates(s: SparkSession, d: str) -> DataFrame:
    return address.clean_coordinates(exposure(s, d).withColumn("CountryISO", F.lit("US"))).select("row_index", "Latitude", "Longitude", F.array_join("flags.issue", "|").alias("issues"))


def clean_address(s: SparkSession, d: str) -> DataFrame:
    return address.clean_address(exposure(s, d)).select("row_index", "Street", "City", "State", "PostalCode", "CountryISO", F.array_join(F.array_sort("flags.issue"), "|").alias("issues"))


def clean_street_city(s: SparkSession, d: str) -> DataFrame:
    rows = exposure(s, d).select("row_index", "Street", "City")
    uses = address.address_uses(rows, {k: k for k in address.ADDRESS_PARTS})
    return by_distinct(rows, [uses["Street"], uses["City"]]).select("row_index", F.col("_street").alias("street"), F.col("_city").alias("city"))


def geocode_join(s: SparkSession, d: str) -> DataFrame:
    nation = s.read.parquet(f"{d}/nation.parquet").filter("n_nationkey % 2 = 0")
    gazetteer = nation.select(address.address_key(F.col("n_name")).alias("address_key"), (F.col("n_nationkey") + 10.25).alias("lat"), (F.col("n_nationkey") - 60.5).alias("lon"), F.lit(0.9).alias("confidence"))
    rows = exposure(s, d).select("row_index", F.when(F.col("row_index") % 10 == 0, F.lit("")).otherwise(address.assemble(F.col("Nation"))).alias("CombinedAddress"), F.when(F.col("row_index") % 6 == 0, F.col("Latitude")).alias("Latitude"), F.when(F.col("row_index") % 6 == 0, F.col("Longitude")).alias("Longitude"))
    return address.geocode(rows, gazetteer).select("row_index", "Geocode_Status", "Latitude", "Longitude")


def geocode_components(s: SparkSession, d: str) -> DataFrame:
    nation = s.read.parquet(f"{d}/nation.parquet")
    gazetteer = nation.filter("n_nationkey % 2 = 0").selectExpr(
        "lower(n_name) AS address_key", "n_nationkey + 10.25D AS lat", "n_nationkey - 60.5D AS lon", "0.9D AS confidence", "CASE WHEN n_nationkey % 4 = 0 THEN 'Place Street 5' END AS street", "concat('Town ', n_nationkey) AS city",
        "CASE WHEN n_nationkey % 4 = 0 THEN 'TX' WHEN n_nationkey % 8 = 2 THEN 'ZZ' END AS state_code", "concat('1000', n_nationkey) AS postcode", "CASE WHEN n_nationkey % 4 = 0 THEN 'US' END AS country",
    )
    rows = s.read.parquet(f"{d}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey AS row_index", "CASE WHEN c_custkey % 10 = 0 THEN '' ELSE n_name END AS CombinedAddress", "CASE WHEN c_custkey % 3 <> 0 THEN concat(c_name, ', Town ', n_nationkey, ', 1000', n_nationkey) END AS Street",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Own City' END AS City", "'CA' AS State", "'99999' AS PostalCode", "n_name AS CountryISO", "CASE WHEN c_custkey % 7 = 0 THEN '12.5' END AS Latitude", "'7' AS Longitude",
    )
    return address.geocode(rows, gazetteer).select("row_index", "Geocode_Status", "Street", "City", "State", "PostalCode", "CountryISO", "Latitude", "Longitude", "Geo_Confidence", "StateCodeValidation")


def geocode_outcomes(s: SparkSession, d: str) -> DataFrame:
    return address.geocode_counts(geocode_join(s, d))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return codes.distinct_pairs(exposure(s, d), "const_scheme", "construction")


def distinct_pairs(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d)


def crosswalk_iso(s: SparkSession, d: str) -> DataFrame:
    return codes.by_class(_pairs(s, d), s.createDataFrame(ISO, CLASS), codes.is_iso(F.col("scheme"), F.col("value")), "iso_direct")


def crosswalk_rms(s: SparkSession, d: str) -> DataFrame:
    return codes.by_class(_pairs(s, d), s.createDataFrame(RMS, CLASS), F.col("scheme").isin(*codes.RMS_SCHEMES), "rms_direct", 0.98)


def crosswalk_atc(s: SparkSession, d: str) -> DataFrame:
    classes = s.range(1, 55).select(F.col("id").cast("string").alias("key"), (F.col("id") + 300).cast("string").alias("code"))
    pairs = codes.distinct_pairs(exposure(s, d), "occ_scheme", "occupancy")
    return codes.by_class(pairs, classes, codes.is_atc(F.col("scheme"), F.col("value")), "atc_direct").select("scheme", "value", "code", "confidence")


def raw_lookup(s: SparkSession, d: str) -> DataFrame:
    pairs = codes.distinct_pairs(exposure(s, d), "occ_scheme", "occupancy")
    return codes.by_text(pairs, s.createDataFrame(SEGMENTS, "text string, code string, confidence double")).select("scheme", "value", "code", "confidence")


def conflict_rules(s: SparkSession, d: str) -> DataFrame:
    return codes.by_conflict(_pairs(s, d)).select("scheme", "value", "code", "confidence")


#: ISO classes and their fire classes; the scenario that no rule knows.
FIRE = [("0", None), ("1", "F1"), ("2", "F2"), ("3", "F3"), ("4", "F4"), ("5", "F5"), ("6", "F6"), ("7", None)]
SCENARIOS = [("blue rod and small bolt", "153", 0.97, "5")]


def _compound(s: SparkSession, d: str) -> DataFrame:
    """Construction texts of parts: abbreviations and words of their names and types beside each other."""
    part = s.read.parquet(f"{d}/part.parquet")
    words = F.array(*map(F.lit, ("URM walls", "lwf", "RC frame", "cmu walls", "Timber frame", "HT", "tilt", "metal building", "glulam", "unknown frame", "steel", "wood office")))
    more = F.array(*map(F.lit, ("brick veneer", "wood roof", "masonry walls", "concrete foundation", "wood floors", "masonry front", "a canopy", "interior wood office in metal warehouse", "attached wood office", "n/a")))
    link = F.array(*map(F.lit, (" with ", " over ", " and ", ", ")))
    pick = lambda ws, by: F.element_at(ws, (F.col("p_partkey") % by + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 31 == 0, F.lit("Blue rod and small bolt")).otherwise(F.concat(pick(words, 12), F.element_at(link, (F.col("p_size") % 4 + 1).cast("int")), pick(more, 10), F.lit(" "), F.substring_index("p_name", " ", 1)))
    return part.select(F.lit("").alias("scheme"), text.alias("value")).distinct()


def conflict_routing(s: SparkSession, d: str) -> DataFrame:
    return codes.by_conflict(_compound(s, d), s.createDataFrame(SCENARIOS, "text string, code string, confidence double, iso_class string"), codes.ABBREVIATIONS, s.createDataFrame(FIRE, "key string, code string")).select("value", "code", "confidence", "scheme_override")


def conflict_hints(s: SparkSession, d: str) -> DataFrame:
    return codes.conflict_hints(_compound(s, d), RULES, None, codes.ABBREVIATIONS, "RMS").select("value", "hint_code", "hint_category", "hint_confidence", "hint_rule", "expanded")


def expand_abbreviations(s: SparkSession, d: str) -> DataFrame:
    texts = _compound(s, d).select("value").union(s.read.parquet(f"{d}/conversations.parquet").select("text")).distinct()
    return texts.select("value", expand_words(F.col("value"), codes.ABBREVIATIONS).alias("expanded"))


def _cascade(s: SparkSession, d: str, rules: Rules | None = None) -> DataFrame:
    pairs = _pairs(s, d)
    iso = codes.by_class(pairs, s.createDataFrame(ISO, CLASS), codes.is_iso(F.col("scheme"), F.col("value")), "iso_direct")
    rms = codes.by_class(pairs, s.createDataFrame(RMS, CLASS), F.col("scheme").isin(*codes.RMS_SCHEMES), "rms_direct", 0.98)
    return codes.cascade(pairs, [iso, rms, codes.by_conflict(pairs)], rules=rules)


def cascade_default(s: SparkSession, d: str) -> DataFrame:
    return _cascade(s, d).select("scheme", "value", "rows", "code", "confidence", "method")


def cascade_thresholds(s: SparkSession, d: str) -> DataFrame:
    return _cascade(s, d, PRESETS["Balanced"]).select("scheme", "value", "rows", "code", "confidence", "method")


def enrich_codes(s: SparkSession, d: str) -> DataFrame:
    return codes.enrich(exposure(s, d), _cascade(s, d), "const_scheme", "construction", "Construction").select("row_index", "Construction_Code", "Construction_Confidence", "Construction_Method", "Construction_Scheme")


def method_counts(s: SparkSession, d: str) -> DataFrame:
    return portfolio.method_counts(enrich_codes(s, d), "Construction_Method")


def code_distribution(s: SparkSession, d: str) -> DataFrame:
    return portfolio.code_distribution(_cascade(s, d))


def _keywords(s: SparkSession) -> DataFrame:
    return s.createDataFrame(KEYWORDS, "code string, description string, keywords array<string>, ordinal int")


def keyword_scores(s: SparkSession, d: str) -> DataFrame:
    texts = s.read.parquet(f"{d}/part.parquet").select(F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("text"))
    return codes.best_codes(codes.keyword_scores(texts, _keywords(s)), _keywords(s)).select("text", "code", "score", "confidence", F.array_join("alternatives.code", "|").alias("others"))


def modifier_codes(s: SparkSession, d: str) -> DataFrame:
    return codes.modifier_codes(exposure(s, d).select(F.col("roof").alias("text")), "rms_roofsys", 9, s.createDataFrame(ALIASES, "section string, alias string, code int"), s.createDataFrame(TOKENS, "section string, token string, code int, ordinal int"))


def tfidf_topk(s: SparkSession, d: str) -> DataFrame:
    bench = s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("code"), F.col("text").alias("words"))
    turns = s.read.parquet(f"{d}/conversations.parquet").select("text")
    near = codes.tfidf_neighbours(turns, bench)
    return near.select("text", "code", "similarity", "rank", codes.tfidf_confidence(F.col("similarity")).alias("confidence"))


def tfidf_documents(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items nearest to each distinct text of the documents."""
    bench = s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("code"), F.col("text").alias("words"))
    near = codes.tfidf_neighbours(s.read.parquet(f"{d}/documents.parquet").select("text"), bench)
    return near.select(F.md5("text").alias("text_md5"), "code", "similarity", "rank", codes.tfidf_confidence(F.col("similarity")).alias("confidence"))


def modifier_tokens(s: SparkSession, d: str) -> DataFrame:
    """Names of parts against the first two words and the kinds of other parts as tokens."""
    part = s.read.parquet(f"{d}/part.parquet")
    token = F.explode(F.array(F.substring_index("p_name", " ", 2), F.substring_index(F.lower("p_type"), " ", -1), F.substring_index(F.lower("p_type"), " ", 1)))
    tokens = part.filter("p_size % 5 = 0").select(F.lit("roof_cover").alias("section"), token.alias("token"), (F.col("p_partkey") % 11).cast("int").alias("code"), F.col("p_partkey").cast("int").alias("ordinal"))
    aliases = part.filter("p_size = 1").select(F.lit("roof_cover").alias("section"), F.col("p_name").alias("alias"), F.lit(11).alias("code"))
    return codes.modifier_codes(part.select(F.col("p_name").alias("text")), "roof_cover", 11, aliases, tokens)


def fuzzy_topk(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet")
    aliases = part.select(F.col("p_type").alias("alias"), F.substring_index("p_type", " ", 1).alias("canonical")).distinct()
    return mapping.fuzzy_matches(part.select(F.col("p_name").alias("source_col")), aliases, cutoff=30.0)


def weak_suggestions(s: SparkSession, d: str) -> DataFrame:
    return mapping.low_scores(fuzzy_topk(s, d))


def _entries(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_brand").alias("code"), F.col("p_partkey").alias("version"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name")).alias("description"), F.split("p_type", " ").alias("keywords"))


def dict_overlay(s: SparkSession, d: str) -> DataFrame:
    return dictionary.overlay(_entries(s, d)).select("code", "description", F.array_join("keywords", "|").alias("keywords"), "version")


def dict_duplicates(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet").select(F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("code"))
    return dictionary.internal_duplicates(part)


def dict_clean_entries(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet").withColumn("code", F.concat("p_name", (F.col("p_partkey") % 9).cast("string")))
    new = part.select(F.lower("code").alias("code"), "p_partkey")
    return dictionary.clean_entries(new, part.filter("p_size < 20").select("code", F.col("p_type").alias("description")))


def dict_keywords(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet")
    entries = part.select(F.col("p_partkey").cast("string").alias("code"), F.split("p_type", " ").alias("keywords"))
    more = part.filter("p_size < 10").select(F.col("p_partkey").cast("string").alias("code"), F.array(F.substring_index("p_type", " ", 1), "p_brand").alias("keywords"))
    return dictionary.add_keywords(entries, more).select("code", F.array_join("keywords", "|").alias("keywords"))


def dict_first_category(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet")
    return dictionary.first_category(part.select(F.col("p_brand").alias("code"), F.col("p_size").alias("priority"), F.col("p_type").alias("category"), F.col("p_name").alias("description")))


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Parts as JSON texts: brand, kind and number of two depths, with notes beside them."""
    entry = "named_struct('description', p_name, 'keywords', split(p_type, ' '))"
    deep = f"map(p_brand, map(substring_index(p_type, ' ', 1), map(cast(p_partkey as string), {entry}), '_notes', map('x', {entry})))"
    return s.read.parquet(f"{d}/part.parquet").selectExpr(f"if(p_size % 2 = 0, to_json({deep}), to_json(map(p_brand, map(cast(p_partkey as string), {entry})))) AS value")


def dict_registry(s: SparkSession, d: str) -> DataFrame:
    return dictionaries.registry(_nested(s, d)).select("code", F.array_join("path", "/").alias("path"), "description", F.array_join("keywords", "|").alias("keywords"))


def dict_union(s: SparkSession, d: str) -> DataFrame:
    """A registry derived from classes, then a native one."""
    native = dictionaries.registry(_nested(s, d))
    derived = s.read.parquet(f"{d}/part.parquet").filter("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("code"), F.upper("p_name").alias("description"), F.array("p_brand").alias("keywords"))
    return dictionaries.union_registries(derived, native).select("code", "description", F.array_join("keywords", "|").alias("keywords"), "registry")


def scanned_table(s: SparkSession, d: str) -> DataFrame:
    """Customers written as an ordered delimited file, with quoted and empty cells, and read again."""
    path = _scratch(s, "scan")
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("row_index"), F.concat(F.lit(" "), "c_name", F.lit(", "), "c_mktsegment", F.lit(" ")).alias("Name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("Segment"))
    files.write_ordered(rows.withColumnRenamed("row_index", "_row_index"), ["_row_index"], path, ",")
    return files.read_table(s, path)


def dict_aliases(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("section"), F.col("p_brand").alias("code"), F.col("p_name").alias("alias"))
    return dictionary.aliases_of(part).select("section", "code", F.array_join("aliases", "|").alias("aliases"))


def dict_sections(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("roof_cover", "wall_type", "rms_roofsys", "rms_cladsys", "foundation_type", "soft_story", "other")))
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")).alias("section"))
    return dictionary.section_filter(part, "RMS")


def dict_upload_errors(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("Code"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).alias("Description"), F.regexp_replace("p_type", " ", "; ").alias("Keywords"))
    return dictionary.validate_upload(part).groupBy(F.array_join("errors", "|").alias("errors")).agg(F.count("*").alias("entries"), F.sum(F.size("keywords")).alias("keywords"))


def _confirmed(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit(" User_"), F.col("user_id").cast("string")).alias("source_col"), F.lit("AIR").alias("target_format"), F.col("event_type").alias("canonical"), F.col("ts").alias("at"))


def memory_upsert(s: SparkSession, d: str) -> DataFrame:
    return mapping.upsert_memory(None, _confirmed(s.read.parquet(f"{d}/events.parquet")))


def memory_forget(s: SparkSession, d: str) -> DataFrame:
    return mapping.forget(memory_upsert(s, d), F.lit("USER-7"), "AIR")


def memory_stats(s: SparkSession, d: str) -> DataFrame:
    return mapping.memory_statistics(memory_upsert(s, d))


def normalize_rows(s: SparkSession, d: str) -> DataFrame:
    rows = normalize.normalize_all(exposure(s, d), RULES)
    return rows.select("row_index", "PolicyID", F.col("LocationID").cast("bigint").alias("LocationID"), "YearBuilt", "NumberOfStories", "RiskCount", "GrossArea", "BuildingValue", "SprinklerSystem", "LocationName", "LineOfBusiness")


def clean_modifiers(s: SparkSession, d: str) -> DataFrame:
    rows = exposure(s, d).select("row_index", F.col("roof").alias("ROOFGEOM"))
    aliases, tokens = s.createDataFrame(ALIASES, "section string, alias string, code int"), s.createDataFrame(TOKENS, "section string, token string, code int, ordinal int")
    return normalize.clean_modifiers(rows, aliases, tokens, "RMS").select("row_index", "ROOFGEOM", F.array_join("flags.message", "|").alias("methods"))


def context_rules(s: SparkSession, d: str) -> DataFrame:
    pairs = codes.distinct_pairs(exposure(s, d), "occ_scheme", "segment", "Nation")
    rules = s.createDataFrame([("furniture", 1, ["a"], "F1"), ("furniture", 2, ["united", "peru"], "F2"), ("furniture", 9, None, "F9"), ("machinery", 1, ["china"], "M1")], "term string, ordinal int, signals array<string>, code string")
    return codes.by_context(pairs, rules, F.col("Nation")).select("scheme", "value", "code")


def dict_upsert(s: SparkSession, d: str) -> DataFrame:
    part = s.read.parquet(f"{d}/part.parquet")
    entries = part.groupBy("p_name").agg(F.min("p_type").alias("d")).select(F.col("p_name").alias("code"), F.col("d").alias("description"), F.array("d").alias("keywords"), F.lit(1).alias("version"))
    change = part.filter("p_size > 45").groupBy("p_brand").agg(F.max("p_name").alias("n")).select(F.col("n").alias("code"), F.lit("new").alias("description"), F.array(F.lit("k")).alias("keywords")).distinct()
    merged = dictionary.delete(dictionary.upsert(entries, change), part.filter("p_size = 1").select(F.col("p_name").alias("code")))
    return dictionary.export_table(merged)


def remembered_headers(s: SparkSession, d: str) -> DataFrame:
    headers = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("USER-"), (F.col("c_custkey") % 400).cast("string")).alias("source_col")).distinct()
    return mapping.remembered(headers, memory_upsert(s, d), "AIR")


def merged_suggestions(s: SparkSession, d: str) -> DataFrame:
    semantic = s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("source_col"), F.col("p_brand").alias("canonical"), (F.col("p_size") * 1.0).alias("score"))
    return mapping.merge_suggestions(fuzzy_topk(s, d), semantic)


def flag_families(s: SparkSession, d: str) -> DataFrame:
    return review.flag_families(flags_table(cleaning.clean_values(cleaning.clean_years(exposure(s, d), RULES), RULES)), ("year", "value", "currency"))


def qa_summary(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.clean_currency(cleaning.clean_years(exposure(s, d), RULES))
    return review.quality_summary(rows)


def step_diff(s: SparkSession, d: str) -> DataFrame:
    before = exposure(s, d)
    return review.step_diff(before, cleaning.clean_years(before, RULES), [("YearBuilt", "YearBuilt"), ("YearRetrofitted", "YearRetrofitted")])


def diff_sample(s: SparkSession, d: str) -> DataFrame:
    return review.diff_sample(step_diff(s, d))


def filled_counts(s: SparkSession, d: str) -> DataFrame:
    return review.filled_counts(exposure(s, d).select("row_index", "YearBuilt", "BuildingValue", "Currency", "LocationName"))


def changed_counts(s: SparkSession, d: str) -> DataFrame:
    before = exposure(s, d)
    return review.changed_counts(before, cleaning.clean_years(before, RULES), [("YearBuilt", "YearBuilt"), ("YearRetrofitted", "YearRetrofitted")])


def _corrections(s: SparkSession, d: str) -> DataFrame:
    return exposure(s, d).filter("row_index % 8 = 3").select("row_index", F.lit("YearBuilt").alias("field"), F.col("order_year").cast("string").alias("new_value"))


def apply_corrections(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.clean_years(exposure(s, d), RULES)
    return review.apply_corrections(rows, _corrections(s, d), ["YearBuilt"]).select("row_index", "YearBuilt", F.size("flags").alias("n_flags"))


def open_flags(s: SparkSession, d: str) -> DataFrame:
    flags = flags_table(cleaning.clean_years(exposure(s, d), RULES))
    return drop_flags(flags, _corrections(s, d)).select("row_index", "field", "issue", "current_value")


def column_profile(s: SparkSession, d: str) -> DataFrame:
    return mapping.column_profile(exposure(s, d).select("row_index", "PolicyID", "YearBuilt", "BuildingValue"))


def ep_curve(s: SparkSession, d: str) -> DataFrame:
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    losses = lines.select((F.datediff("l_shipdate", F.lit("1992-01-01")) % 1000).alias("year"), F.col("l_extendedprice").alias("loss"))
    return portfolio.exceedance_curve(losses, 1000)


def _scratch(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _event_stream(s: SparkSession, d: str, files: int | None = None) -> DataFrame:
    """Events as a stream of the files of their table; of `files` copies of equal shares, where several batches are wanted."""
    events = s.read.parquet(f"{d}/events.parquet")
    stream, path, pattern = s.readStream.schema(events.schema), f"{d}/events.parquet*", "*.parquet"
    if files:
        path = _scratch(s, "events")
        events.repartition(files, "user_id").write.parquet(path)
        stream = stream.option("maxFilesPerTrigger", 1)
    return stream.option("pathGlobFilter", pattern).parquet(path)


def stream_clean(s: SparkSession, d: str) -> DataFrame:
    """Events streamed file by file through the money job; what the stream wrote is returned."""
    root = _scratch(s, "stream")
    cells = _event_stream(s, d).select(F.col("event_id").alias("row_index"), F.concat(F.lit("$"), F.floor("value").cast("string"), F.lit("K")).alias("BuildingValue"))
    ingest.start_append(ingest.clean_stream(cells, [lambda df: cleaning.clean_values(df, RULES)]).select("row_index", "BuildingValue", "Currency"), f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/rows")


def stream_memory(s: SparkSession, d: str) -> DataFrame:
    """Events streamed in six batches into the memory of confirmed mappings, with a compaction in between."""
    root = _scratch(s, "memory")
    ingest.start_memory(_confirmed(_event_stream(s, d, 6)), f"{root}/table", f"{root}/checkpoint", compact_every=4).awaitTermination()
    return ingest.read_memory(s, f"{root}/table")


def stage_slice(s: SparkSession, d: str) -> DataFrame:
    """500 locations from the thousandth on, of a stage that was written before."""
    root = _scratch(s, "stages")
    stages.save_stage(exposure(s, d).select("row_index", "PolicyID", "YearBuilt", "BuildingValue"), root, "u1", "raw")
    return stages.load_slice(s, root, "u1", "raw", 1000, 500)


def location_file(s: SparkSession, d: str) -> DataFrame:
    """The location file as it was written: number and some cells of each line below the header."""
    path = _scratch(s, "locations")
    files.write_locations(layout.format_years(layout.clone_perils(_rms(s, d))), path, "RMS")
    at = {c: layout.RMS_COLUMNS.index(c) for c in ("ACCNTNUM", "YEARBUILT", "EQCV1VAL", "TOCV1VAL", "FLCV1LCUR")}
    lines = files.read_lines(s, path).filter("line_no > 0").select("line_no", F.split("line", "\t", -1).alias("cells"))
    return lines.select("line_no", *[F.get("cells", F.lit(i)).alias(c) for c, i in at.items()], F.size("cells").alias("n_cells"))


def account_lines(s: SparkSession, d: str) -> DataFrame:
    """The account file as it was written, header included."""
    path = _scratch(s, "accounts")
    files.write_accounts(exposure(s, d), path, "AIR")
    return files.read_lines(s, path)


def queries() -> dict:
    from types import FunctionType

    return {k: v for k, v in globals().items() if isinstance(v, FunctionType) and v.__module__ == __name__ and not k.startswith("_") and k != "queries" and v.__code__.co_argcount == 2}
