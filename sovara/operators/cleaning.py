"""Cleaning jobs over exposure tables: each takes and returns a DataFrame with a column `row_index` and gathers `flags`.

A job has two parts. What a cell says is a Reading (see cells): it looks at the text alone, so equal texts need it once. What
follows for the row, its columns and flags is decided by the job. A job reads in place unless the results are there already.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sovara.flags import add_flags, flag
from sovara.functions.text import blank_to_null, first_filled, look_up, number, rewrite
from sovara.operators.cells import Reading, Use, in_place
from sovara.rules import Rules

# Words and codes that the results depend on.
ROOF_WORDS = "roof roofs electrical plumb plumbing hvac mechanical cosmetic interior tenant appraisal".split()
UPGRADE_WORDS = (
    "upgrade upgrades upgraded renovat renovate renovated renovation retrofit retrofitted rehab rehabbed modernize modernizes modernized code "
    "reconstruct reconstruction reconstructed rebuilt reno seismic seismically update updates updated"
).split()
STORY_WORDS = {"single": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
WOOD_FRAME = ("101", "102", "103", "104", "105")
COUNT_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "dual": 2, "double": 2, "triple": 3, "ground": 1, "a": 1, "an": 1,
    "twenty-one": 21, "twenty-two": 22, "twenty-three": 23, "twenty-four": 24, "twenty-five": 25, "thirty": 30, "forty": 40, "fifty": 50,
}
SIDE_STRUCTURES = (
    "clubhouse", "club house", "community center", "center", "office", "shed", "maintenance shed", "garage", "auxiliary", "aux", "main building", "reception", "gym",
    "pool house", "amenity center", "annex", "pavilion", "chapel", "library", "lobby",
)
VAGUE_COUNT = r"(?i)^(n/?a|various|multiple buildings?|multiple|tbd|unknown|several|numerous|many|tba|none|nil|na|-)$"
SINGLE_COUNT = r"(?i)^(single building|single|one building|one)$"
FOREIGN_AREA = r"(?i)\b(acre|acres|ac|hectare|hectares|ha|sq\s*meters?|sqm|m2)\b"
VAGUE_AREA = r"(?i)^(n/?a|various|varies|tbd|unknown|none|nil|included|-)$"
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
NO_VALUE = ("-", "n/a", "na", "none", "nil")
CURRENCIES = tuple(  # active codes of ISO 4217
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR "
    "FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD "
    "MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC "
    "SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VED VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWG".split()
)
CURRENCY_COLUMNS = ("Currency", "CV1LCUR", "CV2LCUR", "CV3LCUR", "EQCV1LCUR", "EQCV2LCUR", "EQCV3LCUR", "WSCV3LCUR", "TOCV3LCUR", "HUCV3LCUR", "FPCV3LCUR", "TRCV3LCUR")
SPRINKLED = ("yes", "y", "1", "true", "sprinklered", "wet pipe", "dry pipe", "wet", "dry")
UNSPRINKLED = ("no", "n", "0", "false", "none", "no sprinkler", "unsprinklered")


def _at(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("bigint")


def _word(text: str, words: list[str]) -> Column:
    return F.col(text).rlike(rf"\b({'|'.join(words)})\b")


def _years_in_text(rows: DataFrame, rules: Rules) -> DataFrame:
    rows = rows.withColumn("_years_text", F.lower(F.trim(F.concat_ws(" ", "_years_built", "_years_upgrade"))))
    long = F.transform(F.regexp_extract_all("_years_text", F.lit(r"\b([12]\d{3})\b"), F.lit(1)), lambda y: y.cast("int"))
    short = F.transform(F.regexp_extract_all("_years_text", F.lit(r"\b(\d{2})\b"), F.lit(1)), lambda y: y.cast("int") + F.when(y.cast("int") >= rules.year_pivot, 1900).otherwise(2000))
    rows = rows.withColumn("_years", F.when(F.size(long) > 0, long).otherwise(short)).withColumn("_years", F.array_distinct(F.filter("_years", lambda y: y.between(rules.year_min, rules.year_max))))
    rows = rows.withColumns({"_years_alpha": F.col("_years_text").rlike(r"\b(19|20)\d[a-z]\b"), "_years_first": F.array_min("_years"), "_years_last": F.array_max("_years"), "_years_found": F.size("_years")})
    first = F.col("_years_first").cast("string")
    only_upgrade = (F.col("_years_found") == 1) & ~F.col("_years_built").contains(first) & F.col("_years_upgrade").contains(first)
    later = (F.col("_years_found") > 1) & (_word("_years_text", UPGRADE_WORDS) | ~_word("_years_text", ROOF_WORDS))
    return rows.withColumns({"_years_good": ~F.col("_years_alpha") & (F.col("_years_found") > 0) & ~only_upgrade, "_years_later": later}).drop("_years", "_years_text")


def years_use(df: DataFrame, rules: Rules) -> Use:
    reading = Reading(f"years {rules.year_min} {rules.year_max} {rules.year_pivot}", ("_years_built", "_years_upgrade"), ("_years_alpha", "_years_first", "_years_last", "_years_found", "_years_good", "_years_later"), lambda rows: _years_in_text(rows, rules))
    cell = lambda *names: F.coalesce(first_filled(*[_at(df, n) for n in names]), F.lit(""))
    return Use(reading, (cell("YearBuilt", "YEARBUILT"), cell("YearRetrofitted", "YEARUPGRAD")))


def clean_years(df: DataFrame, rules: Rules, target: str = "AIR") -> DataFrame:
    """Year built and year of the last structural upgrade, from free text in two cells.

    A text without a valid year is blanked and flagged; by rules.invalid_year_action it is not flagged (`none`), or gets
    year_default (`set_default`).
    """
    built, upgrade = ("YearBuilt", "YearRetrofitted") if target == "AIR" else ("YEARBUILT", "YEARUPGRAD")
    use = years_use(df, rules)
    rows = in_place(df, use).withColumn("_raw", F.trim(F.concat_ws(" ", *use.cells)))
    good, bad = F.col("_years_good"), (F.col("_raw") != "") & (F.col("_years_alpha") | (F.col("_years_found") == 0))
    default = (F.when(bad, rules.year_default), F.when(bad, 9999)) if rules.invalid_year_action == "set_default" else (F.lit(None).cast("int"),) * 2
    rows = rows.withColumns({built: F.when(good, F.col("_years_first")).otherwise(default[0]), upgrade: F.when(good, F.when(F.col("_years_later"), F.col("_years_last")).otherwise(9999)).otherwise(default[1])})
    flags = [flag(F.col("_years_alpha"), built, "invalid_alpha_year", F.col("_raw"), "year with a letter"), flag(bad & ~F.col("_years_alpha"), built, "unparseable_year", F.col("_raw"), "no valid year")]
    return add_flags(rows, *([] if rules.invalid_year_action == "none" else flags)).drop("_raw", *use.results)


def _stories_in_text(rows: DataFrame) -> DataFrame:
    # the steps and their order are fixed: what a step leaves is what the next one sees
    sums = r"\d+(?:\.\d+)?(?:\s*\+\s*\d+(?:\.\d+)?)+"
    add = lambda run: F.concat(F.lit(" "), F.aggregate(F.split(run, r"\+"), F.lit(0.0), lambda a, x: a + F.trim(x).cast("double")).cast("string"), F.lit(" "))
    rows = rows.withColumn("_stories_left", rewrite(F.lower("_stories_text"), sums, add))
    rows = rows.withColumn("_stories_left", rewrite(F.col("_stories_left"), r"\bg(?:round)?\s*\+\s*\d+\b", lambda g: F.concat(F.lit(" "), (F.regexp_extract(g, r"(\d+)", 1).cast("int") + 1).cast("string"), F.lit(" "))))
    low = r"mezzanine|mezz|basement|bsmt"
    rows = rows.withColumns({"_stories_low": F.col("_stories_left").rlike(low), "_stories_left": F.regexp_replace("_stories_left", rf"(\+\s*)?\b(\d+\s+)?({low})\b", " ")})
    rows = rows.withColumn("_stories_left", F.regexp_replace("_stories_left", r"\b(\d+)\s+(buildings?|bldgs?|structures?)\b", " "))
    rows = rows.withColumn("_stories_left", reduce(lambda t, w: F.regexp_replace(t, rf"\b{w}\b", str(STORY_WORDS[w])), STORY_WORDS, F.col("_stories_left")))
    rows = rows.withColumn("_stories_all", F.regexp_extract_all(F.regexp_replace("_stories_left", r"[-–/,(]+|\bto\b", " "), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))
    raw, n = F.col("_stories_text"), F.size("_stories_all")
    negative = raw.rlike(r"^-\s*\d+(\.\d+)?$")
    summed = raw.contains("+") & (n == 1) & (F.trim("_stories_left") != raw)
    how = F.when(raw.isNull(), None).when(negative, "negative_stories").when(n == 0, "unparseable_stories").when(summed, "summed_stories").when(n > 1, "multiple_story_values").when(F.exists("_stories_all", lambda x: x.contains(".")), "decimal_stories")
    value = F.when(~negative & (n > 0), F.array_max(F.transform("_stories_all", lambda x: F.ceil(x.cast("double")))).cast("int"))
    return rows.withColumns({"_stories_value": value, "_stories_how": how, "_stories_low": F.col("_stories_low") & ~negative}).drop("_stories_left", "_stories_all")


def stories_use(df: DataFrame) -> Use:
    return Use(Reading("stories", ("_stories_text",), ("_stories_value", "_stories_how", "_stories_low"), _stories_in_text), (first_filled(_at(df, "NumberOfStories"), _at(df, "NUMSTORIES")),))


def clean_stories(df: DataFrame, rules: Rules, target: str = "AIR") -> DataFrame:
    """Number of stories from free text; wood frames above the limit follow the rules."""
    out, code = ("NumberOfStories", "ConstructionCode") if target == "AIR" else ("NUMSTORIES", "BLDGCLASS")
    use = stories_use(df)
    how, value = F.col("_stories_how"), F.col("_stories_value")
    wood = F.coalesce(_at(df, "ConstructionCode"), _at(df, "BLDGCLASS")).isin(*WOOD_FRAME)
    rows = in_place(df, use).withColumns({"_raw": use.cells[0], "_over": F.coalesce((value > rules.max_stories_wood_frame) & wood, F.lit(False))})
    raw, bad = F.col("_raw"), how.isin("negative_stories", "unparseable_stories")
    rows = add_flags(
        rows, flag(how == "negative_stories", out, how, raw), flag(F.col("_stories_low"), out, "ignored_mezzanine_basement", raw), flag(how == "unparseable_stories", out, how, raw), flag(how.isNotNull() & ~bad, out, how, raw),
        flag(F.col("_over"), code if rules.stories_exceeded_action == "reset_construction" else out, "wood_frame_stories_exceeded", raw),
    )
    if rules.stories_exceeded_action == "reset_construction" and code in df.columns:
        rows = rows.withColumns({"Construction_Code_Original": F.when(F.col("_over"), F.col(code)), code: F.when(F.col("_over"), F.lit("100")).otherwise(F.col(code))})
    kept = F.when(~F.col("_over"), value) if rules.stories_exceeded_action == "reset_stories" else value
    return rows.withColumn(out, kept).drop("_raw", "_over", *use.results)


def _count_in_text(rows: DataFrame) -> DataFrame:
    """The candidates of all readings are computed, the first that applies wins."""
    word = F.regexp_extract("_count_s", r"^(\S+)", 1)
    rows = rows.withColumn("_count_s", F.lower("_count_text"))
    rows = rows.withColumn("_count_s", F.coalesce(F.concat(look_up(word, COUNT_WORDS).cast("string"), F.substr("_count_s", F.length(word) + 1)), F.col("_count_s")))
    rows = rows.withColumn("_count_flat", F.trim(F.regexp_replace("_count_s", r"[()]", " ")))
    part = lambda p: F.trim(F.regexp_replace(p, r"\b(buildings?|bldgs?|structures?)\b", ""))
    side = lambda p: part(p).rlike("|".join(SIDE_STRUCTURES))
    worth = lambda p: F.coalesce(_plain(F.nullif(F.regexp_extract(p, r"(\d[\d,]*)", 1), F.lit(""))), look_up(F.regexp_extract(F.trim(p), r"^(\S+)", 1), COUNT_WORDS).cast("bigint"), F.when(side(p), F.lit(1)).when(part(p) == "", F.lit(0)).cast("bigint"))
    pieces = F.transform(F.filter(F.split("_count_s", r"\+|&|\band\b"), lambda p: F.trim(p) != ""), worth)
    total = F.when(F.col("_count_s").rlike(r"\+|&|\band\b") & F.forall(pieces, lambda x: x.isNotNull()), F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, x: a + x))
    group = lambda c, pattern, n=1: _plain(F.nullif(F.regexp_extract(c, pattern, n), F.lit("")))
    pair = lambda pattern: F.greatest(group("_count_flat", pattern, 1), group("_count_flat", pattern, 2))
    readings = {
        "_count_units": (group("_count_s", r"\d[\d,]*\s+units?\s+in\s+(\d[\d,]*)\s+buildings?"), "units_vs_buildings"), "_count_each": (group("_count_s", r"(\d[\d,]*)\s+buildings?\s*\(\s*\d+\s+units?"), None),
        "_count_total": (F.nullif(total, F.lit(0).cast("bigint")), "additive_building_count"), "_count_incl": (group("_count_s", r"^(\d[\d,]*)\s*\(including\b"), None),
        "_count_range": (pair(r"(\d[\d,]*)\s*[-–to]+\s*(\d[\d,]*)"), "building_count_range"), "_count_slash": (pair(r"(\d[\d,]*)\s*/\s*(\d[\d,]*)"), "building_count_slash"),
        "_count_deci": (F.ceil(F.nullif(F.regexp_extract("_count_flat", r"(\d+\.\d+)", 1), F.lit("")).cast("double")), "decimal_building_count"),
    }
    rows = rows.withColumns({c: x for c, (x, _) in readings.items()} | {"_count_bare": F.transform(F.regexp_extract_all("_count_flat", F.lit(r"(\d[\d,]*)"), F.lit(1)), _plain)})
    raw = F.col("_count_text")
    negative, vague, single = raw.rlike(r"^-\s*\d"), raw.rlike(VAGUE_COUNT), raw.rlike(SINGLE_COUNT)
    how = F.when(raw.isNull(), None).when(negative, "negative_building_count").when(vague, "vague_building_count").when(single, None)
    value = F.when(raw.isNull() | negative | vague, None).when(single, 1)
    for column, (_, issue) in readings.items():
        how, value = how.when(F.col(column).isNotNull(), issue), value.when(F.col(column).isNotNull(), F.col(column))
    how = how.when(F.size("_count_bare") > 1, "multiple_integers_in_count").when(F.size("_count_bare") == 0, "unresolvable_building_count")
    return rows.withColumns({"_count_how": how, "_count_value": value.otherwise(F.array_max("_count_bare")).cast("int")}).drop("_count_s", "_count_flat", "_count_bare", *readings)


def count_use(df: DataFrame) -> Use:
    return Use(Reading("count", ("_count_text",), ("_count_value", "_count_how"), _count_in_text), (first_filled(_at(df, "RiskCount"), _at(df, "NUMBLDGS")),))


def clean_count(df: DataFrame, target: str = "AIR") -> DataFrame:
    """Number of buildings from free text."""
    out = "RiskCount" if target == "AIR" else "NUMBLDGS"
    use = count_use(df)
    rows = in_place(df, use)
    return add_flags(rows, flag(F.col("_count_how").isNotNull(), out, F.col("_count_how"), use.cells[0])).withColumn(out, F.col("_count_value")).drop(*use.results)


def _area_in_text(rows: DataFrame) -> DataFrame:
    value = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^\d.,]", ""), ",", "").try_cast("double")
    plain = lambda x: F.concat(F.lit(" "), x.cast("decimal(30,4)").cast("string"), F.lit(" "))
    rows = rows.withColumn("_area_s", F.lower("_area_text"))
    rows = rows.withColumn("_area_s", rewrite(F.col("_area_s"), r"\b\d[\d,\.]*\s*(?:k|mn|million|m)[bs]?\b", lambda g: plain(value(g) * F.when(g.contains("k"), 1000).otherwise(1_000_000))))
    sides = lambda g: F.split(g, r"\(each\)")
    rows = rows.withColumn("_area_s", rewrite(F.col("_area_s"), r"\d[\d,\.]*\s*\(each\)\s*\d[\d,\.]*", lambda g: plain(value(F.get(sides(g), F.lit(0))) * value(F.get(sides(g), F.lit(1))))))
    numbers = lambda c, pattern: F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), value), lambda x: x.isNotNull())
    parts = F.transform(F.split("_area_s", r"\+|&"), lambda p: F.coalesce(F.array_max(numbers(p, r"((?<!-)\b\d[\d,\.]*)")), F.lit(0.0)))
    total = F.when(F.col("_area_s").rlike(r"[+&]"), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))
    single = F.array_max(numbers(F.regexp_replace("_area_s", r"[-–/]", " "), r"(\d[\d,\.]*)"))
    raw = F.col("_area_text")
    foreign, negative, vague = raw.rlike(FOREIGN_AREA), raw.rlike(r"^-\s*\d+(\.\d+)?$"), raw.rlike(VAGUE_AREA)
    rows = rows.withColumn("_area_value", F.when(raw.isNotNull() & ~foreign & ~negative & ~vague, F.coalesce(F.when(total > 0, total), single)))
    how = F.when(raw.isNull(), None).when(foreign, "invalid_area_unit").when(negative, "negative_area").when(vague, "vague_area").when(F.col("_area_value").isNull(), "unparseable_area")
    return rows.withColumn("_area_how", how).drop("_area_s")


def area_use(df: DataFrame) -> Use:
    return Use(Reading("area", ("_area_text",), ("_area_value", "_area_how"), _area_in_text), (first_filled(_at(df, "GrossArea"), _at(df, "FLOORAREA")),))


def clean_area(df: DataFrame, rules: Rules, target: str = "AIR") -> DataFrame:
    """Floor area in square feet from free text."""
    out = "GrossArea" if target == "AIR" else "FLOORAREA"
    use = area_use(df)
    rows, how = in_place(df, use), F.col("_area_how")
    if rules.invalid_area_action == "flag_review":
        how = F.coalesce(how, F.when(F.col("_area_value") < rules.min_area_sqft, "area_below_minimum"))
    return add_flags(rows, flag(how.isNotNull(), out, how, use.cells[0])).withColumn(out, F.bround("_area_value", 2)).drop(*use.results)


def money(c: Column) -> tuple[Column, Column]:
    """Whole value and currency code of a money cell."""
    text = F.regexp_replace(c, r"[$€£¥₹,\s]", "")
    currency = reduce(lambda w, s: w.when(c.contains(s), CURRENCY_SIGNS[s]), list(CURRENCY_SIGNS)[1:], F.when(c.contains("$"), "USD"))
    short = F.regexp_extract(text, r"^([\d.]+)[KMBkmb]$", 1)
    factor = F.when(text.rlike("[kK]$"), 1e3).when(text.rlike("[mM]$"), 1e6).otherwise(1e9)
    value = F.when(F.lower(text).isin(*NO_VALUE), F.lit(0.0)).when(short != "", number(short) * factor).otherwise(number(text))
    return F.bround(value, 0).cast("bigint"), currency


def _money_in_text(rows: DataFrame) -> DataFrame:
    value, currency = money(F.col("_money_text"))
    return rows.withColumns({"_money_value": value, "_money_currency": currency})


MONEY_COLUMNS = ("BuildingValue", "ContentsValue", "TimeElementValue")


def money_uses(df: DataFrame, target: str = "AIR") -> list[Use]:
    """The cells of the three coverages share one dictionary."""
    reading = Reading("money", ("_money_text",), ("_money_value", "_money_currency"), _money_in_text)
    own = lambda i, source: source if target == "AIR" else f"EQCV{i}VAL"
    return [Use(reading, (first_filled(_at(df, own(i, source)), _at(df, source)),), str(i)) for i, source in enumerate(MONEY_COLUMNS, 1)]


def clean_values(df: DataFrame, rules: Rules, target: str = "AIR") -> DataFrame:
    """Money of the three coverages with caps; a currency sign fills the currency where it is blank."""
    caps = (rules.max_building_value, rules.max_contents_value, rules.max_bi_value)
    uses, rows, flags, values = money_uses(df, target), df, [], {}
    for i, (use, source, cap) in enumerate(zip(uses, MONEY_COLUMNS, caps, strict=True), 1):
        out = source if target == "AIR" else f"EQCV{i}VAL"
        rows, value = in_place(rows, use), F.col(f"_money_value{i}")
        flags += [flag(value.isNull(), out, "unparseable_value", use.cells[0]), flag(value < 0, out, "negative_value", value)]
        if rules.invalid_value_action != "none":
            flags.append(flag(value > cap, out, "value_exceeds_max", value))
        values[out] = F.when(~(value > cap), value) if rules.invalid_value_action == "reset_value" else value
        if target != "AIR":
            values[f"EQCV{i}LCUR"] = F.coalesce(blank_to_null(_at(df, f"EQCV{i}LCUR")), F.col(f"_money_currency{i}"))
    if target == "AIR":
        values["Currency"] = F.coalesce(blank_to_null(_at(df, "Currency")), *[F.col(f"_money_currency{i}") for i in (1, 2, 3)])
    return add_flags(rows, *flags).withColumns(values).drop(*[c for use in uses for c in use.results])


def cell_uses(df: DataFrame, rules: Rules, target: str = "AIR") -> list[Use]:
    """All readings of the jobs whose texts are worth a dictionary."""
    return [years_use(df, rules), stories_use(df), count_use(df), area_use(df), *money_uses(df, target)]


def clean_currency(df: DataFrame, currencies: tuple[str, ...] = CURRENCIES) -> DataFrame:
    """Currency of a row: the only one of the valid currencies found in its currency columns; several are a conflict."""
    columns = [c for c in CURRENCY_COLUMNS if c in df.columns]
    text = {c: F.upper(blank_to_null(F.col(c))) for c in columns}
    code = {c: F.coalesce(F.when(F.right(t, F.lit(3)).isin(*currencies), F.right(t, F.lit(3))), F.when(t.isin(*currencies), t)) for c, t in text.items()}
    rows = df.withColumn("_found", F.array_sort(F.array_distinct(F.filter(F.array(*code.values()), lambda x: x.isNotNull()))))
    rows = add_flags(
        rows, *[flag(text[c].isNotNull() & code[c].isNull(), c, "unrecognized_currency", F.col(c)) for c in columns],
        flag(F.size("_found") > 1, "Currency", "currency_conflict", F.array_join("_found", ",")),
    )
    one = F.when(F.size("_found") == 1, F.get("_found", F.lit(0)))
    kept = {c: F.when(text[c].isNull() | code[c].isNotNull(), F.col(c)) for c in columns}
    resolved = {c: F.coalesce(one, kept.get(c, F.lit(None).cast("string"))) for c in ("Currency", "EQCV1LCUR", "EQCV2LCUR", "EQCV3LCUR")}
    return rows.withColumns(kept | resolved | {"Currency_Conflicts": F.size("_found") > 1}).drop("_found")


def clean_sprinkler(df: DataFrame, target: str = "AIR") -> DataFrame:
    """Sprinklers: 1, 0 or unknown."""
    out = "SprinklerSystem" if target == "AIR" else "SPRINKLER"
    raw = F.coalesce(_at(df, "SprinklerSystem"), _at(df, "SPRINKLER"))
    text = F.lower(F.trim(raw))
    value = F.when(text.isin(*SPRINKLED), 1).when(text.isin(*UNSPRINKLED), 0)
    rows = df.withColumn("_raw", raw).withColumn(out, value)
    return add_flags(rows, flag(F.col("_raw").isNotNull() & F.col(out).isNull(), out, "unrecognized_sprinkler", F.col("_raw"))).drop("_raw")


def clean_location_name(df: DataFrame, target: str = "AIR", longest: int = 40) -> DataFrame:
    """Location name, else the policy's or the insured's, in allowed characters."""
    out, policy = ("LocationName", "PolicyID") if target == "AIR" else ("LOCNAME", "ACCNTNUM")
    own = first_filled(_at(df, "LocationName"), _at(df, "LOCNAME"))
    other = first_filled(_at(df, policy), _at(df, "AccountName"), _at(df, "SubmissionName"), _at(df, "InsuredName"))
    rows = df.withColumns({"_own": own, "_other": other})
    rows = rows.withColumn("_name", F.trim(F.regexp_replace(F.coalesce("_own", "_other"), r"[^A-Za-z0-9 .,&'\-()/]", "")))
    rows = add_flags(
        rows, flag(F.col("_own").isNull() & F.col("_other").isNotNull(), out, "location_name_fallback", F.col("_other")),
        flag(F.col("_own").isNull() & F.col("_other").isNull(), out, "missing_location_name", F.lit(None)),
        flag(F.length("_name") > longest, out, "location_name_truncated", F.coalesce("_own", "_other")),
    )
    return rows.withColumn(out, F.trim(F.substring("_name", 1, longest))).drop("_own", "_other", "_name")


def fill_blank(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Defaults for blank cells."""
    return df.withColumns({c: F.coalesce(blank_to_null(_at(df, c)), F.lit(v)) for c, v in values.items()})
