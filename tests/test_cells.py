"""What cells say, read once per distinct text, against reading every row; and golden results of odd shapes."""

import random

import pytest

from sovara.operators import address, cells, cleaning, normalize
from sovara.rules import Rules

YEARS = ["1985", "1990/2012", "Built 1975, roof replaced 2008", "198X", "85", "unknown", "", "  ", "c.1901", "2030", "1699", "renovated 2001", "built 1950 reno 1999", "1990-1995", "80/90", "24", "25", "26", "YOB 1988", "1988 (upgraded 2010)", "1920s", "200X", "1800", "2026", "12/31/1999", "1999 2000 2001", "n/a", "1985.0", "'85", "built in 85, hvac 99"]
STORIES = ["two", "3 + 2", "G+4", "2.5", "3-5", "2 plus basement", "-2", "", "tall", "1 & 2", "ground + 3", "3 + 2 + 1", "5 buildings - various", "1 story + mezzanine", "2 to 4", "2,3", "(3)", "1/2", "10.0", "seven stories", "2 Basement", "g+1+2", "3 bldgs 2", "single", "-3.5", "0", "1.2.3", "two-three", "one story", "12 + 1.5"]
COUNTS = ["8 units in 3 buildings", "2 buildings + clubhouse", "Eight Buildings", "Single Building", "3-5", "2.5", "various", "-4", "7 (including shed)", "3/4", "", "n/a", "1,200", "12 buildings (24 units each)", "two and a garage", "a", "An annex", "twenty-one", "3 & 4", "2 to 5", "several", "10", "1 + 1 + 1", "office + shed", "one building", "5 structures", "3 bldgs", "x", "2 and 3 and pool house", "4 units in 1,000 buildings"]
AREAS = ["10,000 sq ft", "2.5k", "1,200 + 800", "50", "5 acres", "included", "-7", "abc", "2m", "", "100 (each) 3", "3 x 4", "1.5 million", "2 mn", "10-20", "1,000/2,000", "2 ha", "5000 SF", "5,000.75", "1k + 2k", "tbd", "100 & 200", "12 m2", "3kb", "-5 + 10", "1.2.3", "7 sqm", "99", "100", "1e3"]
MONEY = ["$1.5M", "1,234.50", "n/a", "-5000", "abc", "€100", "1d", "", "2500000000", "£2K", "¥3B", "₹ 1,000", "$-5", "(5)", "1.5", "0.5", "1e6", "none", "-", "nan", "$", "5 000", "12K5", "k", "1.5m USD", "$1,000,000.49", "2.5", "3.5", ".5", "+7"]
STREETS = ["123 N Main St.", "P.O. Box 1234", "12-14 Oak Ave Suite 200", "5 Elm Rd Rd", "Attn: Warehouse 77 e 5th ave", "c/o Bob 12 n st", "100 Main St, Bldg 5", "S Main", "12-14A Oak", "po box 9", "P O Box 77", "dept 5 main st", "1/2 elm blvd #5", "10 ne 5th ter", "Near the mill 5 Oak", "unit 5, 20 Oak pl", "20 Oak pl,", "  7   hwy   st ", "", "N", "st st st", "1 Oak St & 2 Elm", "care of X 9 un rd", "Rm. 5 Fl: 2 55 Park", "55 W. 5th St", "Block B 2 mt rd", "77 ind park rd", "Industrial Park 5 rd", "9-10/2 Elm St", "street"]
CITIES = ["Ft Worth, TX 76102", "77002", "AUSTIN - Downtown", "houston (TX)", "new york city city", "são paulo", "O'brien", "St. Louis MO", "Mt Vernon, IL", "Paris TX 75460-1234", "Dallas 75001", "NY", "TX 77002", "winston-salem", "Spring Valley - x", "(note)", "a,b", "Orange County", "lk city", "Pk. ridge, IL 60068", "Ft", "", "Ciudad Juárez", "Boston MA - North", "Worth,TX", "town, tx", "Saint-Denis", "X - ", "city 12345 TX", "A (b) c (d)"]
STATES = ["Texas", "t x", "ZZ", "Dallas, TX", "nowhere land", "", "TX", "tx", "T.X.", "Calif.", "new york", "N.Y.", "Washington DC", "X", "Texas 77002", "(TX)", "Mass", "penn", "Ontario", "O'Neil, ca", "TX USA", "12", "MN-", "puerto rico", "west virginia", "w va", "Fla", "NY, NY", "Guam", "ab cd"]
POSTALS = ["10001", "1234", "770021234", "77A02", "TX 10001", "", "77002-1234", "1", "123456", "SW1A 1AA", "75001 ", "00000", "12 345", "1234567890", "A1B 2C3", "77002.0", "ABC", "-", "12345 67890", "#77002", "1-2-3", "99999-", "1 2 3 4 5", "123", "ÄÖ 12345", "77O02", "0", "12", "12345-", "  9  "]
COUNTRIES = ["USA", "us", "United States", "Germany", "", "uk", "u.k.", "ZZZ", "Deutschland", "Hong Kong", "x", "fr", "FRA", "Austria", "Côte d'Ivoire", "U.S.A.", "the netherlands", "12", "Atlantis", "korea", "CHE", "XX", "united  states", "Ind", "ire", "C", "GB ", "can", "mex ", "Viet Nam"]
LATS = ["29.1234", "95.25", "0", "n.a.", "", "41.5", '45°31\'07.2"N', "122-40-30 W", "48,2082", "-91", "91.5", "S 33 51 0", "1", "-0.5", "100"]
LONS = ["95.1234", "-29.75", "0", "10.5", "", "200", '122°40\'30"W', "16,3738", "-181", "E 151 12 36", "77", "x", "-95.5", "180", "0.001"]


def mixed(spark, n=900):
    """Rows whose cells are drawn from all shapes; a third of them are one row."""
    rng = random.Random(11)
    columns = {
        "YearBuilt": YEARS, "YearRetrofitted": YEARS, "NumberOfStories": STORIES, "RiskCount": COUNTS, "GrossArea": AREAS, "BuildingValue": MONEY, "ContentsValue": MONEY, "TimeElementValue": MONEY, "ConstructionCode": ["101", "131", ""],
        "Street": STREETS, "City": CITIES, "State": STATES, "PostalCode": POSTALS, "CountryISO": COUNTRIES, "Latitude": LATS, "Longitude": LONS, "Currency": ["USD", "xx", "100 EUR", ""], "SprinklerSystem": ["yes", "no", "maybe"], "PolicyID": ["P1", ""],
    }
    rows = [(i, *(rng.choice([*values, None]) for values in columns.values())) for i in range(n)]
    rows += [(n + i, *rows[7][1:]) for i in range(n // 2)]
    return spark.createDataFrame(rows, "row_index bigint, " + ", ".join(f"{c} string" for c in columns)).repartition(3)


def plain(df):
    """Rows by row_index, flags in any order."""
    return {r["row_index"]: {c: sorted(map(str, v)) if c == "flags" else v for c, v in r.asDict().items()} for r in df.collect()}


SETTINGS = [{"REPEATS": 1.0}, {"REPEATS": 1.0, "BROADCAST_BYTES": 0}, {"REPEATS": 1.0, "BROADCAST_ROWS": 0, "HOT": 10}]


@pytest.fixture(scope="module")
def rows(spark):
    return mixed(spark).cache()


@pytest.mark.parametrize("target", ["AIR", "RMS"])
def test_distinct_cells_equal_every_row(spark, rows, monkeypatch, target):
    rules = Rules(stories_exceeded_action="reset_construction", max_building_value=1000, invalid_value_action="reset_value", invalid_year_action="set_default")
    wanted = plain(normalize.clean_rows(rows, rules, target))
    for settings in SETTINGS:
        for name, value in settings.items():
            monkeypatch.setattr(cells, name, value)
        found = cells.by_distinct(rows, cleaning.cell_uses(rows, rules, target))
        assert plain(normalize.clean_rows(found, rules, target)) == wanted
        monkeypatch.undo()


def test_distinct_addresses_equal_every_row(spark, rows, monkeypatch):
    monkeypatch.setattr(cells, "REPEATS", 0.0)
    wanted = plain(address.clean_address(rows))
    for settings in SETTINGS:
        monkeypatch.undo()
        for name, value in settings.items():
            monkeypatch.setattr(cells, name, value)
        assert plain(address.clean_address(rows)) == wanted


def test_dictionary_counts_every_text_once(spark, rows):
    entries = cells.dictionary(rows, cleaning.money_uses(rows)).collect()
    texts = [(r[c] or "").strip() or None for r in rows.collect() for c in cleaning.MONEY_COLUMNS]
    assert {r["key"][0]: r["cells"] for r in entries} == {t: texts.count(t) for t in set(texts)} and len(entries) == len(set(texts))


def test_plans_of_the_widest_passes_are_short(spark, small):
    from sovara.plans import queries

    for name in ("normalize_rows", "clean_address"):
        assert len(queries.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_empty_table(spark, rows):
    assert normalize.normalize_all(rows.filter("false")).count() == address.clean_address(rows.filter("false")).count() == 0


@pytest.mark.parametrize("action,wanted", [("flag_review", (None, None, 1)), ("reset_year", (None, None, 1)), ("none", (None, None, 0)), ("set_default", (1975, 9999, 1))])
def test_invalid_years_by_the_rules(spark, action, wanted):
    df = spark.createDataFrame([(1, "unknown"), (2, "198X"), (3, "1990"), (4, "")], "row_index bigint, YearBuilt string")
    out = {r["row_index"]: (r["YearBuilt"], r["YearRetrofitted"], len(r["flags"])) for r in cleaning.clean_years(df, Rules(invalid_year_action=action, year_default=1975)).collect()}
    assert out == {1: wanted, 2: wanted, 3: (1990, 9999, 0), 4: (None, None, 0)}


def test_streets_and_cities(spark):
    streets = {
        "12-14A Oak": "12-14A Oak", "9-10/2 Elm St": "9/2 Elm Street", "c/o Bob 12 n st": "12 North Street", "Attn: Warehouse 77 e 5th ave": "77 East 5th Avenue", "100 Main St, Bldg 5": "100 Main Street", "S Main": "S Main", "Suite 5": None,
        "po box 9": "9 PO Box", "55 W. 5th St": "55 West 5th Street", "5 Elm Rd Rd": "5 Elm Road", "1 Oak St & 2 Elm": "1 Oak Street 2 Elm", "ave": "Avenue", "": None,
    }
    cities = {
        "Ft Worth, TX 76102": "Fort Worth", "Paris TX 75460-1234": "Paris", "Dallas 75001": "Dallas", "NY": "Ny", "Worth,TX": "Worth", "winston-salem": "Winston", "AUSTIN - Downtown": "Austin", "houston (TX)": "Houston", "city 12345 TX": "City",
        "Boston MA - North": "Boston Ma", "St. Louis MO": "Saint Louis", "77002": None, "(note)": None, "new york city city": "New York City", "O'brien": "O'Brien", "são paulo": "São Paulo",
    }
    for column, result, wanted in (("Street", "_street", streets), ("City", "_city", cities)):
        df = spark.createDataFrame([(t, t) for t in wanted], f"t string, {column} string")
        use = address.address_uses(df, {k: k for k in address.ADDRESS_PARTS})[column]
        assert {r["t"]: r[result] for r in cells.in_place(df, use).collect()} == wanted
