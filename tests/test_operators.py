"""Golden rows of the cleaning, address, code and mapping operators, and files, dictionaries and streams."""

import json

import pytest
from pyspark.sql import functions as F

from sovara.flags import flags_table
from sovara.functions.text import expand_words, lenient_number, title_case, token_sort_ratio
from sovara.operators import address, cleaning, codes, dictionary, identity, layout, mapping, portfolio, review
from sovara.operators.cells import in_place
from sovara.rules import PRESETS, Rules
from sovara.sources import dictionaries, files, stages

RULES = Rules()


def table(spark, columns, rows):
    schema = "row_index bigint, " + ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def run(job, spark, column, values):
    out = job(table(spark, [column], [(v,) for v in values])).orderBy("row_index").collect()
    return [(r[column], "|".join(f["issue"] for f in r["flags"])) for r in out]


def test_years(spark):
    df = table(spark, ["YearBuilt", "YearRetrofitted"], [("1985", None), ("1990/2012", ""), ("Built 1975, roof replaced 2008", ""), ("198X", ""), ("85", ""), ("", "2005"), ("unknown", ""), ("", "")])
    out = cleaning.clean_years(df, RULES).orderBy("row_index").collect()
    assert [(r["YearBuilt"], r["YearRetrofitted"]) for r in out] == [(1985, 9999), (1990, 2012), (1975, 9999), (None, None), (1985, 9999), (None, None), (None, None), (None, None)]
    assert [[f["issue"] for f in r["flags"]] for r in out] == [[], [], [], ["invalid_alpha_year"], [], [], ["unparseable_year"], []]


def test_stories(spark):
    values = ["two", "3 + 2", "G+4", "2.5", "3-5", "2 plus basement", "-2", "", "tall"]
    assert run(lambda d: cleaning.clean_stories(d, RULES), spark, "NumberOfStories", values) == [
        (2, ""), (5, "summed_stories"), (5, "summed_stories"), (3, "decimal_stories"), (5, "multiple_story_values"), (2, "ignored_mezzanine_basement"), (None, "negative_stories"), (None, ""), (None, "unparseable_stories"),
    ]


@pytest.mark.parametrize("action,code,stories", [("reset_construction", "100", 7), ("reset_stories", "101", None), ("flag_review", "101", 7)])
def test_wood_frame_limit(spark, action, code, stories):
    df = table(spark, ["NumberOfStories", "ConstructionCode"], [("7", "101")])
    row = cleaning.clean_stories(df, Rules(stories_exceeded_action=action)).first()
    assert (row["ConstructionCode"], row["NumberOfStories"], row["flags"][0]["issue"]) == (code, stories, "wood_frame_stories_exceeded")


def test_counts(spark):
    values = ["8 units in 3 buildings", "2 buildings + clubhouse", "Eight Buildings", "Single Building", "3-5", "2.5", "various", "-4", "7 (including shed)", "3/4", ""]
    assert run(cleaning.clean_count, spark, "RiskCount", values) == [
        (3, "units_vs_buildings"), (3, "additive_building_count"), (8, ""), (1, ""), (5, "building_count_range"), (3, "decimal_building_count"), (None, "vague_building_count"), (None, "negative_building_count"), (7, ""), (4, "building_count_slash"), (None, ""),
    ]


def test_areas(spark):
    values = ["10,000 sq ft", "2.5k", "1,200 + 800", "50", "5 acres", "included", "-7", "abc", "2m"]
    assert run(lambda d: cleaning.clean_area(d, RULES), spark, "GrossArea", values) == [
        (10000, ""), (2500, ""), (2000, ""), (50, "area_below_minimum"), (None, "invalid_area_unit"), (None, "vague_area"), (None, "negative_area"), (None, "unparseable_area"), (2_000_000, ""),
    ]


def test_money(spark):
    rows = ["$1.5M", "1,234.50", "n/a", "-5000", "abc", "€100", "1d", "", "2500000000"]
    out = cleaning.clean_values(table(spark, ["BuildingValue", "ContentsValue", "TimeElementValue"], [(v, "1", "1") for v in rows]), RULES).orderBy("row_index").collect()
    assert [r["BuildingValue"] for r in out] == [1500000, 1234, 0, -5000, None, 100, None, None, 2500000000]
    assert [r["Currency"] for r in out] == ["USD", None, None, None, None, "EUR", None, None, None]
    assert [[f["issue"] for f in r["flags"]] for r in out] == [[], [], [], ["negative_value"], ["unparseable_value"], [], ["unparseable_value"], ["unparseable_value"], ["value_exceeds_max"]]
    assert cleaning.clean_values(table(spark, ["BuildingValue"], [("2500000000",)]), PRESETS["strict"]).first()["BuildingValue"] is None


def test_names(spark):
    df = table(spark, ["LocationName", "PolicyID"], [(" A*B  ", "P"), (None, "P1"), ("", ""), ("x" * 50, "P")])
    out = cleaning.clean_location_name(df).orderBy("row_index").collect()
    assert [r["LocationName"] for r in out] == ["AB", "P1", None, "x" * 40]
    assert [[f["issue"] for f in r["flags"]] for r in out] == [[], ["location_name_fallback"], ["missing_location_name"], ["location_name_truncated"]]


def test_identity(spark):
    df = table(spark, ["PolicyID"], [("",), ("B",), ("A",), ("B",), (None,)])
    assert [r["LocationID"] for r in identity.serial_numbers(df).orderBy("row_index").collect()] == [1, 1, 1, 2, 2]
    assert {r["PolicyID"] for r in identity.uniform_policy(df).collect()} == {"B"}
    empty = identity.uniform_policy(table(spark, ["PolicyID"], [("",), (None,)]))
    assert [f["issue"] for f in flags_table(empty).collect()] == ["missing_policy_id"] * 2


def test_address(spark):
    df = table(spark, ["Street", "City", "State", "PostalCode", "CountryISO"], [
        ("123 N Main St.", "Ft Worth, TX 76102", "Texas", "1234", "USA"), ("P.O. Box 1234", "77002", "T X", "770021234", "Germany"), ("12-14 Oak Ave Suite 200", "são paulo", "ZZ", "77A02", "u.k."),
        ("", "", "", "", "uk"), (None, None, None, None, None), ("5 Elm Rd Rd", "O'brien", "Dallas, TX", "Dallas, TX 77002", "ZZZ"),
    ])
    out = address.clean_address(df).orderBy("row_index").collect()
    assert [r["Street"] for r in out] == ["123 North Main Street", "1234 PO Box", "12 Oak Avenue", None, None, "5 Elm Road"]
    assert [r["City"] for r in out] == ["Fort Worth", None, "São Paulo", None, None, "O'Brien"]
    assert [r["State"] for r in out] == ["TX", "T X", "ZZ", None, None, "Dallas, TX"]
    assert [r["PostalCode"] for r in out] == ["01234", "770021234", "77A02", None, None, "Dallas TX 77002"]
    assert [r["CountryISO"] for r in out] == ["US", "DE", "GB", "GB", None, "ZZZ"]
    us = df.select("row_index", address.state(F.col("State"), F.lit("US")).alias("s"), address.postal(F.col("PostalCode"), F.lit("US")).alias("p")).orderBy("row_index").collect()
    assert [r["s"] for r in us] == ["TX", "TX", None, None, None, "TX"]
    assert [r["p"] for r in us] == ["01234", "77002", None, None, None, "77002"]
    again = address.clean_address(address.clean_address(df).drop("flags")).orderBy("row_index").collect()
    assert [r[:6] for r in again] == [r[:6] for r in out]


def test_coordinates(spark):
    df = table(spark, ["Latitude", "Longitude", "CountryISO"], [("95.1", "29.7", "US"), ("0", "0", "US"), ("45°31'07.2\"N", "122-40-30 W", "US"), ("x", "1", ""), ("1.5", "", ""), ("", None, ""), ("100", "200", ""), ("48,2082", "16,3738", "AT")])
    out = address.clean_coordinates(df).orderBy("row_index").collect()
    assert [(r["Latitude"], r["Longitude"]) for r in out] == [(29.7, -95.1), (None, None), (45.5186667, -122.675), (None, None), (None, None), (None, None), (None, None), (48.2082, 16.3738)]
    assert [f["issue"] for f in out[0]["flags"]] == ["coordinates_reversed", "positive_longitude_in_us", "low_precision_coordinates"]


def test_raw_address_columns(spark):
    df = table(spark, ["`Loc Street`", "Town", "Zip"], [("1 oak st", "austin", "77002")])
    row = address.clean_raw_address(df).first()
    assert row["CombinedAddress"] == "1 oak Street, Austin, 77002"
    assert address.address_columns(["Zip", "Loc Street", "Town"]) == {"Street": "Loc Street", "City": "Town", "PostalCode": "Zip"}
    rest = spark.range(1).select(address.street_rest(F.lit("1 Oak St, Austin, 77002, US"), F.lit("Austin"), F.lit("77002"), F.lit("US"))).first()[0]
    assert rest == "1 Oak St"


@pytest.mark.parametrize("text,code", [
    ("Steel frame with masonry infill walls", "151"), ("CMU walls with wood roof joists", "119"), ("Tilt-up concrete walls with steel roof deck", "111"), ("Concrete podium with wood upper floors", "141"),
    ("Heavy timber with masonry walls", "104"), ("Brick exterior, unknown frame", "119"), ("wood frame", None),
    ("timber frame with brick veneer", "100"), ("clt and masonry walls", "104"), ("HT with masonry walls", "104"), ("concrete frame over concrete foundation", "131"), ("steel frame with masonry front", "151"),
    ("light wood frame with stone veneer", "101"), ("height of masonry walls and more", None), ("church with wood floors", "141"), ("pre-engineered metal building with canopy", "152"), ("concrete parking and steel office", "100"),
    ("interior wood office in metal warehouse and shed", "152"), ("wood office beside metal warehouse and shed", "152"), ("masonry walls with wood mezzanine", None), ("cmu and wood level", "141"), ("structure unknown", "119"), ("curm and steel", None),
])
def test_conflict_rules(spark, text, code):
    row = spark.range(1).select(codes.conflict(F.lit(text)).alias("c")).first()["c"]
    assert (row and row["code"]) == code


@pytest.mark.parametrize("tokens,beside,code", [(codes.URM, "steel and ", "119"), (codes.MASONRY_WALLS, "wood roof and ", "119"), (codes.COMBUSTIBLE[:-1], "block walls and ", "119"), (codes.TILT_UP, "steel deck and ", "111"), (codes.HEAVY_TIMBER, "brick walls and ", "104"), (codes.FACADE, "steel frame and ", "151"), (codes.UNKNOWN_FRAME, "brick and ", "119")])
def test_every_token_of_the_conflict_rules(spark, tokens, beside, code):
    rows = spark.createDataFrame([(beside + t,) for t in tokens], "t string").select("t", codes.conflict(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] and r["c"]["code"] for r in rows} == {beside + t: code for t in tokens}


def test_conflicts_are_routed(spark):
    pairs = spark.createDataFrame([("", "Steel frame w/ URM and RC"), ("", "lwf with canopy"), ("", "unknown frame")], "scheme string, value string")
    fire = spark.createDataFrame([("2", "F2"), ("1", "F1")], "key string, code string")
    got = {r["value"]: (r["code"], r["scheme_override"]) for r in codes.by_conflict(pairs, None, codes.ABBREVIATIONS, fire).collect()}
    assert got == {"Steel frame w/ URM and RC": ("F2", "ISF"), "lwf with canopy": ("101", None), "unknown frame": ("F2", "ISF")}
    assert codes.by_conflict(pairs, target="RMS").count() == 0
    low = codes.conflict_hints(pairs, RULES, None, codes.ABBREVIATIONS).collect()
    assert [(r["value"], r["hint_code"], r["expanded"]) for r in low] == [("unknown frame", "119", False)]
    assert codes.conflict_hints(pairs, RULES, None, codes.ABBREVIATIONS, "RMS").count() == 3
    for field, target, code in (("occupancy", "AIR", "311"), ("construction", "AIR", "100"), ("occupancy", "RMS", "Com1"), ("construction", "RMS", "W1")):
        assert codes.cascade(pairs, [codes.by_conflict(pairs.limit(0))], rules=RULES, field=field, target=target).first()["code"] == code


def test_abbreviations_in_one_walk(spark):
    texts = ["RC/rcc N/A n/ab", "tilt tilt-up", "src_rc rc-src", "", None, "sf sqft SQFT", "Été rc"]
    wanted = ["reinforced concrete/reinforced concrete construction not available n/ab", "tilt-up concrete tilt-up concrete-up", "src_rc reinforced concrete-steel reinforced concrete", "", None, "single family square feet square feet", "Été reinforced concrete"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expand_words(F.col("t"), codes.ABBREVIATIONS).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == wanted


def test_modifiers(spark):
    texts = spark.createDataFrame([("3",), ("Clay Tiles",), ("slate and wood shingles",), ("99",), ("",), (None,)], "text string")
    aliases = spark.createDataFrame([("r", "clay tiles", 6)], "section string, alias string, code int")
    tokens = spark.createDataFrame([("r", "slate", 1, 1), ("r", "wood shingles", 7, 2)], "section string, token string, code int, ordinal int")
    out = {r["text"]: (r["code"], r["method"]) for r in codes.modifier_codes(texts, "r", 9, aliases, tokens).collect()}
    assert out == {"3": (3, "integer"), "Clay Tiles": (6, "alias"), "slate and wood shingles": (7, "token"), "99": (0, "default"), "": (0, "empty"), None: (0, "empty")}


def test_keyword_scores_meet_inside_words(spark):
    table_ = spark.createDataFrame([("A", "brickwork", ["brick"], 1), ("B", "", ["steel frame"], 2)], "code string, description string, keywords array<string>, ordinal int")
    texts = spark.createDataFrame([("old brickwork",), ("frame",)], "text string")
    out = {(r["text"], r["code"]): r["score"] for r in codes.keyword_scores(texts, table_).collect()}
    assert out == {("old brickwork", "A"): 1.0, ("frame", "B"): 0.5}


def test_context_and_raw_lookup(spark):
    pairs = spark.createDataFrame([("", "store", "cold storage yard"), ("", "store", "mall"), ("", "Shop (big)", ""), ("", "x/Shop", "")], "scheme string, value string, note string")
    rules = spark.createDataFrame([("store", 1, ["cold"], "C"), ("store", 9, None, "D")], "term string, ordinal int, signals array<string>, code string")
    first = codes.by_context(pairs.limit(1), rules, F.col("note")).collect()
    assert [r["code"] for r in first] == ["C"]
    lookup = spark.createDataFrame([("shop", "S", 0.9)], "text string, code string, confidence double")
    assert sorted(r["value"] for r in codes.by_text(pairs, lookup).collect()) == ["Shop (big)", "x/Shop"]


def test_text_functions(spark):
    df = spark.createDataFrame([("kitten sitting", "sitting kitten"), ("kitten", "sitting"), ("", ""), ("a", "")], "a string, b string")
    assert [round(r[0], 2) for r in df.select(token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [100.0, round(200 * 4 / 13, 2), 100.0, 0.0]
    assert spark.range(1).select(title_case(F.lit("o'brien st-luc élan"))).first()[0] == "O'Brien St-Luc Élan"
    assert [r[0] for r in spark.createDataFrame([("$1,000",), ("x",), ("1d",), (None,)], "c string").select(lenient_number(F.col("c"))).collect()] == [1000.0, 0.0, 0.0, 0.0]


def test_mapping(spark):
    df = table(spark, ["a", "b", "X"], [("1", "2", None), ("3", "4", "5")])
    out = mapping.apply_column_map(df, {"a": "X", "b": "X"}).orderBy("row_index").collect()
    assert [(r["X"], r["b"]) for r in out] == [("1", "2"), ("5", "4")]
    headers = spark.createDataFrame([("Yr_Built",)], "source_col string")
    memory = mapping.upsert_memory(None, spark.createDataFrame([("yr built", "AIR", "A", 1), ("YR-BUILT", "AIR", "B", 2)], "source_col string, target_format string, canonical string, at int"))
    row = mapping.remembered(headers, memory, "AIR").first()
    assert (row["canonical"], row["score"], memory.first()["confirmed_count"]) == ("B", 1.0, 2)
    assert mapping.forget(memory, F.lit("yr built"), "AIR").count() == 0
    aliases = spark.createDataFrame([("year built", "YB"), ("built year", "YB"), ("city", "C")], "alias string, canonical string")
    assert [r["canonical"] for r in mapping.fuzzy_matches(spark.createDataFrame([("year blt",)], "source_col string"), aliases).collect()] == ["YB"]


def test_layout(spark):
    df = table(spark, ["PolicyID", "InsuredName"], [("A", "n1"), ("A", "n2"), ("", "n3")])
    assert layout.fixed_layout(df, "AIR").columns == layout.AIR_COLUMNS and len(layout.RMS_COLUMNS) == 61
    accounts = layout.account_rows(df, "AIR")
    assert accounts.count() == 6 and {r["InsuredName"] for r in accounts.collect()} == {"n1"}
    assert {r["ContractID"] for r in layout.account_rows(df.filter("false"), "AIR").collect()} == {"CONT_1"}


def test_corrections(spark):
    rows = cleaning.clean_years(table(spark, ["YearBuilt", "YearRetrofitted"], [("198X", ""), ("1990", "")]), RULES)
    fixes = spark.createDataFrame([(0, "YearBuilt", "1985")], "row_index bigint, field string, new_value string")
    out = review.apply_corrections(rows, fixes, ["YearBuilt"]).orderBy("row_index").collect()
    assert [(r["YearBuilt"], len(r["flags"])) for r in out] == [(1985, 0), (1990, 0)]


def test_dictionary(spark, tmp_path):
    (tmp_path / "codes.json").write_text(json.dumps({"frame": {"101": {"description": "wood", "keywords": ["wood", "timber"]}}, "other": {"101": {"description": "x", "keywords": []}}}))
    loaded = dictionaries.read_codes(spark, str(tmp_path / "codes.json"), ["frame"])
    assert dictionary.first_category(loaded).first()["description"] == "wood"
    entries = spark.createDataFrame([("1", 1, "old", ["a", "b"]), ("1", 2, "", ["b", "c"]), ("_x", 1, "n", ["q"])], "code string, version int, description string, keywords array<string>")
    row = dictionary.overlay(entries).first()
    assert (row["code"], row["description"], row["keywords"]) == ("1", "old", ["a", "b", "c"])
    upload = spark.createDataFrame([("1", "d", "a; b,c"), ("2", "e", None), (None, "x", ""), ("", "", "")], "Code string, Description string, Keywords string")
    errors, known, clean = dictionary.split_upload(upload, entries)
    assert (errors.count(), known.count(), clean.count()) == (1, 1, 1)
    changed = dictionary.upsert(dictionary.overlay(entries), spark.createDataFrame([("9", "new", ["z"])], "code string, description string, keywords array<string>"))
    assert dictionary.delete(changed, changed.filter("code = '1'")).first()["code"] == "9"


def test_files(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("Name,Name, City \n a ,,M\xfcnchen\n\"x,1\",b,\n".encode("latin-1"))
    df = files.read_table(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["row_index", "Name", "Name_2", "City"]
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [(0, "a", None, "München"), (1, "x,1", "b", None)]
    files.write_locations(df.withColumn("PolicyID", F.lit("P")), str(tmp_path / "out"), "AIR")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).columns == layout.AIR_COLUMNS


@pytest.mark.parametrize("data,columns,rows", [
    (b"\xef\xbb\xbfA,B\r\n1,2\r\n\r\n  \n3,\"x, \"\"y\"\"\"\n", ["A", "B"], [("1", "2"), ("3", 'x, "y"')]), (b"A,,A\n1\n1,2,3,4\n", ["A", "column_2", "A_2"], [("1", None, None), ("1", "2", "3")]),
    ("N\ncaf\xe9\n".encode("latin-1"), ["N"], [("caf\xe9",)]), ("N\ncaf\xe9 \u65e5\n".encode(), ["N"], [("caf\xe9 \u65e5",)]), (b"A,B\n", ["A", "B"], []), (b"", [], []),
])
def test_scans_of_odd_files(spark, tmp_path, data, columns, rows):
    (tmp_path / "in.csv").write_bytes(data)
    df = files.read_table(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["row_index", *columns] and [tuple(r)[1:] for r in df.orderBy("row_index").collect()] == rows


def test_scan_of_many_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("N\n" + "".join(f"{i:06d}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = [(r["row_index"], int(r["N"])) for r in files.read_table(spark, str(tmp_path / "a.csv")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == [(i, i) for i in range(4000)]


def test_quoted_breaks(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("A,B\n\"x\ny\",\xe9\n".encode("latin-1"))
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "in.csv"), multiline=True).collect()] == [(0, "x\ny", "é")]


def test_registries_of_any_depth(spark):
    text = {"frame": {"wood": {"light": {"101": {"description": "wood", "keywords": ["w"]}}, "_note": {"description": "no"}}, "102": {"keywords": ["k"]}}, "_about": {"x": {"description": "y"}}, "other": {"101": {"description": "again"}, "n": 3, "s": "t"}, "103": {"description": "top"}}
    rows = dictionaries.registry(spark.createDataFrame([(json.dumps(text),), ("{}",), (None,)], "value string")).collect()
    assert sorted((r["code"], "/".join(r["path"]), r["description"], r["keywords"]) for r in rows) == [("101", "frame/wood/light", "wood", ["w"]), ("101", "other", "again", None), ("102", "frame", None, ["k"]), ("103", "", "top", None)]
    table_ = spark.createDataFrame([("1", "a", ["x"]), ("2", "b", None)], "code string, description string, keywords array<string>")
    both = dictionaries.union_registries(table_, table_.selectExpr("code", "upper(description) AS description", "keywords").union(spark.createDataFrame([("3", "c", None)], table_.schema)))
    assert sorted((r["code"], r["description"], r["registry"]) for r in both.collect()) == [("1", "a", 0), ("2", "b", 0), ("3", "c", 1)]


def test_stages(spark, tmp_path):
    root, df = str(tmp_path / "stages"), spark.range(5).withColumnRenamed("id", "row_index")
    stages.save_stage(df, root, "u1", "raw")
    stages.save_stage(df, root, "u2", "raw")
    stages.append_stage(df.limit(2), root, "u1", "raw")
    assert stages.row_count(spark, root, "u1", "raw") == 7
    stages.save_stage(df.limit(1), root, "u1", "raw")
    assert (stages.row_count(spark, root, "u1", "raw"), stages.row_count(spark, root, "u2", "raw")) == (1, 5)
    assert [r[0] for r in stages.load_slice(spark, root, "u2", "raw", 1, 2).collect()] == [1, 2]
    stages.delete_upload(spark, root, "u2")
    assert stages.row_count(spark, root, "u2", "raw") == 0


def test_slices_read_few_files(spark, tmp_path):
    root, before = str(tmp_path / "stages"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 2000, 2).selectExpr("(id * 7919) % 2000 as row_index", "id as x")
        stages.save_stage(rows, root, "u", "s")
        assert len(list((tmp_path / "stages/upload_id=u/stage=s").glob("*.parquet"))) == 4
        for offset, n in ((0, 5), (240, 30), (990, 50), (1000, 5), (5000, 1)):
            part = stages.load_slice(spark, root, "u", "s", offset, n)
            assert [r["row_index"] for r in part.collect()] == list(range(0, 2000, 2))[offset : offset + n]
        part = stages.load_slice(spark, root, "u", "s", 300, 20)
        assert part.count() == 20 and "row_index" in str([f for f in part._jdf.queryExecution().executedPlan().toString().split("PushedFilters")][1:])
        index = spark.read.parquet(f"{root}/_index/u/s").orderBy("first").collect()
        assert all(a["last"] < b["first"] for a, b in zip(index, index[1:], strict=False)) and sum(r["rows"] for r in index) == 1000
        stages.append_stage(spark.range(1, 11, 2).selectExpr("id as row_index", "id as x"), root, "u", "s")  # ranges overlap now
        assert [r["row_index"] for r in stages.load_slice(spark, root, "u", "s", 3, 6).collect()] == [3, 4, 5, 6, 7, 8]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_ordered_parts(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(300).selectExpr("(id * 71) % 300 as row_index", "concat('n', (id * 71) % 300, if(id % 9 = 0, '\t\"q\"', '')) as PolicyID").repartition(5)
        files.write_locations(rows, str(tmp_path / "out"), "AIR")
        parts = sorted((tmp_path / "out").glob("part-*"))
        text = "".join(p.read_text() for p in parts).splitlines()
        assert len(parts) == 4 and text[0].split("\t") == layout.AIR_COLUMNS and len(text) == 301
        whole = tmp_path / "whole.tsv"
        whole.write_text("\n".join(text) + "\n")
        back = files.read_table(spark, str(whole), sep="\t").orderBy("row_index").collect()
        wanted = [r["PolicyID"] for r in rows.orderBy("row_index").collect()]
        assert [r["PolicyID"] for r in back] == wanted and text.count(text[0]) == 1
        lines = files.read_lines(spark, str(tmp_path / "out")).orderBy("line_no").collect()
        assert [r["line"] for r in lines] == text and [r["line_no"] for r in lines] == list(range(301))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_memory_stream(spark, tmp_path):
    from sovara.streaming import ingest

    schema = "source_col string, target_format string, canonical string, at int"
    rows = [("A b", "AIR", "X", 1), ("a_B", "AIR", "Y", 2), ("c", "AIR", None, 3), ("c", "RMS", "Z", 4)]
    path, source = str(tmp_path / "memory"), str(tmp_path / "in")
    assert ingest.read_memory(spark, path) is None
    every = []
    for n in range(7):
        more = [(s, t, f"{c}{n}" if c else None, 10 * n + at) for s, t, c, at in rows[: n + 1]]
        every += more
        spark.createDataFrame(more, schema).write.mode("append").parquet(source)
        ingest.start_memory(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "ck"), compact_every=3).awaitTermination()
        wanted = {tuple(r) for r in mapping.upsert_memory(None, spark.createDataFrame(every, schema)).collect()}
        assert {tuple(r) for r in ingest.read_memory(spark, path).collect()} == wanted
        # a batch or a compaction that runs again changes nothing
        mapping.upsert_memory(None, spark.createDataFrame(more, schema)).write.mode("overwrite").parquet(f"{path}/delta/batch-{n}")
        if n % 3 == 2:
            ingest.compact_memory(spark, path, n)
        assert {tuple(r) for r in ingest.read_memory(spark, path).collect()} == wanted
    kept = sorted(p.name for p in (tmp_path / "memory").glob("*/*"))
    assert kept == ["batch-6", "upto-5"], kept


def test_exceedance_curve(spark):
    losses = spark.createDataFrame([(y, float(y)) for y in range(1, 101)] + [(100, 5.0)], "year int, loss double")
    out = {(r["curve"], r["return_period"]): r["loss_amount"] for r in portfolio.exceedance_curve(losses, 100).collect()}
    assert out[("oep", 10)] == 91.0 and out[("aep", 100)] == 105.0


def test_lookup_tables_are_whole(spark):
    """Every entry of the address tables, and texts that a shorter table would answer wrongly."""
    def of(make, texts):
        return [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", make(F.col("c")).alias("v")).orderBy("i").select("v").collect()]

    def read(column, values):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, {column} string")
        use = address.address_uses(df, {k: k for k in address.ADDRESS_PARTS})[column]
        return [r[0] for r in in_place(df, use).orderBy("i").select(*use.results).collect()]

    assert of(address.country, [*address.COUNTRIES, *address.ALPHA3]) == [*address.COUNTRIES.values(), *address.ALPHA3.values()]
    assert of(address.country, ["Austria", "Hong Kong", "U.A.E.", "Korea", "Atlantis", "XYZ", None]) == ["AT", "HK", "AE", "KR", "AT", "XYZ", None]
    us = lambda c: address.state(c, F.lit("US"))
    assert of(us, list(address.STATES)) == list(address.STATES.values())
    assert of(us, ["D.C.", "Washington DC", "n.y.", "Okla", "Guam", "QQ"]) == ["DC", "DC", "NY", "OK", "GU", None]
    assert read("City", ["W Palm Beach", "Pt Arthur", "St. Louis", "ft worth"]) == ["W Palm Beach", "Point Arthur", "Saint Louis", "Fort Worth"]
    assert read("Street", [f"5 Oak {w}" for w in address.STREET_WORDS]) == [f"5 Oak {v}" for v in address.STREET_WORDS.values()]


def test_words_of_cells(spark):
    rows = [("wet pipe", "triple", "AED"), ("no sprinkler", "dual buildings", "THB"), ("full", "eleven", "ILS"), ("dry", "twenty-one", "XXX")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_index int, SprinklerSystem string, RiskCount string, Currency string")
    got = cleaning.clean_currency(cleaning.clean_count(cleaning.clean_sprinkler(df))).orderBy("row_index").select("SprinklerSystem", "RiskCount", "Currency").collect()
    assert [tuple(r) for r in got] == [(1, 3, "AED"), (0, 2, "THB"), (None, None, "ILS"), (1, 21, None)]
    only = cleaning.clean_currency(df.select("row_index", "Currency"), ("AED",)).filter("Currency is not null").collect()
    assert [r["Currency"] for r in only] == ["AED"]


def test_serial_numbers_in_many_ranges(spark):
    df = spark.createDataFrame([(i, "p" if i % 3 else None) for i in range(400)], "row_index bigint, PolicyID string")
    got = {r["row_index"]: r["LocationID"] for r in identity.serial_numbers(df, range_rows=5).collect()}
    assert [got[i] for i in range(400) if i % 3] == list(range(1, 267)) and [got[i] for i in range(0, 400, 3)] == list(range(1, 135))


def test_cascade_takes_confident_hits(spark):
    pairs = table(spark, ["scheme", "value"], [("", "brick"), ("", "wood"), ("", "tile"), ("", "mud")])
    hit = "scheme string, value string, code string, confidence double, method string, scheme_override string"
    rules = spark.createDataFrame([("", "brick", "119", 0.70, "conflict", None), ("", "wood", "101", 0.85, "conflict", None)], hit)
    near = spark.createDataFrame([("", "brick", "103", 0.58, "tfidf", None), ("", "tile", "104", 0.48, "tfidf", None), ("", "wood", "999", 0.68, "tfidf", None)], hit)
    got = lambda rules_: {r["value"]: (r["code"], r["confidence"], r["method"]) for r in codes.cascade(pairs, [rules, near], rules=rules_).collect()}
    assert got(PRESETS["Balanced"]) == {"brick": ("103", 0.58, "tfidf"), "wood": ("101", 0.85, "conflict"), "tile": ("100", 0.0, "default"), "mud": ("100", 0.0, "default")}
    assert got(PRESETS["Permissive"])["brick"] == ("119", 0.70, "conflict")
    assert got(PRESETS["Conservative"]) == {v: ("100", 0.0, "default") for v in ("brick", "tile", "mud")} | {"wood": ("999", 0.68, "tfidf")}
    assert got(None)["tile"] == ("104", 0.48, "tfidf")
