"""DuckDB SQL for the rows of the exposure queries."""

from __future__ import annotations

from sovara.plans.exposure import SQL_VIEW

_V = f"WITH v AS ({SQL_VIEW})"
_NUM = lambda c: f"coalesce(try_cast(regexp_replace({c}, '[$€£¥₹,\\s]', '', 'g') AS DOUBLE), 0)"
_SUM = lambda c: f"sum(CAST({_NUM(c)} AS DECIMAL(38,2)))"
_TIV = f"{_V}, t AS (SELECT *, {_NUM('BuildingValue')} + {_NUM('ContentsValue')} + {_NUM('TimeElementValue')} AS tiv FROM v)"
_DEC = "CAST(sum(CAST(tiv AS DECIMAL(38,2))) AS DECIMAL(38,2))"
_BLANK = lambda c: f"nullif(trim({c}), '')"


def _tiv_by(*columns: tuple[str, str]) -> str:
    keys = ", ".join(f"coalesce({_BLANK(c)}, '{blank}') AS {c}" for c, blank in columns)
    return f"{_TIV} SELECT {keys}, count(*) AS locations, {_DEC} AS tiv FROM t GROUP BY {', '.join(str(i + 1) for i in range(len(columns)))}"


def _bands(bands: tuple[str, ...], case: str) -> str:
    rows = ", ".join(f"({i}, '{b}')" for i, b in enumerate(bands))
    return f"{_TIV}, b(ordinal, band) AS (VALUES {rows}), s AS (SELECT {case} AS band, count(*) AS locations, {_DEC} AS tiv FROM t GROUP BY 1) SELECT ordinal, band, coalesce(locations, 0) AS locations, coalesce(tiv, 0) AS tiv FROM b LEFT JOIN s USING (band)"


_RMS = f"{_V}, r AS (SELECT row_index, PolicyID AS ACCNTNUM, CASE WHEN row_index % 3 = 0 THEN price END AS e, CASE WHEN row_index % 4 = 0 THEN 7 END AS w, CASE WHEN row_index % 5 = 0 THEN 9999 ELSE order_year END AS y, CASE WHEN row_index % 2 = 0 THEN 1500 END AS u FROM v)"
_HEADERS = "h AS (SELECT DISTINCT 'u' || (l_orderkey % 97) AS upload_id, 'col ' || (l_partkey % 13) AS source_col, CASE WHEN l_linenumber < 5 THEN 'C' || (l_suppkey % 11) END AS canonical FROM lineitem)"

# the year rules on the forms that the view holds
_YEARS = f"""{_V}, a AS (SELECT *, coalesce({_BLANK('YearBuilt')}, '') AS b, coalesce({_BLANK('YearRetrofitted')}, '') AS u FROM v),
t AS (SELECT *, trim(concat_ws(' ', b, u)) AS raw, lower(trim(concat_ws(' ', b, u))) AS t FROM a),
n AS (SELECT *, list_transform(regexp_extract_all(t, '\\b([12][0-9]{{3}})\\b', 1), lambda x: CAST(x AS INT)) AS four, list_transform(regexp_extract_all(t, '\\b([0-9]{{2}})\\b', 1), lambda x: CAST(x AS INT) + CASE WHEN CAST(x AS INT) >= 25 THEN 1900 ELSE 2000 END) AS two, regexp_matches(t, '\\b(19|20)[0-9][a-z]\\b') AS alpha FROM t),
y AS (SELECT *, list_distinct(list_filter(CASE WHEN len(four) > 0 THEN four ELSE two END, lambda x: x BETWEEN 1700 AND 2026)) AS ys FROM n),
z AS (SELECT *, list_min(ys) AS mn, list_max(ys) AS mx, len(ys) AS k, NOT alpha AND len(ys) > 0 AND NOT (len(ys) = 1 AND NOT contains(b, CAST(list_min(ys) AS VARCHAR)) AND contains(u, CAST(list_min(ys) AS VARCHAR))) AS good FROM y),
c AS (SELECT *, CASE WHEN good THEN mn END AS built, CASE WHEN good THEN CASE WHEN k > 1 AND (regexp_matches(t, 'renovated') OR NOT regexp_matches(t, '\\broofs?\\b')) THEN mx ELSE 9999 END END AS retro,
  CASE WHEN alpha THEN 'invalid_alpha_year' WHEN raw <> '' AND k = 0 THEN 'unparseable_year' ELSE '' END AS issues FROM z)"""

_MONEY = f"""{_V}, m AS (SELECT *, trim(BuildingValue) AS bt, trim(ContentsValue) AS ct FROM v),
n AS (SELECT *, regexp_replace(bt, '[$€]', '', 'g') AS s FROM m),
w AS (SELECT *, CASE WHEN s = 'n/a' THEN 0 WHEN s LIKE '%K' THEN try_cast(left(s, length(s) - 1) AS BIGINT) * 1000 ELSE try_cast(nullif(s, '') AS BIGINT) END AS bv, try_cast(nullif(ct, '') AS BIGINT) AS cv,
  CASE WHEN contains(bt, '$') THEN 'USD' WHEN contains(bt, '€') THEN 'EUR' END AS cur FROM n)"""

_PAIRS = f"{_V}, p AS (SELECT coalesce(upper({_BLANK('const_scheme')}), '') AS scheme, {_BLANK('construction')} AS value, min(row_index) AS first_row, count(*) AS rows FROM v WHERE {_BLANK('construction')} IS NOT NULL GROUP BY 1, 2)"
_OCC = f"{_V}, p AS (SELECT DISTINCT coalesce(upper({_BLANK('occ_scheme')}), '') AS scheme, {_BLANK('occupancy')} AS value FROM v WHERE {_BLANK('occupancy')} IS NOT NULL)"
_IS_ISO = "(scheme = 'ISO' OR (scheme = '' AND upper(value) IN ('0','1','2','3','4','5','6','7','8','9','F','JM','NC','MNC','MFR','FR','HTJM','SNC','SMNC')))"
_ISO_CODE = "CASE value WHEN '0' THEN '100' WHEN '1' THEN '101' WHEN '2' THEN 'F2' WHEN '3' THEN 'F3' WHEN '4' THEN 'F4' WHEN '5' THEN 'F5' WHEN '6' THEN 'F6' END"
_RMS_CODE = "CASE value WHEN '1' THEN '101' WHEN '2' THEN 'F2' WHEN '3' THEN 'F3' WHEN '4' THEN 'F4' WHEN '7' THEN '152' WHEN '8' THEN '155' END"
_CONFLICT = "CASE value WHEN 'Steel frame with masonry infill walls' THEN '151' WHEN 'CMU walls with wood roof joists' THEN '119' WHEN 'Tilt-up concrete walls with steel roof deck' THEN '111' WHEN 'Concrete podium with wood upper floors' THEN '141' WHEN 'Heavy timber with masonry walls' THEN '104' WHEN 'Brick exterior, unknown frame' THEN '119' WHEN 'unreinforced masonry and steel roof' THEN '119' END"
_CONFLICT_CONF = "CASE value WHEN 'Steel frame with masonry infill walls' THEN 0.90 WHEN 'CMU walls with wood roof joists' THEN 0.93 WHEN 'Tilt-up concrete walls with steel roof deck' THEN 0.92 WHEN 'Concrete podium with wood upper floors' THEN 0.92 WHEN 'Heavy timber with masonry walls' THEN 0.92 WHEN 'Brick exterior, unknown frame' THEN 0.70 WHEN 'unreinforced masonry and steel roof' THEN 0.93 END::DOUBLE"
_CASCADE = f"""{_PAIRS}, x AS (SELECT *, CASE WHEN {_IS_ISO} THEN {_ISO_CODE} END AS i, CASE WHEN scheme = 'RMS' THEN {_RMS_CODE} END AS r, {_CONFLICT} AS k FROM p),
c AS (SELECT scheme, value, rows, coalesce(i, r, k, '100') AS code, CASE WHEN i IS NOT NULL THEN 1.0 WHEN r IS NOT NULL THEN 0.98 WHEN k IS NOT NULL THEN {_CONFLICT_CONF} ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN i IS NOT NULL THEN 'iso_direct' WHEN r IS NOT NULL THEN 'rms_direct' WHEN k IS NOT NULL THEN 'conflict' ELSE 'default' END AS method, CASE WHEN coalesce(i, r) LIKE 'F%' THEN 'ISF' END AS o FROM x)"""
_ENRICH = f"{_CASCADE}, e AS (SELECT v.row_index, c.code AS Construction_Code, c.confidence AS Construction_Confidence, c.method AS Construction_Method, coalesce(c.o, nullif(upper(trim(v.const_scheme)), '')) AS Construction_Scheme FROM v LEFT JOIN c ON c.scheme = coalesce(upper({_BLANK('v.const_scheme')}), '') AND c.value = {_BLANK('v.construction')})"
_MEMORY = "m AS (SELECT regexp_replace(lower(trim(' User_' || user_id)), '[\\s_\\-]+', ' ', 'g') AS source_col_normalized, 'AIR' AS target_format, arg_max(event_type, struct_pack(ts, event_type)) AS canonical, count(*)::BIGINT AS confirmed_count, min(ts) AS first_confirmed, max(ts) AS last_confirmed FROM events GROUP BY 1)"
_EVENT_MONEY = "CAST(floor(value) AS BIGINT) * 1000"

SQL = {
    "portfolio_totals": f"{_V}, s AS (SELECT count(*) AS locations, {_SUM('BuildingValue')} AS building, {_SUM('ContentsValue')} AS contents, {_SUM('TimeElementValue')} AS bi FROM v) SELECT *, building + contents + bi AS total FROM s",
    "tiv_by_country_state": _tiv_by(("Nation", "Unknown"), ("Area", "NA")),
    "tiv_by_occupancy": _tiv_by(("segment", "Unknown")),
    "tiv_by_construction": _tiv_by(("priority", "Unknown")),
    "tiv_rollup": f"{_TIV} SELECT coalesce({_BLANK('Nation')}, 'Unknown') AS country, coalesce({_BLANK('Area')}, 'NA') AS state, CAST(grouping({_BLANK('Nation')}, {_BLANK('Area')}) AS INT) AS level, count(*) AS locations, {_DEC} AS tiv FROM t GROUP BY ROLLUP ({_BLANK('Nation')}, {_BLANK('Area')})".replace(f"coalesce({_BLANK('Nation')}, 'Unknown')", _BLANK("Nation")).replace(f"coalesce({_BLANK('Area')}, 'NA')", _BLANK("Area")),
    "tiv_by_year_band": _bands(("Pre 1995", "1995 – 2001", "2002 – 2010", "2011 – 2017", "Post 2017", "Unknown"), "CASE WHEN order_year <= 0 THEN 'Unknown' WHEN order_year < 1995 THEN 'Pre 1995' WHEN order_year <= 2001 THEN '1995 – 2001' WHEN order_year <= 2010 THEN '2002 – 2010' WHEN order_year <= 2017 THEN '2011 – 2017' ELSE 'Post 2017' END"),
    "tiv_by_story_band": _bands(("1", "2–3", "4–7", "7+", "Unknown"), "CASE WHEN stories_number <= 0 THEN 'Unknown' WHEN stories_number <= 1 THEN '1' WHEN stories_number <= 3 THEN '2–3' WHEN stories_number <= 7 THEN '4–7' ELSE '7+' END"),
    "top_locations": f"{_TIV} SELECT row_index, InsuredName, Nation, segment, tiv FROM t ORDER BY tiv DESC, row_index LIMIT 10",
    "serial_numbers": f"{_V} SELECT row_index, PolicyID, row_number() OVER (PARTITION BY coalesce({_BLANK('PolicyID')}, '') ORDER BY row_index) AS LocationID FROM v",
    "uniform_policy": f"{_V}, f AS (SELECT arg_min({_BLANK('PolicyID')}, row_index) AS PolicyID FROM v WHERE {_BLANK('PolicyID')} IS NOT NULL) SELECT row_index, f.PolicyID FROM v, f",
    "account_file": f"{_V}, c AS (SELECT {_BLANK('PolicyID')} AS ContractID, arg_min(InsuredName, row_index) AS InsuredName FROM v WHERE {_BLANK('PolicyID')} IS NOT NULL GROUP BY 1), l(LayerID, LayerPerils) AS (VALUES ('1','PEA'),('2','PSH'),('3','PWX'),('4','PFL'),('5','PWB'),('6','PWB')) SELECT * FROM c, l",
    "contract_file": f"{_V}, c AS (SELECT DISTINCT {_BLANK('PolicyID')} AS ACCNTNUM FROM v WHERE {_BLANK('PolicyID')} IS NOT NULL), l(POLICYNUM, POLICYTYPE) AS (VALUES ('EQ','1'),('HU','2'),('SCS','3'),('FL','4'),('FR','5'),('TR','6')) SELECT ACCNTNUM, ACCNTNUM AS ACCNTNAME, POLICYNUM, POLICYTYPE FROM c, l",
    "peril_clone": f"{_RMS} SELECT row_index, e AS EQCV1VAL, coalesce(w, e) AS WSCV1VAL, e AS FRCV1VAL, 'USD' AS TRCV1LCUR FROM r",
    "rms_layout": f"{_RMS} SELECT ACCNTNUM, '' AS LOCNAME, CASE WHEN y = 9999 THEN '12/31/9999' WHEN y BETWEEN 1700 AND 2026 THEN '01/01/' || y ELSE y::VARCHAR END AS YEARBUILT, CASE WHEN u IS NULL THEN '' ELSE u::VARCHAR END AS YEARUPGRAD, coalesce(e::VARCHAR, '') AS EQCV1VAL, coalesce(e::VARCHAR, '') AS TOCV1VAL, 'USD' AS FLCV1LCUR FROM r",
    "column_map_apply": f"{_V} SELECT row_index, coalesce(Street, Area) AS Street, City AS Place FROM v",
    "mapping_conflicts": f"WITH {_HEADERS} SELECT upload_id, canonical, array_to_string(list_sort(list(DISTINCT source_col)), '|') AS sources FROM h WHERE canonical IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source_col) > 1",
    "missing_required": f"WITH {_HEADERS}, f AS (SELECT * FROM h), q(canonical) AS (VALUES ('C1'), ('C7'), ('Z9')) SELECT u.upload_id, q.canonical FROM (SELECT DISTINCT upload_id FROM f) u, q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.upload_id = u.upload_id AND f.canonical = q.canonical)",
    "clean_years": f"{_YEARS} SELECT row_index, built AS YearBuilt, retro AS YearRetrofitted, issues FROM c",
    "clean_stories": f"""{_V}, s AS (SELECT row_index, row_index % 8 AS k, {_BLANK('NumberOfStories')} AS t FROM v),
n AS (SELECT *, list_transform(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE)) AS ns FROM s)
SELECT row_index, CASE WHEN k = 1 THEN list_sum(ns)::INT WHEN k = 2 THEN (1 + ns[1])::INT WHEN k = 5 OR t IS NULL THEN NULL ELSE ceil(list_max(ns))::INT END AS NumberOfStories,
  CASE k WHEN 1 THEN 'summed_stories' WHEN 2 THEN 'summed_stories' WHEN 3 THEN 'decimal_stories' WHEN 4 THEN 'multiple_story_values' WHEN 5 THEN 'negative_stories' WHEN 6 THEN 'unparseable_stories' ELSE '' END AS issues FROM n""",
    "clean_count": f"""{_V}, s AS (SELECT row_index, row_index % 9 AS k, {_BLANK('RiskCount')} AS t FROM v),
n AS (SELECT *, list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: CAST(x AS INT)) AS ns FROM s)
SELECT row_index, CASE k WHEN 0 THEN ns[1] WHEN 1 THEN ns[2] WHEN 2 THEN ns[1] + 1 WHEN 4 THEN list_max(ns) WHEN 5 THEN ns[1] + 1 WHEN 7 THEN 1 END AS RiskCount,
  CASE k WHEN 1 THEN 'units_vs_buildings' WHEN 2 THEN 'additive_building_count' WHEN 3 THEN 'vague_building_count' WHEN 4 THEN 'building_count_range' WHEN 5 THEN 'decimal_building_count' WHEN 6 THEN 'negative_building_count' ELSE '' END AS issues FROM n""",
    "clean_area": f"""{_V}, s AS (SELECT row_index, row_index % 7 AS k, {_BLANK('GrossArea')} AS t FROM v),
n AS (SELECT *, list_transform(regexp_extract_all(replace(t, ',', ''), '[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS ns FROM s)
SELECT row_index, CASE k WHEN 0 THEN ns[1] WHEN 1 THEN ns[1] * 1000 WHEN 2 THEN list_sum(ns) WHEN 3 THEN ns[1] END AS GrossArea,
  CASE WHEN k = 3 AND ns[1] < 100 THEN 'area_below_minimum' WHEN k = 4 THEN 'invalid_area_unit' WHEN k = 5 THEN 'vague_area' ELSE '' END AS issues FROM n""",
    "clean_values": f"{_MONEY} SELECT row_index, bv AS BuildingValue, cv AS ContentsValue, cur AS Currency, concat_ws('|', CASE WHEN bv < 0 THEN 'negative_value' END, CASE WHEN bv > 400000 THEN 'value_exceeds_max' END) AS issues FROM w",
    "clean_currency": f"""{_V}, a AS (SELECT row_index, Currency AS c, EQCV1LCUR AS e, upper({_BLANK('Currency')}) AS ct, upper({_BLANK('EQCV1LCUR')}) AS et FROM v),
b AS (SELECT *, CASE WHEN right(ct, 3) IN ('USD','EUR','GBP') THEN right(ct, 3) END AS cc, CASE WHEN right(et, 3) IN ('USD','EUR','GBP') THEN right(et, 3) END AS ec FROM a),
d AS (SELECT *, cc IS NOT NULL AND ec IS NOT NULL AND cc <> ec AS clash, CASE WHEN cc IS NULL OR ec IS NULL OR cc = ec THEN coalesce(cc, ec) END AS one FROM b)
SELECT row_index, coalesce(one, CASE WHEN ct IS NULL OR cc IS NOT NULL THEN c END) AS Currency, coalesce(one, CASE WHEN et IS NULL OR ec IS NOT NULL THEN e END) AS EQCV1LCUR, one AS EQCV2LCUR, clash AS Currency_Conflicts,
  concat_ws('|', CASE WHEN ct IS NOT NULL AND cc IS NULL THEN 'unrecognized_currency' END, CASE WHEN et IS NOT NULL AND ec IS NULL THEN 'unrecognized_currency' END, CASE WHEN clash THEN 'currency_conflict' END) AS issues FROM d""",
    "clean_sprinkler": f"{_V} SELECT row_index, CASE WHEN lower(trim(SprinklerSystem)) IN ('yes', '1') THEN 1 WHEN lower(trim(SprinklerSystem)) = 'no' THEN 0 END AS SprinklerSystem, CASE WHEN SprinklerSystem = 'maybe' THEN 1 ELSE 0 END AS n_flags FROM v",
    "clean_name": f"""{_V}, a AS (SELECT row_index, {_BLANK('LocationName')} AS own, coalesce({_BLANK('PolicyID')}, {_BLANK('InsuredName')}) AS other FROM v),
b AS (SELECT *, trim(regexp_replace(coalesce(own, other), '[^A-Za-z0-9 .,&''\\-()/]', '', 'g')) AS n FROM a)
SELECT row_index, trim(left(n, 40)) AS LocationName, concat_ws('|', CASE WHEN own IS NULL AND other IS NOT NULL THEN 'location_name_fallback' END, CASE WHEN length(n) > 40 THEN 'location_name_truncated' END) AS issues FROM b""",
    "clean_postal": f"""{_V}, a AS (SELECT row_index, row_index % 6 AS k, {_BLANK('PostalCode')} AS t FROM v)
SELECT row_index, CASE k WHEN 0 THEN t WHEN 1 THEN lpad(t, 5, '0') WHEN 2 THEN left(t, 5) WHEN 4 THEN right(t, 5) END AS postal FROM a""",
    "clean_state": f"{_V} SELECT row_index, CASE WHEN row_index % 6 IN (0, 1, 3) THEN 'TX' END AS state, CASE WHEN row_index % 6 IN (0, 1, 3) THEN 'valid' ELSE 'missing' END AS label FROM v",
    "clean_country": f"""{_V}, c(k, iso) AS (VALUES ('argentina','AR'),('brazil','BR'),('canada','CA'),('egypt','EG'),('france','FR'),('germany','DE'),('india','IN'),('indonesia','ID'),('japan','JP'),('kenya','KE'),('peru','PE'),('china','CN'),('romania','RO'),('saudi arabia','SA'),('vietnam','VN'),('russia','RU'),('united kingdom','GB'),('united states','US'))
SELECT row_index, coalesce(iso, upper(left({_BLANK('CountryISO')}, 2))) AS country FROM v LEFT JOIN c ON c.k = lower({_BLANK('CountryISO')})""",
    "clean_coordinates": f"""{_V}, a AS (SELECT row_index, row_index % 6 AS k, try_cast(Latitude AS DOUBLE) AS la, try_cast(Longitude AS DOUBLE) AS lo FROM v)
SELECT row_index, CASE k WHEN 0 THEN la WHEN 1 THEN -29.75 END AS Latitude, CASE k WHEN 0 THEN -lo WHEN 1 THEN -95.25 END AS Longitude,
  CASE k WHEN 0 THEN 'positive_longitude_in_us' WHEN 1 THEN 'coordinates_reversed|positive_longitude_in_us|low_precision_coordinates' WHEN 2 THEN 'coordinates_zero' WHEN 3 THEN 'non_numeric_coordinates' WHEN 5 THEN 'missing_lat_or_lon' ELSE '' END AS issues FROM a""",
    "clean_street_city": f"""{_V}, a AS (SELECT row_index, o_custkey AS k FROM v JOIN orders ON o_orderkey = row_index)
SELECT row_index, CASE row_index % 4 WHEN 0 THEN '12 North Main Street' WHEN 1 THEN k || ' PO Box' WHEN 2 THEN k || ' oak Avenue' ELSE k || ' South Elm Road' END AS street,
  CASE row_index % 5 WHEN 0 THEN 'Fort Worth' WHEN 1 THEN NULL WHEN 2 THEN 'Austin' WHEN 3 THEN 'Houston' ELSE 'New York City' END AS city FROM a""",
    "geocode_join": f"""{_V}, a AS (SELECT row_index, CASE WHEN row_index % 10 = 0 THEN '' ELSE regexp_replace(lower(Nation), '[^\\w\\s]', '', 'g') END AS k, CASE WHEN row_index % 6 = 0 THEN Latitude END AS la, CASE WHEN row_index % 6 = 0 THEN Longitude END AS lo FROM v),
g AS (SELECT regexp_replace(lower(n_name), '[^\\w\\s]', '', 'g') AS k, n_nationkey + 10.25 AS lat, n_nationkey - 60.5 AS lon FROM nation WHERE n_nationkey % 2 = 0)
SELECT row_index, CASE WHEN la IS NOT NULL THEN 'provided' WHEN length(a.k) < 5 THEN 'insufficient_address' WHEN g.k IS NOT NULL THEN 'geocoded' ELSE 'failed' END AS Geocode_Status,
  CASE WHEN la IS NOT NULL THEN la::DOUBLE WHEN length(a.k) >= 5 THEN lat::DOUBLE END AS Latitude, CASE WHEN la IS NOT NULL THEN lo::DOUBLE WHEN length(a.k) >= 5 THEN lon::DOUBLE END AS Longitude FROM a LEFT JOIN g USING (k)""",
    "distinct_pairs": f"{_PAIRS} SELECT * FROM p",
    "crosswalk_iso": f"{_PAIRS} SELECT scheme, value, {_ISO_CODE} AS code, 1.0::DOUBLE AS confidence, 'iso_direct' AS method, CASE WHEN {_ISO_CODE} LIKE 'F%' THEN 'ISF' END AS scheme_override FROM p WHERE {_IS_ISO} AND {_ISO_CODE} IS NOT NULL",
    "crosswalk_rms": f"{_PAIRS} SELECT scheme, value, {_RMS_CODE} AS code, 0.98::DOUBLE AS confidence, 'rms_direct' AS method, CASE WHEN {_RMS_CODE} LIKE 'F%' THEN 'ISF' END AS scheme_override FROM p WHERE scheme = 'RMS' AND {_RMS_CODE} IS NOT NULL",
    "crosswalk_atc": f"{_OCC}, n AS (SELECT *, try_cast(value AS INT) AS n FROM p) SELECT scheme, value, (n + 300)::VARCHAR AS code, 1.0::DOUBLE AS confidence FROM n WHERE n BETWEEN 1 AND 54 AND (scheme = 'ATC' OR (scheme = '' AND (n BETWEEN 1 AND 39 OR n BETWEEN 42 AND 44 OR n BETWEEN 47 AND 54)))",
    "raw_lookup": f"{_OCC}, l(t, code, confidence) AS (VALUES ('building', '311', 0.95), ('machinery', '321', 0.9), ('household', '301', 0.85)) SELECT scheme, value, code, confidence::DOUBLE AS confidence FROM p JOIN l ON l.t = lower(value)",
    "conflict_rules": f"{_PAIRS} SELECT scheme, value, {_CONFLICT} AS code, {_CONFLICT_CONF} AS confidence FROM p WHERE {_CONFLICT} IS NOT NULL",
    "cascade_default": f"{_CASCADE} SELECT scheme, value, rows, code, confidence, method FROM c",
    "enrich_codes": f"{_ENRICH} SELECT * FROM e",
    "method_counts": f"{_ENRICH} SELECT Construction_Method AS method, count(*) AS count FROM e GROUP BY 1",
    "code_distribution": f"{_CASCADE} SELECT code, count(*) AS pairs, array_to_string(list_sort(list(DISTINCT value))[1:6], '|') AS samples FROM c GROUP BY code ORDER BY pairs DESC, code LIMIT 10",
    "keyword_scores": """WITH k(code, description, keywords, ordinal) AS (VALUES ('K1', 'steel goods', ['steel', 'small steel', 'steel rod'], 1), ('K2', 'hot', ['hot', 'hot bolt economy'], 2), ('K3', 'promo goods', ['promo', 'rod promo'], 3), ('K4', 'blue rod', ['blue', 'large blue rod'], 4), ('K5', 'economy goods', ['economy', 'old ring economy', 'ring'], 5)),
t AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS text FROM part), w AS (SELECT text, code, ordinal, description, unnest(keywords) AS w FROM t, k),
s AS (SELECT text, code, ordinal, round(sum(CASE WHEN w = text THEN 1.0 WHEN contains(text, w) THEN 0.7 + (len(string_split(w, ' ')) - 1) * 0.05 WHEN contains(w, text) THEN 0.5 WHEN list_has_any(list_filter(string_split(w, ' '), lambda x: length(x) > 3), string_split(text, ' ')) THEN 0.2 ELSE 0 END) + max(CASE WHEN contains(text, description) THEN 0.3 ELSE 0 END), 4)::DOUBLE AS score FROM w GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, ordinal) AS rn, lead(score) OVER (PARTITION BY text ORDER BY score DESC, ordinal) AS nx FROM s WHERE score > 0),
b AS (SELECT *, CASE WHEN score >= 1.5 THEN 0.95 WHEN score >= 1.0 THEN 0.90 WHEN score >= 0.7 THEN 0.85 WHEN score >= 0.5 THEN 0.75 ELSE 0.65 END - CASE WHEN score - nx < 0.2 THEN 0.10 ELSE 0 END AS conf FROM r WHERE rn = 1),
o AS (SELECT text, string_agg(code, '|' ORDER BY rn) AS others FROM r WHERE rn IN (2, 3) GROUP BY text)
SELECT text, code, score, round(conf, 4)::DOUBLE AS confidence, coalesce(others, '') AS others FROM b LEFT JOIN o USING (text)""",
    "modifier_codes": f"""{_V}, t AS (SELECT DISTINCT roof AS text FROM v)
SELECT text, CASE text WHEN '3' THEN 3 WHEN 'Clay Tiles' THEN 6 WHEN 'old slate roof' THEN 1 WHEN 'wood shingles, painted' THEN 7 ELSE 0 END AS code, CASE text WHEN '3' THEN 'integer' WHEN 'Clay Tiles' THEN 'alias' WHEN 'old slate roof' THEN 'token' WHEN 'wood shingles, painted' THEN 'token' WHEN '' THEN 'empty' ELSE 'default' END AS method,
  CASE text WHEN '3' THEN 1.0 WHEN 'Clay Tiles' THEN 0.97 WHEN 'old slate roof' THEN 0.85 WHEN 'wood shingles, painted' THEN 0.85 ELSE 0 END::DOUBLE AS confidence FROM t""",
    "dict_overlay": """WITH e AS (SELECT p_brand AS code, p_partkey AS version, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS description, unnest(string_split(p_type, ' ')) AS k, unnest(range(len(string_split(p_type, ' ')))) AS i FROM part),
f AS (SELECT code, k, min(version * 100 + i) AS p1 FROM e GROUP BY 1, 2)
SELECT code, arg_max(description, version) FILTER (WHERE description IS NOT NULL) AS description, any_value(kw) AS keywords, max(version) AS version FROM e JOIN (SELECT code, string_agg(k, '|' ORDER BY p1) AS kw FROM f GROUP BY code) USING (code) GROUP BY code""",
    "dict_duplicates": "WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS code FROM part) SELECT upper(trim(code)) AS key, count(*) AS entries, array_to_string(list_sort(list(DISTINCT code)), '|') AS codes FROM p GROUP BY 1 HAVING count(*) > 1",
    "dict_clean_entries": "SELECT lower(p_name) || (p_partkey % 9) AS code, p_partkey FROM part WHERE upper(p_name || (p_partkey % 9)) NOT IN (SELECT upper(p_name || (p_partkey % 9)) FROM part WHERE p_size < 20)",
    "dict_upload_errors": "WITH e AS (SELECT CASE WHEN p_partkey % 5 = 0 AND p_partkey % 7 = 0 THEN 'missing_code|missing_description' WHEN p_partkey % 5 = 0 THEN 'missing_code' WHEN p_partkey % 7 = 0 THEN 'missing_description' ELSE '' END AS errors, len(string_split(p_type, ' ')) AS n FROM part) SELECT errors, count(*) AS entries, sum(n)::BIGINT AS keywords FROM e GROUP BY 1",
    "memory_upsert": f"WITH {_MEMORY} SELECT * FROM m",
    "memory_stats": f"WITH {_MEMORY} SELECT target_format, count(*) AS entries, sum(confirmed_count)::BIGINT AS confirmations FROM m GROUP BY 1",
    "flag_families": f"{_YEARS}, m AS (SELECT row_index, bt, bv, ct, cv FROM ({_MONEY.replace('WITH v AS', 'WITH v2 AS').replace('FROM v)', 'FROM v2)')} SELECT * FROM w)), q AS (SELECT (SELECT count(*) FROM c WHERE issues <> '') AS y, (SELECT count_if(bv IS NULL) + count_if(bv < 0) + count_if(bv > 400000) + count_if(cv IS NULL) FROM m) + (SELECT count(*) FROM v) AS x) SELECT unnest(['year', 'value', 'currency']) AS family, unnest([y, x, 0]) AS flags FROM q",
    "step_diff": f"{_YEARS} SELECT row_index, YearBuilt AS \"before_YearBuilt\", YearRetrofitted AS \"before_YearRetrofitted\", built::VARCHAR AS \"after_YearBuilt\", retro::VARCHAR AS \"after_YearRetrofitted\" FROM c WHERE raw <> '' OR built IS NOT NULL",
    "diff_sample": f"{_YEARS} SELECT row_index, YearBuilt AS \"before_YearBuilt\", YearRetrofitted AS \"before_YearRetrofitted\", built::VARCHAR AS \"after_YearBuilt\", retro::VARCHAR AS \"after_YearRetrofitted\" FROM c WHERE raw <> '' OR built IS NOT NULL ORDER BY row_index LIMIT 100",
    "filled_counts": f"{_V}, n AS (SELECT count_if({_BLANK('YearBuilt')} IS NOT NULL) AS a, count_if({_BLANK('BuildingValue')} IS NOT NULL) AS b, count_if({_BLANK('Currency')} IS NOT NULL) AS c, count_if({_BLANK('LocationName')} IS NOT NULL) AS d FROM v) SELECT unnest(['YearBuilt', 'BuildingValue', 'Currency', 'LocationName']) AS column_name, unnest([a, b, c, d]) AS filled FROM n",
    "changed_counts": f"{_YEARS}, q AS (SELECT count_if(trim(YearBuilt) IS DISTINCT FROM built::VARCHAR) AS a, count_if(trim(YearRetrofitted) IS DISTINCT FROM retro::VARCHAR) AS b FROM c) SELECT unnest(['YearBuilt', 'YearRetrofitted']) AS column_name, unnest([a, b]) AS changed FROM q",
    "apply_corrections": f"{_YEARS} SELECT row_index, CASE WHEN row_index % 8 = 3 THEN order_year ELSE built END AS YearBuilt, CASE WHEN row_index % 8 = 3 OR issues = '' THEN 0 ELSE 1 END AS n_flags FROM c",
    "open_flags": f"{_YEARS} SELECT row_index, 'YearBuilt' AS field, issues AS issue, raw AS current_value FROM c WHERE issues <> '' AND row_index % 8 <> 3",
    "column_profile": f"{_V}, h AS (SELECT row_index, PolicyID, YearBuilt, BuildingValue FROM v ORDER BY row_index LIMIT 20), u AS (SELECT row_index, unnest(['PolicyID', 'YearBuilt', 'BuildingValue']) AS column_name, unnest([{_BLANK('PolicyID')}, {_BLANK('YearBuilt')}, {_BLANK('BuildingValue')}]) AS cell FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY row_index) AS rn FROM u WHERE cell IS NOT NULL) SELECT column_name, string_agg(cell, '|' ORDER BY rn) AS samples FROM r WHERE rn <= 3 GROUP BY 1",
    "ep_curve": """WITH l AS (SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE) % 1000 AS year, l_extendedprice AS loss FROM lineitem),
y AS (SELECT year, max(loss) AS oep, sum(CAST(loss AS DECIMAL(38,2)))::DOUBLE AS aep FROM l GROUP BY 1),
c AS (SELECT 'oep' AS curve, oep AS loss FROM y UNION ALL SELECT 'aep', aep FROM y), r AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY loss DESC) AS rank FROM c),
p(return_period) AS (VALUES (10), (25), (50), (100), (250), (500), (1000)), k(curve) AS (VALUES ('oep'), ('aep'))
SELECT p.return_period, k.curve, round(1.0 / p.return_period, 6)::DOUBLE AS exceedance_probability, coalesce(r.loss, 0) AS loss_amount FROM p CROSS JOIN k LEFT JOIN r ON r.curve = k.curve AND r.rank = greatest(1, 1000 // p.return_period)""",
    "stream_clean": f"SELECT event_id AS row_index, {_EVENT_MONEY} AS BuildingValue, 'USD' AS Currency FROM events",
}

SQL["geocode_components"] = """WITH r AS (
  SELECT c_custkey AS row_index, n_nationkey AS k, n_name, c_custkey AS i, c_name AS a,
    CASE WHEN c_custkey % 7 = 0 THEN 'provided' WHEN c_custkey % 10 = 0 OR length(n_name) < 5 THEN 'insufficient_address' WHEN n_nationkey % 2 = 0 THEN 'geocoded' ELSE 'failed' END AS Geocode_Status
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT *, Geocode_Status = 'geocoded' AS g, CASE WHEN i % 3 <> 0 THEN trim(concat(a, ', Town ', k, ', 1000', k)) END AS s FROM r)
SELECT row_index, Geocode_Status,
  CASE WHEN g AND k % 4 = 0 THEN 'Place Street 5' WHEN g THEN coalesce(nullif(trim(regexp_replace(CASE WHEN i % 3 <> 0 THEN a ELSE n_name END, '[,\\s]+$', '')), ''), '') WHEN Geocode_Status = 'failed' THEN coalesce(s, n_name) ELSE s END AS Street,
  CASE WHEN g THEN concat('Town ', k) WHEN i % 2 = 0 THEN 'Own City' END AS City, CASE WHEN g AND k % 4 = 0 THEN 'TX' WHEN g AND k % 8 = 2 THEN 'ZZ' ELSE 'CA' END AS State,
  CASE WHEN g THEN concat('1000', k) ELSE '99999' END AS PostalCode, CASE WHEN g AND k % 4 = 0 THEN 'US' ELSE n_name END AS CountryISO,
  CASE WHEN g THEN k + 10.25 WHEN Geocode_Status = 'provided' THEN 12.5 END AS Latitude, CASE WHEN g THEN k - 60.5 WHEN Geocode_Status = 'provided' THEN 7.0 END AS Longitude,
  CASE WHEN g THEN 0.9 END AS Geo_Confidence, CASE WHEN g THEN CASE WHEN k % 4 = 0 THEN 'valid' WHEN k % 8 = 2 THEN 'invalid' ELSE 'missing' END END AS StateCodeValidation
FROM o"""
SQL["geocode_outcomes"] = f"WITH g AS ({SQL['geocode_join']}) SELECT " + ", ".join(f"count_if(Geocode_Status = '{k}') AS {k}" for k in ("provided", "geocoded", "failed", "insufficient_address")) + " FROM g"
SQL["qa_summary"] = f"""WITH y AS ({SQL['clean_years']}), c AS ({SQL['clean_currency']}), j AS (SELECT y.issues AS yi, c.issues AS ci, c.Currency_Conflicts AS k FROM y JOIN c USING (row_index)),
n AS (SELECT count(*) AS r, count_if(k) AS x, count_if(yi <> '') AS b, count_if(yi <> '' OR ci <> '') AS f, sum(CASE WHEN yi = '' THEN 0 ELSE 1 END + CASE WHEN ci = '' THEN 0 ELSE len(string_split(ci, '|')) END)::BIGINT AS t FROM j)
SELECT unnest(['rows', 'geocode_failures', 'low_occupancy_confidence', 'low_construction_confidence', 'currency_conflicts', 'bad_years', 'flagged_rows', 'flags']) AS label, unnest([r, 0, 0, 0, x, b, f, t]) AS value FROM n"""

SQL["normalize_rows"] = f"""WITH a AS ({SQL['clean_years']}), b AS ({SQL['clean_stories']}), c AS ({SQL['clean_count']}), d AS ({SQL['clean_area']}), e AS ({SQL['clean_values']}), f AS ({SQL['clean_sprinkler']}), g AS ({SQL['clean_name']}), p AS ({SQL['uniform_policy']})
SELECT row_index, p.PolicyID, row_number() OVER (ORDER BY row_index) AS LocationID, YearBuilt, NumberOfStories, RiskCount, GrossArea, BuildingValue, SprinklerSystem, LocationName, 'COM' AS LineOfBusiness
FROM a JOIN b USING (row_index) JOIN c USING (row_index) JOIN d USING (row_index) JOIN e USING (row_index) JOIN f USING (row_index) JOIN g USING (row_index) JOIN p USING (row_index)"""
SQL["clean_modifiers"] = f"""{_V} SELECT row_index, CASE roof WHEN '3' THEN 3 WHEN 'Clay Tiles' THEN 6 WHEN 'old slate roof' THEN 1 WHEN 'wood shingles, painted' THEN 7 WHEN NULL THEN NULL ELSE 0 END AS ROOFGEOM,
CASE roof WHEN 'Clay Tiles' THEN 'alias' WHEN 'old slate roof' THEN 'token' WHEN 'wood shingles, painted' THEN 'token' WHEN 'mystery' THEN 'default' ELSE '' END AS methods FROM v"""
SQL["context_rules"] = f"""{_V}, p AS (SELECT coalesce(upper({_BLANK('occ_scheme')}), '') AS scheme, {_BLANK('segment')} AS value, arg_min(lower(Nation), row_index) AS n FROM v WHERE {_BLANK('segment')} IS NOT NULL GROUP BY 1, 2)
SELECT scheme, value, CASE WHEN lower(value) = 'furniture' THEN CASE WHEN contains(n, 'a') THEN 'F1' WHEN contains(n, 'united') OR contains(n, 'peru') THEN 'F2' ELSE 'F9' END WHEN contains(n, 'china') THEN 'M1' END AS code FROM p WHERE lower(value) = 'furniture' OR (lower(value) = 'machinery' AND contains(n, 'china'))"""
SQL["dict_upsert"] = """WITH e AS (SELECT p_name AS code, min(p_type) AS d FROM part GROUP BY 1), c AS (SELECT DISTINCT n AS code FROM (SELECT p_brand, max(p_name) AS n FROM part WHERE p_size > 45 GROUP BY 1))
SELECT code, CASE WHEN c.code IS NOT NULL THEN 'new' ELSE d END AS description, CASE WHEN c.code IS NOT NULL THEN 'k' ELSE d END AS keywords FROM e FULL JOIN c USING (code) WHERE code NOT IN (SELECT p_name FROM part WHERE p_size = 1)"""
SQL["remembered_headers"] = f"WITH {_MEMORY}, h AS (SELECT DISTINCT 'USER-' || (c_custkey % 400) AS source_col FROM customer) SELECT source_col, canonical, CASE WHEN canonical IS NOT NULL THEN 1.0 END AS score FROM h LEFT JOIN m ON m.source_col_normalized = replace(lower(source_col), '-', ' ')"
SQL["cascade_thresholds"] = f"""{_CASCADE}, t AS (SELECT *, method = 'conflict' AND confidence < 0.85 AS low FROM c)
SELECT scheme, value, rows, CASE WHEN low THEN '100' ELSE code END AS code, CASE WHEN low THEN 0.0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN low THEN 'default' ELSE method END AS method FROM t"""
SQL["dict_keywords"] = "SELECT p_partkey::VARCHAR AS code, replace(p_type, ' ', '|') || CASE WHEN p_size < 10 THEN '|' || p_brand ELSE '' END AS keywords FROM part"
SQL["dict_first_category"] = "SELECT code, category, description FROM (SELECT p_brand AS code, p_type AS category, p_name AS description, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type, p_name) AS n FROM part) WHERE n = 1"
SQL["dict_aliases"] = "SELECT p_type AS section, p_brand AS code, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS aliases FROM part GROUP BY 1, 2"
SQL["dict_sections"] = "WITH s AS (SELECT p_partkey, ['roof_cover', 'wall_type', 'rms_roofsys', 'rms_cladsys', 'foundation_type', 'soft_story', 'other'][p_partkey % 7 + 1] AS section FROM part) SELECT * FROM s WHERE section LIKE 'rms%' OR section IN ('foundation_type', 'soft_story')"
SQL["memory_forget"] = f"WITH {_MEMORY} SELECT * FROM m WHERE source_col_normalized <> 'user 7'"
SQL["tfidf_topk"] = r"""WITH w AS (SELECT code, word, count(*) AS tf FROM (SELECT item_id::VARCHAR AS code, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM benchmark) WHERE length(word) > 1 GROUP BY 1, 2),
i AS (SELECT word, ln(((SELECT count(DISTINCT item_id) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM w GROUP BY 1),
c AS (SELECT code, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY code)) AS w FROM w JOIN i USING (word)),
q AS (SELECT text, word, count(*) AS tf FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM (SELECT DISTINCT text FROM conversations)) WHERE length(word) > 1 GROUP BY 1, 2),
t AS (SELECT text, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY text)) AS w FROM q JOIN i USING (word)),
n AS (SELECT text, code, round(sum(t.w * c.w), 6) AS similarity FROM t JOIN c USING (word) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, code) AS rank FROM n WHERE similarity > 0.1)
SELECT text, code, similarity, rank::INT AS rank, CASE WHEN similarity >= 0.65 THEN 0.68 WHEN similarity >= 0.45 THEN 0.58 WHEN similarity >= 0.25 THEN 0.48 ELSE 0.40 END::DOUBLE AS confidence FROM r WHERE rank <= 3"""
SQL["clean_address"] = f"""WITH s AS ({SQL['clean_street_city']}), c AS ({SQL['clean_country']}), z AS ({SQL['clean_postal']}), v AS ({SQL_VIEW}),
k(name) AS (VALUES ('argentina'),('brazil'),('canada'),('egypt'),('france'),('germany'),('india'),('indonesia'),('japan'),('kenya'),('china'),('romania'),('saudi arabia'),('vietnam'),('russia'),('united kingdom'),('united states')),
a AS (SELECT v.row_index, v.row_index % 6 AS n, s.street, s.city, c.country, country IS NULL OR country = 'US' AS us, coalesce(country = 'US', false) AS home, z.postal, {_BLANK('v.State')} AS st, {_BLANK('v.PostalCode')} AS zip,
  v.row_index % 5 = 1 AS numeric_city, {_BLANK('v.CountryISO')} IS NOT NULL AND lower({_BLANK('v.CountryISO')}) NOT IN (SELECT name FROM k) AS odd FROM v JOIN s USING (row_index) JOIN c USING (row_index) JOIN z USING (row_index))
SELECT row_index, street AS Street, city AS City, CASE WHEN NOT us THEN st WHEN n IN (0, 1, 3) THEN 'TX' END AS State, CASE WHEN us THEN postal ELSE zip END AS PostalCode, country AS CountryISO,
  array_to_string(list_sort(list_filter([CASE WHEN numeric_city THEN 'city_is_numeric' END, CASE WHEN us AND n = 2 THEN 'invalid_state_code' WHEN us AND n = 4 THEN 'unresolvable_state' END,
    CASE WHEN zip IS NULL THEN 'missing_postal' WHEN us THEN CASE n WHEN 1 THEN 'zip_padded' WHEN 2 THEN 'zip_plus4_stripped' WHEN 3 THEN 'invalid_zip_has_letters' END END, CASE WHEN odd THEN 'unresolvable_country' END,
    CASE n WHEN 1 THEN 'coordinates_reversed' WHEN 2 THEN 'coordinates_zero' WHEN 3 THEN 'non_numeric_coordinates' WHEN 5 THEN 'missing_lat_or_lon' END, CASE WHEN n = 1 THEN 'low_precision_coordinates' END,
    CASE WHEN home AND n IN (0, 1) THEN 'positive_longitude_in_us' END], lambda x: x IS NOT NULL)), '|') AS issues FROM a"""

# the abbreviations one after another, longest first
_SHORT = "urm=unreinforced masonry;rm=reinforced masonry;rc=reinforced concrete;rcc=reinforced concrete construction;wf=wood frame;sf=single family;mf=multi family;tilt=tilt-up concrete;src=steel reinforced concrete;smrf=steel moment resisting frame;mrf=moment resisting frame;cbf=concentrically braced frame;ebf=eccentrically braced frame;cmu=concrete masonry unit;sfr=single family residential;sfh=single family home;mfr=multi family residential;pc=precast concrete;lwf=light wood frame;bi=business interruption;tiv=total insured value;sqft=square feet;sqm=square meters;yb=year built;n/a=not available"
_EXPAND = "value"
for _pair in sorted(_SHORT.split(";"), key=lambda p: -len(p.split("=")[0])):
    _EXPAND = f"regexp_replace({_EXPAND}, '\\b{_pair.split('=')[0]}\\b', '{_pair.split('=')[1]}', 'gi')"
_COMPOUND = """k AS (SELECT DISTINCT CASE WHEN p_partkey % 31 = 0 THEN 'Blue rod and small bolt' ELSE ['URM walls', 'lwf', 'RC frame', 'cmu walls', 'Timber frame', 'HT', 'tilt', 'metal building', 'glulam', 'unknown frame', 'steel', 'wood office'][p_partkey % 12 + 1]
  || [' with ', ' over ', ' and ', ', '][p_size % 4 + 1] || ['brick veneer', 'wood roof', 'masonry walls', 'concrete foundation', 'wood floors', 'masonry front', 'a canopy', 'interior wood office in metal warehouse', 'attached wood office', 'n/a'][p_partkey % 10 + 1]
  || ' ' || string_split(p_name, ' ')[1] END AS value FROM part)"""
SQL["expand_abbreviations"] = f"WITH {_COMPOUND}, t AS (SELECT value FROM k UNION SELECT text FROM conversations) SELECT value, {_EXPAND} AS expanded FROM t"
# the rules as a table: what must stand in the text, in the order in which they are asked
_HITS = f"""WITH {_COMPOUND}, e AS (SELECT value, {_EXPAND} AS x, lower({_EXPAND}) AS t FROM k),
w AS (SELECT *, regexp_matches(t, 'masonry walls|concrete masonry unit walls') AS walls, regexp_matches(t, 'brick veneer|concrete foundation|masonry front|canopy|interior wood office') AS facade FROM e),
h AS (SELECT value, x <> value AS expanded, CASE
  WHEN NOT regexp_matches(t, ' with | over | and |unknown') THEN NULL
  WHEN contains(t, 'unreinforced masonry') THEN '119,Joisted Masonry,2,0.93,urm_governs_weakest'
  WHEN walls AND regexp_matches(t, 'wood roof|wood floors') THEN '119,Joisted Masonry,2,0.93,combustible_downgrade'
  WHEN contains(t, 'wood floors') AND regexp_matches(t, 'concrete|rc|masonry') THEN '141,Mixed Construction,2,0.92,mixed_construction'
  WHEN contains(t, 'attached wood office') AND contains(t, 'steel') THEN '141,Mixed Construction,2,0.86,mixed_construction'
  WHEN contains(t, 'wood office') AND contains(t, 'metal warehouse') THEN '152,Metal Building,3,0.90,primary_governs_interior_partition'
  WHEN regexp_matches(t, 'tilt-up') THEN '111,Masonry Non-Combustible,4,0.92,tilt_up_governs'
  WHEN regexp_matches(t, '\\bht\\b|glulam') AND walls THEN '104,Heavy Timber,7,0.92,heavy_timber_governs'
  WHEN facade AND contains(t, 'concrete frame') THEN '131,Concrete Frame,6,0.90,frame_governs' WHEN facade AND contains(t, 'metal building') THEN '152,Metal Building,3,0.90,frame_governs'
  WHEN facade AND contains(t, 'wood frame') THEN '101,Frame,1,0.90,frame_governs' WHEN facade AND contains(t, 'timber frame') THEN '100,Unknown,0,0.90,frame_governs'
  WHEN contains(t, 'unknown frame') THEN '119,Joisted Masonry,2,0.70,unknown_frame_conservative_downgrade' END AS hit FROM w),
r AS (SELECT value, expanded, string_split(hit, ',') AS p FROM h WHERE hit IS NOT NULL)"""
SQL["conflict_routing"] = f"""{_HITS} SELECT value, CASE p[3] WHEN '2' THEN 'F2' WHEN '3' THEN 'F3' WHEN '4' THEN 'F4' WHEN '5' THEN 'F5' WHEN '6' THEN 'F6' ELSE p[1] END AS code, p[4]::DOUBLE AS confidence, CASE WHEN p[3] IN ('2', '3', '4', '5', '6') THEN 'ISF' END AS scheme_override FROM r
UNION ALL SELECT value, 'F5', 0.97, 'ISF' FROM k WHERE value = 'Blue rod and small bolt'"""
SQL["conflict_hints"] = f"{_HITS} SELECT value, p[1] AS hint_code, p[2] AS hint_category, p[4]::DOUBLE AS hint_confidence, p[5] AS hint_rule, expanded FROM r"

SQL["tfidf_documents"] = SQL["tfidf_topk"].replace("FROM conversations", "FROM documents").replace("SELECT text, code, similarity, rank::INT", "SELECT md5(text) AS text_md5, code, similarity, rank::INT")
SQL["modifier_tokens"] = """WITH k AS (SELECT token, arg_min(code, o) AS code, min(o) AS o FROM (SELECT lower(unnest([array_to_string(string_split(p_name, ' ')[1:2], ' '), string_split(lower(p_type), ' ')[-1], string_split(lower(p_type), ' ')[1]])) AS token, p_partkey % 11 AS code, p_partkey AS o FROM part WHERE p_size % 5 = 0) GROUP BY 1),
t AS (SELECT DISTINCT p_name AS text, lower(p_name) AS key FROM part), a AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_size = 1),
m AS (SELECT key, arg_max(code, length(token) * 1000000 - o) AS code FROM (SELECT DISTINCT key FROM t) JOIN k ON contains(key, token) GROUP BY key)
SELECT text, CASE WHEN a.key IS NOT NULL THEN 11 ELSE coalesce(m.code, 0) END::INT AS code, CASE WHEN a.key IS NOT NULL THEN 'alias' WHEN m.code IS NOT NULL THEN 'token' ELSE 'default' END AS method, CASE WHEN a.key IS NOT NULL THEN 0.97 WHEN m.code IS NOT NULL THEN 0.85 ELSE 0 END::DOUBLE AS confidence
FROM t LEFT JOIN a USING (key) LEFT JOIN m USING (key)"""

SQL["stream_memory"] = SQL["memory_upsert"]
SQL["stage_slice"] = f"{_V} SELECT row_index, PolicyID, YearBuilt, BuildingValue FROM v ORDER BY row_index LIMIT 500 OFFSET 1000"
SQL["location_file"] = f"{_RMS} SELECT row_number() OVER (ORDER BY row_index) AS line_no, ACCNTNUM, CASE WHEN y = 9999 THEN '12/31/9999' WHEN y BETWEEN 1700 AND 2026 THEN '01/01/' || y ELSE y::VARCHAR END AS YEARBUILT, coalesce(e::VARCHAR, '') AS EQCV1VAL, coalesce(e::VARCHAR, '') AS TOCV1VAL, 'USD' AS FLCV1LCUR, 61 AS n_cells FROM r"
SQL["account_lines"] = f"WITH a AS ({SQL['account_file']}) SELECT 0 AS line_no, concat_ws(chr(9), 'ContractID', 'InsuredName', 'LayerID', 'LayerPerils') AS line UNION ALL SELECT row_number() OVER (ORDER BY encode(ContractID), LayerID), concat_ws(chr(9), ContractID, InsuredName, LayerID, LayerPerils) FROM a"

SQL["dict_registry"] = "SELECT p_partkey::VARCHAR AS code, CASE WHEN p_size % 2 = 0 THEN p_brand || '/' || string_split(p_type, ' ')[1] ELSE p_brand END AS path, p_name AS description, replace(p_type, ' ', '|') AS keywords FROM part"
SQL["dict_union"] = "SELECT p_partkey::VARCHAR AS code, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS description, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE replace(p_type, ' ', '|') END AS keywords, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS registry FROM part"
SQL["scanned_table"] = "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, c_name || ', ' || c_mktsegment AS Name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS Segment FROM customer"

# likeness by the longest common subsequence: one step per letter on the bits of all places of the other text
_SORTED = lambda c: f"array_to_string(list_sort(list_filter(regexp_split_to_array(lower(trim({c})), '\\s+'), lambda w: w <> '')), ' ')"
_LIKE = f"""h AS (SELECT DISTINCT p_name AS source_col, {_SORTED('p_name')} AS x FROM part),
a AS (SELECT DISTINCT p_type AS alias, string_split(p_type, ' ')[1] AS canonical, {_SORTED('p_type')} AS y FROM part),
b AS (SELECT *, length(y) AS n, list_distinct(string_split(y, '')) AS cs FROM a),
m AS (SELECT *, (1::BIGINT << n) - 1 AS every, map(cs, list_transform(cs, lambda c: list_sum(list_transform(range(n), lambda i: CASE WHEN y[i + 1] = c THEN 1::BIGINT << i ELSE 0 END))::BIGINT)) AS masks FROM b),
p AS (SELECT source_col, alias, canonical, length(x) + n AS total, n - bit_count(list_reduce(list_prepend(every, list_transform(string_split(x, ''), lambda c: coalesce(masks[c], 0))), lambda v, k: ((v + (v & k)) | (v & ~k)) & every)) AS common FROM h, m),
s AS (SELECT source_col, alias, canonical, round(200.0 * common / total, 4)::DOUBLE AS score FROM p WHERE round(200.0 * common / total, 4) >= 30),
t AS (SELECT *, row_number() OVER (PARTITION BY source_col ORDER BY score DESC, alias, canonical) AS rn FROM s),
o AS (SELECT source_col, canonical, max(score) AS score FROM t WHERE rn <= 5 GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY source_col ORDER BY score DESC, canonical)::INT AS rank FROM o)"""
SQL["fuzzy_topk"] = f"WITH {_LIKE} SELECT * FROM f WHERE rank <= 3"
SQL["weak_suggestions"] = f"WITH {_LIKE} SELECT source_col, max(score) AS best FROM f WHERE rank <= 3 GROUP BY 1 HAVING max(score) < 72"
SQL["merged_suggestions"] = f"""WITH {_LIKE}, k AS (SELECT source_col, canonical, score FROM (SELECT *, max(score) OVER (PARTITION BY source_col) AS best FROM f WHERE rank <= 3) WHERE score >= 0.85 * best UNION ALL SELECT p_name, p_brand, p_size * 1.0 FROM part),
g AS (SELECT source_col, canonical, max(score)::DOUBLE AS score FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source_col ORDER BY score DESC, canonical)::INT AS rank FROM g) SELECT * FROM r WHERE rank <= 3"""
