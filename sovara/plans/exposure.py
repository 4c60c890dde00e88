"""The exposure view: locations with messy text cells, derived from orders, customer and nation by one portable SQL text.

The same text runs in Spark (tables as parameters) and in DuckDB (tables by name), so queries and their SQL see equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEW = """
SELECT o_orderkey AS row_index,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'P' || CAST(o_custkey % 500 AS STRING) END AS "PolicyID",
  c_name AS "InsuredName",
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '  Site #' || CAST(o_orderkey AS STRING) || '! ' WHEN o_orderkey % 5 = 2 THEN 'Warehouse & Logistics Centre of ' || c_name || ' (North)' ELSE 'Plant ' || CAST(o_orderkey AS STRING) END AS "LocationName",
  CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN LOWER(n_name) ELSE n_name END AS "CountryISO",
  r_name AS "Area",
  n_name AS "Nation",
  o_orderdate AS "When",
  CASE o_orderkey % 8 WHEN 0 THEN CAST(y AS STRING) WHEN 1 THEN CAST(y AS STRING) || '/' || CAST(y + 15 AS STRING)
    WHEN 2 THEN 'Built ' || CAST(y AS STRING) || ', roof replaced ' || CAST(y + 10 AS STRING) WHEN 3 THEN '198X'
    WHEN 4 THEN CAST(y - 1900 AS STRING) WHEN 5 THEN '' WHEN 6 THEN 'unknown' ELSE 'renovated ' || CAST(y + 5 AS STRING) || ', built ' || CAST(y AS STRING) END AS "YearBuilt",
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(y + 20 AS STRING) ELSE '' END AS "YearRetrofitted",
  CASE o_orderkey % 8 WHEN 0 THEN CAST(1 + o_custkey % 9 AS STRING) WHEN 1 THEN CAST(1 + o_custkey % 4 AS STRING) || ' + ' || CAST(2 + o_custkey % 3 AS STRING) WHEN 2 THEN 'G+' || CAST(1 + o_custkey % 9 AS STRING)
    WHEN 3 THEN CAST(2 + o_custkey % 5 AS STRING) || '.5' WHEN 4 THEN CAST(1 + o_custkey % 3 AS STRING) || '-' || CAST(5 + o_custkey % 4 AS STRING) WHEN 5 THEN '-2' WHEN 6 THEN 'tall' ELSE '' END AS "NumberOfStories",
  CASE o_orderkey % 9 WHEN 0 THEN CAST(1 + o_custkey % 40 AS STRING) WHEN 1 THEN '8 units in ' || CAST(1 + o_custkey % 6 AS STRING) || ' buildings' WHEN 2 THEN CAST(2 + o_custkey % 6 AS STRING) || ' buildings + clubhouse' WHEN 3 THEN 'various'
    WHEN 4 THEN CAST(1 + o_custkey % 6 AS STRING) || '-' || CAST(3 + o_custkey % 9 AS STRING) WHEN 5 THEN CAST(1 + o_custkey % 6 AS STRING) || '.5' WHEN 6 THEN '-4' WHEN 7 THEN 'Single Building' ELSE '' END AS "RiskCount",
  CASE o_orderkey % 7 WHEN 0 THEN '10,' || CAST(100 + o_custkey % 900 AS STRING) || ' sq ft' WHEN 1 THEN CAST(2 + o_custkey % 50 AS STRING) || 'k' WHEN 2 THEN '1,200 + ' || CAST(300 + o_custkey % 500 AS STRING) WHEN 3 THEN CAST(10 + o_custkey % 90 AS STRING) WHEN 4 THEN '5 acres' WHEN 5 THEN 'included' ELSE '' END AS "GrossArea",
  CASE o_orderkey % 8 WHEN 0 THEN '$' || CAST(v AS STRING) WHEN 1 THEN CAST(v AS STRING) || 'K' WHEN 2 THEN '€' || CAST(v AS STRING) WHEN 3 THEN 'n/a' WHEN 4 THEN '-5000' WHEN 5 THEN 'abc' WHEN 6 THEN '' ELSE CAST(v AS STRING) END AS "BuildingValue",
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(v % 40000 AS STRING) ELSE '' END AS "ContentsValue",
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(v % 9000 AS STRING) || ' USD' ELSE NULL END AS "TimeElementValue",
  CASE o_orderkey % 5 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN '' WHEN 3 THEN 'XXY' ELSE NULL END AS "Currency",
  CASE WHEN o_orderkey % 6 = 0 THEN 'GBP' WHEN o_orderkey % 6 = 1 THEN '100 EUR' ELSE NULL END AS "EQCV1LCUR",
  CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' ELSE NULL END AS "SprinklerSystem",
  CASE o_orderkey % 6 WHEN 0 THEN CAST(10000 + o_custkey % 80000 AS STRING) WHEN 1 THEN CAST(1000 + o_custkey % 9000 AS STRING) WHEN 2 THEN '77002' || CAST(1000 + o_custkey % 9000 AS STRING) WHEN 3 THEN '77A02' WHEN 4 THEN 'TX ' || CAST(10000 + o_custkey % 80000 AS STRING) ELSE '' END AS "PostalCode",
  CASE o_orderkey % 6 WHEN 0 THEN 'Texas' WHEN 1 THEN 't x' WHEN 2 THEN 'ZZ' WHEN 3 THEN 'Dallas, TX' WHEN 4 THEN 'nowhere land' ELSE '' END AS "State",
  CASE o_orderkey % 6 WHEN 0 THEN '29.' || CAST(1000 + o_custkey % 9000 AS STRING) WHEN 1 THEN '95.25' WHEN 2 THEN '0' WHEN 3 THEN 'n.a.' WHEN 4 THEN '' ELSE '41.5' END AS "Latitude",
  CASE o_orderkey % 6 WHEN 0 THEN '95.' || CAST(1000 + o_custkey % 9000 AS STRING) WHEN 1 THEN '-29.75' WHEN 2 THEN '0' WHEN 3 THEN '10.5' WHEN 4 THEN '' ELSE '' END AS "Longitude",
  CASE o_orderkey % 4 WHEN 0 THEN '12-14 N Main St.' WHEN 1 THEN 'P.O. Box ' || CAST(o_custkey AS STRING) WHEN 2 THEN CAST(o_custkey AS STRING) || ' oak ave suite 200' ELSE CAST(o_custkey AS STRING) || ' S Elm Rd Rd' END AS "Street",
  CASE o_orderkey % 5 WHEN 0 THEN 'Ft Worth, TX 76102' WHEN 1 THEN '77002' WHEN 2 THEN 'AUSTIN - Downtown' WHEN 3 THEN 'houston (TX)' ELSE 'new york city city' END AS "City",
  CASE WHEN o_orderkey % 3 = 0 THEN 'ATC' WHEN o_orderkey % 3 = 1 THEN '' ELSE 'custom' END AS occ_scheme,
  CASE WHEN o_orderkey % 3 = 2 THEN c_mktsegment ELSE CAST(1 + o_custkey % 60 AS STRING) END AS occupancy,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ISO' WHEN o_orderkey % 4 = 1 THEN 'RMS' ELSE '' END AS const_scheme,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 9 AS STRING) WHEN o_orderkey % 4 = 1 THEN CAST(1 + o_custkey % 8 AS STRING)
    ELSE CASE o_custkey % 8 WHEN 0 THEN 'Steel frame with masonry infill walls' WHEN 1 THEN 'CMU walls with wood roof joists' WHEN 2 THEN 'Tilt-up concrete walls with steel roof deck' WHEN 3 THEN 'Concrete podium with wood upper floors'
      WHEN 4 THEN 'Heavy timber with masonry walls' WHEN 5 THEN 'Brick exterior, unknown frame' WHEN 6 THEN 'wood frame' ELSE 'unreinforced masonry and steel roof' END END AS construction,
  CASE o_orderkey % 6 WHEN 0 THEN '3' WHEN 1 THEN 'Clay Tiles' WHEN 2 THEN 'old slate roof' WHEN 3 THEN 'wood shingles, painted' WHEN 4 THEN '' ELSE 'mystery' END AS roof,
  c_mktsegment AS segment, o_orderpriority AS priority, y AS order_year, v AS price, p_size_of AS stories_number
FROM (
  SELECT o.*, c.c_name, c.c_mktsegment, n.n_name, r.r_name, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(FLOOR(o_totalprice) AS BIGINT) AS v, CAST(o_custkey % 12 AS INT) AS p_size_of
  FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
)
"""

TABLES = ("orders", "customer", "nation", "region")
#: The view for DuckDB.
SQL_VIEW = VIEW.replace("AS STRING", "AS VARCHAR").format(**{t: t for t in TABLES})


def spread(table: DataFrame) -> DataFrame:
    """A table that fewer tasks would read than there are cores is dealt to all of them; a large one stays where it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view for Spark."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(VIEW.replace('"', "`"), **(tables | {"orders": spread(tables["orders"])}))
