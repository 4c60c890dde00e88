"""Reading and writing of exposure files; all cells are text."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sovara.functions.text import blank_to_null
from sovara.operators.layout import account_rows, fixed_layout
from sovara.sources.scratch import written

POLICY_COLUMNS = ("Policy_ID", "Account_ID", "Policy_Limit", "Policy_Deductible", "Coverage_Type", "Policy_Type")


def unique_names(names: list[str]) -> list[str]:
    """Trimmed names; a repeated one gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in (n.strip() for n in names):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def add_row_index(df: DataFrame) -> DataFrame:
    """Numbers 0..n-1 in file order, without moving rows: sizes of the partitions before are added to places within them."""
    rows = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per input partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").withColumn("row_index", F.col("_before") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_before")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are not blank, as they are, with file, split and a number that grows within the split."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    return lines.filter(F.trim("line") != "").withColumn("_id", F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, multiline: bool = False) -> DataFrame:
    """A delimited file, or files in the order of their names, as trimmed text cells with `row_index`.

    The file is read twice at most: once for what a row per split tells (its lines, whether all are UTF-8, the first line of
    all), and once for the cells. Without an encoding, a file with one line that is no UTF-8 is latin-1. Blank lines are
    skipped, missing cells null, cells beyond the header dropped; a byte order mark is not part of the first name. Cells with
    line breaks need `multiline`; a file is then one task, as it cannot be split.
    """
    if multiline:
        return _read_multiline(spark, path, sep, encoding)
    rows = _numbered_lines(spark, path)
    text = lambda name: F.decode(F.col("line").cast("binary"), name)
    splits = rows.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.count_if(~F.is_valid_utf8("line")).alias("_bad"), F.min_by(F.col("line").cast("binary"), "_id").alias("_line"))
    splits = written(splits)  # a row per split
    about = splits.agg(F.sum("_bad").alias("bad"), F.min_by("_line", F.struct("_path", "_start")).alias("line")).first()
    if about["line"] is None:
        return spark.createDataFrame([], "row_index bigint")
    encoding = encoding or ("ISO-8859-1" if about["bad"] else "UTF-8")
    cells = next(csv.reader([bytes(about["line"]).decode(encoding, "replace").removeprefix("\ufeff")], delimiter=sep))
    names = unique_names([c.strip() or f"column_{i}" for i, c in enumerate(cells, 1)])
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select("_path", "_start", (before - F.col("_first")).alias("_shift"))
    numbered = rows.join(F.broadcast(shifts), ["_path", "_start"]).select((F.col("_id") + F.col("_shift") - 1).alias("row_index"), (F.col("line") if encoding == "UTF-8" else text(encoding)).alias("line")).filter("row_index >= 0")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = numbered.select("row_index", F.from_csv("line", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("cells"))
    return parsed.select("row_index", *[blank_to_null(F.col(f"cells.c{i}")).alias(n) for i, n in enumerate(names)])


def _read_multiline(spark: SparkSession, path: str, sep: str, encoding: str | None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", False).option("inferSchema", False).option("multiLine", True).option("quote", '"').option("escape", '"')
    if encoding is None:
        lines = spark.read.text(path)
        encoding = "ISO-8859-1" if lines.filter(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"
    rows = add_row_index(reader.option("encoding", encoding).csv(path))
    header = rows.filter("row_index = 0").drop("row_index").first()
    names = unique_names([(h or "").strip().removeprefix("\ufeff") or f"column_{i}" for i, h in enumerate(header, 1)])
    body = rows.filter("row_index > 0").withColumn("row_index", F.col("row_index") - 1)
    return body.select("row_index", *[blank_to_null(F.col(c)).alias(n) for c, n in zip(header.__fields__, names, strict=True)])


def read_policies(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A policy file and the required columns that it lacks."""
    df = read_table(spark, path)
    return df, [c for c in POLICY_COLUMNS if c not in df.columns]


def write_ordered(df: DataFrame, order: list[str], path: str, sep: str = "\t") -> None:
    """Delimited text whose parts, one after another in the order of their names, are the rows in order below one header.

    The columns in `order` sort the rows and are written if they do not begin with an underscore. Ranges are sorted side by side.
    """
    names = [c for c in df.columns if not c.startswith("_")]
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names]), {"sep": sep, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    rows = df.select(F.lit(1).alias("_below"), *order, line.alias("_line"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("_below"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order], F.lit(sep.join(names)).alias("_line"))
    keys = ["_below", *order]
    head.union(rows).repartitionByRange(*keys).sortWithinPartitions(*keys).select("_line").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a text or of the parts of one, in the order of their names; each is numbered where it is read."""
    own = ["_metadata.file_path", "_metadata.file_block_start"]
    rows = spark.read.text(path).select(F.col("value").alias("line"), *[F.col(c).alias(f"_{c.split('_')[-1]}") for c in own]).withColumn("_id", F.monotonically_increasing_id())
    splits = rows.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # a row per split
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_path", "_start", (before - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(splits), ["_path", "_start"]).select((F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def write_locations(df: DataFrame, path: str, target: str) -> None:
    """Location file, tab-separated, in the target's column order and in the order of row_index."""
    write_ordered(fixed_layout(df, target, "row_index"), ["_row_index"], path)


def write_accounts(df: DataFrame, path: str, target: str) -> None:
    """Account or contract file, ordered by its first columns."""
    rows = account_rows(df, target)
    write_ordered(rows, ["ACCNTNUM", "POLICYNUM"] if target == "RMS" else ["ContractID", "LayerID"], path)
