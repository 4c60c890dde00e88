"""Stage tables: one parquet table partitioned by upload and stage, its files clustered by row_index.

Beside the rows stands an index with a row per file: first and last row_index and number of rows. A slice looks up the files
that hold it and reads no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _labelled(df: DataFrame, upload_id: str, stage: str) -> DataFrame:
    """The rows with their labels, dealt into ranges of row_index and sorted within them."""
    rows = df.withColumns({"upload_id": F.lit(upload_id), "stage": F.lit(stage)})
    return rows.repartitionByRange("row_index").sortWithinPartitions("row_index") if "row_index" in df.columns else rows


def _write_index(spark: SparkSession, root: str, upload_id: str, stage: str) -> None:
    """The index of a stage, from one column of its files; its folder is hidden from readers of the table."""
    rows = load_stage(spark, root, upload_id, stage)
    if "row_index" in rows.columns:
        index = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("row_index").alias("first"), F.max("row_index").alias("last"), F.count("*").alias("rows"))
        index.coalesce(1).write.mode("overwrite").parquet(_index_path(root, upload_id, stage))


def _index_path(root: str, upload_id: str, stage: str) -> str:
    return f"{root}/_index/{upload_id}/{stage}"


def save_stage(df: DataFrame, root: str, upload_id: str, stage: str) -> None:
    """Replaces the rows of one stage of one upload; other partitions stay."""
    _labelled(df, upload_id, stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id", "stage").parquet(root)
    _write_index(df.sparkSession, root, upload_id, stage)


def append_stage(df: DataFrame, root: str, upload_id: str, stage: str) -> None:
    _labelled(df, upload_id, stage).write.mode("append").partitionBy("upload_id", "stage").parquet(root)
    _write_index(df.sparkSession, root, upload_id, stage)


def load_stage(spark: SparkSession, root: str, upload_id: str, stage: str) -> DataFrame:
    """The stage's rows; only its partition is read."""
    return spark.read.parquet(root).filter((F.col("upload_id") == upload_id) & (F.col("stage") == stage)).drop("upload_id", "stage")


def load_slice(spark: SparkSession, root: str, upload_id: str, stage: str, offset: int, rows: int) -> DataFrame:
    """`rows` rows from the offset on, in the order of row_index.

    Only the files are read whose ranges hold the slice. Where ranges of files overlap, as after appending rows of earlier
    numbers, the whole stage is sorted.
    """
    index = spark.read.parquet(_index_path(root, upload_id, stage))  # a row per file
    order = Window.orderBy("first", "last")
    placed = index.withColumns({"before": F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows"), "clash": F.lag("last").over(order) >= F.col("first")})
    inside = (F.col("before") < offset + rows) & (F.col("before") + F.col("rows") > offset)
    at = placed.agg(F.coalesce(F.bool_or("clash"), F.lit(False)).alias("clash"), *[f(F.when(inside, F.col(c))).alias(c) for f, c in ((F.min, "first"), (F.max, "last"), (F.min, "before"))]).first()
    stage_rows = load_stage(spark, root, upload_id, stage)
    if at["clash"]:
        return stage_rows.orderBy("row_index").offset(offset).limit(rows)
    if at["first"] is None:
        return stage_rows.limit(0)
    return stage_rows.filter(F.col("row_index").between(at["first"], at["last"])).orderBy("row_index").offset(offset - at["before"]).limit(rows)


def row_count(spark: SparkSession, root: str, upload_id: str, stage: str) -> int:
    return load_stage(spark, root, upload_id, stage).count()


def delete_upload(spark: SparkSession, root: str, upload_id: str) -> None:
    """Removes the partitions and the index of an upload through the file system of the table."""
    jvm = spark.sparkContext._jvm
    for name in (f"{root}/upload_id={upload_id}", f"{root}/_index/{upload_id}"):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
