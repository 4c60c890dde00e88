"""Streaming ingest: the stateless cleaning jobs run unchanged on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sovara.operators.mapping import MEMORY_COLUMNS, merge_memories, upsert_memory


def clean_stream(stream: DataFrame, jobs: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A stream through cleaning jobs; those that number or compare rows of a whole table do not apply."""
    for job in jobs:
        stream = stream.transform(job)
    return stream


def start_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all available rows to a parquet table, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """number -> path of the complete tables `<path>/<name>-<number>`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = [s.getPath() for s in files.listStatus(root) if "-" in s.getPath().getName() and files.exists(hadoop(s.getPath(), "_SUCCESS"))]
    return {int(p.getName().split("-")[1]): p.toString() for p in found}


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _parts(spark: SparkSession, path: str, upto: int | None = None) -> tuple[int, list[str]]:
    """The last compacted batch and what makes up the memory up to a batch: its table and the deltas since."""
    within = lambda found: {n: p for n, p in found.items() if upto is None or n <= upto}
    bases, deltas = within(_folders(spark, f"{path}/base")), within(_folders(spark, f"{path}/delta"))
    last = max(bases, default=-1)
    return last, [*([bases[last]] if bases else []), *(p for n, p in sorted(deltas.items()) if n > last)]


def read_memory(spark: SparkSession, path: str) -> DataFrame | None:
    """The memory of confirmed mappings that a stream keeps; None before its first batch."""
    _, parts = _parts(spark, path)
    return merge_memories(spark.read.parquet(*parts).select(MEMORY_COLUMNS)) if parts else None


def compact_memory(spark: SparkSession, path: str, upto: int) -> None:
    """Writes the memory up to a batch as one table and removes what the compaction before made needless.

    The table that it starts from stays until the next compaction, for those who read it now. A compaction that runs twice
    writes the same table again.
    """
    last, parts = _parts(spark, path, upto)
    if last < upto and parts:
        merge_memories(spark.read.parquet(*parts).select(MEMORY_COLUMNS)).write.mode("overwrite").parquet(f"{path}/base/upto-{upto}")
    for kind in ("base", "delta"):
        for number, old in _folders(spark, f"{path}/{kind}").items():
            if number < last or (kind == "delta" and number <= last):
                _remove(spark, old)


def start_memory(confirmed: DataFrame, path: str, checkpoint: str, compact_every: int = 50) -> StreamingQuery:
    """Keeps a memory of confirmed mappings: batch n writes what it adds per (header, target), <path>/delta/batch-n.

    A batch costs what it holds, not what the memory holds; every `compact_every` batches the deltas are merged. A batch that runs
    twice overwrites its own delta, so counts stay right after a failure.
    """

    def add(batch: DataFrame, number: int) -> None:
        upsert_memory(None, batch).write.mode("overwrite").parquet(f"{path}/delta/batch-{number}")
        if (number + 1) % compact_every == 0:
            compact_memory(batch.sparkSession, path, number)

    return confirmed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
