"""Loading of code dictionaries from JSON: nested categories become rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sovara.sources.scratch import written

def registry(texts: DataFrame) -> DataFrame:
    """JSON texts (value) of nested categories to rows: path (the categories from the outermost), code, description, keywords.

    An object with a description or keywords is an entry, whatever its depth, and its key is the code; names that begin with an
    underscore are notes. One explosion per level goes down until no objects are left.
    """
    level = texts.select(F.array().cast("array<string>").alias("path"), F.parse_json("value").alias("object"))
    found = []
    while level is not None:
        level.createOrReplaceTempView("registry_level")
        each = level.sparkSession.sql("SELECT path, e.key, e.value FROM registry_level, LATERAL variant_explode(object) AS e WHERE NOT startswith(e.key, '_')")
        each = each.filter("schema_of_variant(value) LIKE 'OBJECT%'").withColumn("entry", F.expr("try_variant_get(value, '$.description', 'string') IS NOT NULL OR try_variant_get(value, '$.keywords', 'array<string>') IS NOT NULL"))
        each = written(each.select("path", "key", F.to_json("value").alias("json"), "entry"))
        found.append(each.filter("entry").select("path", F.col("key").alias("code"), *[F.expr(f"try_variant_get(parse_json(json), '$.{name}', '{kind}')").alias(name) for name, kind in (("description", "string"), ("keywords", "array<string>"))]))
        deeper = each.filter("NOT entry")
        level = deeper.select(F.concat("path", F.array("key")).alias("path"), F.parse_json("json").alias("object")) if deeper.limit(1).count() else None
    return reduce(DataFrame.unionByName, found)


def read_codes(spark: SparkSession, path: str, priority: list[str] | None = None) -> DataFrame:
    """Nested categories -> code -> {description, keywords} as rows (code, category, description, keywords, priority).

    The category is the outermost one; an entry that stands in several has a row in each.
    """
    rows = registry(spark.read.text(path, wholetext=True)).select("code", F.get("path", F.lit(0)).alias("category"), "description", "keywords")
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("category")) if priority else F.lit(0)
    return rows.withColumn("priority", F.when(rank > 0, rank).otherwise(F.lit(1 << 20)).cast("int"))


def union_registries(*registries: DataFrame) -> DataFrame:
    """One row per code of several registries (code, description, keywords); the first that has a code wins, and says which it is."""
    every = reduce(DataFrame.unionByName, [r.select("code", "description", "keywords", F.lit(i).alias("registry")) for i, r in enumerate(registries)])
    best = every.groupBy("code").agg(F.min_by(F.struct("description", "keywords", "registry"), F.struct("registry", "description")).alias("best"))
    return best.select("code", "best.*")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """section -> alias -> code as rows (section, alias, code)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return text.select(F.explode("m").alias("section", "aliases")).select("section", F.explode("aliases").alias("alias", "code"))


def write_export(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").option("header", True).csv(path)
