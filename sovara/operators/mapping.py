"""Column mapping over many uploads: suggestions, checks, memory of confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sovara.functions.text import blank_to_null, common_length, header_key, letter_masks, masked_common_length, token_sort


def apply_column_map(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Renames by the map: the first source of a canonical name wins and fills it where it is null; other columns stay."""
    out, done = df, set()
    for source, canonical in mapping.items():
        if canonical and source in df.columns and canonical not in done and source != canonical:
            done.add(canonical)
            own = F.col(f"`{canonical}`") if canonical in out.columns else F.lit(None).cast("string")
            out = out.withColumn(canonical, F.coalesce(own, F.col(f"`{source}`"))).drop(source)
    return out


def mapping_conflicts(column_map: DataFrame) -> DataFrame:
    """Canonical names that an upload claims more than once."""
    return column_map.filter("canonical is not null").groupBy("upload_id", "canonical").agg(F.array_sort(F.collect_set("source_col")).alias("sources")).filter("size(sources) > 1")


def missing_required(uploads: DataFrame, required: DataFrame, column_map: DataFrame) -> DataFrame:
    """Required canonical names that an upload does not map. required is a short fixed list."""
    need = uploads.select("upload_id").distinct()
    wanted = required.agg(F.collect_set("canonical").alias("all"))
    return need.crossJoin(F.broadcast(wanted)).select("upload_id", F.explode("all").alias("canonical")).join(column_map.select("upload_id", "canonical"), ["upload_id", "canonical"], "left_anti")


def remembered(headers: DataFrame, memory: DataFrame, target: str) -> DataFrame:
    """Headers with the canonical name that was confirmed before; score 1.0, null if unknown."""
    known = memory.filter(F.col("target_format") == target).select(F.col("source_col_normalized").alias("_key"), "canonical")
    return headers.withColumn("_key", header_key(F.col("source_col"))).join(known, "_key", "left").withColumn("score", F.when(F.col("canonical").isNotNull(), 1.0)).drop("_key")


def _profiles(texts: DataFrame, text: str, cutoff: float) -> DataFrame:
    """Of each text: `x`, its words in order, `n` its length, `marks` (its letters, each with how often it came before), `low` and
    `high` (bits that the marks are hashed to) and `masks`."""
    rows = texts.withColumn("x", token_sort(F.col(text))).withColumn("n", F.length("x")).withColumn("letters", F.split("x", ""))
    rows = rows.withColumn("marks", F.expr("transform(letters, (c, i) -> concat(c, ':', size(filter(slice(letters, 1, i + 1), d -> d = c))))"))
    bits = lambda half: F.expr(f"aggregate(marks, 0L, (b, m) -> if(pmod(xxhash64(m), 2) = {half}, b | shiftleft(1L, cast(pmod(xxhash64(m) div 2, 63) as int)), b))")
    return rows.withColumns({"low": bits(0), "high": bits(1), "masks": letter_masks(F.col("x"))}).drop("letters")


def _prefixes(rows: DataFrame, seen: DataFrame, key: str, cutoff: float) -> DataFrame:
    """key, mark: the rarest marks of each text, as many as one must share with any text that is alike enough.

    A partner of length m shares t = cutoff * (n + m) / 200 letters or more, and is itself that long, so m and t are at least
    n * cutoff / (200 - cutoff). Two texts that share t of their marks share one among the first n - t + 1, in one order of all marks.
    """
    least = F.ceil(F.col("n") * cutoff / (200 - cutoff) - 1e-9).cast("int")
    each = rows.select(key, "n", F.explode("marks").alias("mark")).join(seen, "mark", "left")
    ordered = each.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "mark"))).alias("marks"))
    some = ordered.select(key, F.explode(F.slice("marks", F.lit(1), F.greatest(F.col("n") - least + 1, F.lit(1)))).alias("m")).select(key, "m.mark")
    return some.union(rows.filter("n = 0").select(key, F.lit("").alias("mark")))


def fuzzy_pairs(headers: DataFrame, aliases: DataFrame, cutoff: float) -> DataFrame:
    """source_col, alias, canonical, score of all pairs of distinct headers and aliases that reach the cutoff.

    Candidates meet in an equi-join on rare letters (see _prefixes), are dropped by lengths and by the bits of their letters, which
    bound the common subsequence, and are scored once. No pair that reaches the cutoff is lost, of whatever alphabet.
    """
    if not 0 < cutoff <= 100:
        raise ValueError("the cutoff must be above 0 and at most 100")
    left = _profiles(headers.select("source_col").distinct().filter("source_col is not null"), "source_col", cutoff)
    right = _profiles(aliases.select("alias").distinct().filter("alias is not null"), "alias", cutoff)
    seen = right.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("texts"))
    about = ["n", "low", "high"]
    a = _prefixes(left, seen, "source_col", cutoff).join(left.select("source_col", *about), "source_col")
    b = _prefixes(right, seen, "alias", cutoff).join(right.select("alias", *[F.col(c).alias(f"{c}2") for c in about]), "alias")
    lacking = lambda x, y: f"bit_count(low{x} & ~low{y}) - bit_count(high{x} & ~high{y})"  # noqa: E731  letters that the other has not
    shared = f"least(n - {lacking('', '2')}, n2 - {lacking('2', '')})"
    met = a.join(b, "mark").filter(f"200 * {shared} >= {cutoff} * (n + n2)").select("source_col", "alias").distinct()
    texts = met.join(left.select("source_col", "x", "masks"), "source_col").join(right.select("alias", F.col("x").alias("y"), F.col("masks").alias("masks2")), "alias")
    n, m = F.length("x"), F.length("y")
    common = F.when(F.col("masks2").isNotNull(), masked_common_length(F.col("x"), F.col("masks2"), m)).when(F.col("masks").isNotNull(), masked_common_length(F.col("y"), F.col("masks"), n)).otherwise(common_length(F.col("x"), F.col("y")))
    scored = texts.withColumn("score", F.bround(F.when(n + m == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common / (n + m)), 4)).filter(F.col("score") >= cutoff)
    return scored.select("source_col", "alias", "score").join(aliases.select("alias", "canonical").distinct(), "alias").select("source_col", "alias", "canonical", "score")


def fuzzy_matches(headers: DataFrame, aliases: DataFrame, cutoff: float = 60.0, best: int = 5, keep: int = 3) -> DataFrame:
    """Per distinct header: its `keep` likest canonical names among its `best` likest aliases. aliases: alias, canonical."""
    by_alias = Window.partitionBy("source_col").orderBy(F.desc("score"), "alias", "canonical")
    top = fuzzy_pairs(headers, aliases, cutoff).withColumn("rn", F.row_number().over(by_alias)).filter(F.col("rn") <= best)
    return best_suggestions(top.select("source_col", "canonical", "score"), keep)


def best_suggestions(scored: DataFrame, keep: int = 3) -> DataFrame:
    """One suggestion per canonical name, the `keep` best of a header, ranked."""
    one = scored.groupBy("source_col", "canonical").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("source_col").orderBy(F.desc("score"), "canonical"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= keep)


def merge_suggestions(fuzzy: DataFrame, semantic: DataFrame, share: float = 0.85) -> DataFrame:
    """Suggestions of a second scorer first; fuzzy ones stay if they reach a share of the header's best."""
    best = fuzzy.groupBy("source_col").agg(F.max("score").alias("best"))
    kept = fuzzy.join(best, "source_col").filter(F.col("score") >= share * F.col("best")).select("source_col", "canonical", "score")
    return best_suggestions(kept.union(semantic.select("source_col", "canonical", "score")))


def low_scores(suggestions: DataFrame, least: float = 72.0) -> DataFrame:
    """Headers whose best suggestion is weak."""
    return suggestions.groupBy("source_col").agg(F.max("score").alias("best")).filter(F.col("best") < least)


def upsert_memory(memory: DataFrame | None, confirmed: DataFrame) -> DataFrame:
    """Memory with new confirmations (source_col, target_format, canonical, at): the latest name wins, counts add up."""
    new = confirmed.filter("canonical is not null").select(header_key(F.col("source_col")).alias("source_col_normalized"), "target_format", "canonical", F.lit(1).cast("bigint").alias("confirmed_count"), F.col("at").alias("first_confirmed"), F.col("at").alias("last_confirmed"))
    return merge_memories(new if memory is None else memory.select(new.columns).unionByName(new))


MEMORY_COLUMNS = ["source_col_normalized", "target_format", "canonical", "confirmed_count", "first_confirmed", "last_confirmed"]


def merge_memories(rows: DataFrame) -> DataFrame:
    """One row per header and target of the rows of several memories."""
    return rows.groupBy("source_col_normalized", "target_format").agg(
        F.max_by("canonical", F.struct("last_confirmed", "canonical")).alias("canonical"), F.sum("confirmed_count").alias("confirmed_count"),
        F.min("first_confirmed").alias("first_confirmed"), F.max("last_confirmed").alias("last_confirmed"),
    )


def forget(memory: DataFrame, source_col: Column, target: str) -> DataFrame:
    return memory.filter(~((F.col("source_col_normalized") == header_key(source_col)) & (F.col("target_format") == target)))


def memory_statistics(memory: DataFrame) -> DataFrame:
    return memory.groupBy("target_format").agg(F.count("*").alias("entries"), F.sum("confirmed_count").alias("confirmations")).orderBy("target_format")


def column_profile(df: DataFrame, rows: int = 20, keep: int = 3) -> DataFrame:
    """The first `keep` filled cells among the first `rows` rows, per column."""
    names = [c for c in df.columns if c != "row_index"]
    head = df.orderBy("row_index").limit(rows).select("row_index", *[blank_to_null(F.col(f"`{c}`")).alias(c) for c in names])
    cells = head.unpivot(["row_index"], names, "column_name", "cell").filter("cell is not null")
    order = Window.partitionBy("column_name").orderBy("row_index")
    top = cells.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep)
    return top.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "cell"))), lambda x: x["cell"]), "|").alias("samples"))
