"""Quality rules as a bitmask ledger, in DataFrame operations only.

`ledger` reads a text once, measures it and stores one bit for each rule that the text fails. What to keep is decided
afterwards on the bits: a policy is a named, versioned mask, and a document is kept if none of the mask's bits is set. What
each rule removes, alone or together with others, is one aggregation over the bits (`ablation`), without reading texts.

Repeated three-word windows are found inside the row: windows are hashed, sorted by (hash, position), and positions whose
neighbour has the same hash are kept; no shuffle is needed, and a long text costs n log n.

Null text counts as empty: no words, so `few_words` fails. Empty tables give empty results; repeated rows and null doc_ids
give one row each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit i of `failed` belongs to rule i. The first two are the base rules.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {
    "base": Policy("base", 1, BASE),
    "default": Policy("default", 1, (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words")),
}


def _repeated(windows: Column) -> Column:
    """Of the sorted (hash, position) windows, the positions that share their hash with a neighbour, in order."""
    n = F.size(windows)
    kept = F.filter(windows, lambda x, i: F.coalesce(x["h"] == F.get(windows, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(windows, i + 1)["h"], F.lit(False)))
    return F.when(n > 1, F.array_sort(F.transform(kept, lambda x: x["p"]))).otherwise(F.array().cast("array<int>"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of its text, one row per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = r"[\x20\x09-\x0D]+"
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.length(F.regexp_replace("text", blank, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter(F.split("text", blank), lambda x: x != "").alias("words"),
    )
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", F.size("words").cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform(F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, greatest(size(words) - 1, 0))").alias("b"), F.expr("slice(words, 3, greatest(size(words) - 2, 0))").alias("c")),
                    lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.cast("int").alias("p"))).alias("windows"),
    )
    # the zip runs to the last word: its last two entries are not windows of three words
    rows = rows.withColumn("windows", F.sort_array(F.expr("slice(windows, 1, cast(greatest(n_words - 2, 0) as int))")))
    rows = rows.withColumn("repeats", _repeated(F.col("windows"))).drop("windows")
    covered = F.aggregate("repeats", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `failed`: bit i is set if rule i of RULES fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs).withColumn("failed", failed.cast("bigint"))


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds base_failed, kept and the policy's name and version to ledger entries."""
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return entries.select("*", hit(POLICIES["base"].mask).alias("base_failed"), (~hit(policy.mask | POLICIES["base"].mask)).alias("kept"), F.lit(f"{policy.name}/{policy.version}").alias("policy"))


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that a policy without it would keep."""
    inside = F.col("failed").bitwiseAND(F.lit(policy.mask))
    counts = [
        F.struct(F.lit(r).alias("rule"), F.count_if(inside.bitwiseAND(F.lit(1 << list(RULES).index(r))) != 0).alias("failed"), F.count_if(inside == (1 << list(RULES).index(r))).alias("failed_alone"), F.count_if(inside.bitwiseAND(F.lit(policy.mask & ~(1 << list(RULES).index(r)))) == 0).alias("kept_without"))
        for r in policy.rules
    ]
    return entries.agg(F.array(*counts).alias("rules")).select(F.inline("rules"))
