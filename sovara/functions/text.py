"""Column expressions for text cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_filled(*cells: Column) -> Column:
    """The first cell that is not blank."""
    return F.coalesce(*map(blank_to_null, cells))


def first_valid(*cells: Column) -> Column:
    """The first cell that is neither blank nor `nan`."""
    return F.coalesce(*[F.when(~F.lower(F.trim(c)).isin("", "nan"), c) for c in cells])


def number(c: Column) -> Column:
    """The plain number in a cell, else null; forms that only a cast would take (`1d`, `nan`) are no numbers."""
    text = F.trim(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def lenient_number(c: Column) -> Column:
    """A number without currency signs and separators; what cannot be read is 0."""
    return F.coalesce(number(F.regexp_replace(c.cast("string"), r"[$€£¥₹,\s]", "")), F.lit(0.0))


def simplify(c: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def header_key(c: Column) -> Column:
    """A header as the memory of confirmed mappings knows it."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", " ")


def title_case(c: Column) -> Column:
    """Capitals after every character that is not a letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match of the pattern replaced by change(match)."""
    between = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(change(b), F.lit("")))), "")


def expand_words(text: Column, table: dict[str, str]) -> Column:
    """Whole words replaced by the table, whatever their case, in one walk over the text: the longest one at a place wins."""
    if not table:
        return text
    words = "|".join(rf"\Q{w}\E" for w in sorted(table, key=lambda w: (-len(w), w)))
    full = {w.lower(): v for w, v in table.items()}
    return rewrite(text, rf"(?i)\b(?:{words})\b", lambda w: look_up(F.lower(w), full))


def look_up(key: Column, table: dict[str, object]) -> Column:
    """The value of a key in a small fixed table, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: t != "")), " ")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by one fold over the rows of the dynamic programme."""
    letters = F.split(b, "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(before: Column, letter: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)),
            lambda now, j: F.concat(now, F.array(F.when(F.get(letters, j - 1) == letter, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.get(now, j - 1))))),
        )

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(F.split(a, ""), start, row), -1))


#: Longest text whose places fit the bits of a bigint that additions do not overflow.
MASK_LENGTH = 61


def letter_masks(c: Column) -> Column:
    """letter -> the places where it stands, as bits; null for texts longer than MASK_LENGTH."""
    letters = F.split(c, "")
    places = lambda x: F.aggregate(F.transform(letters, lambda y, i: F.when(y == x, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda m, bit: m.bitwiseOR(bit))
    return F.when(F.length(c) <= MASK_LENGTH, F.map_from_entries(F.transform(F.array_distinct(letters), lambda x: F.struct(x, places(x)))))


def masked_common_length(a: Column, masks: Column, length: Column) -> Column:
    """common_length of a and a text of which masks and length are given: one step per letter of a, on all places at once."""
    every = F.call_function("shiftleft", F.lit(1).cast("bigint"), length) - 1
    hit = lambda x: F.coalesce(F.try_element_at(masks, x), F.lit(0).cast("bigint"))
    step = lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(every)
    left = F.aggregate(F.transform(F.split(a, ""), hit), every, step)
    return F.when((F.length(a) == 0) | (length == 0), F.lit(0)).otherwise(length - F.bit_count(left))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Likeness from 0 to 100 of two texts with their words in order: 200 * common / (length + length)."""
    x, y = token_sort(a), token_sort(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common_length(x, y) / total)


def text_table(df: DataFrame) -> DataFrame:
    """All cells trimmed, blank cells null."""
    return df.select([blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
