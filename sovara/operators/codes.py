"""Classification of occupancy and construction texts by a cascade of dictionary joins.

The cascade runs once per distinct (scheme, value); its stages are candidate columns and the first that hits wins. Texts and
dictionaries meet in equi-joins (whole texts, words), not in nested loops: a keyword phrase can only be contained in a text
if the text has the phrase's longest word in it, so phrases are dealt by word first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sovara.functions.text import blank_to_null, expand_words, simplify
from sovara.rules import Rules
from sovara.sources.scratch import written

#: Words that more codes of a TF-IDF table have are looked up only for pairs that other words found; entries of a table that may be
#: broadcast; pairs of texts and codes that a task may hold; keys of texts that a task remembers, to send copies once. They decide
#: how work is dealt, not what is found.
COMMON, BROADCAST_ENTRIES, PAIRS, REMEMBERED = 1000, 1 << 18, 1_000_000, 100_000

# Labels, classes and tokens that the results depend on.
ATC_SCHEMES = ("ATC", "ATC_CLASS", "ATC_OCC", "OCCTYPE", "OCC_TYPE", "RMS", "RMS_OCC", "RMS_OCC_CODE", "RMSATC")
ISO_SCHEMES = ("ISO", "ISO_CLASS", "FIRE_CLASS", "ISF", "ISO_FIRE_CLASS")
ISO_LABELS = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "F", "JM", "NC", "MNC", "MFR", "FR", "HTJM", "SNC", "SMNC")
RMS_SCHEMES = ("RMS", "RMS_CONST", "RMS_OCC")
URM = ("unreinforced masonry", "urm", "unconfined masonry", "plain masonry")
MASONRY_WALLS = (
    "masonry walls", "brick walls", "cmu walls", "concrete masonry unit walls", "concrete block walls", "block walls", "masonry load-bearing", "masonry bearing", "urm walls", "unreinforced masonry walls",
)
COMBUSTIBLE = (
    "wood roof", "wood joist", "wood truss roof", "combustible roof", "wood deck", "wood planking", "wood joists", "wood upper floor", "wood upper level", "wood upper", "wood floors", "wood floor", "wood framing",
    "wood penthouse", "wood mezzanine",
)
TILT_UP = ("tilt-up", "tilt up", "tilt wall", "tilt panel")
HEAVY_TIMBER = ("heavy timber", "ht", "hvy timber", "glulam", "glulam timber", "cross laminated timber", "clt", "post and beam timber")
FACADE = (
    "masonry infill", "brick veneer", "masonry veneer", "stone veneer", "glass curtain wall", "curtain wall", "glass facade", "precast panels", "precast cladding", "masonry exterior", "masonry front", "masonry facade",
    "concrete infill", "infill walls", "canopy", "steel canopy", "foundation", "concrete foundation", "wood mezzanine", "wood partition", "wood office interior", "interior wood office",
)
#: Frames in the order in which they govern: token, code, category, ISO class.
FRAMES = (
    ("concrete frame", "131", "Concrete Frame", "6"), ("rc frame", "131", "Concrete Frame", "6"), ("reinforced concrete frame", "131", "Concrete Frame", "6"), ("steel moment frame", "155", "Steel Frame", "5"),
    ("steel braced frame", "153", "Steel Frame", "5"), ("steel frame", "151", "Steel Frame", "5"), ("heavy timber", "104", "Heavy Timber", "7"), ("pre-engineered metal building", "152", "Metal Building", "3"),
    ("metal building", "152", "Metal Building", "3"), ("wood frame", "101", "Frame", "1"), ("light wood frame", "102", "Frame", "1"), ("tilt-up", "111", "Masonry Non-Combustible", "4"), ("tilt up", "111", "Masonry Non-Combustible", "4"),
    ("timber frame", "100", "Unknown", "0"), ("tilt wall", "100", "Unknown", "0"),
)
#: Systems side by side: both texts, then code, category, ISO class.
ADJACENT = (
    ("attached wood office", "steel", "141", "Mixed Construction", "2"), ("wood office", "metal warehouse", "152", "Mixed Construction", "0"), ("concrete block office", "steel warehouse", "141", "Mixed Construction", "2"),
    ("masonry addition", "metal building", "141", "Mixed Construction", "2"), ("concrete parking", "steel office", "100", "Unknown", "0"), ("wood office extension", "steel", "141", "Mixed Construction", "2"),
)
UNKNOWN_FRAME = ("unknown frame", "unknown interior", "frame unknown", "unknown construction", "unspecified frame", "insufficient data")
ABBREVIATIONS = {
    "urm": "unreinforced masonry", "rm": "reinforced masonry", "rc": "reinforced concrete", "rcc": "reinforced concrete construction", "wf": "wood frame", "sf": "single family", "mf": "multi family",
    "tilt": "tilt-up concrete", "src": "steel reinforced concrete", "smrf": "steel moment resisting frame", "mrf": "moment resisting frame", "cbf": "concentrically braced frame", "ebf": "eccentrically braced frame",
    "cmu": "concrete masonry unit", "sfr": "single family residential", "sfh": "single family home", "mfr": "multi family residential", "pc": "precast concrete", "lwf": "light wood frame", "bi": "business interruption",
    "tiv": "total insured value", "sqft": "square feet", "sqm": "square meters", "yb": "year built", "n/a": "not available",
}
COMPOUND = (" with ", " over ", " and ", " + ", " & ", " attached to ", " lower level", " upper level", " upper floor", " podium", " penthouse", " extension", " addition", "unknown")


def distinct_pairs(df: DataFrame, scheme: str, value: str, *context: str) -> DataFrame:
    """Distinct (scheme, value) with the context of the first row and the number of rows; blank values are left out."""
    pair = df.select("row_index", F.coalesce(F.upper(blank_to_null(F.col(scheme))), F.lit("")).alias("scheme"), blank_to_null(F.col(value)).alias("value"), *context)
    first = [F.min_by(c, "row_index").alias(c) for c in context]
    return pair.filter("value is not null").groupBy("scheme", "value").agg(F.min("row_index").alias("first_row"), F.count("*").alias("rows"), *first)


def enrich(df: DataFrame, codes: DataFrame, scheme: str, value: str, prefix: str) -> DataFrame:
    """Writes the results of the distinct pairs to all rows as <prefix>_Code, _Confidence, _Method and _Scheme."""
    found = codes.select(F.col("scheme").alias("_s"), F.col("value").alias("_v"), F.col("code").alias(f"{prefix}_Code"), F.col("confidence").alias(f"{prefix}_Confidence"), F.col("method").alias(f"{prefix}_Method"), F.col("scheme_override").alias("_o"))
    rows = df.withColumns({"_scheme": F.coalesce(F.upper(blank_to_null(F.col(scheme))), F.lit("")), "_value": blank_to_null(F.col(value))})
    joined = rows.join(found, (F.col("_scheme") == F.col("_s")) & (F.col("_value") == F.col("_v")), "left")
    return joined.withColumn(f"{prefix}_Scheme", F.coalesce("_o", F.nullif("_scheme", F.lit("")))).drop("_s", "_v", "_o", "_scheme", "_value")


def is_atc(scheme: Column, value: Column) -> Column:
    """Occupancy classes 1-54 by scheme name, or by the bare number when there is no scheme."""
    n = F.when(value.rlike(r"^\d{1,2}$"), value.cast("int"))
    return scheme.isin(*ATC_SCHEMES) | ((scheme == "") & (n.between(1, 39) | n.between(42, 44) | n.between(47, 54)))


def is_iso(scheme: Column, value: Column) -> Column:
    return scheme.isin(*ISO_SCHEMES) | ((scheme == "") & F.upper(value).isin(*ISO_LABELS))


def by_class(pairs: DataFrame, classes: DataFrame, applies: Column, method: str, confidence: float = 1.0) -> DataFrame:
    """Equi-join with a class table (key, code, and optionally rank, scheme_override); the lowest rank wins."""
    table = classes.withColumn("rank", F.lit(0)) if "rank" not in classes.columns else classes
    over = F.col("scheme_override") if "scheme_override" in classes.columns else F.lit(None).cast("string")
    first = table.groupBy(F.upper("key").alias("key")).agg(F.min_by(F.struct("code", over.alias("scheme_override")), F.struct("rank", "code")).alias("hit"))
    hits = pairs.filter(applies).select("scheme", "value", F.upper(F.trim("value")).alias("key")).join(first, "key")
    return hits.select("scheme", "value", F.col("hit.code").alias("code"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"), F.col("hit.scheme_override").alias("scheme_override"))


def by_text(pairs: DataFrame, lookup: DataFrame, method: str = "raw_lookup") -> DataFrame:
    """Whole normalized text, then without its last parenthesis, then its parts between slashes, in this order. lookup: text, code, confidence."""
    text = simplify(F.col("value"))
    bare = simplify(F.regexp_replace("value", r"\s*\([^)]*\)\s*$", ""))
    keys = F.array_distinct(F.concat(F.array(text, bare), F.transform(F.split("value", "/"), simplify)))
    table = lookup.groupBy(simplify(F.col("text")).alias("key")).agg(F.max_by(F.struct("code", "confidence"), F.struct("confidence", "code")).alias("hit"))
    tried = pairs.select("scheme", "value", F.posexplode(keys).alias("pos", "key")).join(table, "key")
    best = tried.groupBy("scheme", "value").agg(F.min_by("hit", "pos").alias("hit"))
    return best.select("scheme", "value", "hit.code", F.col("hit.confidence").cast("double").alias("confidence"), F.lit(method).alias("method"), F.lit(None).cast("string").alias("scheme_override"))


def by_context(pairs: DataFrame, rules: DataFrame, context: Column) -> DataFrame:
    """Terms whose code depends on signals in the row's text. rules: term, ordinal, signals (array; null: default), code."""
    rows = pairs.select("scheme", "value", simplify(F.col("value")).alias("term"), F.lower(context).alias("_context")).join(rules, "term")
    hit = F.exists(F.coalesce("signals", F.array().cast("array<string>")), lambda s: F.contains(F.col("_context"), s))
    rank = F.when(hit, F.col("ordinal")).when(F.col("signals").isNull(), F.lit(1 << 30))
    best = rows.withColumn("rank", rank).filter("rank is not null").groupBy("scheme", "value").agg(F.min_by("code", "rank").alias("code"))
    return best.select("scheme", "value", "code", F.lit(0.9).alias("confidence"), F.lit("context").alias("method"), F.lit(None).cast("string").alias("scheme_override"))


def _any(text: Column, tokens: tuple[str, ...]) -> Column:
    """Whether the text has one of the tokens: single words as whole words, phrases anywhere."""
    return text.rlike("|".join(rf"\Q{t}\E" if " " in t else rf"\b\Q{t}\E\b" for t in tokens))


def _inside(text: Column, *parts: str) -> Column:
    """Whether one of the parts stands anywhere, also within words."""
    return text.rlike("|".join(rf"\Q{p}\E" for p in parts))


def conflict(text: Column) -> Column:
    """struct(code, category, iso_class, confidence, rule) of a compound construction text, null if no rule applies.

    Precedence: the weakest system governs, then combustible parts on masonry, mixed systems, tilt-up, heavy timber, the
    frame before its facade, and last the cautious reading of an unknown frame. A light wood frame is found as the wood frame
    that it contains, which comes first.
    """
    t = F.lower(F.trim(text))
    res = lambda code, category, iso, confidence, rule: F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(iso).alias("iso_class"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))
    first = lambda cases: reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0]))
    mixed = res("141", "Mixed Construction", "2", 0.92, "mixed_construction")
    beside = []
    for part, whole, code, category, iso in ADJACENT:
        both = _inside(t, part) & _inside(t, whole)
        if "wood office" in part and "metal" in whole:
            beside.append((both & _inside(t, "interior"), res("152", "Metal Building", "3", 0.90, "primary_governs_interior_partition")))
        beside.append((both, res(code, category, iso, 0.86, "mixed_construction")))
    frame = first([(_any(t, (token,)), res(code, category, iso, 0.90, "frame_governs")) for token, code, category, iso in FRAMES])
    unknown = _any(t, UNKNOWN_FRAME) | (_inside(t, "unknown") & _inside(t, "frame", "interior", "structure"))
    rules = first([
        (_any(t, URM), res("119", "Joisted Masonry", "2", 0.93, "urm_governs_weakest")),
        (_any(t, MASONRY_WALLS) & _any(t, COMBUSTIBLE) & ~_inside(t, "partition", "interior office", "mezzanine"), res("119", "Joisted Masonry", "2", 0.93, "combustible_downgrade")),
        (_inside(t, "wood upper", "wood floors", "wood penthouse") & _inside(t, "concrete", "rc"), mixed), (_inside(t, "wood upper", "wood floors") & _inside(t, "masonry", "cmu"), mixed), *beside,
        (_inside(t, "cmu", "concrete masonry") & _inside(t, "wood upper", "wood level", "wood floor"), res("141", "Mixed Construction", "2", 0.91, "mixed_construction")),
        (_any(t, TILT_UP), res("111", "Masonry Non-Combustible", "4", 0.92, "tilt_up_governs")), (_any(t, HEAVY_TIMBER) & _any(t, MASONRY_WALLS), res("104", "Heavy Timber", "7", 0.92, "heavy_timber_governs")),
        (_any(t, tuple(f[0] for f in FRAMES)) & _any(t, FACADE), frame), (unknown, res("119", "Joisted Masonry", "2", 0.70, "unknown_frame_conservative_downgrade")),
    ])
    return F.when(_inside(t, *COMPOUND), rules)


def conflict_hits(pairs: DataFrame, scenarios: DataFrame | None = None, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """scheme, value, rule, expanded: exact scenarios (text, code, confidence, optional category and iso_class) first, then the rules.

    Abbreviations are written out before either is asked.
    """
    text = expand_words(F.trim("value"), abbreviations or {})
    rows = pairs.select("scheme", "value", text.alias("_text")).withColumn("expanded", F.col("_text") != F.trim("value"))
    # exploded rather than filtered: a filter would carry the long expression below the aggregation of the pairs
    rows = rows.select("scheme", "value", "expanded", F.lower("_text").alias("_key"), F.explode_outer(F.array(conflict(F.col("_text")))).alias("rule"))
    if scenarios is not None:
        about = lambda c: F.col(c) if c in scenarios.columns else F.lit(None).cast("string")
        hit = F.struct(F.col("code"), about("category").alias("category"), about("iso_class").alias("iso_class"), F.col("confidence").cast("double").alias("confidence"), F.lit("exact_scenario").alias("rule"))
        rows = rows.join(scenarios.select(F.lower(F.trim("text")).alias("_scenario"), hit.alias("_hit")), F.col("_key") == F.col("_scenario"), "left").withColumn("rule", F.coalesce("_hit", "rule"))
    return rows.filter(F.col("rule.code").isNotNull()).select("scheme", "value", "rule", "expanded")


def by_conflict(pairs: DataFrame, scenarios: DataFrame | None = None, abbreviations: dict[str, str] | None = None, isf: DataFrame | None = None, target: str = "AIR") -> DataFrame:
    """The stage of conflict rules. isf: key (ISO class), code, of the classes that are written as fire classes.

    Only the AIR target takes these codes; for others there is no hit, and conflict_hints has what was found. A class other than
    1 with a fire class gets that code and the scheme ISF.
    """
    hits = conflict_hits(pairs, scenarios, abbreviations)
    if target != "AIR":
        hits = hits.filter("false")
    if isf is not None:
        fire = isf.filter("key <> '1' AND code IS NOT NULL").groupBy("key").agg(F.min("code").alias("_fire"))
        hits = hits.join(fire, F.col("rule.iso_class") == F.col("key"), "left")
    else:
        hits = hits.withColumn("_fire", F.lit(None).cast("string"))
    return hits.select("scheme", "value", F.coalesce("_fire", "rule.code").alias("code"), "rule.confidence", F.lit("conflict").alias("method"), F.when(F.col("_fire").isNotNull(), "ISF").alias("scheme_override"))


def conflict_hints(pairs: DataFrame, rules: Rules, scenarios: DataFrame | None = None, abbreviations: dict[str, str] | None = None, target: str = "AIR") -> DataFrame:
    """What the conflict rules found and do not decide: all of it for targets other than AIR, else what is below the threshold."""
    hits = conflict_hits(pairs, scenarios, abbreviations)
    low = F.lit(True) if target != "AIR" else F.col("rule.confidence") < rules.deterministic_score_threshold
    return hits.filter(low).select("scheme", "value", F.col("rule.code").alias("hint_code"), F.col("rule.category").alias("hint_category"), F.col("rule.confidence").alias("hint_confidence"), F.col("rule.rule").alias("hint_rule"), "expanded")


def keyword_scores(texts: DataFrame, codes: DataFrame, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """Scores of all codes that share anything with a text. texts: text; codes: code, description, keywords, ordinal.

    Returns text, code, score, expanded. A keyword scores 1.0 as the whole text, 0.7 and 0.05 for each further word inside
    it, 0.5 if the text is inside the keyword, 0.2 for a common word of more than 3 letters; a description inside the text 0.3.
    Containment is of characters, also within words: what has no three letters in a row meets on its first one or two characters.
    """
    lower = F.lower("text")
    expanded = expand_words(lower, {k.lower(): v.lower() for k, v in (abbreviations or {}).items()})
    rows = texts.select("text").distinct().withColumn("query", expanded).withColumn("expanded", F.col("query") != lower)
    words = F.array_distinct(F.filter(F.split("query", r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    terms = codes.select("code", F.lower("description").alias("description"), F.posexplode_outer(F.transform("keywords", F.lower)).alias("pos", "keyword"))
    shape = lambda c: F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    # pieces of words: a phrase inside a text shares a word with it or begins or ends within one, so pairs meet on trigrams of words
    grams = lambda ws: F.array_distinct(F.flatten(F.transform(ws, lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))))
    key = lambda c: F.explode(grams(shape(c)))
    phrase = F.concat_ws(" ", "keyword", "description")
    pairs = rows.select("query", key(F.col("query")).alias("gram")).join(terms.select("code", "pos", key(phrase).alias("gram")), "gram").select("query", "code", "pos")
    # a phrase without a trigram: one of its pairs of characters (or its only character) stands in whatever contains it
    short = lambda c: (F.length(c) > 0) & ~c.rlike(r"[\p{L}\p{N}]{3}")
    head = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"[\p{L}\p{N}]{2}", 0), F.lit("")), F.left(c, F.lit(2)))
    inside = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(F.substr(c, i, F.lit(1)), F.substr(c, i, F.lit(2)))))))
    signs = F.coalesce(F.filter(F.split("keyword", r"\s+"), lambda w: (F.length(w) > 3) & ~w.rlike(r"[\p{L}\p{N}]")), F.array().cast("array<string>"))
    needles = terms.select("code", "pos", F.explode(F.concat(F.array("keyword", "description"), signs)).alias("needle")).filter(short(F.col("needle")))
    in_text = rows.filter(F.length("query") > 0).select("query", inside(F.col("query")).alias("gram")).join(needles.select("code", "pos", head(F.col("needle")).alias("gram")), "gram").select("query", "code", "pos")
    asked = rows.filter(short(F.col("query"))).select("query", head(F.col("query")).alias("gram"))
    in_keyword = asked.join(terms.filter(F.length("keyword") > 0).select("code", "pos", inside(F.col("keyword")).alias("gram")), "gram").select("query", "code", "pos")
    pairs = pairs.union(in_text).union(in_keyword).distinct()
    scored = pairs.join(rows.select("query", "text", "expanded", words.alias("words")), "query").join(terms, ["code", "pos"])
    k, q = F.col("keyword"), F.col("query")
    long = F.filter(F.split(k, r"\s+"), lambda w: F.length(w) > 3)
    points = F.when(k == q, 1.0).when(F.contains(q, k), F.lit(0.7) + (F.size(F.split(k, r"\s+")) - 1) * 0.05).when(F.contains(k, q), 0.5).when(F.arrays_overlap(long, F.split(q, r"\s+")), 0.2).otherwise(0.0)
    described = F.max(F.when((F.col("description") != "") & F.contains(q, F.col("description")), 0.3).otherwise(0.0))
    return scored.groupBy("text", "expanded", "code").agg(F.bround(F.sum(points) + described, 4).alias("score")).filter("score > 0")


def best_codes(scores: DataFrame, codes: DataFrame) -> DataFrame:
    """Per text: best code, its confidence, and up to two alternatives."""
    order = Window.partitionBy("text").orderBy(F.desc("score"), "ordinal", "code")
    ranked = scores.join(codes.select("code", "ordinal"), "code").withColumns({"rn": F.row_number().over(order), "next": F.lead("score").over(order)}).filter("rn <= 3")
    top = F.max(F.when(F.col("rn") == 1, F.struct("code", "score", "next", "expanded")))
    rest = F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "code", "score"))))
    base = F.when(F.col("top.score") >= 1.5, 0.95).when(F.col("top.score") >= 1.0, 0.90).when(F.col("top.score") >= 0.7, 0.85).when(F.col("top.score") >= 0.5, 0.75).otherwise(0.65)
    less = F.when(F.col("top.expanded"), 0.10).otherwise(0.0) + F.when(F.col("top.score") - F.col("top.next") < 0.2, 0.10).otherwise(0.0)
    out = ranked.groupBy("text").agg(top.alias("top"), rest.alias("rest")).withColumn("confidence", F.bround(F.least(F.lit(0.95), F.greatest(F.lit(0.0), base - less)), 4))
    alternatives = F.transform("rest", lambda a: F.struct(a["code"].alias("code"), F.bround(F.col("confidence") * a["score"] / F.col("top.score") * 0.85, 3).alias("confidence")))
    return out.select("text", F.col("top.code").alias("code"), F.col("top.score").alias("score"), "confidence", alternatives.alias("alternatives"))


def _unit(weights: DataFrame, key: str) -> DataFrame:
    """key, word, w with vectors of length 1."""
    size = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return weights.join(size, key).select(key, "word", (F.col("w") / F.col("size")).alias("w"))


def _weighed_words(named: DataFrame, words: DataFrame, tokens, least: float) -> DataFrame:
    """key, word, w (vectors of length 1), and whether a text must look the word up to find its neighbours.

    Words are taken from the most common of the table on. As long as their weights times the largest weight that the table has
    for each, or the length of what they make up, stay below `least`, they cannot reach it alone; of these, words that more than
    COMMON codes have need not be looked up.
    """
    asked = named.select("key", tokens(F.col("text")).alias("word")).join(words, "word")  # words that no code has count for nothing
    weighed = asked.groupBy("key", "word").agg((F.count("*") * F.min("idf")).alias("w"), F.min("codes").alias("codes"), F.min("most").alias("most"))
    order = Window.partitionBy("key").orderBy(F.desc("codes"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    square = F.col("w") * F.col("w")
    weighed = weighed.withColumns({"size": F.sqrt(F.sum(square).over(whole)), "bound": F.least(F.sum(F.col("w") * F.col("most")).over(upto), F.sqrt(F.sum(square).over(upto)))})
    return weighed.select("key", "word", (F.col("w") / F.col("size")).alias("w"), ((F.col("codes") <= COMMON) | (F.col("bound") / F.col("size") >= least - 1e-6)).alias("looked_up"))


def dealt_once(texts: DataFrame, tasks: int) -> DataFrame:
    """text, key: the distinct texts, dealt by key in one shuffle. A task drops the copies it has just seen before, so a text that
    very many rows have is sent a few times by each task; the copies that are left meet where they are sent."""
    remembered = REMEMBERED

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > remembered:
                seen.clear()
            keys, fresh = batch.column("key").to_pylist(), []
            for key in keys:
                fresh.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    named = texts.filter("text is not null").select("text", F.unhex(F.md5("text")).alias("key")).mapInArrow(unseen, "text string, key binary")
    return named.repartition(tasks, "key").distinct()


def tfidf_neighbours(texts: DataFrame, codes: DataFrame, top: int = 3, least: float = 0.1) -> DataFrame:
    """The codes whose vocabulary is nearest by TF-IDF cosine. texts: text; codes: code, words (text). Returns text, code, similarity, rank.

    Words are weighed by the codes' table. Texts are shuffled once, by key, and all that follows for a text happens where it lies:
    neither its words nor its pairs are shuffled, unless the codes' table is too large to be broadcast. A word that very many
    codes have is no meeting point of all with all: what it adds is looked up for the pairs that other words found.
    """
    tokens = lambda c: F.explode(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))
    n = codes.select("code").distinct().count()  # size of the dictionary
    counted = codes.select("code", tokens(F.col("words")).alias("word")).groupBy("code", "word").agg(F.count("*").alias("tf"))
    idf = counted.groupBy("word").agg((F.log((F.lit(n) + 1) / (F.count("*") + 1)) + 1).alias("idf"), F.count("*").alias("codes"))
    left = written(_unit(counted.join(idf, "word").select("code", "word", (F.col("tf") * F.col("idf")).alias("w")), "code")).withColumnRenamed("w", "w2")
    words = written(idf.join(left.groupBy("word").agg(F.max("w2").alias("most")), "word", "left"))
    side = F.broadcast if left.count() <= BROADCAST_ENTRIES else lambda df: df
    rows = texts.count()
    tasks = max(1, -(-rows * min(n, COMMON) // PAIRS), min(texts.sparkSession.sparkContext.defaultParallelism, rows // 1000))
    named = dealt_once(texts, tasks)
    right = _weighed_words(named, side(words), tokens, least)
    met = right.filter("looked_up").join(side(left), "word").groupBy("key", "code").agg(F.sum(F.col("w") * F.col("w2")).alias("similarity"))
    if not words.filter(F.col("codes") > COMMON).isEmpty():
        rest = right.filter("not looked_up").select("key", "word", "w")
        more = met.join(rest, "key", "left").join(side(left), ["code", "word"], "left").groupBy("key", "code")
        met = more.agg((F.max("similarity") + F.sum(F.coalesce(F.col("w") * F.col("w2"), F.lit(0.0)))).alias("similarity"))
    near = met.withColumn("similarity", F.bround("similarity", 6)).filter(F.col("similarity") > least)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "code"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= top).join(named, "key").select("text", "code", "similarity", "rank")


def tfidf_confidence(similarity: Column) -> Column:
    return F.when(similarity >= 0.65, 0.68).when(similarity >= 0.45, 0.58).when(similarity >= 0.25, 0.48).otherwise(0.40)


def confident(stage: DataFrame, rules: Rules) -> DataFrame:
    """Hits of a stage that reach the rules' threshold for their method; exact look-ups have none."""
    least = F.when(F.col("method").isin("conflict", "keywords"), rules.deterministic_score_threshold).when(F.col("method") == "tfidf", rules.tfidf_confidence_threshold).otherwise(0.0)
    return stage.filter(F.col("confidence") >= least)


def cascade(pairs: DataFrame, stages: list[DataFrame], default: str | None = None, rules: Rules | None = None, field: str = "construction", target: str = "AIR") -> DataFrame:
    """Of the stages (each scheme, value, code, confidence, method, scheme_override), the first with a hit per pair; else the default.

    With rules, a hit under the threshold of its method is none: later stages are asked, and at last the default holds. The
    default is that of the rules for the field and target, if none is given.
    """
    default = default or (rules or Rules()).default_code(field, target)
    columns = ["scheme", "value", "code", "confidence", "method", "scheme_override"]
    union = reduce(DataFrame.unionByName, [(s if rules is None else confident(s, rules)).select(*columns, F.lit(i).alias("stage")) for i, s in enumerate(stages)])
    first = union.groupBy("scheme", "value").agg(F.min_by(F.struct("code", "confidence", "method", "scheme_override"), F.struct("stage", "code")).alias("hit"))
    rows = pairs.join(first, ["scheme", "value"], "left")
    return rows.select(*pairs.columns, F.coalesce("hit.code", F.lit(default)).alias("code"), F.coalesce("hit.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("hit.method", F.lit("default")).alias("method"), F.col("hit.scheme_override").alias("scheme_override"))


def longest_tokens(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """The longest token that stands in each text, of equally long ones the first. texts: key; tokens: token, code, ordinal.

    A token can only stand in a text that has its rarest three letters in a row, so it is dealt by these and meets the texts in an
    equi-join; tokens of one or two letters meet on themselves. Any number of tokens may be asked.
    """
    wanted = tokens.select(F.lower("token").alias("token"), "code", "ordinal").filter("token <> ''").groupBy("token").agg(F.min_by(F.struct("code", "ordinal"), F.struct("ordinal", "code")).alias("own"))
    grams = lambda c, n: f"array_distinct(transform(sequence(1, length({c}) - {n - 1}), i -> substr({c}, i, {n})))"
    cut = wanted.filter("length(token) >= 3").select("token", F.expr(f"explode({grams('token', 3)}) as gram"))
    rare = cut.join(cut.groupBy("gram").agg(F.count("*").alias("tokens")), "gram").groupBy("token").agg(F.min_by("gram", F.struct("tokens", "gram")).alias("gram"))
    keys = texts.select("key").distinct()
    long = keys.filter("length(key) >= 3").select("key", F.expr(f"explode({grams('key', 3)}) as gram")).join(rare, "gram").filter("contains(key, token)").select("key", "token")
    short = wanted.filter("length(token) < 3").select("token")
    pieces = [keys.filter(f"length(key) >= {n}").select("key", F.expr(f"explode({grams('key', n)}) as token")) for n in (1, 2)]
    found = long.unionByName(pieces[0].unionByName(pieces[1]).join(short, "token").select("key", "token")).join(wanted, "token")
    best = found.groupBy("key").agg(F.max_by(F.struct("token", "own.code"), F.struct(F.length("token"), -F.col("own.ordinal"))).alias("best"))
    return best.select("key", "best.token", "best.code")


def modifier_codes(texts: DataFrame, section: str, highest: int, aliases: DataFrame, tokens: DataFrame) -> DataFrame:
    """Secondary modifier of each distinct text: a number in range, an alias, the longest token inside it, else 0.

    aliases: section, alias, code. tokens: section, token, code, ordinal.
    """
    rows = texts.select("text").distinct().withColumn("key", simplify(F.col("text")))
    named = aliases.filter(F.col("section") == section).groupBy(simplify(F.col("alias")).alias("key")).agg(F.min("code").alias("alias_code"))
    inside = longest_tokens(rows, tokens.filter(F.col("section") == section)).select("key", F.col("code").alias("token_code"))
    rows = rows.join(named, "key", "left").join(inside, "key", "left")
    number = F.when(F.trim("text").rlike(r"^\d{1,4}(\.0+)?$"), F.trim("text").cast("double").cast("int"))
    direct = F.when(number.between(0, highest), number)
    method = F.when(blank_to_null(F.col("text")).isNull(), "empty").when(direct.isNotNull(), "integer").when(F.col("alias_code").isNotNull(), "alias").when(F.col("token_code").isNotNull(), "token").otherwise("default")
    confidence = F.when(method == "integer", 1.0).when(method == "alias", 0.97).when(method == "token", 0.85).otherwise(0.0)
    return rows.select("text", F.coalesce(direct, "alias_code", "token_code", F.lit(0)).cast("int").alias("code"), method.alias("method"), confidence.alias("confidence"))
