"""Operators that once lost matches: against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sovara.functions import text
from sovara.operators import codes, mapping


def ratio(a, b):
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        row, before = [0], row
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return round(200 * row[-1] / (len(a) + len(b)), 4) if a or b else 100.0


@pytest.mark.parametrize("longest", [61, 3])
def test_fuzzy_matches_of_all_characters(spark, monkeypatch, longest):
    monkeypatch.setattr(text, "MASK_LENGTH", longest)
    names = ["année", "Straße Nr", "год постройки", "建築年", "év_épült", "a-b]c^d&&e", "[x\\y]", "year built", "😀 é", "--"]
    headers = [*names, "annee", "strasse nr", "год", "建築", "a-b]c", "built year", "é 😀x", None, ""]
    wanted = {(h, n.upper(), ratio(h, n)) for h in headers if h is not None for n in names if ratio(h, n) >= 60}
    got = mapping.fuzzy_matches(spark.createDataFrame([(h,) for h in headers], "source_col string"), spark.createDataFrame([(n, n.upper()) for n in names], "alias string, canonical string"), best=50, keep=50)
    assert {(r["source_col"], r["canonical"], r["score"]) for r in got.collect()} == wanted and len(wanted) > len(names)


@pytest.mark.parametrize("cutoff", [25.0, 60.0, 87.5, 100.0])
def test_fuzzy_pairs_against_brute_force(spark, cutoff):
    """Every pair that reaches the cutoff is found, and none below it, in several alphabets and lengths."""
    rng = random.Random(7)
    some = lambda letters: "".join(rng.choices(letters, k=rng.randint(0, 14))).strip()
    names = [some(rng.choice(["abc ", "abcdefghijklmnop ", "где постр ", "建築年ab ", "éè e"])) for _ in range(120)] + ["x" * 80, "x" * 70 + "y" * 9, "total insured value " * 5, ""]
    headers = [some(rng.choice(["abc ", "abcdefghijklmnop ", "где постр ", "建築年ab ", "éè e"])) for _ in range(160)] + names[:20] + ["x" * 75, "insured total value " * 5, " ", ""]
    wanted = {(h, n): ratio(h, n) for h in set(headers) for n in set(names) if ratio(h, n) >= cutoff}
    pairs = mapping.fuzzy_pairs(spark.createDataFrame([(h,) for h in [*headers, None]], "source_col string"), spark.createDataFrame([(n, "c") for n in [*names, None]], "alias string, canonical string"), cutoff)
    got = {(r["source_col"], r["alias"]): r["score"] for r in pairs.collect()}
    assert got == wanted and len(wanted) >= 20
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_keyword_scores_of_short_phrases(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choices("abc1- /", k=n)).strip() or "a"
    table = [("AC", "", ["ac"]), ("RC", "rc", ["src frame", "c-1"]), ("S", "#", ["---- x", "+"]), ("L", "", ["vacant lot"])]
    table += [(f"R{i}", some(rng.randint(1, 4)), [some(rng.randint(1, 9)) for _ in range(3)]) for i in range(25)]
    texts = ["vacant", "src", "abc-12", "ac", "r", "y ----", "a + b", "#1", *{some(rng.randint(1, 12)) for _ in range(40)}]

    def score(q, keywords, description):
        total = 0.3 if description and description in q else 0.0
        for k in keywords:
            words = k.split()
            if k == q:
                total += 1.0
            elif k in q:
                total += 0.7 + 0.05 * (len(words) - 1)
            elif q in k:
                total += 0.5
            elif {w for w in words if len(w) > 3} & set(q.split()):
                total += 0.2
        return round(total, 4)

    wanted = {(t, c): score(t, ks, d) for t in texts for c, d, ks in table if score(t, ks, d) > 0}
    dictionary = spark.createDataFrame([(*r, i) for i, r in enumerate(table)], "code string, description string, keywords array<string>, ordinal int")
    got = codes.keyword_scores(spark.createDataFrame([(t,) for t in set(texts)], "text string"), dictionary)
    assert {(r["text"], r["code"]): pytest.approx(r["score"]) for r in got.collect()} == wanted
    assert got.groupBy("text", "code").agg(F.count("*").alias("n")).filter("n > 1").count() == 0


def test_longest_tokens_against_brute_force(spark):
    """Tokens of all lengths, those of one and two letters included, in several alphabets; the first of equally long ones."""
    rng = random.Random(5)
    some = lambda k: "".join(rng.choices("abc- где年", k=k))
    tokens = [(some(rng.randint(1, 5)), i % 7, i) for i in range(150)] + [("", 1, 500), ("abc", 1, 501), ("abc", 2, 502)]
    texts = [*{some(rng.randint(0, 12)) for _ in range(300)}, "z", "zz"]
    wanted = {}
    for t in texts:
        inside = [(len(k), -o, k, c) for k, c, o in tokens if k and k in t]
        if inside:
            wanted[t] = max(inside)[2:]
    got = codes.longest_tokens(spark.createDataFrame([(t,) for t in texts], "key string"), spark.createDataFrame(tokens, "token string, code int, ordinal int"))
    assert {r["key"]: (r["token"], r["code"]) for r in got.collect()} == wanted and len(wanted) > 200
    assert codes.longest_tokens(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "token string, code int, ordinal int")).count() == 0


@pytest.mark.parametrize("least", [0.05, 0.3, 0.8])
def test_neighbours_against_all_pairs(spark, least):
    """Common words in every text and code, ties, repeated and empty texts: no pair that reaches the limit is lost."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["the", "of", "roof", *(f"w{rng.randrange(40)}" for _ in range(4))]) for _ in range(n))
    table = [(f"c{i}", words(rng.randint(2, 20))) for i in range(40)] + [("same", "roof roof of"), ("same2", "roof of roof"), ("none", "")]
    texts = [words(rng.randint(1, 40)) for _ in range(80)] + ["", None, "the", "unknown words"]
    vector = lambda t: Counter(w for w in (t or "").split() if len(w) > 1)
    found = {c: vector(t) for c, t in table}
    df = Counter(w for v in found.values() for w in v)
    weigh = lambda v: {w: n * (math.log((len(table) + 1) / (df[w] + 1)) + 1) for w, n in v.items() if w in df}
    norm = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    codes_ = {c: norm(weigh(v)) for c, v in found.items()}
    wanted = {}
    for t in set(texts) - {None}:
        own = norm(weigh(vector(t)))
        for c, v in codes_.items():
            s = sum(x * v.get(w, 0) for w, x in own.items())
            if round(s, 6) > least:
                wanted[t, c] = round(s, 5)
    got = codes.tfidf_neighbours(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(table, "code string, words string"), top=1000, least=least)
    assert {(r["text"], r["code"]): pytest.approx(r["similarity"], abs=2e-5) for r in got.collect()} == wanted and len(wanted) > 3


@pytest.mark.parametrize("entries", [1 << 18, 0])
@pytest.mark.parametrize("least", [0.05, 0.3, 0.8])
def test_common_words_add_to_pairs_that_others_found(spark, monkeypatch, least, entries):
    """Words that many codes have, looked up late or at once, and a table that is broadcast or shuffled: the same pairs and scores."""
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(["the", "of", "roof", *(f"w{rng.randrange(30)}" for _ in range(3))]) for _ in range(n))
    table = spark.createDataFrame([(f"c{i}", some(rng.randint(1, 15))) for i in range(40)] + [("none", ""), (None, "of w1")], "code string, words string")
    asked = spark.createDataFrame([(some(rng.randint(1, 30)),) for _ in range(60)] + [("the",), ("",), (None,)], "text string")
    found = lambda: {(r["text"], r["code"]): r["similarity"] for r in codes.tfidf_neighbours(asked, table, top=1000, least=least).collect()}
    wanted = found()
    monkeypatch.setattr(codes, "COMMON", 2)
    monkeypatch.setattr(codes, "BROADCAST_ENTRIES", entries)
    assert found() == pytest.approx(wanted, abs=2e-6) and len(wanted) > 3


def test_neighbours_shuffle_texts_and_not_their_words(spark):
    """What is shuffled follows the distinct texts, twice, and not the words or pairs (compressed, so less than twice their bytes)."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    vocabulary = [word() for _ in range(1500)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    table = spark.createDataFrame([(f"c{i}", some(60)) for i in range(150)], "code string, words string")
    texts = [some(150) for _ in range(1200)]
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    assert codes.tfidf_neighbours(spark.createDataFrame([(t,) for t in texts], "text string"), table).count() > 1000
    assert sent() - before < 2 * sum(map(len, texts))


def test_texts_are_shuffled_once(spark):
    """Nothing of the size of the texts is shuffled a second time, neither to find the distinct ones nor to name the hits."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    vocabulary = [word() for _ in range(1500)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    table = spark.createDataFrame([(f"c{i}", some(60)) for i in range(150)], "code string, words string")
    texts = [some(150) for _ in range(1200)]
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    assert codes.tfidf_neighbours(spark.createDataFrame([(t,) for t in texts], "text string"), table).count() > 1000
    assert sent() - before < sum(map(len, texts))


@pytest.mark.parametrize("remembered", [0, 3, 100_000])
def test_copies_of_a_text_are_dropped_before_and_after_the_shuffle(spark, monkeypatch, remembered):
    """One text in most of the rows, others in a few, null and empty ones: each once, however many keys a task remembers."""
    monkeypatch.setattr(codes, "REMEMBERED", remembered)
    rows = ["hot"] * 5000 + [f"t{i % 700}" for i in range(1500)] + ["", "", None, "ñ\x00 z", "ñ\x00 z"]
    random.Random(11).shuffle(rows)
    got = [r["text"] for r in codes.dealt_once(spark.createDataFrame([(t,) for t in rows], "text string").repartition(6), 5).collect()]
    assert sorted(got) == sorted(set(rows) - {None})
