"""Word-table BPE against the library, whitening against plain integers, the manifest against a plain tree."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sovara.llm import merkle, queries, whitening, wordtable
from tests.compare import rows_of

PATH = public_tokenizers.path(queries.VOCABULARY)
sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def by_library(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


def odd_texts():
    rng = random.Random(4)
    letters = ["a", "B", "'", "s", " ", "\n", "1", "é", " ", "_", "<", "|", ">", "\U00031350", "\U00016130", "日", "😀", "\t", "\x85", "　"]
    texts = [None, "", " ", "  a  b\n\n c's we'll I'Ve 12 ½x", "x" * 20_000, " " * 3000 + "q", "ab" * 40_000, "the same " * 30_000, "<|endoftext|>", "a<|endoftext|><|endoftext|> !<|endoftext|>", "<|endoftext|", "\x00\x1f\x7f​﻿", "İıſ"]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(200)]
    return texts + ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(200)]


@pytest.mark.parametrize("size", [8 << 20, 1])
def test_words_against_the_library(spark, library, monkeypatch, size):
    monkeypatch.setattr(wordtable, "BLOCK_BYTES", size)
    texts = odd_texts()
    rows = [(i, t, "x", 3, [1]) for i, t in enumerate(texts)] + [(None, "null id", "x", 3, [1])] * 2 + [(7, "again", "x", 3, [1])] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string, block int, ids array<int>").repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *tuple(r)[1:]) for r in wordtable.encode_digests(docs, PATH).collect())
    assert got == sorted((i if i is not None else -1, *by_library(library, t)) for i, t, *_ in rows)
    if size > 1:
        back = {r["doc_id"]: r["text"] for r in wordtable.decode(wordtable.encode(docs.filter("doc_id <> 7"), PATH), PATH).collect()}
        assert back == {i: t or "" for i, t in enumerate(texts) if i != 7}
        odd = spark.createDataFrame([(1, None), (2, []), (3, [50256, 32, 10]), (3, [162])], "doc_id bigint, ids array<int>")
        assert sorted((r["doc_id"], r["text"]) for r in wordtable.decode(odd, PATH).collect()) == sorted((i, library.decode(x, skip_special_tokens=False)) for i, x in [(1, []), (2, []), (3, [50256, 32, 10]), (3, [162])])
        assert wordtable.encode_digests(docs.filter("false"), PATH).count() == wordtable.encode(docs.filter("false"), PATH).count() == 0


def test_word_query_against_the_library(spark, small, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = queries.op11_word_table_bpe(spark, small).collect()
    assert len(found) == len(texts) and all(tuple(r)[1:] == by_library(library, texts[r["doc_id"]]) for r in found)


def test_split_knows_every_character(spark, library):
    """Each code point beside a letter, a digit and a sign falls into words as the library has it."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)}\n" for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    for r in rows.select("doc_id", wordtable.words_of(rows["text"], []).alias("words")).toLocalIterator():
        wanted = library.pre_tokenizer.pre_tokenize_str(texts[r["doc_id"]])
        assert r["words"] == [texts[r["doc_id"]][a:b] for _, (a, b) in wanted]


def test_cross_products_of_bit_planes():
    rng = np.random.default_rng(1)
    for x in (rng.integers(-5000, 90000, (777, 7)), rng.integers(-(1 << 40), 1 << 40, (70, 5)), np.full((3, 4), -7), rng.integers(0, 2, (64, 3)), np.zeros((5, 0), np.int64)):
        x = x.copy()
        if x.shape[1] > 2:
            x[:, 2] = 5
        total, product = whitening.cross_products(x)
        assert (total == x.astype(object).sum(axis=0)).all() and (product == x.astype(object).T @ x.astype(object)).all()


def plain_whitening(vectors, components=8):
    """(component -> whitened, explained), deviation per vector, by integers and one eigh."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    v = np.array([[int(c) / n**2 for c in row] for row in n * (x.T @ x) - np.outer(s, s)], float)
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value)[:components]
    far = n * x - s
    return np.array(far / n, float) @ vector[:, order] / np.sqrt(value[order]), value[order] / np.trace(v), (far * far).sum(axis=1)


def test_whitening_query_against_plain_integers(spark, small):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect())
    whitened, explained, deviation = plain_whitening([v for _, v in rows])
    found = sorted(queries.op12_embedding_whitening(spark, small).collect(), key=lambda r: (r["vec_id"], r["component"]))
    got = np.array([r["whitened"] for r in found]).reshape(-1, 8)
    assert [r["component"] for r in found[:8]] == list(range(1, 9)) and len(got) == len(rows)
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-9
    assert [int(r["deviation"]) for r in found[::8]] == deviation.tolist() and {r["n"] for r in found} == {len(rows)}
    assert all(abs(r["explained"] - explained[r["component"] - 1]) < 1e-10 for r in found)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-9


@pytest.mark.parametrize("sent", [256, 0])
def test_whitening_of_odd_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(whitening, "SENT_LENGTHS", sent)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    rng = np.random.default_rng(3)
    good = {3: rng.normal(size=(50, 3)).tolist(), 10: (rng.normal(size=(80, 10)) * 1e5).tolist(), 1: [[2.5]], 2: [[1.0, k * 0.5] for k in range(4)]}
    bad = [None, [None] * 3, [1.0, float("nan"), 2.0], [float("-inf"), 1.0, 1.0], []]
    rows = [(None if k == 0 else k, v) for k, v in enumerate([*(v for g in good.values() for v in g), good[3][0], *bad])]
    table = spark.createDataFrame([(i, v, 5, 1) for i, v in rows], "vec_id bigint, embedding array<double>, n int, dims int").repartition(4)
    found = whitening.whiten(table).collect()
    good[3].append(good[3][0])
    assert len(found) == 51 * 3 + 80 * 8 + 1 + 4 * 2
    for d in (3, 10):
        own = [r for r in found if r["n"] == len(good[d])]
        whitened, explained, deviation = plain_whitening(good[d])
        assert sorted({int(r["deviation"]) for r in own}) == sorted(set(deviation.tolist()))
        assert sorted(round(abs(r["whitened"]), 6) for r in own) == pytest.approx(sorted(np.abs(whitened).round(6).ravel().tolist()), abs=2e-6)
        assert {round(r["explained"], 9) for r in own} == {round(float(e), 9) for e in explained} and all(r["identity_error"] < 1e-9 for r in own)
    alone = [r for r in found if r["n"] == 1]
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, None, None)]
    flat = [r for r in found if r["n"] == 4]
    assert [r["explained"] for r in flat if r["component"] == 1] == [1.0] * 4 and all(r["whitened"] is None for r in flat if r["component"] == 2)
    assert whitening.whiten(table.filter("false")).count() == whitening.whiten(table.filter("embedding is null")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id bigint, embedding array<double>")
    assert {int(r["deviation"]) for r in whitening.whiten(huge).collect()} == {(2 * whitening.BOUND) ** 2 + 1024**2}


def plain_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars. What verify(manifest()) returns, from lists."""
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*map(text, (r[0], r[3], r[2], r[4], t)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            a = i // 8 * 8
            yield "".join(level[a:i]), "".join(level[i + 1 : a + 8])
            i //= 8

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for g in names}
    trees = {g: levels([leaf(r, r[1]) for r in own[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, r in enumerate(own[g]):
            steps, seen = [*path(trees[g], i), *path(top, k)], r[1]
            if None not in (r[0], seen) and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in seen)
            up = leaf(r, seen)
            for a, b in steps:
                up = sha(a, up, b)
            yield r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], sha(*(a + b for a, b in steps)), up, up == top[-1][0]


@pytest.mark.parametrize("settings", [{}, {"RANGE_ROWS": 7, "SMALL_ROWS": 0}])
def test_manifest_of_odd_rows(spark, settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(merkle, name, value)
    rng = random.Random(5)
    rows = [(i, rng.choice(["Abc é", "x" * 500, "", None, "no capitals"]), "hot" if i % 3 else rng.choice([None, "", "é", "z", "Z", "a=", "𝔞"]), rng.choice([None, "s"]), rng.choice([None, 4])) for i in range(150)]
    rows += [(3, "Again", "hot", None, 1)] * 40 + [(None, "No id", "hot", None, 1), (None, "No id", "hot", None, 1), (None, None, None, None, None), (9, "alone", "only one", "s", 2)]
    docs = spark.createDataFrame([(*r, "group", 1, "digest") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, group string, nth int, digest string").repartition(5)
    got = merkle.verify(merkle.manifest(docs, merkle.lower_third(docs)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_manifest(rows)))
    assert merkle.verify(merkle.manifest(docs)).filter("not verified").count() == 0
    assert [tuple(r) for r in merkle.verify(merkle.manifest(docs.filter("lang = 'only one'"))).collect()] == list(plain_manifest(rows[-1:]))
    assert merkle.verify(merkle.manifest(docs.filter("false"))).count() == 0


def test_manifest_does_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, many = (rows_of(merkle.verify(merkle.manifest(docs.repartition(n), merkle.lower_third(docs)))) for n in (1, 9))
    assert one == many
