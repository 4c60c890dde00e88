"""The numpy and Python cores of the operators against brute force."""

import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sovara.llm import bpe, embeddings, jaccard, language, packing, passages, quality, toxicity
from sovara.llm.common import words_of

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODER = bpe.PrefixCoder(RANKS)
SPLIT = bpe.splitter(public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.text(max_size=60) | st.text("abcetinrs '0129\n\t\x1c\x85é日😀", max_size=60))
@settings(max_examples=400, deadline=None)
def test_encoding_is_the_library_s(text):
    assert bpe.encode_text(CODER, SPLIT, text) == LIBRARY.encode_ordinary(text)


def test_prefix_table_appends_and_edits():
    random.seed(4)
    for _ in range(200):
        data = bytes(random.choices("the ingandé".encode(), k=random.randint(1, 25)))
        table = bpe.PrefixTable(CODER)
        table.append(data[:5])
        table.append(data[5:])
        at, removed, put = random.randint(0, len(data)), random.randint(0, 3), bytes(random.choices(b"tion", k=2))
        table.edit(at, removed, put)
        fresh = bpe.PrefixTable(CODER)
        fresh.append(data[:at] + put + data[at + removed :])
        assert table.ids() == fresh.ids() and table.last == fresh.last
        assert b"".join(CODER.bytes_of[i] for i in table.ids()) == table.data


def test_filled_pieces_equal_single_ones():
    pieces = {"the", "then", "theng", "thengs", "x" * 40, "xxxxy", " and", "é"}
    known = {}
    bpe.fill(known, CODER, pieces)
    for p in pieces:
        ids = CODER.encode_piece(p.encode())
        assert known[p] == (",".join(map(str, ids)), len(ids), p.encode())


@given(st.lists(st.text("ab\0é", max_size=25).map(str.encode), max_size=7), st.sampled_from([2, 3, 5, 8]))
@settings(max_examples=300, deadline=None)
def test_suffix_runs(texts, least):
    if not texts:
        return
    where = {}
    for i, t in enumerate(texts):
        for o in range(len(t) - least + 1):
            where.setdefault(t[o : o + least], set()).add((i, o))
    text, offset, run = passages.suffix_runs(texts, least)
    got = {}
    for i, o, r in zip(text.tolist(), offset.tolist(), run.tolist(), strict=True):
        got.setdefault(r, set()).add((i, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in where.values() if len(v) > 1)


def test_anchors_cover_every_string_and_agree():
    random.seed(2)
    texts = [bytes(random.choices(b"abc", k=n)) for n in (0, 49, 50, 51, 300, 700)]
    texts[4] = texts[5][100:400]
    chosen, starts = {}, {i: set() for i in range(len(texts))}
    for who, h, f, first, count, _, _ in passages.batch_anchors(texts, 50):
        for i, a, b, s, c in zip(who.tolist(), h.tolist(), f.tolist(), first.tolist(), count.tolist(), strict=True):
            assert not starts[i] & set(range(s, s + c))
            starts[i] |= set(range(s, s + c))
            assert chosen.setdefault((a, b), texts[i][s : s + c + 49]) == texts[i][s : s + c + 49]
            for o in range(s, s + c):
                assert chosen.setdefault(texts[i][o : o + 50], a) == a
    assert all(v == set(range(max(0, len(texts[i]) - 49))) for i, v in starts.items())


def test_planes_and_packing_round_trip():
    a, b = np.array([1, -5, 1 << 60]), np.array([0, 7, -1])
    for x, y in zip(passages.unplanes([passages.planes(a, b), passages.planes(b, a)], 2), (np.append(a, b), np.append(b, a)), strict=True):
        assert (x == y).all()
    v, s, c = passages.unpack(passages.pack(np.array([262143, 0]), np.array([1 << 37, 5]), np.array([35, 1])))
    assert v.tolist() == [262143, 0] and s.tolist() == [1 << 37, 5] and c.tolist() == [35, 1]


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(0, 6)), max_size=40), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_packing_takes_the_tightest_bin(items, limit):
    items = sorted(items, reverse=True)
    sizes, sources, clusters = ([x[i] for x in items] for i in range(3))
    bins = packing.pack_items(sizes, sources, clusters, 20, limit)
    rest, held, counts = {}, {}, {}
    for s, o, c, b in zip(sizes, sources, clusters, bins, strict=True):
        fits = [r for k, r in rest.items() if r >= s and c not in held[k] and counts[k].count(o) < limit]
        assert rest.get(b, 20) == min(fits, default=20)
        rest[b] = rest.get(b, 20) - s
        held.setdefault(b, set()).add(c)
        counts.setdefault(b, []).append(o)


def test_shingles():
    text = pa.array(["a b c d e f", "A  b\tc\nd e f", "x y", "", None, "a b c d e a b c d e", "é" * 3])
    values, sizes = jaccard.shingle_sets(text, 5)
    assert sizes.tolist() == [2, 2, 1, 0, 0, 5, 1]
    assert values[:2].tolist() == values[2:4].tolist()
    names = [n.tobytes() for n in jaccard.set_names(values, sizes)]
    assert names[0] == names[1] and len(set(names)) == 5 and len(names[0]) == 16


@pytest.mark.parametrize("dense", [8, 1 << 22])
def test_block_links(dense, monkeypatch):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "THIN", 3)
    rng = random.Random(5)
    for _ in range(60):
        base = rng.sample(range(400), rng.randint(5, 40))
        sets = []
        for _ in range(rng.randint(2, 30)):
            own = set(rng.sample(base, rng.randint(max(1, len(base) * 3 // 4), len(base)))) | set(rng.sample(range(400), rng.randint(0, 5)))
            sets.append(np.sort(np.array(list(own), np.uint64)))
        got = jaccard.block_links(np.concatenate(sets), np.array([len(s) for s in sets]), 80)
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = want[i], want[j]
                    want = [min(a, b) if w in (a, b) else w for w in want]
        assert got.tolist() == want


def test_words_are_ascii_separated():
    codes, words, counts = words_of(pa.array([" a\x0bb c  ", "", None, "\x1c"]))
    assert [words[i].as_py() for i in codes] == ["a", "b c", "\x1c"] and counts.tolist() == [2, 0, 0, 1]


def test_forest_keeps_components():
    random.seed(7)
    for _ in range(100):
        n = random.randint(1, 9)
        link = np.zeros((n, n), bool)
        for _ in range(n):
            a, b = random.randrange(n), random.randrange(n)
            if a != b:
                link[a, b] = link[b, a] = True
        ids = np.random.default_rng(n).permutation(n).astype(np.int64)
        to = embeddings._forest(link, ids, ids)[1]
        reach = link | np.eye(n, dtype=bool)
        for _ in range(n):
            reach = reach @ reach
        assert to.tolist() == [ids[reach[i]].min() for i in range(n)]


WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]


def texts_of(n, mark, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(5, 60)) + ([mark] if i % 2 else [])) for i in range(n)]


@pytest.mark.parametrize("module,mark", [(quality, "%%% %%% %%%"), (toxicity, "idiot,")])
def test_classifiers_learn_and_take_any_text(module, mark):
    text, label = pa.array(texts_of(600, mark, 1)), np.arange(600) % 2
    model = module.train(text, label)
    got = model.score(pa.array(texts_of(100, mark, 2)))
    assert ((got >= 0.5) == (np.arange(100) % 2)).mean() > 0.95
    odd = model.score(pa.array([None, "", " \n", "a" * 50_000, "idiot " * 20_000]))
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1] == odd[2]
    assert len(model.score(pa.array([], pa.string()))) == 0
    for one in (np.zeros(3, int), np.ones(3, int)):
        assert ((module.train(text[:3], one).score(text[:5]) >= 0.5) == one[0]).all()
    assert module.train(text[:0], label[:0]).score(text[:1])[0] == 0.5


def test_repetition_is_seen_whatever_is_repeated():
    rng = random.Random(3)
    make = lambda i: " ".join([f"w{rng.randrange(999)}"] * 40 if i % 2 else [f"w{rng.randrange(999)}" for _ in range(40)])
    model = quality.train(pa.array([make(i) for i in range(600)]), np.arange(600) % 2)
    assert ((model.score(pa.array([make(i) for i in range(60)])) >= 0.5) == (np.arange(60) % 2)).mean() > 0.9


def test_language_network():
    rng = random.Random(5)
    vocabulary = {"aa": ["the", "and", "ing", "with"], "bb": ["der", "und", "schön", "für"]}
    make = lambda name, n: " ".join(rng.choices(vocabulary[name], k=n))
    names = ["aa", "bb"] * 80
    net = language.train(pa.array([make(x, 50) for x in names]), names)
    got, score = net.predict(pa.array([make(x, 30) for x in names[:40]] + [None, "", "123 %", "der " * 50_000]))
    assert got == [*names[:40], "und", "und", "und", "bb"] and ((score >= 0) & (score <= 1)).all()
    windows, each, filled = language.windows_of(pa.array(["x" * 600, "", "é" * 128]))
    assert each.tolist() == [3, 0, 1] and filled.tolist() == [256, 256, 88, 256]
    p = net.probabilities(windows)
    hidden, _ = net.responses(windows)
    z = np.exp(hidden @ net.out + net.bias)
    assert np.allclose(p, z / z.sum(1, keepdims=True), atol=1e-4)
    assert language.train(pa.array([], pa.string()), []).predict(pa.array(["abc"]))[0] == ["und"]


def test_packing_of_many_copies_and_sources():
    """Copies each open a bin, closed sources cost nothing, and thousands of either take no time to speak of."""
    began = time.process_time()
    assert packing.pack_items([5] * 8000, list(range(8000)), [0] * 8000, 2048, 2) == list(range(8000))
    hot = packing.pack_items([5] * 6000, [0] * 6000, list(range(6000)), 2048, 2)
    assert len(set(hot)) == 3000 and max(Counter(hot).values()) == 2
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 2048) for _ in range(4000)), reverse=True)
    packing.pack_items(sizes, list(range(4000)), list(range(4000)), 2048, 2)
    assert time.process_time() - began < 6


@pytest.mark.parametrize("least", [10, 15, 143, 300])
def test_passage_lengths_that_entries_cannot_hold(least):
    with pytest.raises(ValueError):
        passages.checked(least)
