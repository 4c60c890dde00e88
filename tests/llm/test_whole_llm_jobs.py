"""Jobs that once did less than the whole: several ranges, many texts of one id, repeated rows, sparse labels."""

import hashlib
import random
import zlib

import pytest

from sovara.llm import packing, passages, urls


@pytest.fixture
def conf(spark):
    """Sets configuration for one test."""
    before = {}

    def put(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("coalesce", [False, True])
def test_url_rules_stay_open_over_several_ranges(spark, conf, coalesce):
    """A rule for `com` is open over all ranges; the large rule rows in the first ones must not shift the others' bounds."""
    conf(shuffle__partitions="4", adaptive__coalescePartitions__enabled=str(coalesce).lower(), adaptive__coalescePartitions__parallelismFirst="false", adaptive__advisoryPartitionSizeInBytes="30kb", adaptive__coalescePartitions__minPartitionSize="1kb")
    table = [("com", "/", "block")] + [(f"h{i:04d}.a.com", f"/{'p' * 60}{j}", "allow") for i in range(300) for j in range(6)]
    pages = spark.createDataFrame([(i, f"http://{x}{i:04d}.com/x") for x in "hz" for i in range(2000)], "page_id bigint, url string")
    got = urls.judge_urls(pages, spark.createDataFrame(table, "host string, path string, verdict string"))
    assert [(r["rule"], r["verdict"], r["count"]) for r in got.groupBy("rule", "verdict").count().collect()] == [("com/", "block", 4000)]


@pytest.mark.parametrize("settings", [{}, {"REPEATED_IDS": 0}, {"SENT": 1, "BLOCK_LEADERS": 1, "FLUSH": 50}, {"SENT": 2, "FLUSH": 50, "HELD": 30}])
def test_passages_of_many_texts_of_one_id(spark, settings, monkeypatch):
    """Texts of null or one repeated doc_id, some of which agree in 18 bits of crc32, and many copies."""
    for name, value in settings.items():
        monkeypatch.setattr(passages, name, value)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    bits = lambda t: zlib.crc32(t.encode()) % (1 << 18)
    shared = noise(80)
    tail, clean = noise(60), noise(150)
    wanted = {bits(f"{i}{shared[:60]}{tail}"): i for i in range(3000)}
    j = next(j for j in range(1_000_000) if bits(f"{j}{clean}") in wanted)
    twins = [f"{wanted[bits(f'{j}{clean}')]}{shared[:60]}{tail}", f"{j}{clean}"]
    assert bits(twins[0]) == bits(twins[1])
    more = [noise(rng.randint(40, 90)) + rng.choice([shared, shared[5:70], ""]) + noise(20) for _ in range(60)]
    rows = [(1, shared), (2, noise(90)), *((i, t) for i in (7, None) for t in [*twins, *more]), *[(None, more[3]), (7, twins[0])] * 20]
    rows += [(50 + i, noise(30) + shared[rng.randint(0, 20) :] + noise(30)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    last = 1 << 62
    order = [last if i is None else i for i, _ in rows]
    first = {}
    for i, (_, t) in zip(order, rows, strict=True):
        for o in range(len(t) - 49):
            first[t[o : o + 50]] = min(first.get(t[o : o + 50], last), i)
    wanted = []
    for i, (doc, t) in zip(order, rows, strict=True):
        gone = bytearray(len(t))
        for o in range(len(t) - 49):
            if first[t[o : o + 50]] < i:
                gone[o : o + 50] = b"\1" * 50
        kept = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        wanted.append((doc or 0, len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in passages.passage_digests(docs).collect()]
    assert sorted(got) == sorted(wanted)
    # a list holds what one text has, however many rows have its id
    _, texts, size = passages.named(docs)
    longest = max(len(t) for _, t in rows)
    assert all(len(r["gone"]) == len(set(r["gone"])) <= longest for r in passages.removals(texts, passages.squeezed(texts), size).collect())


def test_passages_of_thousands_of_texts_without_id(spark):
    """5,000 texts with null doc_id and 2,000 of one doc_id, all with a passage of document 1: only that passage goes."""
    rng = random.Random(9)
    shared = "".join(rng.choices("abcdefgh ", k=60))
    edge = lambda i: "%" if i < 5000 else "#"  # noqa: E731  what surrounds the passage differs between the ids
    rows = [(1, shared), *((None if i < 5000 else 7, f"{i:07d}{rng.getrandbits(100):030d}{edge(i)}{shared}{edge(i)}{rng.getrandbits(90):028d}") for i in range(7000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["kept_sha256"]) for r in passages.passage_digests(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 0, sha(shared)), *((i or 0, 60, sha(t.replace(shared, ""))) for i, t in rows[1:])])


def plain_bins(items, capacity, per_source):
    """The tightest bin without conflict for each (size, source, cluster), by looking at all bins."""
    rest, clusters, sources, out = [], [], [], []
    for size, source, cluster in items:
        fits = [(rest[b], b) for b in range(len(rest)) if rest[b] >= size and cluster not in clusters[b] and sources[b].count(source) < per_source]
        tightest = [b for r, b in fits if r == min(fits)[0]] if fits else [len(rest)]
        if not fits:
            rest.append(capacity)
            clusters.append(set())
            sources.append([])
        out.append((tightest, lambda b, n=size, s=source, c=cluster: (rest.__setitem__(b, rest[b] - n), clusters[b].add(c), sources[b].append(s))))
        yield out[-1]


def test_packing_against_a_plain_packer_per_shard(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    shards = {}
    for r in packing.pack(docs).collect():
        shards.setdefault(r["shard"], []).append(r)
    assert len(shards) > 3
    for rows in shards.values():
        rows.sort(key=lambda r: (-r["size"], r["doc_id"], r["piece"], r["cluster"]))
        steps = plain_bins([(r["size"], r["source"], r["cluster"]) for r in rows], packing.CAPACITY, packing.PER_SOURCE)
        for r, (tightest, place) in zip(rows, steps, strict=True):
            assert r["bin"] in tightest
            place(r["bin"])


def test_packing_spreads_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    docs = spark.createDataFrame([(1, "a b c", "s")] * 1500 + [(None, None, None)] * 500, "doc_id bigint, text string, source string").repartition(4)
    found = packing.pack(docs).groupBy("shard").count().collect()
    assert len(found) == 20 and max(r["count"] for r in found) < 200 and sum(r["count"] for r in found) == 2000
