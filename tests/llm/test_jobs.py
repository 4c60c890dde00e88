"""The operators as Spark jobs: against SQL, against brute force, on odd rows and on skewed groups."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from sovara.llm import bpe, embeddings, jaccard, language, packing, passages, quality, queries, rules, toxicity, urls
from sovara.llm.components import connected
from tests.compare import rows_of, sql_rows

QUERIES, SQL = queries.queries(), queries.oracle_sql()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, cluster string, words int, h int, data string, gone string, squeezed string, gone_from_text string, name string, key string, fragment string"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing extra columns."""
    rows = [
        (1, LONG, "la", "s", 1), (2, LONG, "la", "s", 1), (2, LONG, "la", "s", 1), (3, None, None, None, None), (4, "", "la", "s", 0), (None, LONG, "la", None, 5), (None, None, None, None, None),
        (5, "  \n\t ", "la", "s", 1), (6, "word " * 60_000, "la", "s", 9), (7, "x" * 200_000, "la", "s", 9), (8, LONG + " extra", None, "s", 3), (9, "é日😀 " * 30, "xx", "t", 3), (9, "other text of the same id " + LONG, "xx", "t", 3),
    ]
    return spark.createDataFrame([(*r, "c", 1, 2, "d", *"uvwxyz") for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == sql_rows(SQL[name], small)


def test_encoding_query_against_the_library(spark, small):
    ranks = bpe.load_ranks(public_tokenizers.path(queries.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = QUERIES["op4_byte_bpe"](spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    few = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    path = public_tokenizers.path(queries.RANKS)
    back = bpe.decode(bpe.encode(few, path, public_tokenizers.PATTERN), path).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back} == {r["doc_id"]: r["text"] for r in few.collect()}


@pytest.mark.parametrize("name,column,label,least", [("op1_quality_classifier", "predicted", "quality", 0.9), ("op9_toxicity", "predicted", "toxic", 0.85), ("op7_language_id", "lang_pred", "lang", 0.95)])
def test_held_out_accuracy(spark, name, column, label, least):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label)
    found = QUERIES[name](spark, sf)
    rows = found.filter("held_out").join(truth, "doc_id").select(column, label).collect()
    assert np.mean([a == b for a, b in rows]) >= least and len(rows) > 50
    parts, rest = {"op1_quality_classifier": (3, 1), "op9_toxicity": (5, 0), "op7_language_id": (5, 0)}[name]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest) for r in found.collect())
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_scores_do_not_look_at_labels(spark):
    docs = odd_documents(spark)
    model = quality.train(pa.array(["a b", "c d"] * 20), np.array([0, 1] * 20))
    a, b = (sorted((r["doc_id"] or 0, round(r["score"], 9)) for r in quality.score(d, model).collect()) for d in (docs, docs.withColumn("lang", F.lit("q")).withColumn("source", F.lit("z"))))
    assert a == b


OPERATORS = {
    "quality": lambda d, s: quality.score(d, quality.fit(d, s.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (8, None, None)], "doc_id bigint, quality int, toxic int"), lambda i: i.isNotNull())),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.fit(d, s.createDataFrame([(1, 0), (8, 1)], "doc_id bigint, toxic int"), lambda i: i.isNotNull())),
    "language": lambda d, s: language.predict(d, language.fit(d, lambda i: i.isNotNull())),
    "bpe": lambda d, s: bpe.encode_digests(d, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN),
    "rules": lambda d, s: rules.apply_policy(rules.ledger(d), rules.POLICIES["default"]),
    "jaccard": lambda d, s: jaccard.jaccard_components(d),
    "passages": lambda d, s: passages.passage_digests(d),
    "keep": lambda d, s: quality.keep(d, quality.train(pa.array([], pa.string()), np.zeros(0, int)), 0.0),
    "remove": lambda d, s: passages.remove(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_give_one_row_each(spark, name):
    docs = odd_documents(spark)
    assert OPERATORS[name](docs, spark).count() == docs.count()
    assert OPERATORS[name](docs.filter("false"), spark).count() == 0


def test_odd_rows_of_the_jaccard_join(spark):
    found = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd_documents(spark)).collect()), key=str)
    by_id = {}
    for doc, n, component in found:
        by_id.setdefault(doc, set()).add((n > 0, component))
    assert by_id[1] == by_id[2] == by_id[8] == {(True, 1)} and by_id[3] == {(False, 3)} and by_id[4] == {(False, 4)} and by_id[0] == {(True, None), (False, None)}
    kept = jaccard.keep_one(odd_documents(spark)).filter("doc_id in (1, 2, 8)").collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_odd_rows_of_passages(spark):
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in passages.passage_digests(odd_documents(spark)).collect()]
    n = len(LONG)
    assert rows.count((2, n, n)) == 2 and (1, n, 0) in rows and (None, n, n) in rows and (8, n + 6, n) in rows and (6, 300_000, 0) in rows
    assert sorted(x[2] for x in rows if x[0] == 9) == [0, n]


def test_rules_against_plain_python(spark):
    docs = odd_documents(spark)
    got = {(r["doc_id"], r["word_chars"]): r for r in rules.ledger(docs).collect()}
    for r in docs.collect():
        words = (r["text"] or "").split(" ") if r["doc_id"] == 6 else (r["text"] or "").split()
        words = [w for w in words if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
        row = got[(r["doc_id"], sum(map(len, words)))]
        assert (row["n_words"], row["n_repeat_words"]) == (len(words), len(covered))
    entries = rules.ledger(docs)
    policy = rules.POLICIES["default"]
    table = {r["rule"]: r for r in rules.ablation(entries, policy).collect()}
    failed = [r["failed"] for r in entries.collect()]
    assert table["few_words"]["failed"] == sum(x & 1 for x in failed) and table["few_words"]["failed_alone"] == sum(x == 1 for x in failed)
    assert table["few_words"]["kept_without"] == sum(not x & (policy.mask & ~1) for x in failed)


def plain_rule(host, path, table):
    best = None
    for h, p, v in table:
        if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or "/"):
            key = (len(h) + len(p or "/"), len(h), v == "block")
            best = max(best, (key, h + (p or "/"), v)) if best else (key, h + (p or "/"), v)
    return best


def test_url_rules_against_plain_python(spark):
    rng = random.Random(8)
    label = lambda: rng.choice(["a", "b", "com", "net"])
    table = [(".".join(label() for _ in range(rng.randint(1, 4))), rng.choice(["/", "/a", "/a/b", None, "/b/"]), rng.choice(["allow", "block"])) for _ in range(40)] + [(None, "/", "block"), ("", "/", "block"), ("net", "/", None)]
    pages = [(i, rng.choice(["http://", "HTTPS://", "", "x://y://"]) + ".".join(rng.choice([label(), label().upper()]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "/a/b?q=/x", "/b/c#t", "?x", "/A\n/b"])) for i in range(400)]
    pages += [(400, None), (401, ""), (401, ""), (402, "://"), *((500 + i, "http://hot.a.com/a") for i in range(500))]
    rules_df = spark.createDataFrame(table, "host string, path string, verdict string")
    pages_df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id bigint, url string, host string, rule string")
    for broadcast_rows in (20_000, 0):
        got = urls.judge_urls(pages_df, rules_df, broadcast_rows=broadcast_rows).collect()
        assert len(got) == len(pages)
        for r in got:
            best = plain_rule(r["host"], r["path"], table)
            assert (r["rule"], r["verdict"]) == ((best[1], best[2]) if best else (None, "allow")), r
    assert urls.judge_urls(pages_df, rules_df.filter("false")).filter("rule is null and verdict = 'allow'").count() == len(pages)
    assert urls.judge_urls(pages_df.filter("false"), rules_df).count() == 0


def plain_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(60, 90)] + [(0, 0)]
    got = {r["vertex"]: r["component"] for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert [got.get(i, i) for i in range(120)] == plain_components(120, links)


@pytest.mark.parametrize("settings", [{}, {"FREQUENT": 1}, {"FREQUENT": 1, "ROWS": 16, "HUBS": 2, "BROADCAST_ROWS": 0}, {"SHINGLES": 400, "TASK": 1000, "MEMBERS": 50}])
def test_jaccard_on_hard_groups(spark, settings, monkeypatch):
    """Chains of near copies, a passage that most documents share, groups of copies and short texts."""
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(40)]
    texts = []
    base = [word() for _ in range(60)]
    for i in range(120):  # a chain: neighbours are alike, the ends are not
        base = base.copy()
        base[rng.randrange(60)] = word()
        texts.append(base)
    for i in range(150):
        texts.append(shared + [word() for _ in range(rng.choice([3, 5, 8, 20, 60]))])
    texts += [texts[130]] * 40 + [[word() for _ in range(rng.randint(1, 7))] for _ in range(60)] + [["one"], ["one"], ["One"]]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        t = [w.lower() for w in t]
        sets.append({tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else {tuple(t)})
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert [got[i][0] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i][1] for i in range(len(texts))] == plain_components(len(texts), links)


@pytest.mark.parametrize("settings", [{}, {"SENT": 1, "BLOCK_LEADERS": 1, "FLUSH": 50}, {"SENT": 2, "BLOCK_LEADERS": 3, "FLUSH": 400, "BUCKET_BYTES": 3000, "BLOCK_BYTES": 400}])
def test_passages_on_hard_groups(spark, settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(passages, name, value)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdé ", k=n))
    shared, long = noise(70), noise(300)
    texts = [noise(rng.randint(0, 120)) + rng.choice([shared, shared[3:60], long, long[50:120], shared[:49], ""]) + noise(rng.randint(0, 90)) for _ in range(150)] + [long] * 9 + [None, "", "ab" * 200, "ab" * 60]
    data = [(t or "").encode() for t in texts]
    first = {}
    for i, t in enumerate(data):
        for o in range(len(t) - 49):
            first.setdefault(t[o : o + 50], i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in passages.passage_digests(docs).collect()}
    for i, t in enumerate(data):
        gone = bytearray(len(t))
        for o in range(len(t) - 49):
            if first[t[o : o + 50]] < i:
                gone[o : o + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        assert tuple(got[i])[1:] == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i


def test_embeddings_on_hard_groups(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "CELL", 20)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(6, 8))
    rows = [(c + rng.normal(scale=0.25, size=8)) * rng.uniform(0.1, 9) for c in centre for _ in range(50)]
    rows += [rows[3]] * 30 + [rows[7] * 2, np.zeros(8), np.full(8, 1e-200), rows[0][:5], rows[0][:5]]
    values = [r.tolist() for r in rows] + [None, [], [None] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7]
    table = [(i, v) for i, v in enumerate(values)]
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in values]
    unit = [np.array(v) / np.abs(v).max() if g else None for v, g in zip(values, good, strict=True)]
    links = []
    for i in range(len(values)):
        for j in range(i):
            if good[i] and good[j] and len(values[i]) == len(values[j]) and unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= 0.95:
                links.append((i, j))
    count = np.bincount(np.array(links).ravel(), minlength=len(values))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(table, "vec_id bigint, embedding array<double>")).collect()}
    component = plain_components(len(values), links)
    assert [got[i]["n_links"] for i in range(len(values))] == count.tolist()
    assert [got[i]["component_id"] for i in range(len(values))] == component
    assert all(got[i]["kept"] == (component[i] == i) for i in range(len(values)))
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id bigint, embedding array<double>")).collect()].count((4, 1, 4, True)) == 1


def test_packing_query(spark, small):
    found = packing.pack(odd_documents(spark).unionByName(spark.read.parquet(f"{small}/documents.parquet"), allowMissingColumns=True)).collect()
    words = {}
    bins = {}
    for r in found:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["size"]
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    assert words[6] >= 60_000 and len({(r["doc_id"], r["piece"]) for r in found if r["doc_id"] == 6}) >= 30
    for own in bins.values():
        assert sum(r["size"] for r in own) <= packing.CAPACITY
        assert len({r["cluster"] for r in own}) == len(own)
        assert all(sum(r["source"] == s for r in own) <= packing.PER_SOURCE for s in {r["source"] for r in own})
    assert packing.pack(odd_documents(spark).filter("false")).count() == 0


def test_pipeline_against_plain_stages(spark, small):
    import corpus_pipeline as pipeline

    docs = queries.read_table(spark, small, "documents")
    labels = queries.read_table(spark, small, "labels")
    model = quality.fit(docs, labels, lambda i: queries.fold(i, 3) != 1)
    table = docs.toArrow()
    first = table.filter(pa.array(model.score(table["text"].combine_chunks()) >= 0.5))
    stage = pipeline.STAGES[0][1](spark, docs, small)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == set(first["doc_id"].to_pylist())
    net = language.fit(stage, lambda i: queries.fold(i, 5) != 0)
    name, score = net.predict(first["text"].combine_chunks())
    kept = {d for d, n, s in zip(first["doc_id"].to_pylist(), name, score, strict=True) if n != "und" and s >= 0.4}
    second = pipeline.STAGES[1][1](spark, stage, small)
    assert {r["doc_id"] for r in second.collect()} == kept
    component = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(second).collect()}
    third = pipeline.STAGES[2][1](spark, second, small)
    assert {r["doc_id"] for r in third.collect()} == {d for d, c in component.items() if d == c}
    digests = {r["doc_id"]: r for r in passages.passage_digests(third).collect()}
    fourth = pipeline.STAGES[3][1](spark, third, small)
    assert fourth.columns == docs.columns and dict(fourth.dtypes) == dict(docs.dtypes)
    for r in fourth.collect():
        assert len(r["text"].encode()) <= digests[r["doc_id"]]["n_bytes"] - digests[r["doc_id"]]["n_removed"] and r["n_chars"] == len(r["text"])
    fifth = pipeline.STAGES[4][1](spark, fourth, small)
    assert {r["doc_id"] for r in fifth.collect()} == {r["doc_id"] for r in fourth.collect()}
    assert pipeline.run(spark, small).count() == fifth.count()


def test_small_tables_of_the_join_are_few_tasks(spark, small):
    """With many shuffle partitions that nothing merges, what is small is not dealt to all of them step after step."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    tasks = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalTasks()
    start = tasks()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = jaccard.jaccard_components(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 200 and tasks() - start < 3500  # 4,763 when all were dealt
