"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct shingle sets (copies of a set are one row), columns are shingles. Two rows of sizes nx, ny
reach the threshold only if their sizes differ by a factor of 0.8 at most and their overlap o satisfies 9 o >= 4 (nx + ny),
for 0.8. If all sets are sorted in one common order, such rows share a column among the first n - ceil(0.8 n) + 1 of each.
The common order puts columns that are frequent within single input batches last (a bounded, broadcast list; it affects speed
only), so passages that many documents share are rarely among these leading columns.

Which rows meet. Leading columns that one row has alone are dropped, and columns with the same rows are one class. Within each
class, pairs are discarded whose overlap cannot reach its bound: by sizes, by the columns left at the first shared one, and by
the shared leading columns of the row whose lead ends first. What stays links rows to clusters, in spanning forests. A cluster
is a cell; of clusters too large for that, and of classes too large to be bounded pair by pair, each class is a cell, but for
classes within another one.

The product. Whole rows are dealt to blocks by cell, and a block is multiplied with itself in numpy: overlaps are accumulated
over groups of columns, and pairs that can no longer reach their bound are discarded in between. A block returns a spanning
forest of its links, never their pairs. A cell that is too large for a block is cut into chunks; all of them also hold a few
rows of the cell in common, so copies with small edits are joined in time proportional to the cell. Then only what is not yet
connected is multiplied: of such a cell, the rows outside its largest component meet all of its chunks, in pairs of chunks. So
no link between different sets that joins two components is lost.

Sets are named by 128 bits, and counted by 64-bit hashes of their shingles. Texts that are null, empty or blank have no
shingles and link with nothing; texts with fewer words than a shingle are one shingle. Rows with null doc_id link with nothing
and have no component. Repeated rows stay; of rows with the same doc_id and different texts each is linked by its own text.
Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.llm.common import cut_lineage, doc_text, mix, text_chunks, word_hashes, words_of, written
from sovara.llm.components import connected, packed

#: Columns in the list of frequent ones, and rows dealt to blocks that may be broadcast to the texts that make them.
FREQUENT, BROADCAST_ROWS = 1 << 17, 1 << 19
#: Rows and shingles of a chunk of a cell, rows that all chunks of a cell have, shingles and class members of a task.
ROWS, SHINGLES, HUBS, TASK, MEMBERS = 1024, 1 << 20, 32, 1 << 20, 100_000
#: Columns with so few rows are counted pair by pair; the others as dense columns, so many entries at once.
THIN, DENSE = 8, 1 << 22


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (64-bit hashes, ascending) of each text one after another, and how many each text has."""
    codes, words, counts = words_of(pc.ascii_lower(text))
    token = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    whole = np.zeros(len(token), np.uint64)
    for j in range(size):
        if j < len(token):
            whole[: len(token) - j] = whole[: len(token) - j] * step + token[j:]
    whole = mix(whole)
    values, sizes, at = [], np.zeros(len(counts), np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n >= size:
            own = np.unique(whole[at : at + n - size + 1])
        elif n:
            one = np.array([n], np.uint64)
            for h in token[at : at + n]:
                one = one * step + h
            own = mix(one ^ np.uint64(0x5A5A5A5A5A5A5A5A))
        else:
            own = token[:0]
        at += n
        sizes[i] = len(own)
        values.append(own)
    return np.concatenate(values) if values else token[:0], sizes


def set_names(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit names of each set."""
    end = np.cumsum(sizes)
    names = []
    for seed in (0x1234567, 0x89ABCDEF01):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(seed)))])
        names.append(mix(total[end] - total[end - sizes] + sizes.astype(np.uint64)))
    return np.stack(names, 1)


def _bytes(data: bytes, width: np.ndarray) -> pa.Array:
    """A binary array of consecutive pieces of data."""
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n_shingles, name, `row` (half of the name); `frequent` on one row of a batch: columns that several
    sets of the batch have."""

    def run(batches):
        for batch in text_chunks(batches):
            values, sizes = shingle_sets(batch.column("text"), size)
            found, many = np.unique(values, return_counts=True)
            several = many > 1
            hot = [{"h": int(h), "n": int(n)} for h, n in zip(found[several].view(np.int64), many[several], strict=True)]
            frequent = pa.array([hot] + [None] * (batch.num_rows - 1), pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))
            names = set_names(values, sizes)
            whole = _bytes(names.tobytes(), np.full(len(sizes), 16))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), whole, pa.array(names[:, 0].view(np.int64)), frequent], ["doc_id", "n_shingles", "name", "row", "frequent"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, name binary, row bigint, frequent array<struct<h:bigint,n:bigint>>")


def leading_columns(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """The entries of the matrix by which rows meet: h (column), row, place of the column in the row."""
    last = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def run(batches):
        late = last.value
        for batch in text_chunks(batches):
            values, sizes = shingle_sets(batch.column("text"), size)
            rows = set_names(values, sizes)[:, 0].view(np.int64)
            values = values.view(np.int64)
            at = np.minimum(np.searchsorted(late, values), max(0, len(late) - 1))
            is_late = late[at] == values if len(late) else np.zeros(len(values), bool)
            end = np.cumsum(sizes)
            _, once = np.unique(rows, return_index=True)
            once = once[sizes[once] > 0]
            lead = sizes[once] - -(-percent * sizes[once] // 100) + 1
            h = []
            for i, count in zip(once.tolist(), lead.tolist(), strict=True):
                own, own_late = values[end[i] - sizes[i] : end[i]], is_late[end[i] - sizes[i] : end[i]]
                h.append(np.concatenate([own[~own_late], own[own_late]])[:count] if own_late.any() else own[:count])
            if h:
                place = np.arange(lead.sum()) - np.repeat(np.cumsum(lead) - lead, lead)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.repeat(rows[once], lead)), pa.array(place.astype(np.int32))], ["h", "row", "place"])

    return docs.mapInArrow(run, "h bigint, row bigint, place int")


def column_classes(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (class, row) of the classes of columns: first place in the row, n (size of the row), shared (its leading
    columns that other rows lead with too). Should two classes get one name, they are one class, whose pairs include theirs."""
    shared = entries.groupBy("h").agg(F.min("row").alias("least"), F.max("row").alias("most")).filter("least < most").select("h")
    live = packed(cut_lineage(entries.join(shared, "h").dropDuplicates(["h", "row"])))
    code = live.groupBy("h").agg(F.xxhash64(F.count("row"), F.bit_xor(F.xxhash64("row"))).alias("class"))
    members = live.join(code, "h").groupBy("class", "row").agg(F.min("place").alias("place"), F.count("h").alias("columns"))
    size = members.groupBy("row").agg(F.sum("columns").alias("shared")).join(sets.select("row", "n"), "row")
    return packed(cut_lineage(members.drop("columns").join(size, "row")))


def _candidates(percent: int):
    """Of classes: per class, a spanning forest (class, a, b) of the pairs within the bounds."""

    def run(table: pa.Table) -> pa.Table:
        of, row, place, n, shared = (np.asarray(table[c].combine_chunks()) for c in ("class", "row", "place", "n", "shared"))
        order = np.argsort(of, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1], [True]])) if len(of) else [0]
        rest = -(-percent * n // 100) - 1  # columns after the lead
        found = [np.zeros((3, 0), np.int64)]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            own = order[s:e]
            size, left, lead, after = n[own], n[own] - place[own], shared[own], rest[own]
            low, high = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
            most = np.minimum(np.minimum(left[:, None], left), np.minimum(lead[:, None], lead) + np.maximum(after[:, None], after))
            a, b = np.nonzero(np.triu((100 * low >= percent * high) & ((100 + percent) * most >= percent * (low + high)), 1))
            if len(a):
                root = _roots(len(own), a, b)
                moved = np.flatnonzero(root != np.arange(len(own)))
                found.append(np.stack([np.full(len(moved), of[own[0]]), row[own[moved]], row[own[root[moved]]]]))
        return pa.table(dict(zip(("class", "a", "b"), np.concatenate(found, 1), strict=True)))

    return run


def cells(members: DataFrame, percent: int) -> DataFrame:
    """(cell, row, n): rows that must be multiplied with each other."""
    large = members.groupBy("class").agg(F.count("row").alias("k")).filter(F.col("k") > ROWS).select("class")
    tasks = max(1, members.count() // MEMBERS)
    small = members.join(large, "class", "left_anti").withColumn("task", F.pmod(F.xxhash64("class"), F.lit(tasks)))
    forest = cut_lineage(small.groupBy("task").applyInArrow(_candidates(percent), "class bigint, a bigint, b bigint"))
    reach = connected(forest.select("a", "b"))
    sizes = members.select("row", "n").distinct()
    rows = forest.select("class", F.explode(F.array("a", "b")).alias("row")).distinct().join(sizes, "row")
    rows = rows.join(reach, rows["row"] == reach["vertex"], "left").select("class", "row", "n", F.coalesce("component", "row").alias("cluster"))
    clustered = packed(cut_lineage(rows))
    clusters = clustered.select("cluster", "row", "n").distinct()
    heavy = clusters.groupBy("cluster").agg(F.count("row").alias("k"), F.sum("n").alias("n")).filter((F.col("k") > ROWS) | (F.col("n") > SHINGLES)).select("cluster")
    whole = clusters.join(heavy, "cluster", "left_anti").select(F.col("cluster").alias("cell"), "row", "n")
    by_class = clustered.join(heavy, "cluster").select("class", "row", "n").union(members.join(large, "class").select("class", "row", "n"))
    return whole.union(_not_within(cut_lineage(by_class)))


def _not_within(members: DataFrame) -> DataFrame:
    """members without the classes whose rows are all in one larger class."""
    counted = members.join(members.groupBy("class").agg(F.count("row").alias("k")), "class")
    home = counted.groupBy("row").agg(F.max(F.struct("k", "class")).alias("home"))
    homes = members.join(home, "row").groupBy("class").agg(F.min("home").alias("low"), F.max("home").alias("high"))
    within = homes.filter("low = high and low.class <> class").select("class")
    return members.join(within, "class", "left_anti").select(F.col("class").alias("cell"), "row", "n")


def _parts(rows, shingles):
    return F.greatest(F.ceil(rows / ROWS), F.ceil(shingles / SHINGLES), F.lit(1)).cast("int")


def _spread(column, parts):
    return F.pmod(F.xxhash64(column), parts).cast("int")


def _first_deal(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deals members (cell, row, n) to chunks of their cell; and the cells of more than one chunk."""
    sizes = members.groupBy("cell").agg(F.count("row").alias("k"), F.sum("n").alias("all")).withColumn("parts", _parts(F.col("k"), F.col("all")))
    large = cut_lineage(sizes.filter("parts > 1").select("cell", "k", "parts"))
    common = F.pmod(F.xxhash64(F.lit(2), "row"), F.col("k")) < HUBS
    chunks = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(common, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_spread("row", F.col("parts"))))
    return members.join(large, "cell", "left").select("cell", "row", "n", F.explode(chunks).alias("p")).withColumn("q", F.lit(0)).withColumn("kind", F.lit(0)), large


def _second_deal(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Deals members (cell, row, name, n) of large cells to pairs of chunks, of which one holds no row of the largest component."""
    rooted = packed(cut_lineage(members.join(roots, members["name"] == roots["vertex"], "left").select("cell", "row", "n", F.coalesce("component", "name").alias("root"))))
    counts = rooted.groupBy("cell", "root").agg(F.count("row").alias("k"), F.sum("n").alias("n"))
    largest = counts.groupBy("cell").agg(F.max(F.struct("k", "n", "root")).alias("top"), F.sum("k").alias("k"), F.sum("n").alias("n")).filter("k > top.k")
    largest = largest.select("cell", F.col("top.root").alias("top"), _parts(F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n")).alias("mb"), _parts(F.col("top.k"), F.col("top.n")).alias("gb"))
    guest = F.col("root") == F.col("top")
    own = _spread("row", F.when(guest, F.col("gb")).otherwise(F.col("mb")))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda kind, p, q: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))
    inner = F.transform(every("mb"), lambda o: pair(1, F.least(o, own), F.greatest(o, own)))
    outer = F.transform(every("gb"), lambda g: pair(2, g, own))
    return rooted.join(largest, "cell").select("cell", "row", "n", F.inline(F.when(guest, F.transform(every("mb"), lambda m: pair(2, own, m))).otherwise(F.concat(inner, outer))))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n vertices that each one reaches through the links a, b."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(values: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """The smallest row that each row of a block (ascending sets, one after another) reaches through links.

    Overlaps grow column group by column group. A pair is discarded once the columns that are left in either row, of those
    that several rows have, cannot bring it to its bound; a row without pairs leaves the product.
    """
    r = len(sizes)
    row = np.repeat(np.arange(r), sizes)
    order = np.argsort(values, kind="stable")
    value, row = values[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    width = np.diff(np.append(start, len(value)))
    column = np.repeat(np.arange(len(start)), width)
    low, high = np.minimum(sizes[:, None], sizes[None]), np.maximum(sizes[:, None], sizes[None])
    need = -(-percent * (low + high) // (100 + percent))
    alive = np.triu(100 * low >= percent * high, 1)
    thin, count = width[column] <= THIN, np.zeros(r * r, np.int32)
    for gap in range(1, min(THIN, r)):
        same = np.flatnonzero((column[gap:] == column[:-gap]) & thin[gap:])
        pair, n = np.unique(row[same] * r + row[same + gap], return_counts=True)
        count[pair] += n.astype(np.int32)
    count = count.reshape(r, r)
    thick = np.flatnonzero(~thin)
    row, column = row[thick], column[thick]
    left = np.bincount(row, minlength=r)
    while True:
        alive &= count + np.minimum(left[:, None], left[None]) >= need
        used = np.flatnonzero(alive.any(0) | alive.any(1))
        if not len(row) or not len(used):
            break
        now = column - column[0] < max(1, DENSE // r)
        place = np.full(r, -1)
        place[used] = np.arange(len(used))
        own = now & (place[row] >= 0)
        names, at = np.unique(column[own], return_inverse=True)
        block = np.zeros((len(used), len(names)), np.float32)
        block[place[row[own]], at] = 1
        count[np.ix_(used, used)] += (block @ block.T).astype(np.int32)
        left -= np.bincount(row[now], minlength=r)
        row, column = row[~now], column[~now]
    a, b = np.nonzero(alive & (count >= need))
    return _roots(r, a, b)


def _multiply(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.stack([np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("cell", "kind", "p", "q")])
        order = np.lexsort(keys)
        edge = np.flatnonzero(np.concatenate([[True], (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(0), [True]])) if len(order) else [0]
        names, sets = table["name"].combine_chunks(), table["shingles"].combine_chunks()
        a, b = [], []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            own = {names[i].as_py(): i for i in order[s:e].tolist()}  # repeated rows are one
            if len(own) > 1:
                mine = [np.frombuffer(sets[i].as_buffer(), np.uint64) for i in own.values()]
                root = block_links(np.concatenate(mine), np.array([len(x) for x in mine]), percent)
                name = list(own)
                moved = np.flatnonzero(root != np.arange(len(root))).tolist()
                a += [name[i] for i in moved]
                b += [name[root[i]] for i in moved]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _product(docs: DataFrame, sets: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of blocks; dealt has cell, kind, p, q, row, n, and sets finds a text for a row."""
    number, weight = dealt.agg(F.count("row"), F.sum("n")).first()
    tasks = max(1, (weight or 0) // TASK)
    blocks = dealt.groupBy("row").agg(F.collect_list(F.struct("cell", "kind", "p", "q")).alias("blocks"))  # of one row: bounded by its leading columns
    wanted = sets.join(blocks, "row").select("doc_id", "row", "blocks")
    texts = docs.join(F.broadcast(wanted) if number <= BROADCAST_ROWS else wanted, "doc_id").select("text", "row", "blocks")

    def run(batches):
        for batch in text_chunks(batches):
            values, sizes = shingle_sets(batch.column("text"), size)
            end, names = np.cumsum(sizes), set_names(values, sizes)
            right = np.flatnonzero(names[:, 0].view(np.int64) == np.asarray(batch.column("row")))
            data = [values[end[i] - sizes[i] : end[i]].tobytes() for i in right]
            yield pa.RecordBatch.from_arrays([_bytes(names[right].tobytes(), np.full(len(right), 16)), pa.array(data, pa.binary()), batch.column("blocks").take(pa.array(right))], ["name", "shingles", "blocks"])

    rows = texts.mapInArrow(run, "name binary, shingles binary, blocks array<struct<cell:bigint,kind:int,p:int,q:int>>")
    rows = rows.select("name", "shingles", F.inline("blocks")).withColumn("task", F.pmod(F.xxhash64("cell", "kind", "p", "q"), F.lit(tasks)))
    return packed(cut_lineage(rows.groupBy("task").applyInArrow(_multiply(percent), "a binary, b binary")))


def set_links(docs: DataFrame, table: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between names of different sets that reach the threshold, enough to connect all that are connected."""
    top = (
        table.select(F.explode("frequent").alias("f")).groupBy("f.h").agg(F.sum("f.n").alias("n")).filter("n >= 8")
        .orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    )
    entries = written(leading_columns(docs, size, percent, np.asarray(top["h"].combine_chunks()).astype(np.int64)))
    sets = table.filter("n_shingles > 0 and doc_id is not null").groupBy("name", "row", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("doc_id"))
    sets = packed(cut_lineage(sets))
    members = packed(cut_lineage(cells(column_classes(entries, sets), percent)))
    dealt, large = _first_deal(members)
    links = _product(docs, sets, cut_lineage(dealt), size, percent)
    if large.isEmpty():
        return links
    again = members.join(large.select("cell"), "cell").join(sets.select("row", "name"), "row")
    again = cut_lineage(_second_deal(again, connected(links)))
    return links if again.isEmpty() else links.union(_product(docs, sets, again, size, percent))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    docs = doc_text(docs)
    table = cut_lineage(set_table(docs, size))
    usable = table.filter("n_shingles > 0 and doc_id is not null")
    reach = connected(set_links(docs.filter("doc_id is not null"), table, size, percent))
    sets = usable.groupBy("name").agg(F.min("doc_id").alias("least"))
    sets = sets.join(reach, sets["name"] == reach["vertex"], "left").select("name", "least", F.coalesce("component", "name").alias("group"))
    sets = packed(cut_lineage(sets))
    least = sets.groupBy("group").agg(F.min("least").alias("component_id"))
    component = sets.join(least, "group").select("name", "component_id")
    return table.join(component, "name", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component; rows with null doc_id stay."""
    gone = jaccard_components(docs, size, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
