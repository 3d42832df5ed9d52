"""N-gram Jaccard join: sets of word shingles, linked where they are alike enough, by a prefix tree.

0. Candidates. Two alike sets share all but a known share of their shingles. Of the shingles in a fixed part of the
   hash range, those that no other set has are counted; a set with more of them than that share allows has no
   partner. All later steps work on the sets that are left.
1. Keys. Two sets that are alike differ in at most D shingles, D following from their sizes. The hash range is cut
   into more than D parts, so alike sets agree in whole parts; a part's shingles hash to a key. Sets that share
   fewer keys than parts must agree, with all others together, cannot be alike with any.
2. Groups. Components of the graph "shares a key" hold all sets that can be alike, and little else. A group that
   a common passage ties together is taken apart again: of its sets in one order of shingles, rarest first, two alike
   ones share one among the first shingles of each, and how far in it comes bounds the other's size.
3. Tree. A group's sets, their shingles in one global order, rarest first, are stored in a prefix tree. Each
   traversal carries the overlap of a whole path at once and leaves subtrees whose remaining lengths cannot reach
   the similarity. Sets already known to hang together are not compared again.

Groups that stay large are cut into slices of bounded size. Each slice also gets a few anchors of its group, which
tie the slices together; what does not hang on the group's largest part is then compared with every other slice that
has one of its first shingles in a set of fitting size. So no pair is lost, and a group of any size is many small
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.components import components, written
from gazeframe.llm.shingles import mix, portions, shingle_sets

SLICE = 256
ANCHORS = 4
MARKS = 1 << 25


class Sizes:
    """Classes of set sizes, such that alike sets lie in the same or in neighbouring classes."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(self.starts[-1] * 100 // percent + 1)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def parts(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the hash range for a class, and how many of them may be empty.

        Two sets whose larger one lies in the class differ in at most D shingles; of D + 1 + e parts, more than
        e agree, so one that is not empty does unless both sets have more than e empty parts.
        """
        largest = np.array(self.starts)[kind + 1] - 1
        differing = (100 - self.percent) * 2 * largest // (100 + self.percent)
        spare = np.where(differing == 0, 0, (differing + 12) // 12)
        return differing + 1 + spare, spare


def keys(sets: list[np.ndarray], sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of non-empty sets, each with the index of its set, for the set's class and the next one.

    The third array tells how many keys each set shares at least with any set that is alike: more parts agree
    than may be empty, and those that agree and are not empty are keys of both.
    """
    need = np.ones(len(sets), np.int64)
    used = [i for i, s in enumerate(sets) if len(s)]
    if not used:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), need
    least = np.full(len(used), np.iinfo(np.int64).max)
    n = np.array([len(sets[i]) for i in used])
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), n)
    spread = mix(flat ^ np.uint64(0xC2B2AE3D27D4EB4F))
    out_keys, out_owner = [], []
    for step in (0, 1):
        kind = sizes.of(n) + step
        parts, spare = sizes.parts(kind)
        part = ((flat >> np.uint64(32)) * parts.astype(np.uint64)[owner]) >> np.uint64(32)
        new = np.ones(len(flat), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        tag = kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = mix(np.add.reduceat(spread, at) + tag[owner[at]] + part[at] * np.uint64(0xD1B54A32D192ED03))
        out_keys.append(key)
        out_owner.append(owner[at])
        filled = np.bincount(owner[at], minlength=len(used))
        least = np.minimum(least, spare + 1 - (parts - filled))
        for i in np.flatnonzero(parts - filled > spare):
            empty = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), part[at][owner[at] == i])
            out_keys.append(mix(empty * np.uint64(0xD1B54A32D192ED03) + tag[i] + np.uint64(0x632BE59BD9B4E019)))
            out_owner.append(np.full(len(empty), i))
    need[used] = np.maximum(least, 1)
    return np.concatenate(out_keys), np.array(used)[np.concatenate(out_owner)], need


class Node:
    """A run of shingles that the sets ``low`` to ``high`` share; ``depth`` counts those up to its end."""

    __slots__ = ("run", "low", "high", "depth", "here", "below", "fewest", "longest")


def tree(lists: list[np.ndarray], sizes: np.ndarray) -> Node:
    """Prefix tree of lists in lexicographic order; a node with one way on is part of a run."""
    same = [0]
    for a, b in zip(lists, lists[1:]):
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        same.append(int(differ[0]) if len(differ) else m)
    root = Node()
    todo = [(root, 0, len(lists), 0)]
    while todo:
        node, low, high, depth = todo.pop()
        end = len(lists[low]) if high - low == 1 else min(same[low + 1 : high])
        node.run, node.low, node.high, node.depth = lists[low][depth:end], low, high, end
        node.fewest, node.longest = int(sizes[low:high].min()), max(len(x) for x in lists[low:high])
        here = low
        while here < high and len(lists[here]) == end:
            here += 1
        node.here, node.below = here, []
        cuts = [here, *[i for i in range(here + 1, high) if same[i] == end], high] if here < high else []
        for a, b in zip(cuts, cuts[1:]):
            child = Node()
            node.below.append(child)
            todo.append((child, a, b, end))
    return root


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component of each set: the smallest index that links lead to. Empty sets link with nothing."""
    label = np.arange(len(sets))
    used = [i for i, s in enumerate(sets) if len(s)]
    while len(used) > 1:
        size = np.array([len(sets[i]) for i in used])
        _, code, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
        # Shingles of one set only come first in the order and match nothing: they count in the sizes alone.
        # A set that shares too few of its shingles to reach the similarity with any other is out.
        shared = np.add.reduceat(count[code] > 1, np.cumsum(size) - size, dtype=np.int64)
        able = 100 * shared >= percent * size
        if able.all():
            break
        used = [i for i, good in zip(used, able) if good]
    if len(used) < 2:
        return label
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    single = np.count_nonzero(count == 1)
    lists = [np.sort(r[r >= single]) for r in np.split(place[code], np.cumsum(size)[:-1])]
    order = sorted(range(len(used)), key=lambda i: lists[i].astype(">u8").tobytes())
    lists, size, names = [lists[i] for i in order], size[order], [used[i] for i in order]
    root, alive, has = tree(lists, size), np.ones(len(used), bool), np.zeros(len(count), bool)
    high = percent / (100 + percent)

    def alike(x: int) -> list[int]:
        mine, found = lists[x], []
        has[mine] = True
        todo = [(root, 0)]
        while todo:
            node, overlap = todo.pop()
            if not alive[node.low : node.high].any():
                continue
            if len(node.run):
                overlap += int(np.count_nonzero(has[node.run]))
                left = len(mine) - int(np.searchsorted(mine, node.run[-1], "right"))
            else:
                left = len(mine)
            least = max(ceil(high * (size[x] + node.fewest) - 1e-9), -(-percent * max(int(size[x]), node.fewest) // 100))
            if overlap + min(left, node.longest - node.depth) < least:
                continue
            for y in range(node.low, node.here):
                if alive[y] and 100 * overlap >= percent * (int(size[x]) + int(size[y]) - overlap):
                    found.append(y)
            todo.extend((child, overlap) for child in node.below)
        has[mine] = False
        return found

    left = len(used)
    for start in sorted(range(len(used)), key=lambda i: names[i]):
        if not alive[start]:
            continue
        alive[start] = False
        left -= 1
        reached = [start]
        while reached and left:
            for y in alike(reached.pop()):
                alive[y] = False
                left -= 1
                label[names[y]] = names[start]
                reached.append(y)
    return label


def _leads(ids: np.ndarray, known: np.ndarray, digests: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the sets that stand for their copies within a batch: the first by id, none without id."""
    _, first = np.unique(np.column_stack([digests, n]), axis=0, return_inverse=True)
    by_id = np.lexsort((ids, first.ravel()))
    by_id = by_id[known[by_id]]
    lead = known.copy()
    lead[by_id[1:]] = first.ravel()[by_id[1:]] != first.ravel()[by_id[:-1]]
    return np.flatnonzero(lead)


def _sampled(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Rows of one of two kinds: a document with size and digest, or a key, a shingle of a fixed part of the hash range.

    ``short`` is how many keys a document must share with other batches, for it to have a partner; NULL for copies
    within the batch, of which one stands for all. A key of several sets of a batch counts as shared at once and
    is one row without document.
    """
    limit = np.uint64(min(50, 2 * (100 - percent)) * (1 << 64) // 100)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count in portions(batch.column(1), 8 << 20):
                some = batch.slice(at, count)
                named = some.column(0)
                known = np.array(named.is_valid())
                ids = named.fill_null(0).to_numpy()
                sets, digests = shingle_sets(some.column(1), length)
                n = np.array([len(s) for s in sets], np.int64)
                # Rows without id count in size and digest alone: they have no keys and lead nothing.
                mine = _leads(ids, known, digests, n)
                taken = [sets[i][: int(np.searchsorted(sets[i], limit))] for i in mine]
                held = np.array([len(t) for t in taken], np.int64)
                key = np.concatenate([np.zeros(0, np.uint64), *taken])
                owner = np.repeat(np.arange(len(mine)), held)
                rank = np.argsort(key, kind="stable")
                key, owner = key[rank], owner[rank]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                alone = new & np.append(new[1:], True)
                inside = np.bincount(owner[~alone], minlength=len(mine))
                short = held - inside - (100 - percent) * n[mine] // 100
                wanted = pa.array(short).take(pa.array(np.searchsorted(mine, np.arange(count)), mask=~np.isin(np.arange(count), mine)))
                columns = [named, *(pa.array(c) for c in (n, digests[:, 0], digests[:, 1])), wanted, pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "short", "key", "doc"])
                doc = pa.array(ids[mine][owner][new] if len(key) else np.zeros(0, np.int64), mask=~alone[new])
                key = pa.array(key[new].view(np.int64))
                for part in range(0, len(key), 100_000):
                    some_keys = key.slice(part, 100_000)
                    empty = pa.nulls(len(some_keys), pa.int64())
                    columns = [empty] * 5 + [some_keys, doc.slice(part, 100_000)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "short", "key", "doc"])

    schema = "doc_id long, n long, d1 long, d2 long, short long, key long, doc long"
    return docs.select("doc_id", "text").mapInArrow(make, schema)


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a doc_id of ``ids``, and a few others, without a shuffle of the texts.

    The ids are marks in a bitmap that is never larger than 4 MB and so goes to every task.
    """
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    marks = (
        ids.select(mark.alias("mark"))
        .groupBy(F.bitmap_bucket_number("mark").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))
    )
    at = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substr("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        docs.join(F.broadcast(marks), F.bitmap_bucket_number(mark) == F.col("bucket"))
        .where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
        .select(*docs.columns)
    )


def _keyed(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Rows of one of three kinds: a document with what it needs, a link, or a key with one document of its batch.

    Documents of a batch that share a key are linked at once (``a``, ``b``, for how many keys), so that a key
    that very many documents have is few rows. Of copies within a batch one has keys; the others need 0.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for batch in batches:
            for at, count in portions(batch.column(1), 8 << 20):
                some = batch.slice(at, count)
                named = some.column(0)
                known = np.array(named.is_valid())
                ids = named.fill_null(0).to_numpy()
                sets, digests = shingle_sets(some.column(1), length)
                n = np.array([len(s) for s in sets], np.int64)
                # Copies within the batch: only the first, by id, has keys; the digest ties them later.
                mine = _leads(ids, known, digests, n)
                found, owner, least = keys([sets[i] for i in mine], sizes)
                need = np.zeros(len(ids), np.int64)
                need[mine] = least
                doc = ids[mine][owner] if len(owner) else np.zeros(0, np.int64)
                rank = np.lexsort((doc, found))
                found, doc = found[rank], doc[rank]
                new = np.ones(len(found), bool)
                new[1:] = found[1:] != found[:-1]
                pairs = np.column_stack([doc[1:], doc[:-1]])[~new[1:]]
                pairs, times = np.unique(pairs.reshape(-1, 2), axis=0, return_counts=True)
                yield _rows(doc_id=named, need=need)
                yield _rows(a=pairs[:, 0], b=pairs[:, 1], times=times)
                for part in range(0, int(new.sum()), 100_000):
                    yield _rows(key=found[new][part : part + 100_000].view(np.int64), doc=doc[new][part : part + 100_000])

    schema = "doc_id long, need long, a long, b long, times long, key long, doc long"
    return docs.select("doc_id", "text").mapInArrow(make, schema)


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    names = ["doc_id", "need", "a", "b", "times", "key", "doc"]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in names], names
    )


def _tree_links(placed: DataFrame, length: int, percent: int) -> DataFrame:
    """Links (a, b) within each place of (place, doc_id, text): each document with the first of its component."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, texts = None, [], []

        def done() -> pa.RecordBatch:
            known = np.array(ids, np.int64)
            rank = np.argsort(known, kind="stable")
            sets, _ = shingle_sets(pa.array([texts[i] for i in rank], pa.large_binary()), length)
            label = linked(sets, percent)
            found = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays(
                [pa.array(known[rank][found]), pa.array(known[rank][label[found]])], ["a", "b"]
            )

        for batch in batches:
            for key, doc, text in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary())))):
                if key != place:
                    if len(ids) > 1:
                        yield done()
                    place, ids, texts = key, [], []
                ids.append(doc)
                texts.append(text)
        if len(ids) > 1:
            yield done()

    # A place is a slice of bounded size and lies in one partition, its rows together.
    together = placed.repartition("place").sortWithinPartitions("place")
    return together.select("place", "doc_id", "text").mapInArrow(join, "a long, b long")


def _held_shingles(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, component, d, n, key) for every shingle of every text of (doc_id, component, text).

    ``d`` is the text's digest and ``n`` the size of its set.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count in portions(batch.column(2)):
                some = batch.slice(at, count)
                sets, digests = shingle_sets(some.column(2), length)
                n = np.array([len(s) for s in sets], np.int64)
                owner = np.repeat(np.arange(count), n)
                found = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                for part in range(0, len(found), 100_000):
                    of = owner[part : part + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(some.column(i).take(pa.array(of)) for i in range(2)),
                            *(pa.array(c[of]) for c in (digests[:, 0], n)),
                            pa.array(found[part : part + 100_000]),
                        ],
                        ["doc_id", "component", "d", "n", "key"],
                    )

    return texts.select("doc_id", "component", "text").mapInArrow(
        make, "doc_id long, component long, d long, n long, key long"
    )


def _firsts(held: DataFrame, percent: int) -> DataFrame:
    """(doc_id, component, d, n, key, most): of each set's shingles in one order, the group's rarest first, the first.

    Where the first shingle that two alike sets share is at ``at`` of one, it is among these, and the other set has
    at most ``most`` shingles. Those of one set only are not returned; they take the first places.
    """
    whole = Window.partitionBy("component", "doc_id", "d")
    n, at = F.col("n"), F.col("at")
    return (
        held.withColumn("times", F.count("*").over(Window.partitionBy("component", "key")))
        .where("times > 1")
        .withColumn("at", n - F.count("*").over(whole) + F.row_number().over(whole.orderBy("times", "key")) - 1)
        .where(100 * at <= (100 - percent) * n)
        .select(
            "doc_id", "component", "d", "n", "key",
            F.floor((100 * n - (100 + percent) * at) / percent).alias("most"),
        )
    )


def _refined(grouped: DataFrame, texts: DataFrame, length: int, percent: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Groups (node, component) within the large groups of (node, component), and the first shingles of their sets.

    Alike sets share one of the first shingles of both in any order that the group's sets have in common, so the
    sets that a shingle leads to, ordered by size and cut where no set before reaches the next, make new groups.
    Rounds go on while the sets in groups of more than ``slice_rows`` become fewer by half.
    """
    own = _among(texts, grouped.select(F.col("node").alias("doc_id")))
    found = grouped
    before, done = grouped.count(), []
    while True:
        # Repeated rows of one document are one set.
        sets = own.join(found.withColumnRenamed("node", "doc_id"), "doc_id").dropDuplicates(["doc_id", "text"])
        first = written(_firsts(_held_shingles(sets, length), percent), "firsts")
        by_size = Window.partitionBy("component", "key").orderBy("n", "doc_id", "d")
        links = (
            first.select(
                F.col("doc_id").alias("a"),
                F.lag("doc_id").over(by_size).alias("b"),
                "n",
                F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"),
            )
            .where("a <> b AND n <= reach")
            .select("a", "b")
        )
        found = written(components(links), "refined")
        large = written(
            found.groupBy("component").agg(F.count("*").alias("rows")).where(F.col("rows") > slice_rows), "large"
        )
        left = large.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        if left == 0 or 2 * left > before:
            done.append(found)
            return reduce(DataFrame.unionByName, done), first
        before = left
        done.append(found.join(large, "component", "left_anti").select("node", "component"))
        found = found.join(large, "component", "left_semi").select("node", "component")


def classes(docs: DataFrame, length: int = 4, percent: int = 85, slice_rows: int = SLICE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of (doc_id, text).

    A set holds the distinct shingles of ``length`` words with A-Z as a-z, or the whole sequence where there are
    fewer words; it is empty without words or text. Two sets link when 100 * intersection >= percent * union, and
    component_id is the smallest doc_id that links lead to, the document's own included. Rows with one doc_id
    should have one text; each such row is returned. Rows with a NULL doc_id are returned with their own size and
    a NULL component_id. An empty table gives no row.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sampled = _sampled(plain, length, percent)
    info = written(sampled.where("key IS NULL").drop("key", "doc"), "sets")
    met = (
        sampled.where("key IS NOT NULL")
        .select("key", "doc", F.count("*").over(Window.partitionBy("key")).alias("times"))
        .where("times > 1 AND doc IS NOT NULL")
        .groupBy("doc")
        .agg(F.count("*").alias("met"))
    )
    hoping = info.where("n > 0 AND short IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(F.min("short").alias("short"))
    hoped = hoping.join(met, "doc", "left").where("short <= coalesce(met, 0)").select(F.col("doc").alias("doc_id"))
    texts = written(_among(plain.where("text IS NOT NULL"), written(hoped, "candidates")), "texts", compression="zstd")
    keyed = _keyed(texts, length, percent)
    made = written(keyed.where("key IS NULL").drop("key", "doc"), "needs")
    needs = made.where("need IS NOT NULL").select("doc_id", "need")
    near = made.where("a IS NOT NULL").select("a", "b", "times")
    by_key = Window.partitionBy("key").orderBy("doc")
    shared = (
        keyed.where("key IS NOT NULL")
        .select("key", "doc", F.lag("doc").over(by_key).alias("last"))
        .where("last <> doc")
        .select(F.col("doc").alias("a"), F.col("last").alias("b"), F.lit(1).cast("long").alias("times"))
    )
    # Copies: the smallest id of a digest stands for all of them.
    whole = info.where("n > 0 AND doc_id IS NOT NULL")
    lead = whole.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("lead"))
    led = written(whole.join(lead, ["d1", "d2", "n"]).select("doc_id", "lead").distinct(), "copies")
    copies = led.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    needed = needs.join(led, "doc_id").groupBy(F.col("lead").alias("node")).agg(F.max("need").alias("need"))
    sharing = written(
        shared.unionByName(near)
        .groupBy("a", "b")
        .agg(F.sum("times").alias("times"))
        .join(led.toDF("a", "la"), "a")
        .join(led.toDF("b", "lb"), "b")
        .where("la <> lb")
        .groupBy(F.col("la").alias("a"), F.col("lb").alias("b"))
        .agg(F.sum("times").alias("times")),
        "sharing",
    )
    # A set's links count every key it shares at least once: with fewer of them than it needs it has no partner.
    ends = sharing.select("a", "times").unionByName(sharing.select(F.col("b").alias("a"), "times"))
    able = (
        ends.groupBy(F.col("a").alias("node")).agg(F.sum("times").alias("times"))
        .join(needed, "node")
        .where("times >= need")
        .select("node", "need")
    )
    grouped = written(components(sharing.select("a", "b")).join(able, "node").select("node", "component"), "grouped")
    large = grouped.groupBy("component").agg(F.count("*").alias("rows")).where(F.col("rows") > slice_rows)
    wide = written(grouped.join(large, "component", "left_semi").select("node", "component"), "wide")
    first = None
    if not wide.isEmpty():
        refined, first = _refined(wide, texts, length, percent, slice_rows)
        grouped = grouped.join(large, "component", "left_anti").select("node", "component").unionByName(refined)
    counted = grouped.groupBy("component").agg(F.count("*").alias("rows"))
    slices = F.ceil(F.col("rows") / slice_rows).cast("long")
    members = written(
        grouped.join(counted, "component").select(
            F.col("node").alias("doc_id"),
            "component",
            slices.alias("slices"),
            F.pmod(F.xxhash64("node"), slices).alias("slice"),
        ),
        "members",
    )
    many = members.where("slices > 1")
    by_hash = Window.partitionBy("component").orderBy(F.xxhash64("doc_id"), "doc_id")
    anchors = (
        many.where("slice = 0")
        .withColumn("k", F.row_number().over(by_hash))
        .where(F.col("k") <= ANCHORS)
        .select("doc_id", "component", F.explode(F.sequence(F.lit(1), F.col("slices") - 1)).alias("slice"))
    )
    own = members.select("doc_id", "component", "slice")

    def place(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("doc_id", F.concat_ws(":", "component", "slice", *more).alias("place"))

    grouped_texts = _among(texts, members)
    once = written(_tree_links(place(own.unionByName(anchors)).join(grouped_texts, "doc_id"), length, percent), "tree")
    if not many.isEmpty():
        tied = components(once)
        label = many.join(tied.toDF("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        sized = label.groupBy("component", "label").agg(F.count("*").alias("n"))
        main = sized.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        sides = label.join(main, "component").select(
            "doc_id", "component", "slice", (F.col("label") != F.col("main")).alias("loose")
        )
        # A set's first shingles are one row until they are joined.
        listed = first.groupBy("doc_id", "d", "n").agg(F.collect_list(F.struct("key", "most")).alias("listed"))
        held = written(listed.join(sides, "doc_id").select("*", F.inline("listed")).drop("listed"), "held")
        offered = held.groupBy("component", "key", F.col("slice").alias("other")).agg(
            F.min("n").alias("fewest"), F.max("most").alias("reach")
        )
        # A loose set has its partners where one of its first shingles is, of a size that both allow.
        dealt = written(
            held.where("loose")
            .join(offered, ["component", "key"])
            .where("slice <> other AND fewest <= most AND n <= reach")
            .select("doc_id", "component", F.col("other").alias("slice"))
            .distinct(),
            "dealt",
        )
        # The sets dealt to a slice go in lots of bounded size, so a place never holds much more than a slice and a
        # lot however many sets are loose.
        lots = dealt.groupBy("component", "slice").agg(F.ceil(F.count("*") / slice_rows).cast("long").alias("lots"))
        dealt = dealt.join(lots, ["component", "slice"]).select(
            "doc_id", "component", "slice", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("lots")).alias("lot")
        )
        met = many.join(lots, ["component", "slice"]).select(
            "doc_id", "component", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot")
        )
        again = dealt.unionByName(met)
        once = once.unionByName(_tree_links(place(again, "lot").join(texts, "doc_id"), length, percent))
    found = components(once.unionByName(copies)).toDF("doc_id", "component_id")
    return info.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
