"""Prefix trie of conversations from padded matrices of turn ids.

Conversations are sorted by their turn ids and cut into shards of bounded size. A shard is a matrix with a row per
conversation and a column per depth, padded behind the last turn. A mask of where a column differs from the row
above, OR-accumulated over the columns, marks where nodes start; ``reduceat`` between the starts sums every depth.
Only nodes on the path of a shard's first or last row can reach into another shard. These are added up by path,
with what neighbouring shards both counted taken off again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.components import written

#: Bounds of a shard; one conversation alone may be larger.
SHARD_TURNS = 400_000
SHARD_ROWS = 65_536
#: Columns of a matrix; deeper turns are in further matrices that hold only the rows which reach them.
COLUMNS = 64
ID_BYTES = 16
#: Length of the groups that share a beginning, and what a conversation's hash is taken modulo.
GROUP = 5
HEADS = 9

CLOSED, OPEN, ENDS, EDGE = range(4)
EMPTY = hashlib.sha256(b"").hexdigest()

NUMBERS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
PARTS = pa.schema(
    [
        ("kind", pa.int32()),
        ("shard", pa.int64()),
        ("depth", pa.int64()),
        ("key", pa.string()),
        ("parent_key", pa.string()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        *[(name, pa.int64()) for name in NUMBERS],
        ("ends_sha256", pa.string()),
        ("ids", pa.list_(pa.int64())),
        ("path", pa.binary()),
        ("sizes", pa.list_(pa.int64())),
    ]
)
SCHEMA = (
    "kind int, shard long, depth long, key string, parent_key string, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids array<long>, "
    "path binary, sizes array<long>"
)


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, path, sizes): the turns of every rebuilt conversation as 128-bit ids and UTF-8 bytes of text.

    A conversation c begins with the first h turns of conversation c - c % group and goes on with its own turns
    behind the first h, where h is crc32 of c in decimal modulo ``heads``. Turns go by ``turn``, NULL first, and
    rows of one turn by the hash of role and text. Texts do not leave their task: a turn is shuffled as 20 bytes
    and its number, and a conversation is gathered in that form.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.md5(whole.cast("binary")).alias("id"), F.octet_length(text).cast("long").alias("size")).alias("t"),
    )
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    own = written(gathered.select("conv_id", F.transform("t", lambda t: F.struct(t.id, t["size"])).alias("t")), "turns")
    first = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("t", 1, heads).alias("first")
    )
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    begin = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), head)).otherwise(F.slice("t", F.lit(1), F.lit(0)))
    rest = F.slice("t", head + 1, F.greatest(F.size("t") - head, F.lit(0)))
    return (
        own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
        .join(first, "base", "left")
        .select("conv_id", F.concat(begin, rest).alias("t"))
        .select("conv_id", F.unhex(F.array_join("t.id", "")).alias("path"), F.col("t.size").alias("sizes"))
    )


def _dense(flat: np.ndarray) -> np.ndarray:
    """Numbers from 0 of 128-bit ids, in the order of their bytes."""
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    ranked = flat[order]
    out = np.zeros(len(flat), np.int32)
    if len(flat):
        out[order[1:]] = np.cumsum((ranked[1:] != ranked[:-1]).any(axis=1))
    return out


def _matrices(ids: np.ndarray, at: np.ndarray, size: np.ndarray, fill) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, padded matrix) of every ``COLUMNS`` columns, with the rows that reach them."""
    out = []
    for begin in range(0, int(size.max(initial=0)), COLUMNS):
        rows = np.flatnonzero(size > begin)
        cell = np.arange(COLUMNS) < (size[rows] - begin)[:, None]
        matrix = np.full(cell.shape, fill, ids.dtype)
        matrix[cell] = ids[((at[rows] + begin)[:, None] + np.arange(COLUMNS))[cell]]
        out.append((rows, matrix))
    return out


def _order(conv: np.ndarray, size: np.ndarray, matrices: list) -> np.ndarray:
    """Rows by their ids, shorter first, then by conversation: stable sorts from the last matrix to the first."""
    order = np.argsort(conv, kind="stable")
    for begin, (rows, matrix) in reversed(list(zip(range(0, 1 << 62, COLUMNS), matrices))):
        reach = size[order] > begin
        held = order[reach]
        order = np.concatenate([order[~reach], held[np.lexsort(matrix[np.searchsorted(rows, held)].T[::-1])]])
    return order


def _keys(path: bytes) -> list[str]:
    """A key for every prefix of a path, the empty one included."""
    running = hashlib.md5()
    keys = [running.hexdigest()]
    for at in range(0, len(path), ID_BYTES):
        running.update(path[at : at + ID_BYTES])
        keys.append(running.copy().hexdigest())
    return keys


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _summed(shard: int, conv: np.ndarray, flat: np.ndarray, bytes_: np.ndarray, size: np.ndarray) -> list[dict]:
    """Nodes of one shard as columns, deepest first, as if there were no other shard."""
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    ids = _dense(flat)
    order = _order(conv, size, _matrices(ids, at, size, -1))
    conv, size, at = conv[order], size[order], at[order]
    n = len(conv)

    def path(row: int) -> bytes:
        return flat[at[row] : at[row] + size[row]].astype(">u8").tobytes()

    keys = {0: _keys(path(0)), n - 1: _keys(path(n - 1))}
    changed = np.zeros(n, bool)
    shared = np.zeros(n, np.int64)
    depths = []
    for (rows, matrix), (_, lengths) in zip(_matrices(ids, at, size, -1), _matrices(bytes_, at, size, 0)):
        new = np.ones(matrix.shape, bool)
        follows = np.flatnonzero(rows[1:] == rows[:-1] + 1) + 1
        new[follows] = matrix[follows] != matrix[follows - 1]
        new[:, 0] |= changed[rows]
        np.logical_or.accumulate(new, axis=1, out=new)
        changed[rows] = new[:, -1]
        filled = matrix >= 0
        shared[rows] += (~new & filled).sum(axis=1)
        depths.append((rows, filled, new, lengths))
    is_leaf = np.ones(n, np.int64)
    is_leaf[:-1] = shared[1:] < size[:-1]

    made: list[dict] = []
    repeated = np.zeros(n, np.int64)  # bytes of a row's turns, from this depth on, that the row above has too
    begins = np.zeros(n, np.int64)  # whether a node of the depth below starts at the row
    below = None
    for depth in range(int(size.max(initial=0)), -1, -1):
        if depth:
            rows, filled, new, lengths = depths[(depth - 1) // COLUMNS]
            c = (depth - 1) % COLUMNS
            mine = filled[:, c]
            at_row = rows[mine]
            fresh = new[mine, c]
            repeated[at_row] += np.where(fresh, 0, lengths[mine, c])
        else:
            at_row = np.arange(n)
            fresh = at_row == 0
        starts = np.flatnonzero(fresh)
        ended = (size[at_row] == depth).astype(np.int64)
        node = {
            "depth": depth,
            "row": at_row[starts],
            "conv_id": np.minimum.reduceat(conv[at_row], starts),
            "n_convs": np.diff(np.append(starts, len(at_row))),
            "n_children": np.add.reduceat(begins[at_row], starts),
            "n_leaves": np.add.reduceat(is_leaf[at_row], starts),
            "saved_tokens": np.add.reduceat(repeated[at_row], starts),
            "n_ends": np.add.reduceat(ended, starts),
            "key": np.full(len(starts), None, object),
        }
        if at_row[0] == 0:
            node["key"][0] = keys[0][depth]
        if at_row[-1] == n - 1:
            node["key"][-1] = keys[n - 1][depth]
        # The rows that end at a node come first among its rows.
        node["ends"] = [
            conv[r : r + k].tolist() if k else [] for r, k in zip(node["row"].tolist(), node["n_ends"].tolist())
        ]
        begins[:] = 0
        begins[node["row"]] = 1
        if below is not None:
            of = np.cumsum(fresh)[np.searchsorted(at_row, below["row"])] - 1
            below["parent_conv_id"], below["parent_key"] = node["conv_id"][of], node["key"][of]
            made.append(below)
        below = node
    below["parent_conv_id"], below["parent_key"] = np.full(1, None, object), np.full(1, None, object)
    made.append(below)
    return made


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=PARTS)


def _node_batches(shard: int, made: list[dict]) -> Iterator[pa.RecordBatch]:
    closed = {name: [] for name in PARTS.names}
    rest: list[dict] = []
    for node in made:
        is_open = np.array([k is not None for k in node["key"]], bool)
        for i in np.flatnonzero(is_open):
            row = {"shard": shard, "depth": node["depth"], "key": node["key"][i]}
            numbers = {name: int(node[name][i]) for name in ["conv_id", *NUMBERS]}
            rest.append({"kind": OPEN, **row, "parent_key": node["parent_key"][i], **numbers})
            if node["ends"][i]:
                rest.append({"kind": ENDS, **row, "conv_id": node["ends"][i][0], "ids": node["ends"][i]})
        some = np.flatnonzero(~is_open)
        known = np.array([k is None for k in node["parent_key"][some]], bool)
        closed["depth"].append(np.full(len(some), node["depth"], np.int64))
        for name in ["conv_id", *NUMBERS]:
            closed[name].append(node[name][some])
        closed["parent_key"].extend(node["parent_key"][some])
        closed["parent_conv_id"].extend(np.where(known, node["parent_conv_id"][some], None))
        closed["ends_sha256"].extend(_sha(node["ends"][i]) if node["ends"][i] else EMPTY for i in some)
    total = len(closed["parent_key"])
    columns = []
    for field in PARTS:
        name = field.name
        if name in ("kind", "shard"):
            value = CLOSED if name == "kind" else shard
            columns.append(pa.array(np.full(total, value), field.type))
        elif name in ("depth", "conv_id", *NUMBERS):
            columns.append(pa.array(np.concatenate(closed[name]) if closed[name] else [], field.type))
        elif closed[name]:
            columns.append(pa.array(closed[name], field.type))
        else:
            columns.append(pa.nulls(total, field.type))
    whole = pa.RecordBatch.from_arrays(columns, schema=PARTS)
    for start in range(0, total, 10_000):
        yield whole.slice(start, 10_000)
    for start in range(0, len(rest), 1_000):
        yield _batch(rest[start : start + 1_000])


def _overlap(shard: int, last: bytes, sizes: list[int], first: bytes) -> list[dict]:
    """What two neighbouring shards both counted for the nodes on the path that their rows share, to be added.

    The shard of ``first`` took these nodes for new, so it counted them as children and left out their bytes;
    the shard of ``last`` took its last row for a leaf, which it is not if ``first`` goes on from there.
    """
    turns = min(len(last), len(first)) // ID_BYTES
    same = 0
    while same < turns and last[same * ID_BYTES : (same + 1) * ID_BYTES] == first[same * ID_BYTES : (same + 1) * ID_BYTES]:
        same += 1
    keys = _keys(last[: same * ID_BYTES])
    leaf = -1 if same * ID_BYTES == len(last) else 0
    out, saved = [], 0
    for depth in range(same, -1, -1):
        saved += sizes[depth - 1] if depth else 0
        out.append(
            {
                "kind": OPEN,
                "shard": shard,
                "depth": depth,
                "key": keys[depth],
                "parent_key": keys[depth - 1] if depth else None,
                "n_convs": 0,
                "n_children": -1 if depth < same else 0,
                "n_leaves": leaf,
                "saved_tokens": saved,
            }
        )
    return out


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    conv = batch.column(0).to_numpy()
    paths = batch.column(1).cast(pa.large_binary())
    offsets = np.frombuffer(paths.buffers()[1], np.int64)[paths.offset : paths.offset + len(paths) + 1]
    data = paths.buffers()[2]
    body = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    flat = np.frombuffer(body, ">u8").reshape(-1, 2).astype(np.uint64)
    sizes = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return conv, flat, sizes, np.diff(offsets) // ID_BYTES


def _shards(batches: Iterator[pa.RecordBatch], turns: int, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Consecutive conversations with at most ``turns`` turns and ``rows`` rows, or a single longer one."""
    held: list[tuple] = []
    held_turns = held_rows = 0
    for batch in batches:
        conv, flat, sizes, size = _read(batch)
        ends = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < len(conv):
            j = int(np.searchsorted(ends, ends[i] + turns - held_turns, side="right")) - 1
            j = min(max(j, i), i + rows - held_rows, len(conv))
            if j == i and not held:
                j = i + 1
            if j > i:
                held.append((conv[i:j], flat[ends[i] : ends[j]], sizes[ends[i] : ends[j]], size[i:j]))
                held_turns, held_rows = held_turns + int(ends[j] - ends[i]), held_rows + j - i
                i = j
            if i < len(conv):
                yield tuple(np.concatenate(column) for column in zip(*held))
                held, held_turns, held_rows = [], 0, 0
    if held:
        yield tuple(np.concatenate(column) for column in zip(*held))


def _node_parts(shard_turns: int, shard_rows: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        last = None
        for conv, flat, bytes_, size in _shards(batches, shard_turns, shard_rows):
            shard = (part << 32) | number
            first = flat[: size[0]].astype(">u8").tobytes()
            if last is None:
                yield _batch([{"kind": EDGE, "shard": part, "depth": 0, "path": first}])
            else:
                yield _batch(_overlap(shard, *last, first))
            yield from _node_batches(shard, _summed(shard, conv, flat, bytes_, size))
            tail = len(flat) - size[-1]
            last = flat[tail:].astype(">u8").tobytes(), bytes_[tail:].tolist()
            number += 1
        if last is not None:
            yield _batch([{"kind": EDGE, "shard": part, "depth": 1, "path": last[0], "sizes": last[1]}])

    return write


def _edge_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            if row["next_first"] is not None:
                # Between two tasks the overlap has no shard of its own.
                yield _batch(_overlap(-1, row["last"], row["sizes"], row["next_first"]))


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key; pieces of a key follow each other and are never joined in memory."""
    key, running = None, None
    for batch in batches:
        for row in batch.to_pylist():
            ids = ",".join(map(str, row["ids"])).encode()
            if row["key"] == key:
                running.update(b"," + ids)
                continue
            if key is not None:
                yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": running.hexdigest()}])
            key, running = row["key"], hashlib.sha256(ids)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": running.hexdigest()}])


def prefix_nodes(
    sequences: DataFrame, shard_turns: int = SHARD_TURNS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The nodes of the trie over ``sequences`` (conv_id, path, sizes), one row per distinct beginning.

    ``conv_id`` is a whole number and the key of ``sequences``; ``path`` holds 16 bytes per turn and ``sizes`` the
    weight of each turn. See :func:`trie` for the columns. Sequences are range-partitioned and sorted by path and
    conv_id, so copies of one sequence are cut like any others. Shards are written to the shared folder and what
    open nodes add up to is joined from there. The ids that end at an open node are hashed as a stream: SHA-256
    has to see them one after the other, so one task reads them, 8 bytes each, without holding them.
    """
    spread = sequences.select("conv_id", "path", "sizes").repartitionByRange("path", "conv_id")
    ordered = spread.sortWithinPartitions("path", "conv_id")
    parts = written(ordered.mapInArrow(_node_parts(shard_turns, shard_rows), SCHEMA), "trie")

    edges = (
        parts.where(F.col("kind") == EDGE)
        .groupBy("shard")
        .agg(
            F.max(F.when(F.col("depth") == 0, F.col("path"))).alias("first"),
            F.max(F.when(F.col("depth") == 1, F.struct("path", "sizes"))).alias("l"),
        )
        # One row per task that had rows.
        .select(F.col("l.path").alias("last"), F.col("l.sizes").alias("sizes"), F.lead("first").over(Window.orderBy("shard")).alias("next_first"))
    )
    opened = parts.where(F.col("kind") == OPEN)
    merged = written(
        opened.unionByName(edges.mapInArrow(_edge_overlaps, SCHEMA))
        .groupBy("key", "depth")
        .agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *[F.sum(n).alias(n) for n in NUMBERS]),
        "open-nodes",
    )
    ended = (
        parts.where(F.col("kind") == ENDS)
        .select("key", "conv_id", "ids")
        .repartition("key")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(_end_hashes, "key string, ends_sha256 string")
    )
    least = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    columns = ["conv_id", "depth", "parent_conv_id", *NUMBERS, "ends_sha256"]
    open_nodes = (
        merged.join(ended, "key", "left")
        .join(least, "parent_key", "left")
        .withColumns({"ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY)), "parent_conv_id": F.col("__parent")})
        .select(*columns)
    )
    closed = parts.where(F.col("kind") == CLOSED)
    # A popular parent has children in every shard: they meet their own shard's row of it.
    local = opened.select("shard", F.col("key").alias("parent_key")).distinct().join(least, "parent_key")
    hanging = (
        closed.where("parent_key IS NOT NULL")
        .join(local, ["shard", "parent_key"])
        .withColumn("parent_conv_id", F.col("__parent"))
        .select(*columns)
    )
    return closed.where("parent_key IS NULL").select(*columns).unionByName(hanging).unionByName(open_nodes)


def trie(conversations: DataFrame, **options) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations (see :func:`rebuilt`), the empty one included.

    ``conversations`` needs conv_id, turn, role and text; NULL roles and texts are empty. Returns conv_id (smallest
    member), depth, parent_conv_id (NULL at the root), n_convs (members), n_children, n_leaves (nodes without
    children in the subtree), saved_tokens (over the subtree, members less one times bytes of the last text) and
    ends_sha256 (SHA-256 of the comma-joined conv_ids that end at the node). Rows without conv_id are in no
    conversation and left out. Repeated rows are turns of their own. A conversation without turns after rebuilding
    counts at the root. An empty table gives no row. Other columns are ignored. A conversation's ids are one row,
    so it may have up to some 50 million turns.
    """
    return prefix_nodes(rebuilt(conversations), **options)
