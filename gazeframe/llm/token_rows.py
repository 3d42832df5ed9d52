"""Token-ID output: best-fit-decreasing packing with a segment tree over capacities.

Every task packs its documents in blocks of bounded size: pieces go longest first into the row with the least
room that still holds them, which a segment tree over room sizes finds in log(length) steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.tokens import encoder

LENGTH = 4096
END = 2
PAD = 0
BLOCK_TOKENS = 2_000_000

SCHEMA = (
    "part int, block int, row int, n_tokens int, input_ids array<int>, cu_seqlens array<int>, "
    "position_ids array<int>, doc_ids array<bigint>, starts array<bigint>"
)


class Rooms:
    """Rows by the room they have left: a segment tree of counts over room sizes from 0 to ``most``."""

    def __init__(self, most: int) -> None:
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest room of at least ``least``, as (room, row), removed; None if there is none."""
        at = least + self.width
        while not self.count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.width
        self._change(room, -1)
        return room, self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += by
            at >>= 1


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Indices of pieces by row, packed longest first; ties go in the given order."""
    rooms, rows = Rooms(most), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            rows.append([i])
            room, row = most, len(rows) - 1
        else:
            room, row = found
            rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


def _matrix(pieces: list[tuple], most: int, pad: int, part: int, block: int) -> pa.RecordBatch:
    rows = best_fit([len(p[2]) for p in pieces], most)
    ids = np.full((len(rows), most), pad, np.int32)
    positions = np.zeros((len(rows), most), np.int32)
    ends, docs, starts, sizes = [], [], [], []
    for r, row in enumerate(rows):
        at, bounds = 0, [0]
        for i in row:
            doc, start, piece = pieces[i]
            ids[r, at : at + len(piece)] = piece
            positions[r, at : at + len(piece)] = np.arange(len(piece))
            at += len(piece)
            bounds.append(at)
        ends.append(bounds)
        docs.append([pieces[i][0] for i in row])
        starts.append([pieces[i][1] for i in row])
        sizes.append(at)
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * most)
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * n, pa.int32()),
            pa.array([block] * n, pa.int32()),
            pa.array(range(n), pa.int32()),
            pa.array(sizes, pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(ids.reshape(-1))),
            pa.array(ends, pa.list_(pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(positions.reshape(-1))),
            pa.array(docs, pa.list_(pa.int64())),
            pa.array(starts, pa.list_(pa.int64())),
        ],
        ["part", "block", "row", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts"],
    )


def packed_rows(
    docs: DataFrame, path: str, length: int = LENGTH, end: int = END, pad: int = PAD, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Rows of ``length`` token ids that hold every id of every document once.

    ``input_ids`` is padded with ``pad`` behind ``n_tokens``; ``cu_seqlens`` has 0 and the end of each segment;
    ``position_ids`` restart at 0 with each segment; ``doc_ids`` and ``starts`` say which ids of which document a
    segment holds. Documents longer than a row are cut into full rows and a rest, so joining the segments of a
    doc_id by start gives its ids back. A document is its text's ids and ``end``; NULL and empty texts are
    ``end`` alone; a NULL doc_id stays NULL; repeated rows are packed each. ``part`` numbers the input split,
    ``block`` the block of some ``block_tokens`` ids in it. Nothing is shuffled; a task that
    runs again reads the same split and writes the same rows. An empty table gives no row.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = encoder(path), TaskContext.get().partitionId()
        pieces: list[tuple] = []
        held, block = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column(1).cast(pa.binary()).to_pylist()
                for doc, ids in zip(some.column(0).to_pylist(), made.encode(texts, end)):
                    values = np.frombuffer(ids, np.uint32).astype(np.int32)
                    for start in range(0, len(values), length):
                        pieces.append((doc, start, values[start : start + length]))
                        held += len(pieces[-1][2])
                        if held >= block_tokens:
                            yield from _slices(_matrix(pieces, length, pad, part, block))
                            pieces, held, block = [], 0, block + 1
        if pieces:
            yield from _slices(_matrix(pieces, length, pad, part, block))

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(write, SCHEMA)


def _slices(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
