"""Packing: shortest-pack-first over the histogram of piece lengths.

Only the histogram, at most one count per length, reaches the driver. Lengths are placed longest first, each
into the shortest packs it fits; what results is a list of packing patterns with counts. Pieces find their
sequence by their rank within their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.tokens import encoder
from gazeframe.session import work_dir

LENGTH = 4096
END = 2

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every document's token ids, each of at most ``length`` ids.

    Columns doc_id, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and doc_tokens, and with
    ``with_ids`` the ids. NULL and empty texts are the single id ``end``; repeated rows are cut each.
    """
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = some.column(1).cast(pa.binary()).to_pylist()
                rows: list[list] = [[] for _ in range(6)]
                for doc, ids in zip(some.column(0).to_pylist(), made.encode(texts, end)):
                    for start in range(0, len(ids), 4 * length):
                        piece = ids[start : start + 4 * length]
                        values = (doc, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)
                        for column, value in zip(rows, values):
                            column.append(value)
                arrays = [pa.array(c, pa.int64()) for c in rows[:5]]
                if with_ids:
                    offsets = [0]
                    for n in rows[2]:
                        offsets.append(offsets[-1] + n)
                    flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(rows[5]))])
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing patterns of a length histogram: ([(length, times), ...], number of packs), longest first.

    Packs with the same contents are one entry. Each length splits at most one entry, so their number is of the
    order of the number of lengths, whatever the counts are.
    """
    open_packs: list[tuple[int, int, int, list]] = []
    number = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            number += 1
            if not open_packs or open_packs[0][0] + size > length:
                each = min(length // size, left)
                packs = left // each
                heapq.heappush(open_packs, (each * size, number, packs, [(size, each)]))
                left -= each * packs
                continue
            fill, _, packs, items = heapq.heappop(open_packs)
            above = open_packs[0][0] if open_packs else length
            each = max(1, min((length - fill) // size, -(-(above - fill) // size), left // packs))
            used = min(packs, left // each)
            heapq.heappush(open_packs, (fill + each * size, number, used, [*items, (size, each)]))
            if used < packs:
                number += 1
                heapq.heappush(open_packs, (fill, number, packs - used, items))
            left -= each * used
    return [(items, packs) for _, _, packs, items in sorted(open_packs, key=lambda p: p[:2])]


def runs(made: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """Rows (length, first rank, after the last rank, times, first sequence, offset), one per pattern and length."""
    rows, rank, sequence = [], {}, 0
    for items, packs in made:
        offset = 0
        for size, times in items:
            first = rank.get(size, 0)
            rows.append((size, first, first + packs * times, times, sequence, offset))
            rank[size] = first + packs * times
            offset += size * times
        sequence += packs
    return pd.DataFrame(rows, columns=["length", "first", "after", "times", "sequence", "at"]).astype("int64")


def pack(pieces: DataFrame, length: int = LENGTH, slices: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs doc_id, start and length from 1 to ``length``.

    ``pieces`` is read twice and should be a written table. Ranks within a length are counted in hashed slices,
    so a length that a third of all pieces have is no single task. Equal rows are interchangeable. An empty
    table gives an empty result. A column of ``pieces`` named sequence_id or offset is replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    slices = slices or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)))
    counts = sliced.groupBy("length", "__slice").agg(F.count("*").alias("n"))
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not 0 < size <= length for size in histogram):
        raise ValueError(f"lengths must be from 1 to {length}")
    table = runs(patterns(histogram, length))
    placed = spark.createDataFrame(table, "length long, first long, after long, times long, sequence long, at long")
    earlier = Window.partitionBy("length").orderBy("__slice")
    base = counts.select("length", "__slice", (F.sum("n").over(earlier) - F.col("n")).alias("__base"))
    order = Window.partitionBy("length", "__slice").orderBy("doc_id", "start")
    ranked = (
        sliced.withColumn("__row", F.row_number().over(order) - 1)
        .join(base, ["length", "__slice"])
        .withColumn("__rank", F.col("__row") + F.col("__base"))
    )
    # At most one run per pattern and length: bounded by the square of the sequence length, not by the data.
    inside = (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("after"))
    joined = ranked.join(F.broadcast(placed.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & inside)
    step = F.col("__rank") - F.col("first")
    return joined.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col("sequence") + F.floor(step / F.col("times"))).alias("sequence_id"),
        (F.col("at") + (step % F.col("times")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Token pieces of all documents with their places: the piece columns, sequence_id and offset.

    The pieces, some 40 bytes a document, are written once to the shared folder, so that the histogram and the
    ranks see the same rows and a lost executor costs no second tokenising. NULL and empty texts are ``end`` alone,
    a NULL doc_id stays NULL, repeated rows are packed each, other columns are left out; doc_id is cast to long. An
    empty table gives no row.
    """
    at = work_dir(docs.sparkSession, "pieces")
    token_pieces(docs, path, length, end).write.parquet(at)
    return pack(docs.sparkSession.read.parquet(at), length)
