"""LM scoring: context-tree weighting over bytes.

A byte is eight binary decisions, each in the context of the bytes of the running text before it. In every context
of every depth a Krichevsky-Trofimov estimator predicts a decision; context-tree weighting mixes the estimators of
all depths, each weighed by how well it has coded the training texts. Counts are those of the training corpus.

The corpus enters as distinct words and n-grams of bytes with counts, so all work after the first pass is on
these. They meet the documents in buckets of a bounded number of bytes: a task reads the facts of a bucket, then
its documents, one compressed pack at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.components import written
from gazeframe.llm.shingles import portions

DEPTH = 5
TOP = 2
END = b"\n"
BUCKET_BYTES = 48 << 20
HELD_WORDS = 500_000
HELD_GRAMS = 2_400_000
PORTION = 500_000
PACK_BYTES = 1 << 20
PACK_LEVEL = 6
MOST_PARTS = 20_000


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function from 1/2 on, by Stirling's series eight steps up."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives any order of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - log(np.pi) - _log_gamma(a + b + 1.0)


def _mixed(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes with children, and the share of the node's own estimator in it."""
    own = _log_kt(a, b)
    weighted = np.logaddexp(own, below) - log(2)
    return weighted, np.exp(own - log(2) - weighted)


def _rise(key: np.ndarray, count: np.ndarray, depth: int, top: int):
    """Levels ``depth`` to ``top`` of the tree of some n-grams.

    Returns the leaf row of each of the eight decisions of each n-gram, the decisions, the leaves' probability
    of a one mixed over the levels, each leaf's decision node, and (node, a, b, log weighted) of level ``top``.
    """
    byte, context = key & 255, key >> 8
    bits = np.arange(8)
    node = (1 << bits)[None, :] | (byte[:, None] >> (8 - bits)[None, :])
    bit = (byte[:, None] >> (7 - bits)[None, :]) & 1
    rows, leaf = np.unique((context[:, None] << 8 | node).reshape(-1), return_inverse=True)
    weight = np.repeat(count, 8).astype(float)
    ones = bit.reshape(-1).astype(float)
    a = np.bincount(leaf, weight * (1 - ones), len(rows))
    b = np.bincount(leaf, weight * ones, len(rows))
    p = (b + 0.5) / (a + b + 1)
    logs, to, level = _log_kt(a, b), np.arange(len(rows)), rows
    for d in range(depth - 1, top - 1, -1):
        level, up = np.unique(((level >> 8) & ((1 << 8 * d) - 1)) << 8 | (level & 255), return_inverse=True)
        a, b = np.bincount(up, a, len(level)), np.bincount(up, b, len(level))
        logs, own = _mixed(a, b, np.bincount(up, logs, len(level)))
        to = up[to]
        p = own[to] * ((b + 0.5) / (a + b + 1))[to] + (1 - own[to]) * p
    return leaf.reshape(-1, 8), bit, p, (rows & 255), (level & 255, a, b, logs)


def _log_probabilities(ngrams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, lp): log10 probability of the byte of each n-gram (key, n) after its context.

    N-grams are grouped by their two nearest context bytes; the two levels above are joined by decision node,
    where at most 65,536 contexts meet.
    """
    near = ngrams.withColumn("near", F.expr("cast((key >> 8) & 65535 AS int)"))

    def roots(rows: pd.DataFrame) -> pd.DataFrame:
        node, a, b, logs = _rise(rows["key"].to_numpy(), rows["n"].to_numpy(), depth, TOP)[4]
        return pd.DataFrame({"near": rows["near"].iloc[0], "node": node, "a": a, "b": b, "logs": logs})

    def crown(rows: pd.DataFrame) -> pd.DataFrame:
        first, up = np.unique(rows["near"].to_numpy() & 255, return_inverse=True)
        a, b = (np.bincount(up, rows[c].to_numpy(), len(first)) for c in ("a", "b"))
        logs, own = _mixed(a, b, np.bincount(up, rows["logs"].to_numpy(), len(first)))
        one = (b + 0.5) / (a + b + 1)
        _, all_own = _mixed(a.sum(keepdims=True), b.sum(keepdims=True), logs.sum(keepdims=True))
        all_one = (b.sum() + 0.5) / (a.sum() + b.sum() + 1)
        plus = all_own * all_one + (1 - all_own) * (own * one)[up]
        return pd.DataFrame(
            {"near": rows["near"], "node": rows["node"], "plus": plus, "times": (1 - all_own) * (1 - own)[up]}
        )

    def fall(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"key": np.zeros(0, np.int64), "lp": np.zeros(0)})
        leaf, bit, p, node, _ = _rise(rows["key"].to_numpy(), rows["n"].to_numpy(), depth, TOP)
        plus, times = np.zeros(256), np.ones(256)
        plus[above["node"]], times[above["node"]] = above["plus"], above["times"]
        p = plus[node] + times[node] * p
        chosen = np.where(bit == 1, p[leaf], 1 - p[leaf])
        return pd.DataFrame({"key": rows["key"].to_numpy(), "lp": np.log10(chosen).sum(1)})

    root = near.groupBy("near").applyInPandas(roots, "near int, node int, a double, b double, logs double")
    top = root.groupBy("node").applyInPandas(crown, "near int, node int, plus double, times double")
    return near.groupBy("near").cogroup(top.groupBy("near")).applyInPandas(fall, "key long, lp double")


def normalised(words: list[bytes]) -> bytes:
    """The words of a text, each and a blank, then the end."""
    return b"".join(w + b" " for w in words) + END


def running_grams(texts: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (context bytes, then the byte) of all bytes of normalised texts, and the text of each, in portions.

    Contexts run across blanks. Before its first byte a text has a blank, and zeros before that.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        key = data.copy()
        for back in range(1, depth + 1):
            key[back:] |= data[:-back] << (8 * back)
        mine = np.ones(len(data), bool)
        mine[((np.cumsum(lengths) - lengths)[:, None] + np.arange(depth)).ravel()] = False
        return key[mine], np.repeat(np.array(owners, np.int64), lengths - depth)

    for i, text in enumerate(texts):
        led = bytes(depth - 1) + b" " + text
        # Each piece of a long text begins with the context of its first byte.
        for at in range(depth, len(led), PORTION):
            parts.append(led[at - depth : at + PORTION])
            owners.append(i)
            held += len(parts[-1])
            if held >= PORTION:
                yield out()
                parts, owners, held = [], [], 0
    if parts:
        yield out()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their numbers, of several of such pairs."""
    keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)])
    if not len(keys):
        return keys, keys
    # The parts are in order each, which a stable sort merges.
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(np.concatenate([n for _, n in parts])[order], new)


def _packs(bucket_bytes: int):
    """(bucket, pack): documents (doc_id, trains, text) in packs of some ``PACK_BYTES`` of text, compressed.

    Consecutive packs of a task are a bucket until it holds ``bucket_bytes``.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=PACK_LEVEL))
        bucket, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at, rows in portions(batch.column(2), PACK_BYTES):
                some = batch.slice(at, rows)
                size = (pc.sum(pc.binary_length(some.column(2))).as_py() or 0) + 64 * rows
                if held and held + size > bucket_bytes:
                    bucket, held = bucket + 1, 0
                held += size
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=options) as out:
                    out.write_batch(some)
                blob = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), blob], ["bucket", "pack"])

    return pack


def _unpacked(pack: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pack).read_next_batch()


def _bucket_counts(depth: int):
    """(bucket, word, key, n): the words and n-grams of each bucket of (bucket, pack), as often as they train.

    A bucket that is read in parts, or has very many words or n-grams, gives some of them more than once, with
    numbers that add up.
    """

    def cells(bucket: int, words: dict[bytes, int], grams: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        spelled, often = list(words), list(words.values())
        for at in range(0, len(spelled), 100_000):
            some = spelled[at : at + 100_000]
            yield _cell_rows(bucket, pa.array(some, pa.binary()), pa.nulls(len(some), pa.int64()), often[at : at + 100_000])
        for at in range(0, len(grams[0]), 100_000):
            some = grams[0][at : at + 100_000]
            yield _cell_rows(bucket, pa.nulls(len(some), pa.binary()), pa.array(some), grams[1][at : at + 100_000])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for bucket, pack in ((b.as_py(), p.as_py()) for batch in batches for b, p in zip(*batch.columns)):
            if bucket != at:
                if at is not None:
                    yield from cells(at, held, _summed(parts))
                at, held, parts = bucket, {}, []
            docs, sides = _unpacked(pack), ([], [])
            for trains, text in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                words = _words(text)
                sides[trains].append(normalised(words))
                words.append(END)
                for word in words:
                    held[word] = held.get(word, 0) + trains
                if len(held) > HELD_WORDS:
                    yield from cells(at, held, _summed([]))
                    held = {}
            for trains, texts in enumerate(sides):
                for keys, _ in running_grams(texts, depth):
                    found, n = np.unique(keys, return_counts=True)
                    parts.append((found, n * trains))
                    if sum(len(k) for k, _ in parts) > HELD_GRAMS:
                        parts = [_summed(parts)]
                        if 3 * len(parts[0][0]) > 2 * HELD_GRAMS:
                            yield from cells(at, {}, parts[0])
                            parts = []
        if at is not None:
            yield from cells(at, held, _summed(parts))

    return count


def _cell_rows(bucket: int, word: pa.Array, key: pa.Array, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(word), bucket, np.int64)), word, key, pa.array(n, pa.int64())], ["bucket", "word", "key", "n"]
    )


def _reader(n: int, v: int, depth: int):
    """Scores of documents from rows (bucket, kind, key, lp, data) in order of bucket and kind.

    Kind 0 is a word (data) with its count (key), unless that is 1; kind 1 an n-gram with its log10 probability,
    kind 2 a pack of documents.
    """

    def scored(docs: pa.RecordBatch, count: dict[bytes, int], have: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        look = count.get
        tokens, seen, unigram, texts = [], [], [], []
        for text in docs.column(2).to_pylist():
            words = _words(text)
            texts.append(normalised(words))
            words.append(END)
            c = np.array([look(w, 1) for w in words], np.float64)
            tokens.append(len(words))
            seen.append(int(np.count_nonzero(c)))
            unigram.append(float(np.log10((c + 0.1) / (n + 0.1 * (v + 1))).sum()))
        total = np.zeros(len(texts))
        for found, owner in running_grams(texts, depth):
            grams, of = np.unique(found, return_inverse=True)
            lead = int(owner[0])
            part = np.bincount(owner - lead, value[np.searchsorted(have, grams)][of.ravel()])
            total[lead : lead + len(part)] += part
        return pa.RecordBatch.from_arrays(
            [
                docs.column(0),
                docs.column(1),
                pa.array(tokens, pa.int64()),
                pa.array(seen, pa.int64()),
                pa.array([n] * len(texts), pa.int64()),
                pa.array(unigram, pa.float64()),
                pa.array(total),
            ],
            ["doc_id", "trains", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            buckets, kinds = (np.array(batch.column(i)) for i in (0, 1))
            edges = np.flatnonzero((buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
                if first == end:
                    continue
                some = batch.slice(first, end - first)
                if buckets[first] != at:
                    at, count, keys, lps, have = buckets[first], {}, [], [], None
                if kinds[first] == 0:
                    count.update(zip(some.column(4).to_pylist(), some.column(2).to_pylist()))
                elif kinds[first] == 1:
                    # Copies, so that the batch's own memory is free again.
                    keys.append(np.array(some.column(2), np.int64, copy=True))
                    lps.append(np.array(some.column(3), np.float64, copy=True))
                else:
                    if have is None:
                        have, value = np.concatenate(keys), np.concatenate(lps)
                        keys, lps = [], []
                        order = np.argsort(have)
                        have, value = have[order], value[order]
                    for pack in some.column(4):
                        yield scored(_unpacked(pack.as_py()), count, have, value)

    return read


def score_running(docs: DataFrame, trains: str, depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of (doc_id, text, and a boolean column ``trains``) under models of the rows that train.

    Returns doc_id, ``trains``, n_tokens, n_known, train_tokens, base_score and score; other columns are left out.
    Tokens are words with A-Z as a-z and one end per text; base_score is the smoothed unigram log10 probability.
    score is that of the context tree: it predicts the bytes of the running text, its words each with one blank
    behind, then the end, from counts of all n-grams of ``depth`` bytes and one more in all training rows.

    NULL and empty texts are one end. A row whose ``trains`` is NULL does not train. Repeated rows are scored and
    counted each; a NULL doc_id is scored like any other. Without training rows every estimate is that of empty
    counts. An empty table gives no row. Buckets hold some ``bucket_bytes`` of consecutive texts; a longer text is
    a bucket of its own, read in portions.
    """
    dealt = docs.select(
        "doc_id", F.coalesce(trains, F.lit(False)).alias("trains"), F.col("text").cast("binary").alias("text")
    )
    packs = written(dealt.mapInArrow(_packs(bucket_bytes), "bucket long, pack binary"), "packs")
    parts = max(1, min(2 * packs.select("bucket").distinct().count(), MOST_PARTS))
    counted = packs.mapInArrow(_bucket_counts(depth), "bucket long, word binary, key long, n long")
    cells = written(counted, "cells", compression="zstd")
    words, ngrams = cells.where("word IS NOT NULL"), cells.where("key IS NOT NULL")
    lexicon = written(words.groupBy("word").agg(F.sum("n").alias("c")), "lexicon")
    total = lexicon.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    model = written(ngrams.groupBy("key").agg(F.sum("n").alias("n")), "ngrams")

    def rows(df: DataFrame, kind: int, key: str, lp: str, data: str) -> DataFrame:
        return df.selectExpr("bucket", f"{kind} AS kind", f"CAST({key} AS long) AS key", f"CAST({lp} AS double) AS lp", f"CAST({data} AS binary) AS data")

    # Most words come once in the corpus, so a word without a row has the count 1.
    often = words.select("bucket", "word").join(lexicon.where("c <> 1"), "word")
    known = ngrams.select("bucket", "key").join(_log_probabilities(model, depth), "key")
    together = (
        rows(often, 0, "c", "NULL", "word")
        .unionByName(rows(known, 1, "key", "lp", "NULL"))
        .unionByName(rows(packs, 2, "NULL", "NULL", "pack"))
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "kind")
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return together.mapInArrow(
        _reader(total["n"] or 0, total["v"], depth),
        f"doc_id {id_type}, trains boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    ).withColumnRenamed("trains", trains)
