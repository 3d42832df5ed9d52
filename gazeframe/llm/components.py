"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.session import work_dir

#: So many links at most are brought together in one task.
CHUNK = 1 << 18


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: what is built on it can be made again from there."""
    at = work_dir(df.sparkSession, purpose)
    df.write.parquet(at, **options)
    return df.sparkSession.read.parquet(at)


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links (u, v), in order, and the smallest node that each hangs together with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends.ravel(), 2)
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _merged(links: DataFrame, roots: bool = False) -> DataFrame:
    """The links (u, v) of each task, ``CHUNK`` at a time, as links of each node with the smallest it is tied to there.

    What hangs together stays so, with at most one link per node and chunk. ``roots`` adds a row of each smallest
    node with itself.
    """
    most = CHUNK

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            nodes, least = smallest(*(c.to_numpy() for c in table.columns))
            out = slice(None) if roots else nodes != least
            found = [pa.array(c[out], table.schema.types[0]) for c in (nodes, least)]
            return pa.RecordBatch.from_arrays(found, ["u", "v"])

        for batch in batches:
            if held and rows + batch.num_rows > most:
                yield done()
                held, rows = [], 0
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield done()

    return links.select("u", "v").mapInArrow(merge, links.select("u", "v").schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each task first merges its own links. Links that are left, if no more than ``CHUNK``, are merged once more in
    one task of that bounded size. More of them go through rounds of large and small stars: every node hands its
    larger neighbours, then its smaller ones, to the smallest node it knows, until every node hangs on its
    component's smallest or few enough links are left. Neighbours are never gathered: a round takes the minimum per
    node and joins it back, so a node with very many links is only a skewed join, which Spark splits. Each round is
    written to the shared folder.
    """
    edges = written(
        _merged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")), "links"
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= CHUNK:
            return written(_merged(edges.coalesce(1), roots=True).toDF("node", "component"), "components")
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # Each node has a row with its smallest neighbour, so one row out for each row in is enough.
        end = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        small = large.join(lowest, "u").select(end.alias("u"), F.col("m").alias("v"))
        edges = written(small.distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select("v", "v").toDF("node", "component").distinct()
    )
