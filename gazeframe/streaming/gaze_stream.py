"""Live gaze samples with Structured Streaming.

Tables are written by the executors; nothing passes through the driver. Stream
positions live in a checkpoint folder, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_samples(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Append-only stream of sample files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(aggregate: DataFrame, mode: str, checkpoint: str, **sink) -> list[dict]:
    """Process all files that are there now and return the progress of the batches, as far as Spark keeps it."""
    writer = aggregate.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if "save" in sink:
        writer = writer.foreachBatch(sink["save"])
    else:
        writer = writer.format("parquet").option("path", sink["table"])
    query = writer.start()
    query.awaitTermination()
    return [dict(p) for p in query.recentProgress]


def append_samples(stream: DataFrame, table: str, checkpoint: str) -> list[dict]:
    """Write all samples, or closed results, that are there now, each once."""
    return run_available(stream, "append", checkpoint, table=table)


def dropped_late(progress: Sequence[dict]) -> int:
    """Rows that stateful steps dropped because the watermark had passed them."""
    return sum(int(step["numRowsDroppedByWatermark"]) for batch in progress for step in batch["stateOperators"])


def state_rows(progress: Sequence[dict]) -> list[int]:
    """Rows in the state of all steps after each batch."""
    return [sum(int(step["numRowsTotal"]) for step in batch["stateOperators"]) for batch in progress]


def unique_samples(stream: DataFrame, time: str, late_by: str, ids: Sequence[str]) -> DataFrame:
    """Samples without repeats, and without those that come more than ``late_by`` after the latest one.

    Late samples are dropped one by one and counted here, before anything adds them up. Ids are kept no longer
    than the watermark needs.
    """
    return stream.withWatermark(time, late_by).dropDuplicatesWithinWatermark(list(ids))


def look_bins(
    stream: DataFrame,
    time: str,
    width: str,
    keys: Sequence[str],
    hits: Mapping[str, Column],
    late_by: str | None = None,
) -> DataFrame:
    """Counts of looks per tumbling bin and key.

    ``late_by`` sets the watermark: state of older bins is dropped and so are
    samples that come later than that.
    """
    source = stream if late_by is None else stream.withWatermark(time, late_by)
    sums = [F.sum(hit.cast("bigint")).alias(f"k_{name}") for name, hit in hits.items()]
    return source.groupBy(F.window(time, width).alias("bin"), *keys).agg(
        F.count(F.lit(1)).alias("n"), *sums
    )


def trial_windows(
    stream: DataFrame, time: str, gap: str, keys: Sequence[str], late_by: str | None = None
) -> DataFrame:
    """Samples per session of a key; the session column is grouped whole."""
    source = stream if late_by is None else stream.withWatermark(time, late_by)
    return source.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(
        F.count(F.lit(1)).alias("n_samples")
    )


def relative_samples(
    stream: DataFrame, time: str, gap: str, keys: Sequence[str], late_by: str, columns: Sequence[str] = ()
) -> DataFrame:
    """Samples with ``since_first_ms``, the milliseconds since the first sample of their trial.

    A trial is a session of a key: a pause of ``gap`` ends it. Its origin is final only when the watermark has
    passed that pause, as a sample may still come that is earlier than all so far. Until then the state holds
    the trial's samples, and nothing of it after that, so it is bounded by the trials that are open. A sample
    without time is in no trial.
    """
    micros = F.unix_micros(F.col(time))
    row = F.struct(micros.alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    trials = (
        stream.withWatermark(time, late_by)
        .groupBy(*keys, F.session_window(time, gap).alias("trial"))
        .agg(F.collect_list(row).alias("samples"), F.min(micros).alias("first"))
    )
    each = trials.select(*keys, "trial", "first", F.explode("samples").alias("s"))
    since = F.floor((F.col("s.t") - F.col("first")) / 1000).alias("since_first_ms")
    return each.select(*keys, "trial", since, *[F.col(f"s.c{i}").alias(c) for i, c in enumerate(columns)])


def append_results(aggregate: DataFrame, table: str, checkpoint: str) -> list[dict]:
    """Write each closed bin once; bins still open at the end stay in the state."""
    return append_samples(aggregate, table, checkpoint)


def _log_batches(aggregate: DataFrame, table: str, checkpoint: str, mode: str) -> list[dict]:
    def save(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return run_available(aggregate, mode, checkpoint, save=save)


def upsert(aggregate: DataFrame, table: str, checkpoint: str) -> list[dict]:
    """Add the rows that each batch changed to the log of a keyed table."""
    return _log_batches(aggregate, f"{table}/log", checkpoint, "update")


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [name for name in rows.columns if name not in (*keys, "batch")]
    latest = F.max_by(F.struct("batch", *values), F.col("batch")).alias("_v")
    return rows.groupBy(*keys).agg(latest).select(*keys, "_v.*")


def keyed_rows(spark: SparkSession, table: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key: of the last compacted snapshot and the batches after it, with ``batch``."""
    logged = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    log = spark.read.schema(logged).parquet(f"{table}/log")
    upto = _compacted(spark, table)
    if upto is None:
        return _newest(log, keys)
    base = spark.read.schema(logged).parquet(f"{table}/compacted-{upto}")
    return _newest(base.unionByName(log.where(F.col("batch") > upto)), keys)


def _compacted(spark: SparkSession, table: str) -> int | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath().getName()) for s in files.listStatus(path)] if files.exists(path) else []
    done = [
        int(name.removeprefix("compacted-"))
        for name in found
        if name.startswith("compacted-") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{name}/_SUCCESS"))
    ]
    return max(done, default=None)


def compact(spark: SparkSession, table: str, schema: T.StructType, keys: Sequence[str]) -> None:
    """Write one row per key for all batches so far; readers then skip the log up to there.

    A snapshot counts once it is whole, and writing it again gives the same rows.
    """
    rows = keyed_rows(spark, table, schema, keys)
    last = spark.read.parquet(f"{table}/log").agg(F.max("batch")).first()[0]
    if last is not None and last != _compacted(spark, table):
        rows.write.mode("overwrite").parquet(f"{table}/compacted-{last}")


def upsert_results(
    aggregate: DataFrame, table: str, checkpoint: str, keys: Sequence[str]
) -> DataFrame:
    """Run the stream and return the last state of every key.

    Each batch writes only the rows it changed; the newest batch of a key wins.
    """
    upsert(aggregate, table, checkpoint)
    return keyed_rows(aggregate.sparkSession, table, aggregate.schema, keys).drop("batch")


def complete_results(aggregate: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Run the stream in complete mode and return the table of its last batch."""
    spark = aggregate.sparkSession
    schema = aggregate.schema
    _log_batches(aggregate, table, checkpoint, "complete")
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    rows = log.parquet(table)
    last = rows.agg(F.max("batch").alias("b"))
    return rows.where(F.col("batch") == last.scalar()).drop("batch")
