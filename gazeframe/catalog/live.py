"""Queries of streams and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeframe.catalog import standins as S
from gazeframe.catalog.common import r, rounded
from gazeframe.catalog.registry import query
from gazeframe.operators.sessions import trial_sessions
from gazeframe.session import work_dir
from gazeframe.streaming import gaze_stream as G


def _stream(spark, sf, batches: int = 4):
    """The whole event table as a stream of files, with UTC timestamps.

    There are as many files as the table has read tasks, and at least one per batch.
    """
    events = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    files = max(batches, events.rdd.getNumPartitions())
    folder = work_dir(spark, "sample-files")
    events.repartitionByRange(files, "event_id").write.parquet(folder)
    return G.read_samples(spark, folder, events.schema, files // batches)


def _slices(spark, sf, number: int = 4):
    """The whole event table in ``number`` stretches of time, to arrive one after the other."""
    events = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    shares = [i / number for i in range(1, number)]
    cuts = events.agg(F.percentile_approx(micros, shares, 10_000)).first()[0] or []
    place = sum((F.coalesce(micros >= cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    placed = events.withColumn("_slice", place)
    return [placed.where(F.col("_slice") == i).drop("_slice") for i in range(number)]


def _end_of_recording(slices):
    """A single row ten days after the last sample: it closes all trials and bins but its own."""
    latest = slices[-1].agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).where("ts IS NOT NULL")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in slices[-1].schema if f.name != "ts"]
    return latest.select(*rest, "ts").select(*slices[-1].columns)


def _arrive(spark, slices, run):
    """Append the slices to a folder one by one; ``run`` continues the same query after each. All its progress."""
    folder, progress = work_dir(spark, "arrivals"), []
    for rows in slices:
        rows.write.mode("append").parquet(folder)
        progress += run(G.read_samples(spark, folder, rows.schema))
    return progress


_EPOCH_MS = "epoch_us(ts) // 1000"


@query("J1 B14", f"SELECT event_id, user_id, {_EPOCH_MS} AS unix, value FROM events")
def streamed_samples(spark, sf):
    """Samples appended batch by batch, each once."""
    table, checkpoint = work_dir(spark, "samples"), work_dir(spark, "samples-checkpoint")
    stream = _stream(spark, sf).where(F.col("value").isNotNull())
    G.append_samples(stream, table, checkpoint)
    unix = F.expr("unix_micros(ts) div 1000").alias("unix")
    return spark.read.parquet(table).select("event_id", "user_id", unix, "value")


_HITS = {"click": "click", "view": "view"}


def _hits():
    return {name: F.col("event_type") == kind for name, kind in _HITS.items()}


_BIN_SQL = f"""SELECT CAST(bin AS BIGINT) AS bin_ms, count(*) AS n, {r("avg(CAST(event_type = 'click' AS INT))")} AS click_prop,
        {r("avg(CAST(event_type = 'view' AS INT))")} AS view_prop
    FROM (SELECT *, {_EPOCH_MS} // 3600000 * 3600000 AS bin FROM events) GROUP BY bin"""


def _bin_table(found):
    start = F.expr("unix_micros(bin.start) div 1000").alias("bin_ms")
    shares = [(F.col(f"k_{name}") / F.col("n")).alias(f"{name}_prop") for name in _HITS]
    return rounded(found.select(start, "n", *shares))


@query("J2", _BIN_SQL)
def streamed_look_bins(spark, sf):
    """Hourly look shares of the stream; each batch writes only the bins it changed, closed ones leave the state."""
    table, checkpoint, schema = work_dir(spark, "bins"), work_dir(spark, "bins-checkpoint"), None

    def run(stream):
        nonlocal schema
        bins = G.look_bins(stream, "ts", "1 hour", [], _hits(), late_by="10 minutes")
        schema = bins.schema
        progress = G.upsert(bins, table, checkpoint)
        G.compact(spark, table, schema, ["bin"])
        return progress

    _arrive(spark, _slices(spark, sf), run)
    return _bin_table(G.keyed_rows(spark, table, schema, ["bin"]))


@query("J2", _BIN_SQL)
def streamed_look_bins_complete(spark, sf):
    """The same in complete mode."""
    table, checkpoint = work_dir(spark, "bins"), work_dir(spark, "bins-checkpoint")
    bins = G.look_bins(_stream(spark, sf), "ts", "1 hour", [], _hits())
    return _bin_table(G.complete_results(bins, table, checkpoint))


_GAP_MS = 2 * 60 * 60 * 1000
_SESSION_SQL = f"""SELECT user_id, CAST(sum(new) OVER w AS BIGINT) AS session_no, t FROM (
        SELECT user_id, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < {_GAP_MS} THEN 0 ELSE 1 END AS new
        FROM (SELECT user_id, event_id, {_EPOCH_MS} AS t FROM events))
    WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"""


@query(
    "J3",
    f"SELECT user_id, session_no, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n_samples FROM ({_SESSION_SQL}) GROUP BY user_id, session_no",
)
def trial_sessions_batch(spark, sf):
    """Trials as sessions of a worker's samples, two hours apart."""
    day = F.unix_date(F.to_date("ts")).cast("bigint") * 86400000
    clock = (F.hour("ts") * 3600 + F.minute("ts") * 60) * 1000
    second = F.floor(F.extract(F.lit("SECOND"), "ts") * 1000)
    events = S.table(spark, sf, "events")
    return trial_sessions(events, ["user_id"], (day + clock + second).cast("bigint"), _GAP_MS)


@query(
    "J3",
    f"SELECT user_id, min(t) AS start_ms, count(*) AS n_samples FROM ({_SESSION_SQL}) GROUP BY user_id, session_no",
)
def streamed_trial_sessions(spark, sf):
    """The same sessions from the stream, each written once when the watermark has passed it."""
    table, checkpoint = work_dir(spark, "sessions"), work_dir(spark, "sessions-checkpoint")
    slices = _slices(spark, sf)

    def run(stream):
        sessions = G.trial_windows(stream, "ts", "2 hours", ["user_id"], late_by="10 minutes")
        return G.append_results(sessions, table, checkpoint)

    _arrive(spark, [*slices, _end_of_recording(slices)], run)
    found = spark.read.parquet(table)
    return found.select("user_id", F.expr("unix_micros(session.start) div 1000").alias("start_ms"), "n_samples")


@query(
    "J4 J2",
    f"""SELECT bin_ms, event_type, count(*) AS n
    FROM (SELECT event_type, {_EPOCH_MS} // 3600000 * 3600000 AS bin_ms, max({_EPOCH_MS}) OVER () AS latest FROM events)
    WHERE bin_ms + 3600000 <= latest - 600000 GROUP BY bin_ms, event_type""",
)
def closed_stream_bins(spark, sf):
    """Bins the watermark has passed, each written once; open ones stay in the state.

    All files are read in one batch, so the result does not hang on their order.
    """
    table, checkpoint = work_dir(spark, "closed"), work_dir(spark, "closed-checkpoint")
    stream = _stream(spark, sf, batches=1)
    bins = G.look_bins(stream, "ts", "1 hour", ["event_type"], _hits(), late_by="10 minutes")
    G.append_results(bins, table, checkpoint)
    return spark.read.parquet(table).select(
        F.expr("unix_micros(bin.start) div 1000").alias("bin_ms"), "event_type", "n"
    )


_RELATIVE_SQL = f"""SELECT user_id, event_id, event_type, CAST(floor((us - min(us) OVER (PARTITION BY user_id, session_no)) / 1000) AS BIGINT) AS since_first_ms
    FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session_no FROM (
        SELECT user_id, event_id, event_type, us,
            CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < {_GAP_MS * 1000} THEN 0 ELSE 1 END AS new
        FROM (SELECT *, epoch_us(ts) AS us FROM events)))"""


def _relative(spark, sf):
    table, checkpoint = work_dir(spark, "relative"), work_dir(spark, "relative-checkpoint")
    slices = _slices(spark, sf)

    def run(stream):
        samples = G.relative_samples(stream, "ts", "2 hours", ["user_id"], "10 minutes", ["event_id", "event_type"])
        return G.append_results(samples, table, checkpoint)

    _arrive(spark, [*slices, _end_of_recording(slices)], run)
    return spark.read.parquet(table)


@query("J2 J3 F14 D9", _RELATIVE_SQL)
def streamed_relative_samples(spark, sf):
    """Samples of the stream timed from the first sample of their trial."""
    return _relative(spark, sf).select("user_id", "event_id", "event_type", "since_first_ms")


@query(
    "J2 D10",
    f"""SELECT CAST(floor(since_first_ms / 600000) * 600000 AS BIGINT) AS bin_ms, count(*) AS n, {r("avg(CAST(event_type = 'click' AS INT))")} AS click_prop,
        {r("avg(CAST(event_type = 'view' AS INT))")} AS view_prop FROM ({_RELATIVE_SQL}) GROUP BY 1""",
)
def streamed_relative_bins(spark, sf):
    """Look shares in ten-minute bins since the first sample of the trial."""
    found = _relative(spark, sf).withColumn("bin_ms", (F.floor(F.col("since_first_ms") / 600000) * 600000).cast("bigint"))
    shares = [F.avg(hit.cast("int")).alias(f"{name}_prop") for name, hit in _hits().items()]
    return rounded(found.groupBy("bin_ms").agg(F.count(F.lit(1)).alias("n"), *shares))


@query(
    "J4",
    f"""SELECT bin_ms, event_type, count(*) FILTER (NOT held) AS n, CAST(any_value(dropped) AS BIGINT) AS dropped FROM (
        SELECT *, sum(CAST(held AS INT)) OVER () AS dropped FROM (
            SELECT event_type, {_EPOCH_MS} // 3600000 * 3600000 AS bin_ms,
                ts < (SELECT quantile_disc(ts, 0.125) FROM events) AND event_id % 10 = 3 AS held FROM events))
    GROUP BY bin_ms, event_type HAVING count(*) FILTER (NOT held) > 0""",
)
def late_samples(spark, sf):
    """Samples that arrive long after their time are in no bin, and the stream's progress counts them.

    A tenth of the first eighth of the samples is held back and arrives with the last slice.
    """
    slices = _slices(spark, sf)
    table, checkpoint = work_dir(spark, "late"), work_dir(spark, "late-checkpoint")
    early = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    until = early.agg(F.expr("percentile_disc(0.125) WITHIN GROUP (ORDER BY unix_micros(ts))")).scalar()
    held = F.coalesce((F.unix_micros("ts") < until) & (F.col("event_id") % 10 == 3), F.lit(False))
    late = slices[0].where(held)
    arriving = [slices[0].where(~held), *slices[1:-1], slices[-1].unionByName(late), _end_of_recording(slices)]

    def run(stream):
        once = G.unique_samples(stream, "ts", "10 minutes", ["event_id"])
        return G.append_results(G.look_bins(once, "ts", "1 hour", ["event_type"], _hits()), table, checkpoint)

    dropped = G.dropped_late(_arrive(spark, arriving, run))
    return spark.read.parquet(table).select(
        F.expr("unix_micros(bin.start) div 1000").alias("bin_ms"), "event_type", "n", F.lit(dropped).cast("bigint").alias("dropped")
    )
