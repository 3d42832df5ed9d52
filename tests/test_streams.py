"""Streams with watermarks: state that is evicted, late samples, origins, and the compacted table."""

import pytest
from pyspark.sql import functions as F

from gazeframe.catalog import live
from gazeframe.session import work_dir
from gazeframe.streaming import gaze_stream as G

SCHEMA = "id long, w string, minute double"


def samples(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    at = F.timestamp_seconds(F.lit(1_600_000_000 - 1_600_000_000 % 3600) + F.col("minute") * 60)
    return frame.withColumn("ts", at).drop("minute")


def arrive(spark, parts, run):
    return live._arrive(spark, [samples(spark, p) for p in parts], run)


def test_closed_bins_leave_the_state(spark):
    """State rows grow while bins are open and fall when the watermark passes them; the table equals the batch one."""
    # Half-hourly bins of many workers, then one worker a day later.
    first = [(i, f"w{i % 50}", float(i % 60)) for i in range(200)]
    second = [(1000, "w0", 60.0 * 24)]
    third = [(1001, "w0", 60.0 * 24 + 1)]
    table, checkpoint = work_dir(spark, "t"), work_dir(spark, "c")

    def run(stream):
        bins = G.look_bins(stream, "ts", "30 minutes", ["w"], {"odd": F.col("id") % 2 == 1}, late_by="5 minutes")
        run.schema = bins.schema
        progress = G.upsert(bins, table, checkpoint)
        G.compact(spark, table, bins.schema, ["bin", "w"])
        return progress

    progress = arrive(spark, [first, second, third], run)
    held = G.state_rows(progress)
    assert max(held) >= 50 and held[-1] == 1
    assert G.dropped_late(progress) == 0
    found = G.keyed_rows(spark, table, run.schema, ["bin", "w"])
    want = samples(spark, first + second + third).groupBy(F.window("ts", "30 minutes").alias("bin"), "w")
    want = want.agg(F.count("*").alias("n"), F.sum((F.col("id") % 2 == 1).cast("bigint")).alias("k_odd"))
    columns = [F.col("bin.start").cast("long"), "w", "n", "k_odd"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_compacted_table_takes_the_newest_row_and_may_be_written_again(spark):
    table, checkpoint = work_dir(spark, "t"), work_dir(spark, "c")

    def run(stream):
        bins = G.look_bins(stream, "ts", "1 hour", [], {}, late_by="1 hour")
        run.schema = bins.schema
        return G.upsert(bins, table, checkpoint)

    arrive(spark, [[(1, "a", 1.0)], [(2, "a", 2.0)]], run)
    plain = G.keyed_rows(spark, table, run.schema, ["bin"]).collect()
    G.compact(spark, table, run.schema, ["bin"])
    G.compact(spark, table, run.schema, ["bin"])
    assert G.keyed_rows(spark, table, run.schema, ["bin"]).collect() == plain
    assert [r.n for r in plain] == [2]


@pytest.mark.parametrize("late", [0, 7])
def test_exactly_the_late_samples_are_dropped(spark, late):
    on_time = [(i, f"w{i % 3}", float(i)) for i in range(100)]
    next_hours = [(i, "w0", float(i)) for i in range(200, 300)]
    planted = [(900 + i, "w1", float(i)) for i in range(late)]
    table, checkpoint = work_dir(spark, "t"), work_dir(spark, "c")

    def run(stream):
        once = G.unique_samples(stream, "ts", "10 minutes", ["id"])
        return G.append_results(G.look_bins(once, "ts", "1 hour", ["w"], {}), table, checkpoint)

    # A repeated sample counts once, and is not a late one.
    parts = [on_time + on_time[-1:], next_hours, planted + [(301, "w0", 299.5)], [(9999, "end", 10_000.0)]]
    progress = arrive(spark, parts, run)
    assert G.dropped_late(progress) == late
    assert spark.read.parquet(table).agg(F.sum("n")).first()[0] == 201


def test_relative_samples_wait_for_an_earlier_first_sample(spark):
    """The first sample of a trial arrives after others; the trial is written once, from its true origin."""
    table, checkpoint = work_dir(spark, "t"), work_dir(spark, "c")

    def run(stream):
        made = G.relative_samples(stream, "ts", "5 minutes", ["w"], "10 minutes", ["id"])
        return G.append_results(made, table, checkpoint)

    parts = [[(1, "a", 2.0), (2, "a", 3.0)], [(3, "a", 1.0), (4, "b", 6.0)], [(5, "a", 20.0), (6, None, 20.0)], [(7, "end", 100.0)]]
    progress = arrive(spark, parts, run)
    found = {(r.id, r.w, r.since_first_ms) for r in spark.read.parquet(table).collect()}
    assert found == {(3, "a", 0), (1, "a", 60_000), (2, "a", 120_000), (4, "b", 0), (5, "a", 0), (6, None, 0)}
    assert G.state_rows(progress)[-1] == 1
