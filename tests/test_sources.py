"""Files, submissions, merging and streams."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gazeframe.session import work_dir
from gazeframe.sources import files, merge, schemas, stimuli, submissions
from gazeframe.streaming import gaze_stream


def test_quoted_csv(spark):
    folder = work_dir(spark, "csv")
    df = spark.createDataFrame([("1.70", 'a ""few"", words', 3), ("Yes", "", None)], "fairprice string, comments string, age int")
    files.write_csv(df, folder)
    back = files.read_csv(spark, folder, df.schema)
    assert sorted((r.fairprice, r.comments, r.age) for r in back.collect())[0] == ("1.70", 'a ""few"", words', 3)
    lines = [r.line for r in files.csv_lines(df.select("fairprice", "age")).collect()]
    assert sorted(lines) == ["1.70,3", "Yes,NA"]


def test_declared_schemas_have_unique_names():
    for schema in (schemas.GAZE_TRIAL, schemas.CHOICE_TRIAL, schemas.ONSETS, schemas.TRACKER, schemas.SUBJECT):
        assert len(set(schema.names)) == len(schema.names)
    assert len(schemas.STIMULUS_COLUMNS) == 30 and len(schemas.PRACTICE_COLUMNS) == 33
    assert len(set(schemas.PRACTICE_COLUMNS)) == 33


def test_ids_of_merged_sources(spark):
    frames = [spark.createDataFrame([(i,) for i in ids], "workerid bigint") for ids in ([0, 1, 2], [0, 1], [], [4])]
    merged = merge.merge_sources(list(zip(frames, "xyzx")))
    assert sorted(map(tuple, merged.collect())) == [(0, "x"), (1, "x"), (2, "x"), (3, "y"), (4, "y"), (9, "x")]
    with pytest.raises(ValueError):
        merge.merge_sources([])


def test_submissions_without_trials_keep_a_row(spark):
    schema = "trials array<struct<slide_number: bigint>>, system struct<OS: string>, condition string"
    df = spark.createDataFrame(
        [(1, '{"trials": [{"slide_number": 5}, {"slide_number": 6}], "system": {"OS": "x"}, "condition": "c"}'), (2, '{"trials": [], "condition": "d"}')],
        "workerid int, json string",
    )
    flat = submissions.flatten_submissions(submissions.parse_submissions(df, "json", schema))
    assert flat.columns == ["workerid", "system_OS", "condition", "slide_number"]
    assert sorted(map(tuple, flat.collect()), key=str) == [(1, "x", "c", 5), (1, "x", "c", 6), (2, None, "d", None)]


def test_stimuli_with_foreign_headers_and_line_ends(spark):
    folder = work_dir(spark, "stimuli")
    os.makedirs(folder)
    cells = [f"v {i}" for i in range(30)]
    with open(f"{folder}/data.csv", "w", newline="") as out:
        out.write(",".join(["displayID", "lcoation5"] + ["h"] * 28) + "\r\n" + ",".join(cells) + "  \r\n")
    row = stimuli.tidy_stimuli(stimuli.read_stimuli(spark, folder)).first()
    assert row.location5 == "v_8" and row.location7 == "v 10" and row.instruction3 == "v 29"


def test_practice_table_with_carriage_returns(spark):
    folder = work_dir(spark, "practice")
    os.makedirs(folder)
    with open(f"{folder}/data.csv", "w", newline="") as out:
        out.write(",".join(["h"] * 33) + "\r" + "\r".join(",".join(f"{r} {i}" for i in range(33)) for r in "ab"))
    found = stimuli.tidy_practice(stimuli.read_practice(spark, folder)).orderBy("displayID").collect()
    assert [r.displayID for r in found] == ["a 0", "b 0"] and found[0].Res_object == "a_5"


def sample_files(spark, batches):
    folder = work_dir(spark, "samples")
    schema = "worker int, ts timestamp, hit boolean"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder).schema, folder


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


BATCHES = [[(1, at(0), True), (1, at(61), False)], [(1, at(300), True)], [(1, at(5), True), (2, at(301), True)]]


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_stream_equals_batch(spark, mode):
    schema, folder = sample_files(spark, BATCHES)
    stream = gaze_stream.read_samples(spark, folder, schema, 1)
    bins = gaze_stream.look_bins(stream, "ts", "1 hour", [], {"hit": F.col("hit")})
    table, checkpoint = work_dir(spark, "t"), work_dir(spark, "c")
    if mode == "update":
        found = gaze_stream.upsert_results(bins, table, checkpoint, ["bin"])
    else:
        found = gaze_stream.complete_results(bins, table, checkpoint)
    batch = gaze_stream.look_bins(spark.read.parquet(folder), "ts", "1 hour", [], {"hit": F.col("hit")})
    key = lambda df: sorted((r.bin.start, r.n, r.k_hit) for r in df.collect())
    assert key(found) == key(batch)


def test_late_samples_are_dropped(spark):
    # Lateness is judged by the watermark of the batch before, so one more batch lies between.
    batches = [*BATCHES[:2], [(1, at(300), True)], BATCHES[2]]
    schema, folder = sample_files(spark, batches)
    stream = gaze_stream.read_samples(spark, folder, schema, 1)
    bins = gaze_stream.look_bins(stream, "ts", "1 hour", [], {"hit": F.col("hit")}, late_by="10 minutes")
    table = work_dir(spark, "t")
    gaze_stream.append_results(bins, table, work_dir(spark, "c"))
    # The sample at minute 5 comes after the watermark has passed its bin.
    got = sorted((r.bin.start, r.n) for r in spark.read.parquet(table).collect())
    assert got == [(at(0), 1), (at(60), 1)]


def test_a_restarted_stream_adds_only_new_files(spark):
    schema, folder = sample_files(spark, BATCHES[:1])
    table, checkpoint = work_dir(spark, "t"), work_dir(spark, "c")
    gaze_stream.append_samples(gaze_stream.read_samples(spark, folder, schema), table, checkpoint)
    spark.createDataFrame(BATCHES[1], schema).write.mode("append").parquet(folder)
    gaze_stream.append_samples(gaze_stream.read_samples(spark, folder, schema), table, checkpoint)
    assert spark.read.parquet(table).count() == 3


def test_gaze_study_from_a_csv_file(spark):
    """Dotted headers in any order, NA, brackets: through to binned looks."""
    from gazeframe.plans import gaze

    folder = work_dir(spark, "trials")
    os.makedirs(folder)
    header = (
        "slide_number,workerid,extra,trial_type,condition,size,audio,target1,target2,competitor1,competitor2,response,"
        "webgazer_time,unixtlist,x,y,system.windowW,system.windowH,subject_information.camblock,"
        "subject_information.language,subject_information.age"
    )
    lists = '"[0, 500, 2000]","[10, 510, 2010]","[640.5, 10, 10]","[375, 10, 740]"'
    tail = "1280,750,No, ENGLISH,NA"
    rows = [
        f"1,7,z,Exp,all,big,A,1,7,2,8,1,{lists},{tail}",
        f"2,7,z,Exp,all,big,A,1,7,2,8,2,{lists},{tail}",
        f"3,7,z,Prac,,,A,1,NA,2,NA,5,{lists},{tail}",
        f"4,8,z,Exp,all,big,A,1,7,2,8,4,{lists},{tail}",
    ]
    with open(f"{folder}/trials.csv", "w") as out:
        out.write("\n".join([header, *rows]) + "\n")
    trials = files.read_named_csv(spark, folder, schemas.GAZE_TRIAL)
    assert trials.columns == schemas.GAZE_TRIAL.names
    assert {r.subject_information_age for r in trials.collect()} == {None}
    onset_row = {name: 100.0 for name in schemas.ONSETS.names} | {"Prime": "A", "Name": "n", "Noun": "m"}
    onsets = spark.createDataFrame([tuple(onset_row[n] for n in schemas.ONSETS.names)], schemas.ONSETS)
    prepared = gaze.prepare_trials(trials, onsets)
    scored = {r.slide_number: r.selection_correct for r in prepared.collect()}
    assert scored == {1: 1, 2: 0, 3: None, 4: 0}
    # Worker 7 has one of two right, worker 8 none of one.
    kept = gaze.analysed_trials(prepared, least=0.5, divisor=2)
    assert [(r.workerid, r.slide_number) for r in kept.collect()] == [(7, 1)]
    found = gaze.binned_looks(gaze.looks_from_lists(kept)).collect()
    assert [(r.look, r.ROI, r.binned_time_relative) for r in found] == [("bottomleft", "competitor", 900)]
