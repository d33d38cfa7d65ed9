"""Figures taken while rows are written, and milestones."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.shared import children
from ledgerloom.streaming import metrics, windows

EVENTS = "/root/testdata/sf0.001"


def test_observed_without_a_pass_of_its_own(spark, tmp_path):
    df = spark.range(0, 5000, 1, 6).withColumn("odd", F.when(F.col("id") % 2 == 1, F.col("id")))
    watched, seen = metrics.observed(df, rows=F.count("*"), odd=F.count("odd"))
    watched.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"rows": 5000, "odd": 2500}
    empty, seen = metrics.observed(df.where("false"), rows=F.count("*"), top=F.max("id"))
    empty.write.parquet(str(tmp_path / "e"))
    assert seen.get == {"rows": 0, "top": None}


def test_milestones_fire_once_over_restarts(spark, tmp_path):
    told = []
    marks = lambda: metrics.Milestones(spark, str(tmp_path / "m"), lambda step, f: told.append((step, f)), (10, 50, 100))
    assert marks().at(9) == [] and marks().at(60, {"n": 60}) == [10, 50]
    assert marks().at(99) == [] and marks().at(100) == [100] and marks().at(5) == []
    assert told == [(10, {"n": 60}), (50, {"n": 60}), (100, {})]


def test_progress_counts_each_batch_once(spark, tmp_path):
    path = str(tmp_path / "p")
    told = []
    marks = metrics.Milestones(spark, str(tmp_path / "m"), lambda step, f: told.append((step, f["rows"])), (5, 20))
    first = metrics.Progress(spark, path, "run", "rows", 40, marks)
    assert first.figures()["minutes_left"] is None
    first.add(0, {"rows": 4, "bad": None})
    first.add(1, {"rows": 6, "bad": 1})
    first.add(1, {"rows": 6, "bad": 1})
    assert first.totals == {"rows": 10, "bad": 1} and first.figures()["rate"] > 0 and first.figures()["minutes_left"] > 0
    again = metrics.Progress(spark, path, "run", "rows", 10, marks)
    again.add(1, {"rows": 6, "bad": 1})
    assert again.totals == {"rows": 10, "bad": 1} and again.figures()["rate"] == 0
    again.add(2, {"rows": 15, "bad": 0})
    assert again.totals == {"rows": 25, "bad": 1} and again.figures()["minutes_left"] == 0
    assert told == [(5, 10), (20, 25)] and children(spark, path) == ["2"]


@pytest.mark.parametrize("batches", [True, False])
def test_listener_sees_what_the_table_holds(spark, tmp_path, batches):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{EVENTS}/events.parquet")
    events.repartition(4).write.parquet(source)
    told = []
    marks = metrics.Milestones(spark, str(tmp_path / "m"), lambda step, f: told.append(step), (10, 100, 10**9))
    progress = metrics.Progress(spark, str(tmp_path / "p"), "events", "rows", events.count(), marks)
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source).observe("events", F.count("*").alias("rows"))
        if batches:
            query = windows.write_batches(stream, out, str(tmp_path / "c"))
        else:
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.monotonic() + 20
        while progress.totals.get("rows", 0) < events.count() and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    assert progress.totals["rows"] == events.count() == spark.read.parquet(out).count() and progress.batch == 3
    assert told == [10, 100] and progress.figures()["minutes_left"] == 0
