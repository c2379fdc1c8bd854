"""The streams' input is written and read by many tasks, and the micro-batches stay what they are."""

import pytest
from pyspark.sql import functions as F

from jobvigil.plans import queries
from jobvigil.plans.flow import Tables
from jobvigil.sources.tables import read_table
from jobvigil.schema import EVENTS


class Stop(Exception):
    pass


def write_events(spark, folder, ids):
    rows = ids.select(
        "event_id", F.timestamp_micros(1704067200000000 + F.col("event_id") * 4_000_000_000).cast("timestamp_ntz").alias("ts"),
        (F.col("event_id") % 7).alias("user_id"), F.element_at(F.array(*map(F.lit, ("click", "view", "error", "signup", "purchase"))), (F.col("event_id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("event_id") % 11).cast("double").alias("value"), F.lit('{"k": 5}').alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")


def files_of(spark, path):
    return len(spark.read.parquet(path).inputFiles())


def test_a_part_of_many_files_is_one_micro_batch(spark, tmp_path, monkeypatch):
    """Part 0 has most rows, part 1 fewer rows than files, part 2 none."""
    few = spark.createDataFrame([(1,), (7,), (3,), (9,), (15,), (4,), (5,)], "event_id long")
    write_events(spark, tmp_path, spark.range(100).select((F.col("id") * 6).alias("event_id")).unionByName(few))
    monkeypatch.setattr(queries, "FILE_ROWS", 20)
    batches = {}
    monkeypatch.setattr(queries.stream, "process_batch", lambda batch, batch_id, *more: batches.update({batch_id: sorted(int(r.event_id) for r in batch.select("event_id").collect())}))
    tables = Tables(str(tmp_path / "out"))
    queries._run_in_batches(spark, str(tmp_path), tables, queries.SENSITIVE)
    parts = [files_of(spark, f"{tables.path('sent')}/part{i}") for i in range(6)]
    assert parts == [5] * 6
    assert batches[0] == list(range(0, 600, 6)) and [batches[i] for i in range(1, 6)] == [[1, 7], [], [3, 9, 15], [4], [5]]


def test_a_fitted_streams_parts_have_many_files(spark, tmp_path, monkeypatch):
    write_events(spark, tmp_path, spark.range(300).withColumnRenamed("id", "event_id"))
    monkeypatch.setattr(queries, "FILE_ROWS", 25)
    found = []

    def stop(records, tables, *more, **options):
        found.append(files_of(spark, f"{tables.path('sent')}/part0"))
        raise Stop

    monkeypatch.setattr(queries.stream, "run_stream", stop)
    with pytest.raises(Stop):
        queries.refitted_stream(spark, str(tmp_path))
    assert found == [4]


def test_a_resumed_streams_input_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    write_events(spark, tmp_path, spark.range(600).withColumnRenamed("id", "event_id"))
    monkeypatch.setattr(queries, "replay", lambda *more: None)
    found = []

    def stop(records, tables, *more, **options):
        found.append(files_of(spark, tables.path("sent")))
        raise Stop

    monkeypatch.setattr(queries.stream, "run_stream", stop)
    with pytest.raises(Stop):
        queries.resumed_incidents(spark, str(tmp_path))
    assert found[0] > 1


def test_late_events_in_many_files_are_four_micro_batches(spark, tmp_path, monkeypatch):
    write_events(spark, tmp_path, spark.range(400).withColumnRenamed("id", "event_id"))
    monkeypatch.setattr(queries, "FILE_ROWS", 25)
    seen, run_stream = [], queries.stream.run_stream

    def spy(records, tables, *more, **options):
        seen.append(tables)
        return run_stream(records, tables, *more, **options)

    monkeypatch.setattr(queries.stream, "run_stream", spy)
    found = queries.streamed_late_events(spark, str(tmp_path))
    assert found.count() == found.select("event_id").distinct().count() == 400
    assert files_of(spark, seen[0].path("sent")) == 16
    stored = read_table(spark, seen[0].path("events"), EVENTS).select("batch_id").distinct().count()
    assert stored == 4
