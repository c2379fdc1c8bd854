"""Streams equal batch runs, retried batches and replays leave the same tables."""

import pytest
from pyspark.sql import functions as F

from jobvigil.config import Settings
from jobvigil.operators.dedupe import dedupe_stream
from jobvigil.operators.decode import usable_runs
from jobvigil.operators.monitor import (
    dead_letter_rate, dead_letter_rate_of_panes, duration_p95, duration_p95_of_panes, event_panes, throughput, throughput_of_panes,
)
from jobvigil.plans.flow import Tables, replay
from jobvigil.schema import DEAD_LETTER_PANES, DEAD_LETTERS, EVENT_PANES, EVENTS, INCIDENTS, SCAN_STATE
from jobvigil.sinks.tables import dead_letter_rows
from jobvigil.sinks.topics import INCIDENTS_TOPIC, event_records, publish_incidents
from jobvigil.sources.samples import deliveries, runs_from_events
from jobvigil.sources.tables import read_dead_letters, read_events, read_table
from jobvigil.streaming.stream import process_batch, run_dead_letter_topic, run_dead_letters, run_stream

SENSITIVE = Settings(ewma_threshold=2.0)


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    return deliveries(event_records(runs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))))


@pytest.fixture(scope="module")
def batch(spark, records, tmp_path_factory):
    tables = Tables(str(tmp_path_factory.mktemp("batch")))
    replay(spark, records, tables, SENSITIVE)
    return tables


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def contents(spark, tables):
    rows = read_table(spark, tables.path("incidents"), INCIDENTS, "incident_id").drop("batch_id")
    return rows.withColumn("anomaly_score", F.round("anomaly_score", 9)).drop("summary")


def test_replay_twice(spark, records, batch):
    before = contents(spark, batch).toPandas()
    dead = read_table(spark, batch.path("dead_letters"), DEAD_LETTERS).count()
    replay(spark, records, batch, SENSITIVE)
    assert len(before) > 5 and contents(spark, batch).toPandas().equals(before)
    assert read_table(spark, batch.path("dead_letters"), DEAD_LETTERS).count() == dead > 0


def test_stream_equals_batch(spark, records, batch, tmp_path):
    cuts = ["2024-01-01", "2024-01-08", "2024-01-17", "2025-01-01"]
    for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
        part = records.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    source = str(tmp_path / "in" / "*")
    tables = Tables(str(tmp_path / "out"))
    stream = run_stream(read_events(spark, source, True, files_per_trigger=1), tables, str(tmp_path / "c1"), SENSITIVE)
    stream.awaitTermination()
    assert spark.read.parquet(tables.path("events")).select("batch_id").distinct().count() == 3
    assert same(contents(spark, tables), contents(spark, batch))
    stored = spark.read.parquet(tables.path("events")).select(*EVENTS.names)
    assert same(stored, spark.read.parquet(batch.path("events")).select(*EVENTS.names))
    sent = spark.read.parquet(tables.path("outbox"))
    assert sent.count() == sent.select("fingerprint").distinct().count()
    assert same(sent.select("fingerprint"), spark.read.parquet(batch.path("outbox")).select("fingerprint"))
    for tables_of in (tables, batch):
        panes = read_table(spark, tables_of.path("panes"), EVENT_PANES)
        assert same(throughput_of_panes(panes), throughput(stored)) and same(duration_p95_of_panes(panes), duration_p95(usable_runs(stored)))

    run_dead_letters(read_events(spark, source, True), tables, str(tmp_path / "c2")).awaitTermination()
    columns = DEAD_LETTERS.names
    assert same(read_table(spark, tables.path("dead_letters"), DEAD_LETTERS, "event_id").select(columns),
                read_table(spark, batch.path("dead_letters"), DEAD_LETTERS).select(columns))
    panes = read_table(spark, tables.path("dead_letter_panes"), DEAD_LETTER_PANES)
    assert same(dead_letter_rate_of_panes(panes), dead_letter_rate(read_table(spark, tables.path("dead_letters"), DEAD_LETTERS)))


def test_retried_batch_changes_nothing(spark, runs, tmp_path):
    tables = Tables(str(tmp_path))
    first = runs([("CLAIMS_INGEST", 10.0 + i % 3) for i in range(12)] + [("POLICY_RENEWAL", None)], prefix="a")
    second = runs([("CLAIMS_INGEST", 90.0)], prefix="b")
    process_batch(first, 0, tables)
    process_batch(second, 1, tables)
    once = [sorted(map(str, spark.read.parquet(tables.path(t)).collect())) for t in ("incidents", "scan_state", "outbox")]
    process_batch(second, 1, tables)
    again = [sorted(map(str, spark.read.parquet(tables.path(t)).collect())) for t in ("incidents", "scan_state", "outbox")]
    assert once == again and len(once[0]) == 1
    state = {r.job_type: r for r in spark.read.schema(SCAN_STATE).parquet(tables.path("scan_state") + "/batch_id=1").collect()}
    assert state["CLAIMS_INGEST"].run_count == state["CLAIMS_INGEST"].observations == 13
    assert state["POLICY_RENEWAL"].run_count == 1 and state["POLICY_RENEWAL"].mu is None


def test_replay_refuses_tables_that_a_stream_went_on_in(spark, records, tmp_path):
    tables = Tables(str(tmp_path / "out"))
    half = F.col("timestamp") < "2024-01-16"
    replay(spark, records.filter(half), tables, SENSITIVE)
    for i in range(3):
        late = records.filter(~half & (F.day("timestamp") % 3 == i)).unionByName(records.filter(half).limit(40))
        late.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    live = read_events(spark, str(tmp_path / "in" / "*"), True, files_per_trigger=1)
    stream = run_stream(live, tables, str(tmp_path / "c"), SENSITIVE, first_batch=1)
    stream.awaitTermination()
    # the replay's ids are read with the first micro-batch and by no later one
    read = [sorted(s.numInputRows for s in p.sources) for p in stream.recentProgress if p.numInputRows]
    replayed = spark.read.parquet(tables.path("events") + "/batch_id=0").count()
    assert len(read) == 3 and max(read[0]) >= replayed and all(r[0] == 0 for r in read[1:])
    stored = spark.read.parquet(tables.path("events"))
    assert stored.count() == stored.select("event_id").distinct().count() > replayed
    with pytest.raises(ValueError):
        replay(spark, records, tables, SENSITIVE)
    assert spark.read.parquet(tables.path("events")).count() == stored.count()


def test_windows_equal_spark_windows(spark, sf_dir):
    events = runs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    plain = events.groupBy("job_type", "event_type", F.window("ts", "1 minute", "15 seconds").alias("w")).count()
    assert same(throughput(events).select("job_type", "event_type", "window_start", "events"),
                plain.select("job_type", "event_type", "w.start", "count"))
    with pytest.raises(ValueError):
        throughput(events, "1 minute", "7 seconds")


def test_p95_of_a_dense_window_is_close(spark):
    runs = spark.range(200_000).select(
        F.lit("A").alias("job_type"), F.lit("JOB_COMPLETED").alias("event_type"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 300)).alias("ts"),
        (F.col("id") * 7919 % 200_000).cast("double").alias("duration_seconds"),
    )
    full = duration_p95(runs, "5 minutes", "5 minutes").first()
    assert full.runs == 200_000 and abs(full.p95_seconds - 190_000) < 2_000


def test_panels_run_as_streams(spark, sf_dir, tmp_path):
    """Windows that the watermark has closed are the same as in batch."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    live = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    for name, panel in (("throughput", throughput), ("p95", duration_p95)):
        rows = panel(runs_from_events(live).withWatermark("ts", "1 minute"))
        writer = rows.writeStream.outputMode("append").trigger(availableNow=True)
        writer.option("checkpointLocation", str(tmp_path / f"{name}-c")).start(str(tmp_path / name)).awaitTermination()
        streamed, full = spark.read.parquet(str(tmp_path / name)), panel(runs_from_events(table))
        assert streamed.exceptAll(full).count() == 0
        assert streamed.count() > 0.95 * full.count()



def test_streamed_copies_of_one_id(spark, tmp_path):
    copies = spark.range(4000).select(
        F.when(F.col("id") < 3000, F.lit("hot")).otherwise(F.concat(F.lit("e"), (F.col("id") % 500).cast("string"))).alias("event_id"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
    )
    copies.repartition(6).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(copies.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    unique = dedupe_stream(live)
    writer = unique.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    writer.start(str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == found.select("event_id").distinct().count() == 501


def test_dead_letter_topic_has_its_own_progress(spark, records, tmp_path):
    for i, day in enumerate(("2024-01-01", "2024-01-15")):
        end = ("2024-01-15", "2025-01-01")[i]
        part = records.filter((F.col("timestamp") >= day) & (F.col("timestamp") < end))
        part.coalesce(1).write.parquet(str(tmp_path / "topic" / f"part{i}"))
    tables = Tables(str(tmp_path / "out"))
    live = read_dead_letters(spark, str(tmp_path / "topic" / "*"), True, files_per_trigger=1)
    run_dead_letter_topic(live, tables, str(tmp_path / "c")).awaitTermination()
    stored = read_table(spark, tables.path("dead_letters"), DEAD_LETTERS, "event_id").select(*DEAD_LETTERS.names)
    assert same(stored, dead_letter_rows(records))
    assert stored.filter("retry_count > 1").count() > 0 and stored.filter("error <> 'unknown'").count() > 0


def test_incident_topic(spark, batch, tmp_path):
    found = read_table(spark, batch.path("incidents"), INCIDENTS).drop("batch_id")
    publish_incidents(found, str(tmp_path))
    sent = spark.read.parquet(f"{tmp_path}/{INCIDENTS_TOPIC}")
    assert sent.count() == found.count()
    back = sent.select("key", F.get_json_object("value", "$.incidentId").alias("incident_id"))
    assert same(back, found.select("job_type", "incident_id"))


def test_panes_of_nothing_and_of_runs_without_times(spark, runs):
    events = runs([("CLAIMS_INGEST", None), ("CLAIMS_INGEST", 4.0)])
    completed = events.withColumn("event_type", F.lit("JOB_COMPLETED"))
    panels = duration_p95(completed), duration_p95_of_panes(event_panes(completed))
    assert same(*panels) and panels[0].filter("p95_seconds is null").count() > 0
    none = event_panes(events.limit(0))
    assert none.count() == throughput_of_panes(none).count() == duration_p95_of_panes(none).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        throughput_of_panes(none, "1 minute", "10 seconds")
