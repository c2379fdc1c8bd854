"""Decoding, rejects, headers, dead letters, readers and writers."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobvigil.functions import headers as H
from jobvigil.functions.identity import fingerprint
from jobvigil.operators.decode import decode_events, split_valid
from jobvigil.schema import DEAD_LETTERS, EVENTS, METRICS_STATE
from jobvigil.sinks.tables import dead_letter_rows, idempotent_batch_writer, write_batch, write_dead_letters
from jobvigil.sinks.topics import EVENTS_TOPIC, event_records, publish_events
from jobvigil.sources.samples import deliveries, runs_from_events
from jobvigil.sources.tables import metrics_for, read_event_array, read_events, read_metrics_state, read_table


def event(kind="JOB_COMPLETED", **changes):
    payload = {
        "JOB_STARTED": {"runId": "r1", "sourceFile": "in.csv", "expectedRows": 900},
        "JOB_PROGRESS": {"runId": "r1", "rowsProcessedSoFar": 300, "progressPercent": 33},
        "JOB_COMPLETED": {"runId": "r1", "rowsProcessed": 900, "durationSeconds": 61.5, "errorCount": 2, "sourceFile": "in.csv"},
        "JOB_FAILED": {"runId": "r2", "errorCode": "NO_FILE", "errorMessage": "in.csv is missing", "retryCount": 2},
    }[kind]
    doc = {
        "eventId": f"id-{kind}", "schemaVersion": "v1", "jobType": "CLAIMS_INGEST", "timestamp": "2024-03-01T04:05:06Z",
        "payload": {"eventType": kind, **payload},
    }
    for path, value in changes.items():
        *parents, last = path.split("__")
        at = doc
        for p in parents:
            at = at[p]
        if value is ...:
            at.pop(last, None)
        else:
            at[last] = value
    return doc


def decode(spark, *values):
    rows = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return decode_events(spark.createDataFrame(rows, "n int, value string")).orderBy("n").collect()


def test_each_event_type(spark):
    started, progress, completed, failed = decode(
        spark, *[event(k) for k in ("JOB_STARTED", "JOB_PROGRESS", "JOB_COMPLETED", "JOB_FAILED")]
    )
    assert all(r.reject_reason is None and r.schema_version == "v1" for r in (started, progress, completed, failed))
    assert started.expected_rows == 900 and started.duration_seconds is None
    assert progress.progress_percent == 33 and progress.rows_so_far == 300
    assert (completed.rows_processed, completed.duration_seconds, completed.error_count) == (900, 61.5, 2)
    assert completed.ts == datetime(2024, 3, 1, 4, 5, 6) and completed.source_file == "in.csv"
    assert failed.error_code == "NO_FILE" and failed.retry_count == 2 and failed.rows_processed is None


def test_lenient_reading(spark):
    odd = decode(
        spark,
        event(extra=1, payload__unknown={"a": [1]}),
        event(payload__durationSeconds="60"),
        event(payload__rowsProcessed=12.7),
        event(payload__errorCount=...),
        event(payload__errorCount=None),
        event(payload__rowsProcessed=""),
        event(timestamp="2024-03-01T05:05:06.5+01:00"),
        event(timestamp=1709265906),
        event("JOB_STARTED", payload__durationSeconds="ignored here"),
    )
    assert [r.reject_reason for r in odd] == [None] * 9
    assert odd[1].duration_seconds == 60.0 and odd[2].rows_processed == 12
    assert odd[3].error_count == 0 and odd[4].error_count == 0 and odd[5].rows_processed == 0
    assert odd[6].ts == datetime(2024, 3, 1, 4, 5, 6, 500000) and odd[7].ts == datetime(2024, 3, 1, 4, 5, 6)


@pytest.mark.parametrize("value,reason", [
    ("{ half a record", "not_json"),
    ('{"eventId": "x", "jobType": "CLAIMS_INGEST"', "not_json"),
    (None, "not_json"),
    ("", "not_json"),
    ("null", "not_an_object"),
    ("[1, 2]", "not_an_object"),
    (event(jobType="OTHER"), "unknown_job_type"),
    (event(jobType=...), "unknown_job_type"),
    (event(payload=None), "missing_payload"),
    (event(payload=...), "missing_payload"),
    (event(payload__eventType="JOB_PAUSED"), "unknown_event_type"),
    (event(payload__eventType=...), "unknown_event_type"),
    (event(timestamp="yesterday"), "bad_timestamp"),
    (event(timestamp="2024-03-01T04:05:06"), "bad_timestamp"),
    (event(timestamp=...), "bad_timestamp"),
    (event(payload__durationSeconds="soon"), "bad_number"),
    (event(payload__durationSeconds="NaN"), "bad_number"),
    (event(payload__durationSeconds="Infinity"), "bad_number"),
    (event(payload__errorCount=3_000_000_000), "bad_number"),
    (event(eventId=None), "missing_event_id"),
])
def test_reject_reasons(spark, value, reason):
    assert decode(spark, value, event())[0].reject_reason == reason


def test_poison_does_not_stop_the_next(spark):
    df = spark.createDataFrame([("{ broken",), (json.dumps(event()),)], "value string")
    valid, rejected = split_valid(decode_events(df))
    assert valid.columns == EVENTS.names and valid.count() == 1
    assert [r.value for r in rejected.collect()] == ["{ broken"]


def test_text_is_parsed_once(spark):
    valid, _ = split_valid(decode_events(spark.createDataFrame([("{}",)], "value string")))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_headers(spark):
    def entries(*pairs):
        return [(k, None if v is None else bytearray(v.encode())) for k, v in pairs]

    cases = [None, entries(("x-retry-attempt", "2")), entries(("x-retry-attempt", "1"), ("a", "b"), ("x-retry-attempt", "7")),
             entries(("x-retry-attempt", "many"), ("kafka_dlt-exception-message", "boom")), entries()]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "n int, headers array<struct<key:string,value:binary>>")
    stamped = H.set_retry_count(F.col("headers"), H.retry_count(F.col("headers")) + 1)
    rows = df.select("n", H.retry_count(F.col("headers")).alias("c"), H.dead_letter_error(F.col("headers")).alias("e"),
                     stamped.alias("s"), H.set_retry_count(F.col("headers")).alias("d")).orderBy("n").collect()
    assert [r.c for r in rows] == [0, 2, 7, 0, 0]
    assert [r.e for r in rows] == ["unknown", "unknown", "unknown", "boom", "unknown"]
    assert [(h.key, bytes(h.value)) for h in rows[2].s] == [("a", b"b"), ("x-retry-attempt", b"8")]
    assert all(bytes(r.d[-1].value) == b"1" for r in rows)


def test_fingerprint_values(spark):
    df = spark.sql("select timestamp'2024-06-01 14:32:00' a, timestamp'2024-06-01 14:59:59' b, timestamp'2024-06-01 15:00:00' c")
    row = df.select(*[fingerprint(F.lit("ANNUITY_PAYOUT"), F.lit(s), F.col(t)).alias(f"{s}{t}")
                      for s in ("HIGH", "LOW") for t in "abc"]).first()
    assert row.HIGHa == row.HIGHb == "7f6c88bcbc2c13343eaea47400fa5ce2b89449a033dde41039201e8f6d0882ab"
    assert row.LOWa == "7a0bd1da05f53b5edeaa7af85bea397d611b1da5706aa86363a2114f34d14bee"
    assert row.HIGHc != row.HIGHa


def test_event_array_documents(spark, tmp_path):
    docs = [event(k) for k in ("JOB_STARTED", "JOB_PROGRESS", "JOB_COMPLETED", "JOB_FAILED")]
    (tmp_path / "day.json").write_text(json.dumps(docs, indent=2))
    valid, rejected = split_valid(decode_events(read_event_array(spark, str(tmp_path))))
    assert {r.event_id: r.event_type for r in valid.collect()} == {d["eventId"]: d["payload"]["eventType"] for d in docs}
    assert rejected.count() == 0


def test_published_events_come_back(spark, sf_dir, tmp_path):
    events = runs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    publish_events(events, str(tmp_path))
    back, bad = split_valid(decode_events(read_events(spark, f"{tmp_path}/{EVENTS_TOPIC}")))
    back = back.select(*EVENTS.names)
    assert bad.count() == 0 and back.exceptAll(events).count() == 0 and events.exceptAll(back).count() == 0


def test_text_source_has_all_columns(spark, tmp_path):
    (tmp_path / "lines.txt").write_text(json.dumps(event()) + "\nbroken\n")
    records = read_events(spark, str(tmp_path), file_format="text")
    assert records.filter("key is null and headers is null and timestamp is not null").count() == 2


def test_equal_broken_records_are_dead_letters_each(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("{ half\n" * 3 + json.dumps(event()) + "\n\n\n")
    _, bad = split_valid(decode_events(read_events(spark, str(tmp_path), file_format="text")))
    dead = dead_letter_rows(bad, "reject_reason")
    assert dead.count() == dead.select("event_id").distinct().count() == 5 and dead.filter("failed_at is null").count() == 0
    placed = bad.limit(1).crossJoin(spark.range(2).selectExpr("'t' topic2", "0 part2", "id off2")).drop("topic", "partition", "offset")
    placed = placed.withColumnsRenamed({"topic2": "topic", "part2": "partition", "off2": "offset"})
    assert dead_letter_rows(placed, "reject_reason").count() == 2


def test_times_are_utc_in_any_session(spark):
    from jobvigil.functions.scores import hour_utc, iso_dow, utc_text

    frame = spark.createDataFrame([(1_717_252_320_123_456,), (-1,)], "us long").select(F.timestamp_micros("us").alias("ts"))
    texts = lambda: [tuple(r) for r in frame.select(
        hour_utc(F.col("ts")), iso_dow(F.col("ts")), utc_text(F.col("ts")), fingerprint(F.lit("CLAIMS_INGEST"), F.lit("LOW"), F.col("ts"))).collect()]
    utc = texts()
    assert utc[0][:3] == (14, 6, "2024-06-01T14:32:00.123456Z") and utc[1][:3] == (23, 3, "1969-12-31T23:59:59.999999Z")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert texts() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dead_letters_last_put_wins(spark, tmp_path, sf_dir):
    raw = deliveries(event_records(runs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))))
    rows = dead_letter_rows(raw)
    write_dead_letters(rows, str(tmp_path / "dead"), 4)
    write_dead_letters(rows, str(tmp_path / "dead"), 4)
    stored = read_table(spark, str(tmp_path / "dead"), DEAD_LETTERS, "event_id")
    assert stored.count() == stored.select("event_id").distinct().count() == rows.count()
    assert stored.filter("raw_payload is null or error is null").count() == 0


def test_batch_writer_replaces_its_own_batch(spark, tmp_path):
    write = idempotent_batch_writer(str(tmp_path / "t"))
    for _ in range(2):
        write(spark.range(5), 0)
        write(spark.range(7), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 12


def test_metrics_state_reader_fills_gaps(spark, tmp_path):
    row = spark.createDataFrame([("CLAIMS_INGEST", None, None, 3, None, None)], METRICS_STATE)
    write_batch(row, str(tmp_path / "s"), 0)
    state = metrics_for(read_metrics_state(spark, str(tmp_path / "s")), "CLAIMS_INGEST")
    assert tuple(state.first()) == ("CLAIMS_INGEST", 0, 0.0, 3, 0, datetime(1970, 1, 1))
    assert metrics_for(read_metrics_state(spark, str(tmp_path / "s")), "OTHER").isEmpty()
    assert "EqualTo(job_type,CLAIMS_INGEST)" in state._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text, elements", [
    ("", []), (" \n", []), ("[]", []), ("[ ] x", ["x"]), ('[1, "a,]", null, [1,{"b":"]"}], {"a":1}]', ["1", '"a,]"', "null", '[1,{"b":"]"}]', '{"a":1}']),
    ('[{"a":1},{"b', ['{"a":1}', '{"b']), ('[{"a" 1}, {"c":2}, x y, nan]', ['{"a" 1}', '{"c":2}', "x y", "nan"]), ('{"a":1}', ['{"a":1}']),
    ("[1,,2]", ["1", "2"]), ("[1,]", ["1"]), ("[1 2,3]", ["1 2", "3"]), ('[{"a":1}] tail', ['{"a":1}', "tail"]), ('["abc', ['"abc']), ("[1", ["1"]),
    ('[{"a":1}}, {"b":2}]', ['{"a":1}}', '{"b":2}']), ("\ufeff[1.50]", ["1.50"]), ("[" * 50_000, ["[" * 49_999]), ("7", ["7"]),
])
def test_elements_of_documents(text, elements):
    from jobvigil.sources.documents import array_elements

    assert list(array_elements(text)) == elements


def test_elements_that_are_no_events_become_dead_letters_of_their_own(spark, tmp_path):
    event = '{"eventId":"e%d","schemaVersion":"v1","jobType":"CLAIMS_INGEST","timestamp":"2024-06-01T10:00:00Z","payload":{"eventType":"JOB_FAILED","runId":"r"}}'
    for name, text in {"a": f"[{event % 1}, 7, null, 7]", "b": f'[{event % 2}, "text", {event % 3}, {{"eventId":"e4', "c": "", "d": "7"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    valid, rejected = split_valid(decode_events(read_event_array(spark, str(tmp_path))))
    assert sorted(r.event_id for r in valid.collect()) == ["e1", "e2", "e3"]
    dead = dead_letter_rows(rejected, "reject_reason").collect()
    assert sorted(r.raw_payload for r in dead) == ['"text"', "7", "7", "7", "null", '{"eventId":"e4']
    assert len({r.event_id for r in dead}) == 6 and {r.error for r in dead} == {"not_an_object", "not_json"}
