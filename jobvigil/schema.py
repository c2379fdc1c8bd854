"""Spark schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

HEADERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
)

# The columns a Kafka source delivers; file sources are given the same ones.
RAW_RECORDS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("headers", HEADERS),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Decoded events: the envelope plus the nullable columns of all four payloads.
EVENTS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("expected_rows", T.LongType()),
    T.StructField("rows_so_far", T.LongType()),
    T.StructField("progress_percent", T.IntegerType()),
    T.StructField("rows_processed", T.LongType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("error_count", T.IntegerType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
])

METRICS_STATE = T.StructType([
    T.StructField("job_type", T.StringType()),
    T.StructField("run_count", T.LongType()),
    T.StructField("sum_duration_seconds", T.DoubleType()),
    T.StructField("sum_error_count", T.LongType()),
    T.StructField("sum_rows", T.LongType()),
    T.StructField("updated_at", T.TimestampType()),
])

# What a stream carries from one micro-batch to the next, one row per job type.
SCAN_STATE = T.StructType(
    METRICS_STATE.fields
    + [
        T.StructField("observations", T.LongType()),
        T.StructField("mu", T.DoubleType()),
        T.StructField("sigma", T.DoubleType()),
    ]
)

INCIDENTS = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("detector_name", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("likely_cause", T.StringType()),
    T.StructField("suggested_actions", T.ArrayType(T.StringType())),
    T.StructField("llm_unavailable", T.BooleanType()),
    T.StructField("detected_at", T.TimestampType()),
    T.StructField("llm_provider", T.StringType()),
])

# Answers of a summariser that came after their incident was stored.
ANSWERS = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("answered_at", T.TimestampType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("provider", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("likely_cause", T.StringType()),
    T.StructField("suggested_actions", T.ArrayType(T.StringType())),
])

DEAD_LETTERS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("failed_at", T.TimestampType()),
])

OUTBOX = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("incident_id", T.StringType()),
    T.StructField("detected_at", T.TimestampType()),
    T.StructField("payload", T.StringType()),
])

# What became of each message of a batch.
DELIVERIES = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("incident_id", T.StringType()),
    T.StructField("detected_at", T.TimestampType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("error", T.StringType()),
])

# Fingerprints that must not be sent again, and until when.
NOTIFIED = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("until", T.TimestampType()),
])

# What the panels need of events and dead letters, by pane.
EVENT_PANES = T.StructType([
    T.StructField("job_type", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("pane_start", T.TimestampType()),
    T.StructField("events", T.LongType()),
    T.StructField("durations", T.BinaryType()),
])

DEAD_LETTER_PANES = T.StructType([
    T.StructField("pane_start", T.TimestampType()),
    T.StructField("events", T.LongType()),
])

# The pointer to a model: a version is there as soon as its row is.
MODEL_VERSIONS = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("trees", T.LongType()),
])

# By which version a micro-batch is scored; null where there was none.
BATCH_MODELS = T.StructType([T.StructField("version", T.LongType())])

FOREST_MODEL = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("normal", T.ArrayType(T.DoubleType())),
    T.StructField("offset", T.DoubleType()),
    T.StructField("path_length", T.DoubleType()),
    T.StructField("sample_size", T.IntegerType()),
])
