"""Key/value records for topics: Kafka when a server is configured, JSON text files otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobvigil.functions.scores import utc_text

# Topic names of the event contract.
EVENTS_TOPIC = "batch.events.v1"
DEAD_LETTER_TOPIC = "batch.events.v1.dlq"
INCIDENTS_TOPIC = "incidents.v1"


def event_records(events: DataFrame) -> DataFrame:
    """Add ``key`` (job type) and ``value`` (event as JSON, absent fields left out)."""
    payload = F.struct(
        F.col("event_type").alias("eventType"),
        F.col("run_id").alias("runId"),
        F.col("expected_rows").alias("expectedRows"),
        F.col("rows_so_far").alias("rowsProcessedSoFar"),
        F.col("progress_percent").alias("progressPercent"),
        F.col("rows_processed").alias("rowsProcessed"),
        F.col("duration_seconds").alias("durationSeconds"),
        F.col("error_count").alias("errorCount"),
        F.col("source_file").alias("sourceFile"),
        F.col("error_code").alias("errorCode"),
        F.col("error_message").alias("errorMessage"),
        F.col("retry_count").alias("retryCount"),
    )
    envelope = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("schema_version").alias("schemaVersion"),
        F.col("job_type").alias("jobType"),
        utc_text(F.col("ts")).alias("timestamp"),
        payload.alias("payload"),
    )
    return events.withColumns({"key": F.col("job_type"), "value": F.to_json(envelope)})


def incident_records(incidents: DataFrame) -> DataFrame:
    """``key`` (job type) and ``value`` (the whole incident as JSON)."""
    envelope = F.struct(
        F.col("incident_id").alias("incidentId"),
        F.col("schema_version").alias("schemaVersion"),
        F.col("job_type").alias("jobType"),
        F.col("anomaly_score").alias("anomalyScore"),
        F.col("detector_name").alias("detectorName"),
        F.col("fingerprint"),
        F.col("severity"),
        F.col("summary"),
        F.col("likely_cause").alias("likelyCause"),
        F.col("suggested_actions").alias("suggestedActions"),
        F.col("llm_unavailable").alias("llmUnavailable"),
        utc_text(F.col("detected_at")).alias("detectedAt"),
        F.col("llm_provider").alias("llmProvider"),
    )
    value: Column = F.to_json(envelope, {"ignoreNullFields": "false"})
    return incidents.select(F.col("job_type").alias("key"), value.alias("value"))


def publish(records: DataFrame, target: dict[str, str] | str, topic: str, mode: str = "append") -> None:
    """Write key/value records to Kafka options or to a folder of parquet files."""
    chosen = records.select("key", "value")
    if isinstance(target, dict):
        chosen.write.format("kafka").options(**target).option("topic", topic).save()
    else:
        chosen.write.mode(mode).parquet(f"{target}/{topic}")


def publish_events(events: DataFrame, target: dict[str, str] | str, mode: str = "append") -> None:
    publish(event_records(events), target, EVENTS_TOPIC, mode)


def publish_incidents(incidents: DataFrame, target: dict[str, str] | str, mode: str = "append") -> None:
    publish(incident_records(incidents), target, INCIDENTS_TOPIC, mode)
