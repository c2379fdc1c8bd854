"""Notifications: once per fingerprint, not again when delivered before, with a ready payload."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobvigil.operators.dedupe import dedupe

# The message format, the titles of its fields, the colour per severity
# and the texts used when there is no summary.
MESSAGE_FORMAT = "*[%s]* Anomaly in *%s* — score %.4f (detector: %s)"
TITLES = ("Summary", "Likely Cause", "Incident ID", "LLM Provider")
COLOURS = {"HIGH": "#D00000", "MEDIUM": "#FF8800", "LOW": "#FFCC00"}
NO_SUMMARY = "Anomaly detected (LLM unavailable)"
NO_CAUSE = "Unknown"


def notify_dedupe(incidents: DataFrame, order_by: Sequence[str] = ("detected_at", "incident_id")) -> DataFrame:
    """The first incident per fingerprint: one notification per job type, severity and hour."""
    if incidents.isStreaming:
        return incidents.withWatermark("detected_at", "1 hour").dropDuplicatesWithinWatermark(["fingerprint"])
    return dedupe(incidents, "fingerprint", order_by)


def undelivered(
    incidents: DataFrame, delivered: DataFrame, order_by: Sequence[str] = ("detected_at", "incident_id")
) -> DataFrame:
    """One incident per fingerprint that has no successful delivery yet.

    ``delivered`` lists fingerprints; with an ``ok`` column only successful ones
    count, so the next incident of a failed one is tried again.
    """
    done = delivered.filter(F.col("ok")) if "ok" in delivered.columns else delivered
    first = notify_dedupe(incidents, order_by)
    return first.join(done.select("fingerprint"), "fingerprint", "left_anti")


def with_payload(incidents: DataFrame) -> DataFrame:
    """Add ``payload``: the JSON body of a chat message about the incident."""
    def clean(column: str, fallback: str | None = None):
        text = F.col(column) if fallback is None else F.coalesce(F.col(column), F.lit(fallback))
        return F.replace(text, F.lit("\r"), F.lit(""))

    def entry(title: str, value, short: bool):
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))

    colour = F.when(F.col("severity") == "HIGH", COLOURS["HIGH"]).when(
        F.col("severity") == "MEDIUM", COLOURS["MEDIUM"]
    ).otherwise(COLOURS["LOW"])
    text = F.format_string(
        MESSAGE_FORMAT,
        F.col("severity"), F.col("job_type"), F.col("anomaly_score"), F.col("detector_name"),
    )
    attachment = F.struct(
        colour.alias("color"),
        F.array(
            entry(TITLES[0], clean("summary", NO_SUMMARY), False),
            entry(TITLES[1], clean("likely_cause", NO_CAUSE), False),
            entry(TITLES[2], clean("incident_id"), True),
            entry(TITLES[3], clean("llm_provider"), True),
        ).alias("fields"),
    )
    body = F.struct(F.replace(text, F.lit("\r"), F.lit("")).alias("text"), F.array(attachment).alias("attachments"))
    return incidents.withColumn("payload", F.to_json(body))


def deliver(batch: DataFrame, send: Callable[[DataFrame], None]) -> bool:
    """Hand a batch to the caller's own delivery; a failure is reported, not raised."""
    try:
        send(batch)
    except Exception:  # noqa: BLE001 - delivery must not stop the flow
        return False
    return True
