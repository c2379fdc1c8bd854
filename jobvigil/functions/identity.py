"""Deterministic identifiers, so that a replay writes the same keys again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobvigil.functions.scores import utc_text


def fingerprint(job_type: Column, severity: Column, ts: Column) -> Column:
    """SHA-256 hex of job type, severity and hour: one value per alert kind and hour."""
    return F.sha2(F.concat_ws("|", job_type, severity, utc_text(ts, hour=True)), 256)


def incident_id(event_id: Column, detector_name: Column) -> Column:
    """One id per scored event and detector."""
    return F.sha2(F.concat_ws("|", event_id, detector_name), 256)


def own_event_id(value: Column) -> Column:
    """The eventId a raw record carries, null if it cannot be read."""
    return F.try_variant_get(F.try_parse_json(value), "$.eventId", "string")


def dead_letter_id(own: Column, value: Column, topic: Column, partition: Column, offset: Column, copy: Column) -> Column:
    """The record's own eventId, else a hash of where it was, else of its text and which of the equal records it is."""
    place = F.when(offset.isNotNull(), F.sha2(F.concat_ws("|", topic, partition.cast("string"), offset.cast("string")), 256))
    return F.coalesce(own, place, F.sha2(F.concat_ws("|", copy.cast("string"), F.coalesce(value, F.lit(""))), 256))
