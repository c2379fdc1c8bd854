"""Settings shared by every operator; one immutable value, no globals to mutate."""

from __future__ import annotations

from dataclasses import dataclass

# The job types, event types and severities of the event contract.
JOB_TYPES = ("POLICY_RENEWAL", "ANNUITY_PAYOUT", "CLAIMS_INGEST")
EVENT_TYPES = ("JOB_STARTED", "JOB_PROGRESS", "JOB_COMPLETED", "JOB_FAILED")
SEVERITIES = ("LOW", "MEDIUM", "HIGH")
SCHEMA_VERSION = "v1"

# Detector names as they appear in scores and incidents.
EWMA = "ewma"
FOREST = "isolation-forest"

# Record header keys.
RETRY_HEADER = "x-retry-attempt"
ERROR_HEADER = "kafka_dlt-exception-message"


@dataclass(frozen=True)
class Settings:
    """Tuning values of the monitoring flow."""

    job_types: tuple[str, ...] = JOB_TYPES
    detector: str = EWMA
    ewma_alpha: float = 0.2
    ewma_threshold: float = 3.5
    ewma_warmup: int = 10
    forest_trees: int = 100
    forest_sample: int = 256
    forest_threshold: float = 0.65
    forest_min_rows: int = 10
    dedupe_ttl: str = "24 hours"
    schema_version: str = SCHEMA_VERSION


DEFAULTS = Settings()
