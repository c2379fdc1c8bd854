"""The whole flow on static tables, its replay, and the training job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from jobvigil.config import DEFAULTS, Settings
from jobvigil.operators.decode import decode_events, first_delivery, split_valid, usable_runs
from jobvigil.operators.dedupe import dedupe, dedupe_ttl
from jobvigil.operators.detect import Detector, anomalies, observed_features, score
from jobvigil.operators.forest import fit_or_none, last_days, training_matrix
from jobvigil.operators.incidents import enrich, revise, summarize_static, to_incidents
from jobvigil.operators.metrics import metrics_state
from jobvigil.plans.models import load_model, publish_model
from jobvigil.schema import ANSWERS, EVENTS, INCIDENTS
from jobvigil.sinks.tables import (
    publish_batch,
    dead_letter_rows,
    write_batch,
    write_dead_letters,
    write_incidents,
    write_metrics_state,
    write_panes,
)
from jobvigil.sources.tables import read_table, refuse_other_run


@dataclass(frozen=True)
class Tables:
    """Where a run puts its results."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def scored_runs(
    events: DataFrame,
    settings: Settings = DEFAULTS,
    detector: str | Detector | None = None,
    model: DataFrame | None = None,
) -> DataFrame:
    """Every completed run with features and verdict. Events must be free of duplicates."""
    features = observed_features(usable_runs(events), settings)
    return score(features, detector or settings.detector, model, settings)


def revised_incidents(spark: SparkSession, tables: Tables) -> DataFrame:
    """The incidents of a run, one row per id, with the answers that came for them in any batch since."""
    stored = read_table(spark, tables.path("incidents"), INCIDENTS, key="incident_id").select(*INCIDENTS.names)
    return revise(stored, read_table(spark, tables.path("answers"), ANSWERS))


def find_incidents(
    events: DataFrame,
    settings: Settings = DEFAULTS,
    detector: str | Detector | None = None,
    model: DataFrame | None = None,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Events to complete incidents; without a summaries table the built-in text is used."""
    found = to_incidents(anomalies(scored_runs(events, settings, detector, model)), settings)
    return summarize_static(found) if summaries is None else enrich(found, summaries)


def incidents_from_records(records: DataFrame, settings: Settings = DEFAULTS, ttl: str | None = None) -> DataFrame:
    """Raw JSON records to incidents: decode, drop the invalid, de-duplicate, score, report.

    With ``ttl`` an id counts as new again that long after its last accepted arrival.
    """
    valid, _ = split_valid(decode_events(records, settings))
    order = first_delivery(valid)
    unique = dedupe_ttl(valid, "event_id", "timestamp", ttl, order) if ttl else dedupe(valid, "event_id", order)
    return find_incidents(unique, settings)


def replay(spark: SparkSession, records: DataFrame, tables: Tables, settings: Settings = DEFAULTS, batch_id: int = 0) -> None:
    """Process all records from the start into ``tables``.

    Ids come from the data and a batch replaces its own partition, so a second
    replay leaves the same tables. The decoded events and the incidents are read
    back from their tables, so each step runs once. The state of the scan is stored
    too: a stream started with ``first_batch`` after ``batch_id`` goes on from it. Tables
    that hold later batches are refused: their events would be there twice.
    """
    from jobvigil.streaming.ledger import notify_batch
    from jobvigil.streaming.stream import read_state, score_batch

    refuse_other_run(spark, tables.path("scan_state"), batch_id)
    decoded = decode_events(records, settings)
    valid, rejected = split_valid(decoded)
    write_dead_letters(dead_letter_rows(rejected, "reject_reason"), tables.path("dead_letters"), batch_id)
    write_batch(dedupe(valid, "event_id", first_delivery(valid)).select(*EVENTS.names), tables.path("events"), batch_id)
    events = spark.read.parquet(f"{tables.path('events')}/batch_id={batch_id}")
    write_metrics_state(metrics_state(events), tables.path("metrics_state"), batch_id)
    write_panes(events, tables.path("panes"), batch_id)
    scored, after = score_batch(events, read_state(spark, tables, 0), settings)
    write_batch(after, tables.path("scan_state"), batch_id)
    write_incidents(summarize_static(to_incidents(anomalies(scored), settings)), tables.path("incidents"), batch_id)
    incidents = spark.read.parquet(f"{tables.path('incidents')}/batch_id={batch_id}")
    publish_batch(incidents, tables.path("incidents_topic"), batch_id)
    notify_batch(incidents, batch_id, tables, horizon=settings.dedupe_ttl)


def train_forest(features: DataFrame, path: str, settings: Settings = DEFAULTS, days: int | None = 7, seed: int = 7) -> bool:
    """Fit on the last ``days`` of completed runs and publish the next version of the model; False if there are too few rows.

    A stream that was started with ``path`` takes the version up with its next micro-batch.
    """
    history = last_days(features, days) if days else features
    model = fit_or_none(training_matrix(history), settings, seed)
    if model is None:
        return False
    publish_model(model, path)
    return True


def load_forest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A published model, the newest version unless one is named."""
    return load_model(spark, path, version)
