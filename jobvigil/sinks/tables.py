"""Writers. Every table is partitioned by ``batch_id`` and a batch replaces its own partition.

Writing a batch again (a retried micro-batch, a replay with the same id) therefore
leaves one copy; readers resolve keys that occur in several batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobvigil.functions.headers import dead_letter_error, retry_count
from jobvigil.functions.identity import dead_letter_id, own_event_id
from jobvigil.operators.dedupe import dedupe
from jobvigil.operators.monitor import dead_letter_panes, event_panes
from jobvigil.schema import ANSWERS, DEAD_LETTERS, INCIDENTS, METRICS_STATE, OUTBOX
from jobvigil.sinks.topics import incident_records


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace partition ``batch_id`` of the table at ``path``, leaving the others alone."""
    # the partition folder is written directly, so an empty batch clears an old copy too
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def idempotent_batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function whose effect is the same however often a batch is retried."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return write


def write_incidents(incidents: DataFrame, path: str, batch_id: int = 0) -> None:
    write_batch(incidents.select(*INCIDENTS.names), path, batch_id)


def write_answers(answers: DataFrame, path: str, batch_id: int = 0) -> None:
    write_batch(answers.select(*ANSWERS.names), path, batch_id)


def publish_batch(incidents: DataFrame, path: str, batch_id: int = 0) -> None:
    """The batch's topic records; a retried batch replaces its own, so nothing is published twice."""
    write_batch(incident_records(incidents), path, batch_id)


def write_dead_letters(dead: DataFrame, path: str, batch_id: int = 0) -> None:
    write_batch(dead.select(*DEAD_LETTERS.names), path, batch_id)


def write_metrics_state(state: DataFrame, path: str, batch_id: int = 0) -> None:
    write_batch(state.select(*METRICS_STATE.names), path, batch_id)


def write_panes(events: DataFrame, path: str, batch_id: int = 0) -> None:
    """The batch's events by pane, for the panels; a retried batch replaces its own."""
    write_batch(event_panes(events), path, batch_id)


def write_dead_letter_panes(dead: DataFrame, path: str, batch_id: int = 0) -> None:
    write_batch(dead_letter_panes(dead), path, batch_id)


def write_outbox(payloads: DataFrame, path: str, batch_id: int = 0) -> None:
    """Messages to send: fingerprint, incident and payload."""
    write_batch(payloads.select(*OUTBOX.names), path, batch_id)


def dead_letter_rows(records: DataFrame, reason: str | None = None) -> DataFrame:
    """Dead-letter table rows from raw records, one per delivery; of records with one eventId the last.

    ``reason`` names a column with the reject reason, and ``event_id`` then is what
    decoding found; without it the reason is read from the failure headers, as for
    records from a dead-letter topic. A record without an eventId is named by topic,
    partition and offset, or where it has none by its text, its time and its number
    among equal ones. A record without a time failed now.
    """
    error = F.coalesce(F.col(reason), F.lit("unknown")) if reason else dead_letter_error(F.col("headers"))
    has = lambda name, kind: F.col(name) if name in records.columns else F.lit(None).cast(kind)
    rows = records.select(
        (F.col("event_id") if reason and "event_id" in records.columns else own_event_id(F.col("value"))).alias("own"),
        F.coalesce("value", F.lit("")).alias("raw_payload"),
        error.alias("error"),
        retry_count(F.col("headers")).alias("retry_count"),
        F.coalesce("timestamp", F.current_timestamp()).alias("failed_at"),
        has("topic", "string").alias("topic"), has("partition", "int").alias("partition"), has("offset", "bigint").alias("offset"),
    )
    # only records with neither id nor place are numbered among equals, the others are spread by their content
    nameless = F.col("own").isNull() & F.col("offset").isNull()
    spread = F.when(nameless, F.lit(0)).otherwise(F.xxhash64("own", "raw_payload", "failed_at", "partition", "offset"))
    text = F.sha2("raw_payload", 256)
    copy = F.row_number().over(Window.partitionBy(spread, text, "failed_at").orderBy("error", "retry_count"))
    number = F.concat_ws("|", F.unix_micros("failed_at").cast("string"), copy.cast("string"))
    named = rows.withColumn("event_id", dead_letter_id(
        F.col("own"), F.col("raw_payload"), F.col("topic"), F.col("partition"), F.col("offset"), number))
    return dedupe(named, "event_id", (
        F.desc("failed_at"), F.desc("partition"), F.desc("offset"), F.desc("retry_count"), F.desc("error"), F.desc(F.xxhash64("raw_payload")),
    )).select(*DEAD_LETTERS.names)
