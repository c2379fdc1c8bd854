"""The flow as Structured Streaming queries.

Each micro-batch is handled as a small static table: the ordered scan splits it
over all tasks, also when one job type holds most of it, and continues from the
state table the previous batch wrote. Every table is written per ``batch_id``, so
a batch that is retried after a failure replaces its own output and the effect is
exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from jobvigil.config import DEFAULTS, Settings
from jobvigil.operators.decode import decode_events, split_valid, usable_runs
from jobvigil.operators.dedupe import dedupe_stream, only_new
from jobvigil.operators.detect import Detector, anomalies, score
from jobvigil.operators.incidents import decode_answers, summarize_static, to_incidents
from jobvigil.operators.metrics import DELTAS, ORDER, RUN_COLUMNS, feature_vectors, name_running, observe
from jobvigil.operators.ordered import ScanSpec, arrange, scan
from jobvigil.plans.flow import Tables
from jobvigil.plans.models import model_of_batch
from jobvigil.schema import DEAD_LETTERS, EVENTS, INCIDENTS, SCAN_STATE
from jobvigil.sinks.tables import (
    dead_letter_rows, publish_batch, write_answers, write_batch, write_dead_letter_panes, write_dead_letters, write_incidents, write_metrics_state, write_panes,
)
from jobvigil.sources.tables import refuse_other_run
from jobvigil.streaming.ledger import Sender, hand_on, notify_batch

Summarizer = Callable[[DataFrame], DataFrame]


def score_batch(
    events: DataFrame,
    state: DataFrame,
    settings: Settings = DEFAULTS,
    detector: str | Detector | None = None,
    model: DataFrame | None = None,
    order_by: Sequence[str] = ORDER,
) -> tuple[DataFrame, DataFrame]:
    """(scored runs, state after them) for new events that follow on ``state``.

    The stored state goes into the scan as one row per job type in front of its
    events, so resuming needs no join and no lookup.
    """
    finished = usable_runs(events).filter(F.col("event_type").isin("JOB_COMPLETED", "JOB_FAILED"))
    columns = list(dict.fromkeys([*RUN_COLUMNS, *order_by]))
    stored = state.select(
        "job_type",
        F.col("updated_at").alias("ts"),
        F.struct(*[f for f in state.columns if f != "job_type"]).alias("stored"),
    )
    rows = finished.select(*columns).unionByName(stored, allowMissingColumns=True)
    rows = rows.withColumn("is_event", F.col("stored").isNull())
    arranged = _seed_from_stored(observe(arrange(rows, "job_type", ["is_event", *order_by])))
    spec = ScanSpec("job_type", DELTAS, "observed_seconds", settings.ewma_alpha, "start_sigma", "weight")
    consumed = (*DELTAS, "observed_seconds", "start_sigma", "weight", "stored")
    scanned = name_running(scan(arranged, spec, drop=consumed))
    after = _state_after(scanned, order_by)
    features = feature_vectors(scanned.filter("is_event")).drop("is_event")
    return score(features, detector or settings.detector, model, settings), after


def _seed_from_stored(rows: DataFrame) -> DataFrame:
    """Let the row of a stored state bring its totals, mean, deviation and count into the scan."""
    seeds = {
        "d_runs": "run_count",
        "d_duration": "sum_duration_seconds",
        "d_errors": "sum_error_count",
        "d_rows": "sum_rows",
        "observed_seconds": "mu",
    }
    event = F.col("is_event")
    return rows.withColumns({
        **{column: F.when(event, F.col(column)).otherwise(F.col(f"stored.{name}")) for column, name in seeds.items()},
        "start_sigma": F.col("stored.sigma"),
        "weight": F.when(event, F.lit(1).cast("bigint")).otherwise(F.col("stored.observations")),
    })


def _state_after(scanned: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Last values per job type: one partial-aggregated row per key and task."""
    place = F.struct("is_event", *order_by)
    observed = F.col("mu").isNotNull()
    totals = ("running_count", "running_duration_seconds", "running_error_count", "running_rows")
    last = scanned.groupBy("job_type").agg(
        F.max_by(F.struct(*totals), place).alias("sums"),
        F.max("ts").alias("updated_at"),
        F.max_by(F.when(observed, F.struct("observation", "mu", "sigma")), F.when(observed, place)).alias("ewma"),
    )
    return last.select(
        "job_type",
        F.col("sums.running_count").alias("run_count"),
        F.col("sums.running_duration_seconds").alias("sum_duration_seconds"),
        F.col("sums.running_error_count").alias("sum_error_count"),
        F.col("sums.running_rows").alias("sum_rows"),
        "updated_at",
        F.coalesce("ewma.observation", F.lit(0).cast("bigint")).alias("observations"),
        F.col("ewma.mu").alias("mu"),
        F.col("ewma.sigma").alias("sigma"),
    )


def read_state(spark: SparkSession, tables: Tables, before_batch: int) -> DataFrame:
    """The state the previous micro-batch left; empty before the first one."""
    if before_batch == 0:
        return spark.createDataFrame([], SCAN_STATE)
    return spark.read.schema(SCAN_STATE).parquet(f"{tables.path('scan_state')}/batch_id={before_batch - 1}")


def process_batch(
    batch: DataFrame,
    batch_id: int,
    tables: Tables,
    settings: Settings = DEFAULTS,
    detector: str | Detector | None = None,
    model: DataFrame | str | None = None,
    summarize: Summarizer = summarize_static,
    first_batch: int = 0,
    send: Sender | None = None,
    after_crash: str = "resend",
) -> None:
    """All effects of one micro-batch of valid, unique events.

    The events are stored first and read back, so the stream's own operators run
    once per batch however many tables follow from it. Messages go to the outbox and,
    with ``send``, out; ``ledger`` says how each is sent once. A ``model`` given as a path
    is the one published there: its newest version when the batch is first tried.
    """
    spark = batch.sparkSession
    if batch_id == first_batch:
        refuse_other_run(spark, tables.path("scan_state"), batch_id)
    write_batch(batch.select(*EVENTS.names), tables.path("events"), batch_id)
    events = spark.read.schema(EVENTS).parquet(f"{tables.path('events')}/batch_id={batch_id}")
    before = read_state(spark, tables, batch_id)
    if events.isEmpty():
        # a batch that only moves the watermark: hand the state on
        write_batch(before, tables.path("scan_state"), batch_id)
        write_metrics_state(before, tables.path("metrics_state"), batch_id)
        write_incidents(spark.createDataFrame([], INCIDENTS), tables.path("incidents"), batch_id)
        hand_on(spark, batch_id, tables)
        return
    write_panes(events, tables.path("panes"), batch_id)
    if isinstance(model, str):
        model = model_of_batch(spark, model, tables.path("batch_models"), batch_id)
    scored, after = score_batch(events, before, settings, detector, model)
    write_batch(after, tables.path("scan_state"), batch_id)
    write_metrics_state(read_state(spark, tables, batch_id + 1), tables.path("metrics_state"), batch_id)
    found = to_incidents(anomalies(scored), settings)
    write_incidents(summarize(found), tables.path("incidents"), batch_id)
    incidents = spark.read.parquet(f"{tables.path('incidents')}/batch_id={batch_id}")
    publish_batch(incidents, tables.path("incidents_topic"), batch_id)
    notify_batch(incidents, batch_id, tables, send, settings.dedupe_ttl, after_crash)


def run_stream(
    records: DataFrame,
    tables: Tables,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    detector: str | Detector | None = None,
    model: DataFrame | str | None = None,
    summarize: Summarizer = summarize_static,
    trigger: dict | None = None,
    first_batch: int = 0,
    send: Sender | None = None,
    after_crash: str = "resend",
) -> StreamingQuery:
    """Raw streaming records to incidents: decode, drop the invalid, de-duplicate, score, store.

    Input is at least once; ids are remembered for ``settings.dedupe_ttl`` after they
    arrived. Events are processed when they arrive, however old or far ahead their own
    time is. ``first_batch`` is the number of the first micro-batch: 1 after a replay into
    the same tables as batch 0, whose state it goes on from and whose events it knows: their
    ids enter the state of the de-duplication with the first micro-batch, and no later
    one reads them. ``send`` delivers the messages of each batch. ``model`` is a table of
    nodes or the path of a published model, whose versions are taken up as they come.
    """
    valid, _ = split_valid(decode_events(records, settings))
    if first_batch:
        valid = _with_ids_of_replay(valid, tables, first_batch)
    return start_events(dedupe_stream(valid, "event_id", settings.dedupe_ttl), tables, checkpoint, settings,
                        detector, model, summarize, trigger, first_batch, send, after_crash)


REPLAYED = "of_replay"


def _with_ids_of_replay(valid: DataFrame, tables: Tables, first_batch: int) -> DataFrame:
    """The live events and, as a bounded source beside them, the ids that earlier batches stored.

    A source of files reads each file once, all of these in the first micro-batch, and
    keeps that in the stream's progress.
    """
    ids = T.StructType([EVENTS["event_id"]])
    done = f"{tables.path('events')}/batch_id={{{','.join(map(str, range(first_batch)))}}}"
    stored = valid.sparkSession.readStream.schema(ids).parquet(done).withColumn(REPLAYED, F.lit(True))
    return valid.select(*EVENTS.names).withColumn(REPLAYED, F.lit(False)).unionByName(stored, allowMissingColumns=True)


def start_events(
    events: DataFrame,
    tables: Tables,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    detector: str | Detector | None = None,
    model: DataFrame | str | None = None,
    summarize: Summarizer = summarize_static,
    trigger: dict | None = None,
    first_batch: int = 0,
    send: Sender | None = None,
    after_crash: str = "resend",
) -> StreamingQuery:
    """The part of ``run_stream`` after decoding: a stream of valid, unique events."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if REPLAYED in batch.columns:
            batch = batch.filter(~F.col(REPLAYED))
            if batch_id == 0:
                # where a copy and its replayed id came in one batch, either may be the one that is left
                known = batch.sparkSession.read.schema("event_id string, batch_id bigint").parquet(tables.path("events"))
                batch = only_new(batch, known.filter(F.col("batch_id") < first_batch))
        process_batch(batch, batch_id + first_batch, tables, settings, detector, model, summarize, first_batch, send, after_crash)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_answers(answers: DataFrame, tables: Tables, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A summariser's late answers to the answers table, from which ``revised_incidents`` reads.

    ``answers`` has incident_id, answer (JSON text), provider and answered_at, and ``ok`` if it likes.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        refuse_other_run(batch.sparkSession, tables.path("answers"), batch_id)
        write_answers(decode_answers(batch), tables.path("answers"), batch_id)

    writer = answers.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_dead_letters(
    records: DataFrame, tables: Tables, checkpoint: str, settings: Settings = DEFAULTS, trigger: dict | None = None
) -> StreamingQuery:
    """Rejected records of the event topic to the dead-letter table, with their reason."""
    _, rejected = split_valid(decode_events(records, settings))
    return _store_dead_letters(rejected, "reject_reason", tables, checkpoint, trigger)


def run_dead_letter_topic(
    records: DataFrame, tables: Tables, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Records of a dead-letter topic to the dead-letter table, with the reason their headers give."""
    return _store_dead_letters(records, None, tables, checkpoint, trigger)


def _store_dead_letters(
    records: DataFrame, reason: str | None, tables: Tables, checkpoint: str, trigger: dict | None
) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_dead_letters(dead_letter_rows(batch, reason), tables.path("dead_letters"), batch_id)
        stored = batch.sparkSession.read.schema(DEAD_LETTERS).parquet(f"{tables.path('dead_letters')}/batch_id={batch_id}")
        write_dead_letter_panes(stored, tables.path("dead_letter_panes"), batch_id)

    writer = records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
