"""One query per operator over the given tables, each a function of (spark, folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobvigil.config import FOREST, Settings
from jobvigil.functions import headers, identity, scores
from jobvigil.operators import dedupe, detect, forest, incidents, metrics, monitor, notify
from jobvigil.operators.decode import completed_runs, decode_events, first_delivery, split_valid, unusable_runs
from jobvigil.operators.ewma import ewma
from jobvigil.plans.flow import Tables, find_incidents, incidents_from_records, load_forest, replay, revised_incidents, scored_runs, train_forest
from jobvigil.schema import BATCH_MODELS, DEAD_LETTER_PANES, DEAD_LETTERS, DELIVERIES, EVENT_PANES, EVENTS, INCIDENTS, OUTBOX
from jobvigil.session import ensure_checkpoint_dir
from jobvigil.sinks.tables import dead_letter_rows, write_answers, write_dead_letter_panes, write_incidents, write_metrics_state, write_panes
from jobvigil.sinks.topics import DEAD_LETTER_TOPIC, event_records, incident_records, publish_events
from jobvigil.sources.samples import broken_deliveries, contradicting_deliveries, deliveries, runs_from_events
from jobvigil.sources.tables import metrics_for, read_dead_letters, read_event_array, read_events, read_metrics_state, read_table
from jobvigil.streaming import stream

# The tables' values spike less than real run times; a lower threshold finds more of them.
SENSITIVE = Settings(ewma_threshold=2.5)
# The source event types that become finished runs.
FINISHED = ("purchase", "signup", "error")
MIDDLE = "2024-01-16"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name, with times in UTC."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from_events(table(spark, sf_dir, "events"))


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only events that end a run; the condition is on the source column, so the scan skips the rest."""
    return runs_from_events(table(spark, sf_dir, "events").filter(F.col("event_type").isin(*FINISHED)))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(event_records(all_events(spark, sf_dir)))


def stamp(column: str) -> Column:
    """Timestamps as text, alike in every engine."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def steady(column: str | Column, digits: int) -> Column:
    """Round by way of decimals: halves away from zero, float noise cut first."""
    exact = (F.col(column) if isinstance(column, str) else column).cast("decimal(28,10)")
    return F.round(exact, digits).cast("double")


def pick(df: DataFrame, *columns: str, stamps: Iterable[str] = (), rounds: dict[str, int] | None = None) -> DataFrame:
    """Select columns; times as text, doubles rounded."""
    digits = rounds or {}
    out = []
    for c in columns:
        if c in stamps:
            out.append(stamp(c))
        elif c in digits:
            out.append(steady(c, digits[c]).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


EVENT = (
    "event_id", "schema_version", "job_type", "ts", "event_type", "run_id", "source_file", "expected_rows",
    "rows_so_far", "progress_percent", "rows_processed", "duration_seconds", "error_count", "error_code",
    "error_message", "retry_count",
)
STATE = ("job_type", "run_count", "sum_duration_seconds", "sum_error_count", "sum_rows", "updated_at")
SUMS = {"sum_duration_seconds": 4}


# --- records, decoding, dead letters -------------------------------------------------

@query
def published_events(spark, sf_dir):
    return event_records(all_events(spark, sf_dir)).select("event_id", "key", "value")


@query
def decoded_events(spark, sf_dir):
    valid, _ = split_valid(decode_events(records(spark, sf_dir)))
    return pick(valid, *EVENT, stamps=["ts"])


@query
def rejected_records(spark, sf_dir):
    _, rejected = split_valid(decode_events(records(spark, sf_dir)))
    return pick(rejected, "value", "timestamp", "reject_reason", stamps=["timestamp"])


@query
def dead_letters_of_rejects(spark, sf_dir):
    _, rejected = split_valid(decode_events(records(spark, sf_dir)))
    return pick(dead_letter_rows(rejected, "reject_reason"), *DEAD_LETTERS.names, stamps=["failed_at"])


@query
def dead_letters_of_topic(spark, sf_dir):
    rows = dead_letter_rows(records(spark, sf_dir))
    return pick(rows.withColumn("payload_hash", F.sha2("raw_payload", 256)),
                "event_id", "payload_hash", "error", "retry_count", "failed_at", stamps=["failed_at"])


@query
def dead_letter_depth(spark, sf_dir):
    _, rejected = split_valid(decode_events(records(spark, sf_dir)))
    return monitor.dead_letter_depth(rejected)


@query
def dead_letters_of_every_kind(spark, sf_dir):
    _, rejected = split_valid(decode_events(broken_deliveries(event_records(all_events(spark, sf_dir)))))
    records_by = rejected.groupBy(F.col("reject_reason").alias("error")).agg(F.count("*").alias("records"))
    dead = dead_letter_rows(rejected, "reject_reason").where("failed_at is not null")
    return records_by.join(dead.groupBy("error").agg(F.count_distinct("event_id").alias("dead_letters")), "error", "left")


# --- through the readers and writers -------------------------------------------------------

def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


@query
def events_read_back(spark, sf_dir):
    folder = _folder(spark)
    publish_events(all_events(spark, sf_dir), folder)
    valid, _ = split_valid(decode_events(read_events(spark, f"{folder}/batch.events.v1")))
    return pick(valid, *EVENT, stamps=["ts"])


@query
def event_arrays_read_back(spark, sf_dir):
    sent = event_records(all_events(spark, sf_dir))
    # a document per 200 ids, so that none grows with the table
    documents = sent.groupBy(F.floor(F.col("event_id").cast("long") / 200)).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    folder = _folder(spark)
    documents.select("value").write.option("lineSep", "\n").text(folder)
    lines = spark.read.text(folder)
    # a file of several documents is read line by line, a file per document as a whole
    apart = f"{folder}-apart"
    lines.repartition(8).write.option("maxRecordsPerFile", 1).text(apart)
    valid, _ = split_valid(decode_events(read_event_array(spark, apart)))
    return pick(valid, *EVENT, stamps=["ts"])


@query
def event_arrays_with_rubbish(spark, sf_dir):
    """Documents with numbers, texts, nulls, arrays and broken objects among their events, every second one cut off."""
    sent = event_records(all_events(spark, sf_dir))
    rubbish = F.lit(',7,"text",null,[1, 2],{"a" 1},').alias("rubbish")
    documents = sent.groupBy(F.floor(F.col("event_id").cast("long") / 200).alias("number")).agg(F.array_join(F.collect_list("value"), ", ").alias("events"))
    end = F.when(F.col("number") % 2 == 0, '{"eventId":"cut').otherwise('"end"]')
    folder = _folder(spark)
    documents.select(F.concat(F.lit("["), F.col("events"), rubbish, end).alias("value")).repartition(8).write.option("maxRecordsPerFile", 1).text(folder)
    valid, rejected = split_valid(decode_events(read_event_array(spark, folder)))
    none = F.lit(None).cast("string")
    bad = rejected.groupBy("value", "reject_reason").agg(F.count("*").alias("records"), F.count_distinct("topic", "offset").alias("places"))
    good = valid.groupBy("event_id").agg(F.count("*").alias("records")).select("event_id", none.alias("value"), none.alias("reject_reason"), "records", F.col("records").alias("places"))
    return good.unionByName(bad.withColumn("event_id", none))


@query
def dead_letters_read_back(spark, sf_dir):
    folder = _folder(spark)
    records(spark, sf_dir).filter(headers.dead_letter_error(F.col("headers")) != "unknown").write.parquet(f"{folder}/{DEAD_LETTER_TOPIC}")
    found = read_dead_letters(spark, f"{folder}/{DEAD_LETTER_TOPIC}")
    return found.select("value", headers.dead_letter_error(F.col("headers")).alias("error"), headers.retry_count(F.col("headers")).alias("retry_count"), stamp("timestamp"))


@query
def metrics_state_read_back(spark, sf_dir):
    folder = _folder(spark)
    early, late = (metrics.metrics_state(finished(spark, sf_dir).filter(c)) for c in (F.col("ts") < F.lit(MIDDLE).cast("timestamp"), F.col("ts") >= F.lit(MIDDLE).cast("timestamp")))
    write_metrics_state(early, folder, 0)
    write_metrics_state(metrics.merge_metrics(read_metrics_state(spark, folder), late), folder, 1)
    return pick(read_metrics_state(spark, folder), *STATE, stamps=["updated_at"], rounds=SUMS)


@query
def next_attempt_headers(spark, sf_dir):
    found = headers.retry_count(F.col("headers"))
    stamped = records(spark, sf_dir).withColumn("stamped", headers.set_retry_count(F.col("headers"), found + 1))
    return stamped.select(
        F.sha2("value", 256).alias("value_hash"),
        found.alias("retry_count"),
        headers.retry_count(F.col("stamped")).alias("next_count"),
        F.size("stamped").alias("header_count"),
        headers.dead_letter_error(F.col("stamped")).alias("error"),
    )


@query
def completed_events(spark, sf_dir):
    return pick(completed_runs(all_events(spark, sf_dir)), *EVENT, stamps=["ts"])


# --- duplicates ------------------------------------------------------------------------

@query
def unique_events(spark, sf_dir):
    valid, _ = split_valid(decode_events(records(spark, sf_dir)))
    return pick(dedupe.dedupe(valid, "event_id", first_delivery(valid)), *EVENT, stamps=["ts"])


@query
def unique_events_of_copies(spark, sf_dir):
    sent = contradicting_deliveries(event_records(all_events(spark, sf_dir)))
    valid, _ = split_valid(decode_events(sent))
    return pick(dedupe.dedupe(valid, "event_id", first_delivery(valid)), *EVENT, stamps=["ts"])


@query
def unique_users_per_day(spark, sf_dir):
    kept = dedupe.dedupe_ttl(table(spark, sf_dir, "events"), "user_id", "ts", "24 hours", ["event_id"])
    return pick(kept, "event_id", "user_id", "ts", "event_type", "value", "props", stamps=["ts"])


@query
def events_accepted_again(spark, sf_dir):
    """Three job types as ids, so three hot ones: a delivery counts once in six hours."""
    sent = all_events(spark, sf_dir)
    kept = dedupe.dedupe_ttl(sent, "job_type", "ts", "6 hours", ["event_id"])
    return pick(kept, "event_id", "job_type", "ts", stamps=["ts"])


@query
def delivery_uniqueness(spark, sf_dir):
    valid, _ = split_valid(decode_events(records(spark, sf_dir)))
    return dedupe.dedupe_stats(valid)


@query
def events_not_seen_before(spark, sf_dir):
    events = all_events(spark, sf_dir)
    seen = events.filter((F.col("ts") < F.lit(MIDDLE).cast("timestamp")) | (F.col("event_type") == "JOB_FAILED"))
    return pick(dedupe.only_new(events, seen), "event_id", "job_type", "ts", stamps=["ts"])


# --- aggregates ------------------------------------------------------------------------

@query
def metric_deltas(spark, sf_dir):
    return metrics.metric_deltas(finished(spark, sf_dir)).select("event_id", "job_type", *metrics.DELTAS)


@query
def metrics_state(spark, sf_dir):
    state = metrics.with_rates(metrics.metrics_state(finished(spark, sf_dir)))
    return pick(state, *STATE, "mean_duration_seconds", "error_rate", stamps=["updated_at"],
                rounds={**SUMS, "mean_duration_seconds": 6, "error_rate": 9})


@query
def runs_without_numbers(spark, sf_dir):
    last = F.col("event_id").cast("long") % 5
    odd = F.when(last == 0, F.lit(None)).when(last == 1, float("nan")).when(last == 2, float("inf")).otherwise(F.col("duration_seconds"))
    runs = finished(spark, sf_dir).withColumn("duration_seconds", odd)
    counted = lambda frame, name: frame.groupBy("job_type").agg(F.count("*").alias(name))
    state = metrics.metrics_state(runs).select("job_type", F.col("run_count").alias("state_runs"))
    return state.join(counted(scored_runs(runs), "scored_runs"), "job_type").join(counted(unusable_runs(runs), "rejects"), "job_type")


@query
def metrics_state_lookup(spark, sf_dir):
    state = metrics_for(metrics.metrics_state(finished(spark, sf_dir)), "CLAIMS_INGEST")
    return pick(state, *STATE, stamps=["updated_at"], rounds=SUMS)


@query
def metrics_state_daily(spark, sf_dir):
    state = metrics.metrics_state_by_bucket(finished(spark, sf_dir), "1 day")
    return pick(state, "bucket", *STATE, stamps=["bucket", "updated_at"], rounds=SUMS)


@query
def metrics_state_merged(spark, sf_dir):
    events = finished(spark, sf_dir)
    early = F.col("ts") < F.lit(MIDDLE).cast("timestamp")
    merged = metrics.merge_metrics(
        metrics.metrics_state(events.filter(early)), metrics.metrics_state(events.filter(~early))
    )
    return pick(merged, *STATE, stamps=["updated_at"], rounds=SUMS)


@query
def events_processed(spark, sf_dir):
    return metrics.events_processed(all_events(spark, sf_dir))


@query
def duration_stats(spark, sf_dir):
    return metrics.duration_stats(finished(spark, sf_dir))


@query
def latest_error_rate(spark, sf_dir):
    return pick(metrics.latest_error_rate(finished(spark, sf_dir)), "job_type", "error_rate", rounds={"error_rate": 9})


@query
def latest_anomaly_score(spark, sf_dir):
    return pick(metrics.latest_score(scored_runs(finished(spark, sf_dir))), "job_type", "score", rounds={"score": 6})


# --- ordered scans ---------------------------------------------------------------------

@query
def running_metrics(spark, sf_dir):
    running = metrics.running_metrics(finished(spark, sf_dir))
    return pick(running, "event_id", "job_type", "running_count", "running_duration_seconds", "running_error_count",
                "running_rows", "rolling_mean_duration", "rolling_error_rate",
                rounds={"running_duration_seconds": 4, "rolling_mean_duration": 6, "rolling_error_rate": 9})


@query
def feature_vectors(spark, sf_dir):
    features = metrics.feature_vectors(metrics.running_metrics(finished(spark, sf_dir)))
    return pick(features, "event_id", "job_type", "duration_seconds", "rolling_mean_duration", "error_rate",
                "row_count", "hour_of_day", "day_of_week", rounds={"rolling_mean_duration": 6, "error_rate": 9})


@query
def duration_ewma(spark, sf_dir):
    runs = completed_runs(finished(spark, sf_dir)).select("job_type", "ts", "event_id", "duration_seconds")
    smooth = ewma(runs, "duration_seconds", "job_type", metrics.ORDER)
    return pick(smooth, "event_id", "job_type", "observation", "mu", "sigma", "z",
                rounds={"mu": 6, "sigma": 6, "z": 6})


@query
def supplier_quantity_ewma(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"
    )
    smooth = ewma(items, "l_quantity", "l_suppkey", ("l_shipdate", "l_orderkey", "l_linenumber"))
    return pick(smooth, "l_suppkey", "l_orderkey", "l_linenumber", "observation", "mu", "sigma", "z",
                rounds={"mu": 6, "sigma": 6, "z": 6})


# --- detectors -------------------------------------------------------------------------

@query
def ewma_verdicts(spark, sf_dir):
    scored = scored_runs(finished(spark, sf_dir), SENSITIVE)
    return pick(scored, "event_id", "job_type", "score", "anomalous", "reason", "detector_name", rounds={"score": 6})


@query
def fallback_verdicts(spark, sf_dir):
    scored = scored_runs(finished(spark, sf_dir), SENSITIVE, FOREST)
    return pick(scored, "event_id", "job_type", "score", "anomalous", "reason", "detector_name", rounds={"score": 6})


def long_runs(features: DataFrame) -> DataFrame:
    """A detector of the caller's own: how often the rolling mean fits into the run time."""
    ratio = scores.safe_ratio(F.col("duration_seconds"), F.col("rolling_mean_duration"))
    return features.withColumns({
        "score": ratio,
        "anomalous": ratio > 3,
        "reason": F.format_string("rows=%d", F.col("row_count")),
        "detector_name": F.lit("long-runs"),
    })


@query
def custom_verdicts(spark, sf_dir):
    scored = scored_runs(finished(spark, sf_dir), detector=long_runs)
    return pick(scored, "event_id", "score", "anomalous", "reason", "detector_name", rounds={"score": 6})


@query
def training_history(spark, sf_dir):
    features = metrics.feature_vectors(metrics.running_metrics(finished(spark, sf_dir)))
    return _spread(forest.training_matrix(features))


@query
def training_state(spark, sf_dir):
    return _spread(forest.training_matrix(metrics.metrics_state(finished(spark, sf_dir)), "state"))


def _spread(matrix: DataFrame) -> DataFrame:
    return matrix.select(
        "row_key", *[steady(F.col("features")[i], 6).alias(name) for i, name in enumerate(forest.FEATURES)]
    )


@query
def refit_window(spark, sf_dir):
    recent = forest.last_days(completed_runs(finished(spark, sf_dir)), 7)
    return pick(recent, "event_id", "ts", stamps=["ts"])


@query
def fit_gate(spark, sf_dir):
    state = metrics.metrics_state(finished(spark, sf_dir))
    daily = metrics.metrics_state_by_bucket(finished(spark, sf_dir), "1 day")
    outcome = [
        (name, forest.enough_rows(forest.training_matrix(rows, "state"))) for name, rows in
        (("per job type", state), ("per job type and day", daily))
    ]
    return spark.createDataFrame(outcome, "source string, enough boolean")


@query
def forest_model(spark, sf_dir):
    features = metrics.feature_vectors(metrics.running_metrics(finished(spark, sf_dir)))
    return forest.fit_forest(forest.training_matrix(features))


@query
def forest_verdicts(spark, sf_dir):
    events = finished(spark, sf_dir)
    features = detect.observed_features(events)
    model = forest.fit_or_none(forest.training_matrix(features))
    scored = detect.score(features, FOREST, model)
    return pick(scored, "event_id", "job_type", "score", "anomalous", "reason", "detector_name", rounds={"score": 6})


@query
def forest_shape(spark, sf_dir):
    """What must hold for every tree, whatever it cuts: its draw, its nodes, its depth."""
    features = metrics.feature_vectors(metrics.running_metrics(finished(spark, sf_dir)))
    nodes = forest.fit_forest(forest.training_matrix(features)).checkpoint()
    inner = F.col("left").isNotNull()
    children = nodes.filter(inner).select("tree", F.explode(F.array("left", "right")).alias("node")).withColumn("parents", F.lit(1))
    placed = nodes.join(children.groupBy("tree", "node").agg(F.sum("parents").alias("parents")), ["tree", "node"], "left")
    root = F.col("node") == 0
    one_parent = F.when(root, F.col("parents").isNull()).otherwise(F.coalesce(F.col("parents") == 1, F.lit(False)))
    whole = F.when(inner, F.col("normal").isNotNull() & F.col("offset").isNotNull() & (F.col("left") > F.col("node"))).otherwise(F.col("path_length") >= 0)
    return placed.groupBy("tree").agg(
        F.max("sample_size").alias("sample_size"), (F.count(F.when(~inner, 1)) - F.count(F.when(inner, 1))).alias("leaves_over_inner"),
        F.min(one_parent).alias("one_parent_each"), F.min(whole).alias("nodes_whole"), (F.count("*") <= 2 * F.max("sample_size") - 1).alias("within_bound"),
    )


@query
def forest_draws(spark, sf_dir):
    """How many rows each tree draws, and that none is drawn twice for one tree."""
    features = metrics.feature_vectors(metrics.running_metrics(finished(spark, sf_dir)))
    drawn = forest.draw_samples(forest.training_matrix(features), 40, 64, 7)
    return drawn.groupBy("tree").agg(F.count("*").alias("drawn"), F.count_distinct("row_key").alias("keys"))


@query
def forest_verdict_rules(spark, sf_dir):
    """What must hold for every verdict of a forest: its score, threshold, text and name."""
    features = detect.observed_features(finished(spark, sf_dir))
    scored = detect.score(features, FOREST, forest.fit_or_none(forest.training_matrix(features)))
    said = F.format_string("isolation-forest score=%.4f (threshold=%.2f)", F.col("score"), F.lit(0.65))
    return scored.groupBy("job_type", "detector_name").agg(
        F.count("*").alias("runs"), F.count(F.when((F.col("score") > 0) & (F.col("score") < 1), 1)).alias("scores_in_range"),
        F.count(F.when(F.col("anomalous") == (F.col("score") > 0.65), 1)).alias("verdicts_by_threshold"), F.count(F.when(F.col("reason") == said, 1)).alias("reasons"),
    )


# --- incidents -------------------------------------------------------------------------

INCIDENT = (
    "incident_id", "schema_version", "job_type", "anomaly_score", "detector_name", "fingerprint", "severity",
    "likely_cause", "suggested_actions", "llm_unavailable", "detected_at", "llm_provider",
)


def _incident_view(found: DataFrame, *more: str) -> DataFrame:
    joined = found.withColumn("suggested_actions", F.array_join("suggested_actions", "; "))
    return pick(joined, *INCIDENT, *more, stamps=["detected_at"], rounds={"anomaly_score": 6})


@query
def anomalous_runs(spark, sf_dir):
    found = detect.anomalies(scored_runs(finished(spark, sf_dir), SENSITIVE))
    return pick(found, "event_id", "job_type", "duration_seconds", "score", rounds={"score": 6})


@query
def incidents_default_threshold(spark, sf_dir):
    return _incident_view(find_incidents(finished(spark, sf_dir)))


@query
def incidents_of_records(spark, sf_dir):
    return _incident_view(incidents_from_records(records(spark, sf_dir), SENSITIVE))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every completed run reported as if anomalous, with stable decimals for texts."""
    scored = scored_runs(finished(spark, sf_dir), detector=FOREST)
    rounded = scored.withColumns({
        "score": steady("score", 8),
        "error_rate": steady("error_rate", 8),
        "rolling_mean_duration": steady("rolling_mean_duration", 6),
    })
    return incidents.to_incidents(rounded)


@query
def run_fingerprints(spark, sf_dir):
    events = all_events(spark, sf_dir)
    return events.select(
        "event_id",
        *[identity.fingerprint(F.col("job_type"), F.lit(level), F.col("ts")).alias(f"{level.lower()}_fingerprint")
          for level in ("LOW", "MEDIUM", "HIGH")],
        scores.hour_utc(F.col("ts")).alias("hour_of_day"),
        scores.iso_dow(F.col("ts")).alias("day_of_week"),
    )


@query
def severity_bands(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    graded = items.select(
        scores.severity(F.col("l_quantity") / 7, F.lit("ewma")).alias("by_zscore"),
        scores.severity(F.col("l_discount") * 10, F.lit(FOREST)).alias("by_unit"),
    )
    return graded.groupBy("by_zscore", "by_unit").agg(F.count(F.lit(1)).alias("items"))


@query
def incident_prompts(spark, sf_dir):
    prompted = incidents.with_prompt(_reports(spark, sf_dir))
    return prompted.select("incident_id", "prompt", F.length("system_text").alias("system_length"))


@query
def static_summaries(spark, sf_dir):
    reports = _reports(spark, sf_dir).withColumn("rolling_mean_duration", steady("rolling_mean_duration", 2))
    made = incidents.static_summary(reports)
    return made.select("incident_id", "summary", "likely_cause",
                       F.array_join("suggested_actions", "; ").alias("suggested_actions"), "provider", "ok")


def _answers(reports: DataFrame) -> DataFrame:
    """Answers in all the shapes a summariser may return, chosen by the run's hour."""
    hour = F.hour("detected_at") % 6
    return reports.select(
        "incident_id",
        F.when(hour == 0, F.concat(F.lit('{"summary":"run '), F.col("event_id"), F.lit(
            ' slow","likelyCause":"load","severity":"HIGH","suggestedActions":["check","retry"]}')))
        .when(hour == 1, F.concat(F.lit('```json\n{"summary":"fenced '), F.col("event_id"), F.lit('"}\n```')))
        .when(hour == 2, F.lit('{"summary":"x","severity":"URGENT"}'))
        .when(hour == 3, F.concat(F.lit("not json "), F.col("event_id")))
        .when(hour == 4, F.lit('{"summary":"never read"}')).alias("answer"),
        F.lit("remote").alias("provider"),
        (hour != 4).alias("ok"),
    )


@query
def decoded_answers(spark, sf_dir):
    read = incidents.decode_answers(_answers(_reports(spark, sf_dir)))
    return read.select("incident_id", "summary", "likely_cause",
                       F.array_join("suggested_actions", "; ").alias("suggested_actions"), "ok")


@query
def enriched_incidents(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    answered = incidents.enrich(reports, incidents.decode_answers(_answers(reports)))
    return _incident_view(answered, "summary")


def _late_answers(reports: DataFrame, version: int) -> DataFrame:
    """Answers of three rounds: in all shapes, better ones for some hours, and useless ones at the end."""
    hour, when = F.hour("detected_at") % 6, (F.col("detected_at") + F.expr(f"INTERVAL {version + 1} HOURS")).alias("answered_at")
    if version == 0:
        return incidents.decode_answers(_answers(reports).join(reports.select("incident_id", when), "incident_id"))
    better = F.concat(F.lit('{"summary":"later '), F.col("event_id"), F.lit('","likelyCause":"queue","suggestedActions":["wait"]}'))
    text, hours = (better, (0, 2, 5)) if version == 1 else (F.lit("not json"), (0, 1))
    return incidents.decode_answers(reports.where(hour.isin(*hours)).select("incident_id", when, text.alias("answer"), F.lit("late").alias("provider")))


@query
def late_summaries(spark, sf_dir):
    """Incidents stored without a summary, revised by answers that arrive in three batches out of order, one of them twice."""
    tables = _new_tables(spark)
    reports = _reports(spark, sf_dir).checkpoint()
    write_incidents(incidents.enrich(reports, incidents.static_summary(reports.limit(0))), tables.path("incidents"))
    for batch_id, version in ((0, 1), (1, 2), (2, 0), (0, 1)):
        write_answers(_late_answers(reports, version), tables.path("answers"), batch_id)
    return _incident_view(revised_incidents(spark, tables), "summary")


def volume_summary(batch: pd.DataFrame) -> pd.DataFrame:
    """A summariser of the caller's own."""
    return pd.DataFrame({
        "summary": batch["job_type"] + " read " + batch["row_count"].astype(str) + " rows",
        "likely_cause": batch["detector_name"],
        "suggested_actions": [["look"]] * len(batch),
    })


@query
def custom_summaries(spark, sf_dir):
    made = incidents.summarize_with(_reports(spark, sf_dir), volume_summary, "volume")
    return made.select("incident_id", "summary", "likely_cause",
                       F.array_join("suggested_actions", "; ").alias("suggested_actions"), "provider", "ok")


@query
def incident_messages(spark, sf_dir):
    found = find_incidents(finished(spark, sf_dir), SENSITIVE).withColumns({
        "anomaly_score": steady("anomaly_score", 4), "summary": F.lit(None).cast("string"),
    })
    return incident_records(found)


# --- notifications ---------------------------------------------------------------------

@query
def notifications_once(spark, sf_dir):
    once = notify.notify_dedupe(_reports(spark, sf_dir))
    return pick(once, "fingerprint", "incident_id", "severity", "detected_at", stamps=["detected_at"])


@query
def undelivered_notifications(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    sent = reports.select("fingerprint", (F.col("job_type") == "POLICY_RENEWAL").alias("ok"))
    left = notify.undelivered(reports, sent)
    return pick(left, "fingerprint", "incident_id", "job_type", "detected_at", stamps=["detected_at"])


@query
def notification_payloads(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    full = incidents.enrich(reports, incidents.decode_answers(_answers(reports)))
    return notify.with_payload(full).select("incident_id", "payload")


# --- monitoring ------------------------------------------------------------------------

@query
def throughput(spark, sf_dir):
    rates = monitor.throughput(all_events(spark, sf_dir))
    return pick(rates, "job_type", "event_type", "window_start", "events", "per_second",
                stamps=["window_start"], rounds={"per_second": 6})


@query
def dead_letter_rate(spark, sf_dir):
    _, rejected = split_valid(decode_events(records(spark, sf_dir)))
    rates = monitor.dead_letter_rate(dead_letter_rows(rejected, "reject_reason"))
    return pick(rates, "window_start", "events", "per_second", stamps=["window_start"], rounds={"per_second": 6})


@query
def duration_p95(spark, sf_dir):
    return pick(monitor.duration_p95(finished(spark, sf_dir)), "job_type", "window_start", "runs", "p95_seconds",
                stamps=["window_start"])


def _panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as panes stored in four batches, one of them tried twice; each pane has rows of several batches."""
    path, events = _folder(spark), all_events(spark, sf_dir)
    for batch_id in (0, 1, 2, 1, 3):
        write_panes(events.filter(F.col("event_id").cast("long") % 4 == batch_id), path, batch_id)
    return read_table(spark, path, EVENT_PANES)


@query
def throughput_of_panes(spark, sf_dir):
    rates = monitor.throughput_of_panes(_panes(spark, sf_dir))
    return pick(rates, "job_type", "event_type", "window_start", "events", "per_second",
                stamps=["window_start"], rounds={"per_second": 6})


@query
def duration_p95_of_panes(spark, sf_dir):
    return pick(monitor.duration_p95_of_panes(_panes(spark, sf_dir)), "job_type", "window_start", "runs", "p95_seconds",
                stamps=["window_start"])


@query
def dead_letter_rate_of_panes(spark, sf_dir):
    """Dead letters stored by pane in three batches, one of them tried twice."""
    _, rejected = split_valid(decode_events(records(spark, sf_dir)))
    dead, path = dead_letter_rows(rejected, "reject_reason").checkpoint(), _folder(spark)
    for batch_id in (2, 0, 1, 0):
        write_dead_letter_panes(dead.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch_id), path, batch_id)
    rates = monitor.dead_letter_rate_of_panes(read_table(spark, path, DEAD_LETTER_PANES))
    return pick(rates, "window_start", "events", "per_second", stamps=["window_start"], rounds={"per_second": 6})


@query
def incidents_by_severity(spark, sf_dir):
    return monitor.incidents_by_severity(_reports(spark, sf_dir))


@query
def recent_incidents(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    newest = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return monitor.recent_incidents(reports, newest, "12 hours")


@query
def incident_windows(spark, sf_dir):
    return pick(monitor.incident_windows(_reports(spark, sf_dir)), "window_start", "low", "medium", "high",
                stamps=["window_start"])


@query
def summary_latency(spark, sf_dir):
    calls = finished(spark, sf_dir).filter(F.col("event_type") == "JOB_COMPLETED").select(
        F.col("ts").alias("summarized_at"), (F.col("duration_seconds") / 100).alias("latency_seconds")
    )
    return pick(monitor.summary_latency(calls), "window_start", "mean_latency", "max_latency",
                stamps=["window_start"], rounds={"mean_latency": 6, "max_latency": 6})


@query
def error_rate_stats(spark, sf_dir):
    series = metrics.error_rate_series(finished(spark, sf_dir))
    return pick(monitor.series_stats(series, "error_rate"), "job_type", "mean_error_rate", "max_error_rate",
                rounds={"mean_error_rate": 9, "max_error_rate": 9})


@query
def anomaly_score_stats(spark, sf_dir):
    series = scored_runs(finished(spark, sf_dir))
    return pick(monitor.series_stats(series, "score"), "job_type", "mean_score", "max_score",
                rounds={"mean_score": 6, "max_score": 6})


@query
def status_bands(spark, sf_dir):
    scored = scored_runs(finished(spark, sf_dir))
    coloured = scored.select(
        "job_type",
        scores.status_band(F.col("score"), scores.SCORE_BANDS).alias("score_colour"),
        scores.status_band(F.col("error_rate"), scores.ERROR_RATE_BANDS).alias("error_colour"),
    )
    return coloured.groupBy("job_type", "score_colour", "error_colour").agg(F.count(F.lit(1)).alias("runs"))


@query
def incident_bands(spark, sf_dir):
    """Incidents of each job type and hour, with the colour of their number."""
    hours = _reports(spark, sf_dir).groupBy("job_type", F.date_trunc("hour", "detected_at").alias("window_start")).agg(F.count(F.lit(1)).alias("incidents"))
    coloured = hours.withColumn("colour", scores.status_band(F.col("incidents"), scores.INCIDENT_BANDS))
    return pick(coloured, "job_type", "window_start", "incidents", "colour", stamps=["window_start"])


@query
def latency_bands(spark, sf_dir):
    """Windows of each colour of the mean and the greatest latency."""
    windows = summary_latency(spark, sf_dir)
    coloured = windows.select(
        scores.status_band(F.col("mean_latency"), scores.LATENCY_BANDS).alias("mean_colour"),
        scores.status_band(F.col("max_latency"), scores.LATENCY_BANDS).alias("max_colour"),
    )
    return coloured.groupBy("mean_colour", "max_colour").agg(F.count(F.lit(1)).alias("windows"))


# --- streams ---------------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _new_tables(spark: SparkSession) -> Tables:
    return Tables(f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}")


def _record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(event_records(runs_from_events(_event_stream(spark, sf_dir))))


# Records in one file of a made topic, which one task writes and one reads.
FILE_ROWS = 50_000


def _files(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


def _write_topic(events: DataFrame, path: str, files: int) -> None:
    """The records of ``events``, a part of the source table, as a folder of exactly so many files; each task makes the text of its own rows."""
    dealt = events.coalesce(1) if files == 1 else events.repartition(files, "event_id")
    sent = event_records(runs_from_events(dealt)).select("key", "value", F.col("ts").alias("timestamp"))
    sent.write.parquet(path)
    # a task without rows writes no file
    for _ in range(files - len(events.sparkSession.read.parquet(path).inputFiles())):
        sent.limit(0).coalesce(1).write.mode("append").parquet(path)


@query
def streamed_incidents(spark, sf_dir):
    tables = _new_tables(spark)
    stream.run_stream(_record_stream(spark, sf_dir), tables, tables.path("progress"), SENSITIVE).awaitTermination()
    return _incident_view(read_table(spark, tables.path("incidents"), INCIDENTS, "incident_id"))


@query
def streamed_dead_letters(spark, sf_dir):
    tables = _new_tables(spark)
    stream.run_dead_letters(_record_stream(spark, sf_dir), tables, tables.path("progress")).awaitTermination()
    stored = read_table(spark, tables.path("dead_letters"), DEAD_LETTERS, "event_id")
    return pick(stored, *DEAD_LETTERS.names, stamps=["failed_at"])


@query
def streamed_late_events(spark, sf_dir):
    """Days-late and far-future events over several micro-batches; none may go missing or hold others back."""
    tables = _new_tables(spark)
    events = all_events(spark, sf_dir)
    last = F.col("event_id").cast("long") % 10
    moved = F.when(last == 0, F.col("ts") + F.expr("INTERVAL 900 YEARS")).when(last == 1, F.col("ts") - F.expr("INTERVAL 30 DAYS")).otherwise(F.col("ts"))
    sent = deliveries(event_records(events.withColumn("ts", moved)))
    # four groups of files by id, so that every micro-batch has events of all kinds and copies of its own
    files = _files(table(spark, sf_dir, "events").count() // 4)
    sent.repartition(4 * files, F.pmod(F.xxhash64("value"), F.lit(64 * files))).write.parquet(tables.path("sent"))
    live = read_events(spark, tables.path("sent"), streaming=True, files_per_trigger=files)
    stream.run_stream(live, tables, tables.path("progress"), SENSITIVE).awaitTermination()
    return pick(read_table(spark, tables.path("events"), EVENTS), "event_id", "ts", stamps=["ts"])


@query
def replayed_incidents(spark, sf_dir):
    """Two replays from the start into the same tables, which leave them as one does."""
    tables = _new_tables(spark)
    for _ in range(2):
        replay(spark, records(spark, sf_dir), tables, SENSITIVE)
    return _incident_view(read_table(spark, tables.path("incidents"), INCIDENTS))


@query
def resumed_incidents(spark, sf_dir):
    """The first half of the deliveries as a replay, the second as a stream that goes on from its state."""
    tables, sent, middle = _new_tables(spark), records(spark, sf_dir), F.lit(MIDDLE).cast("timestamp")
    replay(spark, sent.filter(F.col("timestamp") < middle), tables, SENSITIVE)
    # without a limit of files, the stream takes all of them in one micro-batch
    sent.filter(F.col("timestamp") >= middle).write.parquet(tables.path("sent"))
    live = read_events(spark, tables.path("sent"), streaming=True)
    stream.run_stream(live, tables, tables.path("progress"), SENSITIVE, first_batch=1).awaitTermination()
    return _incident_view(read_table(spark, tables.path("incidents"), INCIDENTS))


# More of the runs, so that fingerprints come again in later batches.
LIVELY = Settings(ewma_threshold=1.5)
BATCHES = 6


def _run_in_batches(spark: SparkSession, sf_dir: str, tables: Tables, settings: Settings, **options) -> None:
    """The events as a stream of ``BATCHES`` parts, one per micro-batch; each hour's events are in all of them.

    The stream takes the files in the order of their times, as many at a time as each part has.
    """
    events, part = table(spark, sf_dir, "events"), F.col("event_id") % BATCHES
    files = _files(max((r["count"] for r in events.groupBy(part).count().collect()), default=0))
    for i in range(BATCHES):
        _write_topic(events.filter(part == i), f"{tables.path('sent')}/part{i}", files)
    live = read_events(spark, f"{tables.path('sent')}/*", streaming=True, files_per_trigger=files)
    stream.run_stream(live, tables, tables.path("progress"), settings, **options).awaitTermination()


@query
def streamed_outbox(spark, sf_dir):
    """Messages over six micro-batches: one per fingerprint, in the first batch that has it."""
    tables = _new_tables(spark)
    _run_in_batches(spark, sf_dir, tables, LIVELY)
    sent = read_table(spark, tables.path("outbox"), OUTBOX)
    return pick(sent, "fingerprint", "incident_id", "batch_id", "detected_at", stamps=["detected_at"])


def every_third_fails(messages: DataFrame) -> DataFrame:
    """A sender of the caller's own, down in every third batch."""
    return messages.select("fingerprint", (F.col("batch_id") % 3 != 2).alias("ok"))


@query
def retried_deliveries(spark, sf_dir):
    """Deliveries that fail are tried with the fingerprint's next incident, those that went out are not repeated."""
    tables = _new_tables(spark)
    _run_in_batches(spark, sf_dir, tables, LIVELY, send=every_third_fails)
    sent = read_table(spark, tables.path("deliveries"), DELIVERIES)
    ok = F.col("outcome") == "ok"
    return sent.groupBy("fingerprint").agg(
        F.count(F.when(ok, 1)).alias("delivered"), F.count(F.when(~ok, 1)).alias("failures"),
        F.min(F.when(ok, F.col("batch_id"))).alias("batch_id"), F.min(F.when(ok, F.col("incident_id"))).alias("incident_id"),
    )


@query
def metrics_state_streamed(spark, sf_dir):
    """The state that a stream's last micro-batch left."""
    tables = _new_tables(spark)
    _run_in_batches(spark, sf_dir, tables, SENSITIVE)
    return pick(read_metrics_state(spark, tables.path("metrics_state")), *STATE, stamps=["updated_at"], rounds=SUMS)


@query
def refitted_stream(spark, sf_dir):
    """A stream whose forest is fitted, and fitted anew, while it runs; one of its batches is tried again later.

    Per version (-1: none yet) how many events it scored, whether it reported any, and how
    many incidents are not those that this version finds in them.
    """
    tables, settings = _new_tables(spark), Settings(detector=FOREST, forest_threshold=0.55, ewma_threshold=2.5)
    models, events = tables.path("models"), table(spark, sf_dir, "events")
    features = detect.observed_features(finished(spark, sf_dir)).checkpoint()
    files = _files(events.count() // 3)
    for part in range(3):
        _write_topic(events.filter(F.col("event_id") % 3 == part), f"{tables.path('sent')}/part{part}", files)
        live = read_events(spark, f"{tables.path('sent')}/*", streaming=True)
        stream.run_stream(live, tables, tables.path("progress"), settings, model=models).awaitTermination()
        if part < 2:
            train_forest(features, models, settings, seed=part)
    stored = read_table(spark, tables.path("events"), EVENTS)
    again = stored.filter(F.col("event_id").cast("long") % 3 == 1).agg(F.min("batch_id")).first()[0]
    stream.process_batch(stored.filter(F.col("batch_id") == again).select(*EVENTS.names).checkpoint(), again, tables, settings, model=models)

    chosen = read_table(spark, tables.path("batch_models"), BATCH_MODELS).withColumn("version", F.coalesce("version", F.lit(-1).cast("long")))
    scored_by = read_table(spark, tables.path("events"), EVENTS).join(F.broadcast(chosen), "batch_id")
    expected = None
    for version in (-1, 0, 1):
        own = scored_by.filter(F.col("version") == version).select(*EVENTS.names)
        model = None if version < 0 else load_forest(spark, models, version)
        found = incidents.to_incidents(detect.anomalies(scored_runs(own, settings, model=model)), settings)
        found = found.select("incident_id", steady("anomaly_score", 6).alias("score"), F.lit(version).cast("long").alias("version"))
        expected = found if expected is None else expected.unionByName(found)
    made = read_table(spark, tables.path("incidents"), INCIDENTS).join(F.broadcast(chosen), "batch_id").select("incident_id", steady("anomaly_score", 6).alias("score"), "version")
    sides = made.withColumn("side", F.lit(1)).unionByName(expected.withColumn("side", F.lit(-1)))
    apart = sides.groupBy("incident_id", "score", "version").agg(F.sum("side").alias("side")).filter("side <> 0")
    differing = apart.groupBy("version").agg(F.count("*").alias("differing"))
    counted = scored_by.groupBy("version").agg(F.count("*").alias("events")).join(differing, "version", "left")
    reported = counted.join(made.groupBy("version").agg(F.lit(True).alias("reported")), "version", "left")
    return reported.select("version", "events", F.coalesce("reported", F.lit(False)).alias("reported"), F.coalesce("differing", F.lit(0).cast("long")).alias("differing"))


@query
def streamed_messages(spark, sf_dir):
    """Topic records of a stream's incidents: one for each, by the incident's id."""
    tables = _new_tables(spark)
    stream.run_stream(_record_stream(spark, sf_dir), tables, tables.path("progress"), SENSITIVE).awaitTermination()
    sent = spark.read.schema("key string, value string, batch_id bigint").parquet(tables.path("incidents_topic"))
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return sent.select(F.col("key").alias("job_type"), field("incidentId").alias("incident_id"), field("severity").alias("severity"), field("fingerprint").alias("fingerprint"))
