"""Aggregates per job type: final state, counters, gauges and running values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobvigil.config import DEFAULTS, Settings
from jobvigil.functions.scores import hour_utc, iso_dow, safe_ratio
from jobvigil.operators.decode import usable_runs
from jobvigil.operators.ordered import ScanSpec, arrange, scan

ORDER = ("ts", "event_id")
RUN_COLUMNS = ("job_type", "ts", "event_id", "event_type", "duration_seconds", "error_count", "rows_processed")
DELTAS = ("d_runs", "d_duration", "d_errors", "d_rows")


def metric_deltas(events: DataFrame) -> DataFrame:
    """What each finished run adds to its job type; other events add nothing and are left out.

    A failed run counts as one run with one error, no time and no rows. A completed run
    without a finite duration is left out, as it is from the scores.
    """
    return add_deltas(usable_runs(events).filter(F.col("event_type").isin("JOB_COMPLETED", "JOB_FAILED")))


def add_deltas(finished: DataFrame) -> DataFrame:
    done = F.col("event_type") == "JOB_COMPLETED"
    return finished.withColumns({
        "d_runs": F.lit(1).cast("bigint"),
        "d_duration": F.when(done, F.col("duration_seconds")).otherwise(F.lit(0.0)),
        "d_errors": F.when(done, F.col("error_count").cast("bigint")).otherwise(F.lit(1).cast("bigint")),
        "d_rows": F.when(done, F.col("rows_processed")).otherwise(F.lit(0).cast("bigint")),
    })


def state_aggregates() -> list[Column]:
    return [
        F.sum("d_runs").alias("run_count"),
        F.sum("d_duration").alias("sum_duration_seconds"),
        F.sum("d_errors").alias("sum_error_count"),
        F.sum("d_rows").alias("sum_rows"),
        F.max("ts").alias("updated_at"),
    ]


def with_rates(state: DataFrame) -> DataFrame:
    """Add the mean duration and the error rate derived from the sums."""
    return state.withColumns({
        "mean_duration_seconds": safe_ratio(F.col("sum_duration_seconds"), F.col("run_count")),
        "error_rate": safe_ratio(F.col("sum_error_count"), F.col("sum_rows")),
    })


def metrics_state(events: DataFrame) -> DataFrame:
    """Cumulative state per job type over all finished runs."""
    return metric_deltas(events).groupBy("job_type").agg(*state_aggregates())


def metrics_state_by_bucket(events: DataFrame, width: str = "1 day") -> DataFrame:
    """The same aggregates per job type and time bucket."""
    grouped = metric_deltas(events).groupBy("job_type", F.window("ts", width).alias("w")).agg(*state_aggregates())
    return grouped.withColumn("bucket", F.col("w.start")).drop("w")


def merge_metrics(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored state plus the state of new events; a job type in only one of them is kept."""
    return state.unionByName(delta).groupBy("job_type").agg(
        F.sum("run_count").alias("run_count"),
        F.sum("sum_duration_seconds").alias("sum_duration_seconds"),
        F.sum("sum_error_count").alias("sum_error_count"),
        F.sum("sum_rows").alias("sum_rows"),
        F.max("updated_at").alias("updated_at"),
    )


def events_processed(events: DataFrame) -> DataFrame:
    """Count by job type and event class, e.g. ``JobCompleted``."""
    label = F.replace(F.initcap(F.replace(F.lower("event_type"), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    counted = events.groupBy("job_type", "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counted.select("job_type", label.alias("event_class"), "events")


def duration_stats(events: DataFrame) -> DataFrame:
    """Count, sum and maximum of run time per job type, in whole milliseconds as seconds."""
    millis = F.floor(F.col("duration_seconds") * 1000)
    completed = events.filter(F.col("event_type") == "JOB_COMPLETED")
    stats = completed.groupBy("job_type").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(millis).alias("total"), F.max(millis).alias("longest")
    )
    return stats.select(
        "job_type", "runs",
        (F.col("total") / 1000).alias("sum_seconds"), (F.col("longest") / 1000).alias("max_seconds"),
    )


def error_rate_series(events: DataFrame) -> DataFrame:
    """One gauge reading per finished run: its own error share, 1.0 for a failed run."""
    rate = F.when(F.col("event_type") == "JOB_FAILED", F.lit(1.0)).otherwise(
        safe_ratio(F.col("error_count"), F.col("rows_processed"))
    )
    finished = events.filter(F.col("event_type").isin("JOB_COMPLETED", "JOB_FAILED"))
    return finished.select("job_type", "ts", "event_id", rate.alias("error_rate"))


def latest_per_job(series: DataFrame, value: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Last reading of a gauge per job type; 0.0 for a job type without any.

    The newest time is found by a hash aggregate, and only the readings at that
    time are compared by event id: ranking all readings at once would sort them.
    """
    readings = series.filter(F.col("job_type").isin(*settings.job_types)).select("job_type", *ORDER, value)
    newest = readings.groupBy("job_type").agg(F.max("ts").alias("ts"))
    # at most one row per allowed job type, hence small enough to broadcast
    at_newest = readings.join(F.broadcast(newest), ["job_type", "ts"])
    last = at_newest.groupBy("job_type").agg(F.max_by(value, "event_id").alias(value))
    known = literal_rows(series.sparkSession, "job_type", settings.job_types)
    joined = known.join(last, "job_type", "left")
    return joined.select("job_type", F.coalesce(value, F.lit(0.0)).alias(value))


def latest_error_rate(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return latest_per_job(error_rate_series(events), "error_rate", settings)


def latest_score(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return latest_per_job(scored, "score", settings)


def literal_rows(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A small dimension table from fixed values."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def arrange_runs(events: DataFrame, order_by: Sequence[str] = ORDER, keep: Sequence[str] = ()) -> DataFrame:
    """Finished runs in scan order; one arrangement serves running sums and EWMA.

    Only the columns the features need are shuffled and checkpointed, plus those
    named in ``keep``; what can be computed from them is added after that.
    """
    finished = events.filter(F.col("event_type").isin("JOB_COMPLETED", "JOB_FAILED"))
    columns = list(dict.fromkeys([*RUN_COLUMNS, *order_by, *keep]))
    return observe(arrange(finished.select(*columns), "job_type", order_by))


def observe(runs: DataFrame) -> DataFrame:
    """Add the deltas and ``observed_seconds``, the run time the EWMA sees (none for a failed run)."""
    return add_deltas(runs).withColumn(
        "observed_seconds", F.when(F.col("event_type") == "JOB_COMPLETED", F.col("duration_seconds"))
    )


def name_running(scanned: DataFrame) -> DataFrame:
    """Rename the totals of a scan over ``DELTAS`` and add the rates they give."""
    running = scanned.withColumnsRenamed({
        "running_d_runs": "running_count",
        "running_d_duration": "running_duration_seconds",
        "running_d_errors": "running_error_count",
        "running_d_rows": "running_rows",
    })
    return running.withColumns({
        "rolling_mean_duration": safe_ratio(F.col("running_duration_seconds"), F.col("running_count")),
        "rolling_error_rate": safe_ratio(F.col("running_error_count"), F.col("running_rows")),
    })


def running_metrics(
    events: DataFrame, order_by: Sequence[str] = ORDER, keep: Sequence[str] = ()
) -> DataFrame:
    """Cumulative sums per job type at every finished run, the run itself included."""
    arranged = arrange_runs(events, order_by, keep)
    return name_running(scan(arranged, ScanSpec("job_type", DELTAS), drop=(*DELTAS, "observed_seconds")))


def feature_vectors(running: DataFrame) -> DataFrame:
    """The five features of every completed run, from the output of ``running_metrics``."""
    return running.filter(F.col("event_type") == "JOB_COMPLETED").withColumns({
        "error_rate": F.col("rolling_error_rate"),
        "row_count": F.col("rows_processed"),
        "hour_of_day": hour_utc(F.col("ts")),
        "day_of_week": iso_dow(F.col("ts")),
    })
