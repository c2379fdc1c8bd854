"""The monitoring panels as windowed queries.

Sliding windows are built from panes of one slide: rows are aggregated once per
pane and only the panes are copied into the windows that cover them, not the rows.
Panes can also be stored, batch by batch (``event_panes``, ``dead_letter_panes``): a
panel over a year then reads its panes and no events.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobvigil.config import SEVERITIES
from jobvigil.operators.metrics import literal_rows
from jobvigil.schema import DEAD_LETTER_PANES, EVENT_PANES

# Retained items per quantile sketch: windows of up to this many runs are exact.
SKETCH_SIZE = 1024
# Length of a stored pane; windows over stored panes slide by it or by a multiple.
PANE = "15 seconds"


def _seconds(width: str) -> float:
    """Length of a fixed interval such as ``1 minute``."""
    count, unit = width.split()
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return float(count) * scale


def _rates(df: DataFrame, ts: str, keys: Sequence[str], width: str, slide: str) -> DataFrame:
    if _seconds(width) % _seconds(slide):
        raise ValueError("the window width must be a multiple of the slide")
    panes = df.groupBy(*keys, F.window(ts, slide).alias("_pane")).agg(F.count(F.lit(1)).alias("_n"))
    return _counted(panes.withColumn("_at", F.window_time("_pane")), keys, width, slide)


def _counted(placed: DataFrame, keys: Sequence[str], width: str, slide: str) -> DataFrame:
    spans = placed.groupBy(*keys, F.window("_at", width, slide).alias("_span")).agg(F.sum("_n").alias("events"))
    return spans.select(
        *keys,
        F.col("_span.start").alias("window_start"),
        F.col("_span.end").alias("window_end"),
        "events",
        (F.col("events") / F.lit(_seconds(width))).alias("per_second"),
    )


def throughput(events: DataFrame, width: str = "1 minute", slide: str = "15 seconds") -> DataFrame:
    """Events per second by job type and event type, in sliding windows."""
    return _rates(events, "ts", ["job_type", "event_type"], width, slide)


def dead_letter_rate(dead_letters: DataFrame, width: str = "1 minute", slide: str = "15 seconds") -> DataFrame:
    """Dead letters per second, in sliding windows."""
    return _rates(dead_letters, "failed_at", [], width, slide)


def duration_p95(
    events: DataFrame, width: str = "5 minutes", slide: str = "15 seconds", quantile: float = 0.95
) -> DataFrame:
    """95th percentile of run time per job type, in sliding windows.

    One quantile sketch per pane, merged per window: the buffer of a window has a
    fixed size however many runs fall into it.
    """
    runs = events.filter(F.col("event_type") == "JOB_COMPLETED")
    panes = runs.groupBy("job_type", F.window("ts", slide).alias("_pane")).agg(
        F.kll_sketch_agg_double("duration_seconds", F.lit(SKETCH_SIZE)).alias("_sketch"),
        F.count(F.lit(1)).alias("_n"),
    )
    return _quantiles(panes.withColumn("_at", F.window_time("_pane")), width, slide, quantile)


def _quantiles(placed: DataFrame, width: str, slide: str, quantile: float) -> DataFrame:
    spans = placed.groupBy("job_type", F.window("_at", width, slide).alias("_span")).agg(
        F.kll_merge_agg_double("_sketch", F.lit(SKETCH_SIZE)).alias("_sketch"), F.sum("_n").alias("runs")
    )
    # runs without a run time leave an empty sketch, which has no quantile
    measured = F.kll_sketch_get_n_double("_sketch") > 0
    return spans.select(
        "job_type",
        F.col("_span.start").alias("window_start"),
        F.col("_span.end").alias("window_end"),
        "runs",
        F.when(measured, F.kll_sketch_get_quantile_double("_sketch", F.lit(quantile))).alias("p95_seconds"),
    )


def event_panes(events: DataFrame) -> DataFrame:
    """job_type, event_type, pane_start, events, durations: what the panels need of the events, by pane.

    ``durations`` is a mergeable sketch of the completed runs' times. Panes of several
    batches may overlap: late events make rows of their own for an old pane.
    """
    seconds = F.when(F.col("event_type") == "JOB_COMPLETED", F.col("duration_seconds"))
    panes = events.groupBy("job_type", "event_type", F.window("ts", PANE).alias("_pane")).agg(
        F.count(F.lit(1)).alias("events"), F.kll_sketch_agg_double(seconds, F.lit(SKETCH_SIZE)).alias("durations")
    )
    return panes.withColumn("pane_start", F.col("_pane.start")).select(*EVENT_PANES.names)


def dead_letter_panes(dead_letters: DataFrame) -> DataFrame:
    """pane_start, events: dead letters by pane."""
    panes = dead_letters.groupBy(F.window("failed_at", PANE).alias("_pane")).agg(F.count(F.lit(1)).alias("events"))
    return panes.withColumn("pane_start", F.col("_pane.start")).select(*DEAD_LETTER_PANES.names)


def _stored(panes: DataFrame, width: str, slide: str) -> DataFrame:
    if _seconds(slide) % _seconds(PANE) or _seconds(width) % _seconds(slide):
        raise ValueError(f"the window width must be a multiple of the slide, and the slide one of {PANE}")
    return panes.withColumns({"_at": F.col("pane_start"), "_n": F.col("events")})


def throughput_of_panes(panes: DataFrame, width: str = "1 minute", slide: str = PANE) -> DataFrame:
    """``throughput`` from stored panes. A condition on ``pane_start`` reaches the scan."""
    return _counted(_stored(panes, width, slide), ["job_type", "event_type"], width, slide)


def dead_letter_rate_of_panes(panes: DataFrame, width: str = "1 minute", slide: str = PANE) -> DataFrame:
    """``dead_letter_rate`` from stored panes."""
    return _counted(_stored(panes, width, slide), [], width, slide)


def duration_p95_of_panes(panes: DataFrame, width: str = "5 minutes", slide: str = PANE, quantile: float = 0.95) -> DataFrame:
    """``duration_p95`` from stored panes, by merging their sketches."""
    completed = _stored(panes, width, slide).filter(F.col("event_type") == "JOB_COMPLETED")
    return _quantiles(completed.withColumnRenamed("durations", "_sketch"), width, slide, quantile)


def incidents_by_severity(incidents: DataFrame) -> DataFrame:
    """Count per severity; a severity without incidents has 0."""
    counted = incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("incidents"))
    known = literal_rows(incidents.sparkSession, "severity", SEVERITIES)
    return known.join(counted, "severity", "left").select(
        "severity", F.coalesce("incidents", F.lit(0).cast("bigint")).alias("incidents")
    )


def recent_incidents(incidents: DataFrame, now: datetime | Column, span: str = "30 minutes") -> DataFrame:
    """Count per severity within ``span`` up to ``now``."""
    end = now if isinstance(now, Column) else F.lit(now)
    start = end - F.expr(f"INTERVAL {span}")
    return incidents_by_severity(incidents.filter((F.col("detected_at") > start) & (F.col("detected_at") <= end)))


def incident_windows(incidents: DataFrame, width: str = "30 minutes") -> DataFrame:
    """Incidents per severity in consecutive windows, one column per severity."""
    counts = [
        F.count(F.when(F.col("severity") == name, F.lit(1))).alias(name.lower()) for name in SEVERITIES
    ]
    grouped = incidents.groupBy(F.window("detected_at", width).alias("_span")).agg(*counts)
    return grouped.select(F.col("_span.start").alias("window_start"), *[n.lower() for n in SEVERITIES])


def summary_latency(summaries: DataFrame, ts: str = "summarized_at", width: str = "1 minute") -> DataFrame:
    """Mean and maximum of ``latency_seconds`` per window."""
    grouped = summaries.groupBy(F.window(ts, width).alias("_span")).agg(
        F.avg("latency_seconds").alias("mean_latency"), F.max("latency_seconds").alias("max_latency")
    )
    return grouped.select(F.col("_span.start").alias("window_start"), "mean_latency", "max_latency")


def series_stats(series: DataFrame, value: str, key: str | Sequence[str] = "job_type") -> DataFrame:
    """Mean and maximum of a gauge over its readings, per key or combination of keys."""
    return series.groupBy(*([key] if isinstance(key, str) else key)).agg(F.avg(value).alias(f"mean_{value}"), F.max(value).alias(f"max_{value}"))


def dead_letter_depth(rejected: DataFrame) -> DataFrame:
    """Dead letters per reason, and their total in a row with reason ``all``."""
    per_reason = rejected.rollup("reject_reason").agg(F.count(F.lit(1)).alias("records"))
    return per_reason.select(F.coalesce("reject_reason", F.lit("all")).alias("reject_reason"), "records")
