"""The given star-schema tables seen as batch-job events, and events as raw deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobvigil.config import ERROR_HEADER, RETRY_HEADER, SCHEMA_VERSION


def runs_from_events(events: DataFrame) -> DataFrame:
    """Map the click-stream table ``events`` to job events, row by row."""
    kind = (
        F.when(F.col("event_type") == "click", "JOB_STARTED")
        .when(F.col("event_type") == "view", "JOB_PROGRESS")
        .when(F.col("event_type") == "error", "JOB_FAILED")
        .otherwise("JOB_COMPLETED")
    )
    job = (
        F.when(F.col("user_id") % 3 == 0, "POLICY_RENEWAL")
        .when(F.col("user_id") % 3 == 1, "ANNUITY_PAYOUT")
        .otherwise("CLAIMS_INGEST")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    rows = (F.lit(1000) + 10 * k).cast("bigint")
    done, failed = kind == "JOB_COMPLETED", kind == "JOB_FAILED"
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        job.alias("job_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("event_type"),
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.when(done | (kind == "JOB_STARTED"), F.lit("export.csv")).alias("source_file"),
        F.when(kind == "JOB_STARTED", rows).alias("expected_rows"),
        F.when(kind == "JOB_PROGRESS", rows).alias("rows_so_far"),
        F.when(kind == "JOB_PROGRESS", k).alias("progress_percent"),
        F.when(done, rows).alias("rows_processed"),
        F.when(done, F.col("value")).alias("duration_seconds"),
        F.when(done, k % 7).alias("error_count"),
        F.when(failed, F.lit("SOURCE_ABSENT")).alias("error_code"),
        F.when(failed, F.lit("source file missing")).alias("error_message"),
        F.when(failed, k % 4).alias("retry_count"),
    )


def deliveries(published: DataFrame) -> DataFrame:
    """Raw records as a broker hands them over: originals, redeliveries and broken copies.

    Every completed run is delivered a second time an hour later; every failed
    run also arrives once as text that is not JSON, with failure headers.
    """
    original = published.withColumns({
        "headers": F.expr("cast(null as array<struct<key:string,value:binary>>)"),
        "timestamp": F.col("ts"),
    })
    again = original.filter(F.col("event_type") == "JOB_COMPLETED").withColumns({
        "headers": _headers((RETRY_HEADER, F.lit("1"))),
        "timestamp": F.col("ts") + F.expr("INTERVAL 1 HOUR"),
    })
    broken = original.filter(F.col("event_type") == "JOB_FAILED").withColumns({
        "value": F.concat(F.lit("{ broken record "), F.col("event_id")),
        "headers": _headers(
            (RETRY_HEADER, F.lit("x")), (RETRY_HEADER, F.col("retry_count").cast("string")),
            (ERROR_HEADER, F.concat(F.lit("cannot read record "), F.col("event_id"))),
        ),
    })
    return original.unionByName(again).unionByName(broken).select("key", "value", "headers", "timestamp")


def broken_deliveries(published: DataFrame) -> DataFrame:
    """Failed runs as records that are broken in each of the ways decoding tells apart; the first way gives all the same text."""
    failed = published.filter(F.col("event_type") == "JOB_FAILED")
    value, own = F.col("value"), F.col("event_id").cast("long") % 8
    broken = [
        F.lit("{ half a record"), F.lit("[1, 2]"), F.replace(value, F.col("job_type"), F.lit("NO_SUCH_JOB")),
        F.regexp_replace(value, r',"payload".*$', "}"), F.replace(value, F.lit("JOB_FAILED"), F.lit("JOB_LOST")),
        F.regexp_replace(value, r'"timestamp":"[^"]*"', '"timestamp":"yesterday"'),
        F.regexp_replace(value, r'"retryCount":[0-9]+', '"retryCount":"many"'), F.regexp_replace(value, r'"eventId":"[^"]*",', ""),
    ]
    return failed.select(
        "key", F.get(F.array(*broken), own.cast("int")).alias("value"),
        F.expr("cast(null as array<struct<key:string,value:binary>>)").alias("headers"), F.lit(None).cast("timestamp").alias("timestamp"),
    )


def contradicting_deliveries(published: DataFrame) -> DataFrame:
    """Every event, and a completed run with an odd id once more: an hour earlier, with another source file and the same event time."""
    original = published.withColumns({
        "headers": F.expr("cast(null as array<struct<key:string,value:binary>>)"), "timestamp": F.col("ts"),
    })
    early = original.filter((F.col("event_type") == "JOB_COMPLETED") & (F.col("event_id").cast("long") % 2 == 1)).withColumns({
        "value": F.replace("value", F.lit("export.csv"), F.lit("early.csv")), "timestamp": F.col("ts") - F.expr("INTERVAL 1 HOUR"),
    })
    return original.unionByName(early).select("key", "value", "headers", "timestamp")


def _headers(*entries: tuple[str, Column]) -> Column:
    return F.array(*[
        F.struct(F.lit(key).alias("key"), text.cast("binary").alias("value")) for key, text in entries
    ])
