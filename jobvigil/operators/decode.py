"""Raw JSON records to typed events, and the split into valid and rejected ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobvigil.config import DEFAULTS, EVENT_TYPES, Settings

# JSON fields of the payloads. Text fields give their column and the
# event types that carry them, number fields their column, type and event type.
TEXT_FIELDS = {
    "runId": ("run_id", EVENT_TYPES),
    "sourceFile": ("source_file", ("JOB_STARTED", "JOB_COMPLETED")),
    "errorCode": ("error_code", ("JOB_FAILED",)),
    "errorMessage": ("error_message", ("JOB_FAILED",)),
}
NUMBER_FIELDS = {
    "expectedRows": ("expected_rows", "bigint", "JOB_STARTED"),
    "rowsProcessedSoFar": ("rows_so_far", "bigint", "JOB_PROGRESS"),
    "progressPercent": ("progress_percent", "int", "JOB_PROGRESS"),
    "rowsProcessed": ("rows_processed", "bigint", "JOB_COMPLETED"),
    "durationSeconds": ("duration_seconds", "double", "JOB_COMPLETED"),
    "errorCount": ("error_count", "int", "JOB_COMPLETED"),
    "retryCount": ("retry_count", "int", "JOB_FAILED"),
}

ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"
EPOCH_SECONDS = r"^\d{1,12}(\.\d{1,9})?$"

PAYLOAD_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("eventType", *TEXT_FIELDS, *NUMBER_FIELDS)]
)
JSON_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("eventId", "schemaVersion", "jobType", "timestamp")]
    + [T.StructField("payload", PAYLOAD_SCHEMA)]
)
JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

EVENT_COLUMNS = (
    "event_id", "schema_version", "job_type", "ts", "event_type", "run_id", "source_file",
    "expected_rows", "rows_so_far", "progress_percent", "rows_processed", "duration_seconds",
    "error_count", "error_code", "error_message", "retry_count",
)


def decode_events(df: DataFrame, settings: Settings = DEFAULTS, value: str = "value") -> DataFrame:
    """Decode ``value`` into the event columns plus ``reject_reason`` (null when valid).

    The input's own columns are kept. The text is parsed once, every field as
    text, and then read leniently: unknown fields are ignored, quoted numbers
    count as numbers and an absent number is 0.
    """
    kept = [c for c in df.columns if c not in EVENT_COLUMNS]
    doc = F.from_json(F.col(value), JSON_SCHEMA, JSON_OPTIONS)
    parsed = _evaluate_once(df.select(*kept), doc, "_doc")
    typed = _evaluate_once(
        parsed,
        F.struct(
            _instant(F.col("_doc.timestamp")).alias("ts"),
            *[_number(field, dtype).alias(column) for field, (column, dtype, _) in NUMBER_FIELDS.items()],
        ),
        "_typed",
    )
    event_type = F.col("_doc.payload.eventType")
    unusable = reduce(
        Column.__or__,
        [
            (event_type == kind) & _present(field) & _not_finite(F.col(f"_typed.{column}"), dtype)
            for field, (column, dtype, kind) in NUMBER_FIELDS.items()
        ],
    )
    # the text is looked at again only for records without a known job type, and
    # by a lookup, which evaluates it once
    shape = F.left(F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(value))), F.lit("BROKEN")), F.lit(6))
    named = F.create_map(F.lit("BROKEN"), F.lit("not_json"), F.lit("OBJECT"), F.lit("unknown_job_type"))
    reason = (
        F.when(
            ~F.coalesce(F.col("_doc.jobType").isin(*settings.job_types), F.lit(False)),
            F.coalesce(F.try_element_at(named, shape), F.lit("not_an_object")),
        )
        .when(F.col("_doc.payload").isNull(), "missing_payload")
        .when(~F.coalesce(event_type.isin(*EVENT_TYPES), F.lit(False)), "unknown_event_type")
        .when(F.col("_typed.ts").isNull(), "bad_timestamp")
        .when(unusable, "bad_number")
        .when(F.col("_doc.eventId").isNull(), "missing_event_id")
    )
    values = {
        "event_id": F.col("_doc.eventId"),
        "schema_version": F.col("_doc.schemaVersion"),
        "job_type": F.col("_doc.jobType"),
        "ts": F.col("_typed.ts"),
        "event_type": event_type,
    }
    for field, (column, kinds) in TEXT_FIELDS.items():
        values[column] = F.when(event_type.isin(*kinds), F.col(f"_doc.payload.{field}"))
    for column, dtype, kind in NUMBER_FIELDS.values():
        values[column] = F.when(event_type == kind, F.coalesce(F.col(f"_typed.{column}"), F.lit(0).cast(dtype)))
    return typed.select(*kept, *[values[c].alias(c) for c in EVENT_COLUMNS], reason.alias("reject_reason"))


def split_valid(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected records).

    Valid events keep the time, partition and offset of their record, where there are
    such columns; the rejected keep all raw columns and the reason.
    """
    valid = decoded.filter(F.col("reject_reason").isNull()).select(*EVENT_COLUMNS, *arrival(decoded))
    raw = [c for c in decoded.columns if c not in EVENT_COLUMNS and c != "reject_reason"]
    rejected = decoded.filter(F.col("reject_reason").isNotNull()).select(*raw, "event_id", "reject_reason")
    return valid, rejected


def arrival(df: DataFrame) -> list[str]:
    """The columns that tell in which order records arrived."""
    return [c for c in ("timestamp", "partition", "offset") if c in df.columns]


def first_delivery(df: DataFrame) -> list[Column]:
    """An order of records that depends on nothing but their content: arrival, event time, then a hash of the row."""
    return [*map(F.col, arrival(df)), F.col("ts"), F.xxhash64(*[c for c in df.columns if c in EVENT_COLUMNS])]


def completed_runs(events: DataFrame) -> DataFrame:
    """Only events that yield a feature vector and hence a score."""
    return events.filter(F.col("event_type") == "JOB_COMPLETED")


def _broken_run() -> Column:
    duration = F.col("duration_seconds")
    broken = duration.isNull() | F.isnan(duration) | (F.abs(duration) == F.lit(float("inf")))
    return F.coalesce((F.col("event_type") == "JOB_COMPLETED") & broken, F.lit(False))


def usable_runs(events: DataFrame) -> DataFrame:
    """Table input guarded as JSON input is: completed runs need a finite duration. Every metric and score starts from these."""
    return events.filter(~_broken_run())


def unusable_runs(events: DataFrame) -> DataFrame:
    """The rows ``usable_runs`` leaves out, with their reason."""
    return events.filter(_broken_run()).withColumn("reject_reason", F.lit("bad_number"))


def _evaluate_once(df: DataFrame, record: Column, name: str) -> DataFrame:
    """Append a struct column that the optimizer will not copy into later conditions.

    Written as a one-element generator: a filter on a projected column would be
    pushed below the projection and repeat the parsing there.
    """
    return df.select("*", F.explode(F.array(record)).alias(name))


def _number(field: str, dtype: str) -> Column:
    text = F.col(f"_doc.payload.{field}")
    if dtype == "double":
        return text.try_cast("double")
    # whole numbers may be written 60, "60", 6e1 or 60.7 (cut to 60)
    return text.try_cast("decimal(38,9)").try_cast(dtype)


def _present(field: str) -> Column:
    return F.coalesce(F.trim(F.col(f"_doc.payload.{field}")) != "", F.lit(False))


def _not_finite(number: Column, dtype: str) -> Column:
    if dtype == "double":
        return number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return number.isNull()


def _instant(text: Column) -> Column:
    """ISO-8601 with a zone, or epoch seconds."""
    return F.when(text.rlike(ISO_INSTANT), text.try_cast("timestamp")).when(
        text.rlike(EPOCH_SECONDS), F.timestamp_seconds(text.try_cast("decimal(21,9)"))
    )
