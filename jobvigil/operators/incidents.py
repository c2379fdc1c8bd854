"""Anomalous runs become incidents; summaries are joined to them, built in, or made by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobvigil.config import DEFAULTS, SEVERITIES, Settings
from jobvigil.functions import identity
from jobvigil.functions.scores import severity
from jobvigil.schema import INCIDENTS
from jobvigil.session import ship_package

NOOP = "noop"
UNAVAILABLE = "unavailable"
# What a summariser may read about an incident.
CONTEXT = (
    "job_type", "anomaly_score", "detector_name", "duration_seconds", "rolling_mean_duration",
    "error_rate", "row_count",
)

# Fixed value: the instruction that goes with every prompt.
SYSTEM_TEXT = (
    "You are a batch-job reliability engineer. Analyze the provided metrics and return ONLY "
    "valid JSON matching this schema exactly — no markdown, no explanation:\n"
    '{"summary":"...","likelyCause":"...","severity":"LOW|MEDIUM|HIGH","suggestedActions":["..."]}\n'
    "summary must be ≤200 characters. likelyCause must be ≤300 characters."
)
# Fixed value: the fields of a prompt.
PROMPT_FORMAT = (
    "Job: %s | AnomalyScore: %.4f | Duration: %.1fs (rolling mean %.1fs) | ErrorRate: %.4f | Rows: %d | Detector: %s"
)
# The built-in summary. {} are job type, run time and rolling mean.
STATIC_SUMMARY = "Anomaly detected in {} — duration {}s vs mean {}s"
STATIC_CAUSE = "Likely cause: job duration spike detected by "
STATIC_ACTIONS = ("Inspect job logs", "Check upstream data volumes")

ANSWER_SCHEMA = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("likelyCause", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("suggestedActions", T.ArrayType(T.StringType())),
])


def to_incidents(
    anomalous: DataFrame,
    settings: Settings = DEFAULTS,
    detected_at: Column | None = None,
    severity_scale: str = "by_detector",
) -> DataFrame:
    """Incident columns without a summary yet, plus the context a summariser reads.

    ``detected_at`` defaults to the event's own time, so a replay gives the same
    incidents; pass ``current_timestamp()`` for wall-clock time.
    """
    when = F.col("ts") if detected_at is None else detected_at
    base = anomalous.withColumns({
        "detected_at": when,
        "severity": severity(F.col("score"), F.col("detector_name"), severity_scale),
    })
    return base.select(
        identity.incident_id(F.col("event_id"), F.col("detector_name")).alias("incident_id"),
        F.lit(settings.schema_version).alias("schema_version"),
        "job_type",
        F.col("score").alias("anomaly_score"),
        "detector_name",
        identity.fingerprint(F.col("job_type"), F.col("severity"), F.col("detected_at")).alias("fingerprint"),
        "severity",
        "detected_at",
        "event_id",
        "reason",
        "duration_seconds",
        "rolling_mean_duration",
        "error_rate",
        "row_count",
    )


def with_prompt(incidents: DataFrame) -> DataFrame:
    """Add ``prompt``, one line per incident, and the fixed ``system_text``."""
    fields = [F.col(c) for c in (
        "job_type", "anomaly_score", "duration_seconds", "rolling_mean_duration", "error_rate", "row_count",
        "detector_name",
    )]
    return incidents.withColumns({
        "prompt": F.format_string(PROMPT_FORMAT, *fields),
        "system_text": F.lit(SYSTEM_TEXT),
    })


def _static_columns() -> dict[str, Column]:
    fields = (F.col("job_type"), F.col("duration_seconds").cast("string"), F.col("rolling_mean_duration").cast("string"))
    pieces = [F.lit(text) for text in STATIC_SUMMARY.split("{}")]
    filled = [pieces[0]]
    for value, text in zip(fields, pieces[1:]):
        filled += [value, text]
    return {
        "summary": F.concat(*filled),
        "likely_cause": F.concat(F.lit(STATIC_CAUSE), F.col("detector_name")),
        "suggested_actions": F.array(*[F.lit(a) for a in STATIC_ACTIONS]),
    }


def static_summary(incidents: DataFrame) -> DataFrame:
    """Summaries from fixed sentences: ``incident_id`` and the answer's columns, always available."""
    return incidents.withColumns(_static_columns()).select(
        "incident_id", "summary", "likely_cause", "suggested_actions",
        F.lit(NOOP).alias("provider"), F.lit(True).alias("ok"),
    )


def decode_answers(answers: DataFrame) -> DataFrame:
    """Read the JSON in ``answer``, with or without code fences.

    An absent summary or cause is an empty text, an absent severity counts as
    MEDIUM, an unknown one or text that is not a JSON object makes ``ok`` false.
    """
    fenceless = F.regexp_replace(F.regexp_replace("answer", r"(?s)```json\s*", ""), r"(?s)```\s*", "")
    bare = F.trim(fenceless, F.lit(" \t\r\n"))
    given = F.coalesce(F.col("ok"), F.lit(True)) if "ok" in answers.columns else F.lit(True)
    read = answers.withColumn("_given", given).select(
        "*",
        F.explode(F.array(F.struct(
            F.from_json(bare, ANSWER_SCHEMA, {"allowSingleQuotes": "false"}).alias("doc"),
            (F.try_parse_json(bare).isNotNull() | (bare == "")).alias("valid"),
        ))).alias("_read"),
    )
    level = F.coalesce(F.col("_read.doc.severity"), F.lit("MEDIUM"))
    usable = F.col("_given") & F.coalesce(F.col("_read.valid"), F.lit(False)) & level.isin(*SEVERITIES)
    kept = [c for c in answers.columns if c not in ("ok", "summary", "likely_cause", "suggested_actions")]
    return read.select(
        *kept,
        F.when(usable, F.coalesce(F.col("_read.doc.summary"), F.lit(""))).alias("summary"),
        F.when(usable, F.coalesce(F.col("_read.doc.likelyCause"), F.lit(""))).alias("likely_cause"),
        F.when(usable, F.coalesce(F.col("_read.doc.suggestedActions"), no_actions())).alias("suggested_actions"),
        usable.alias("ok"),
    )


def enrich(incidents: DataFrame, summaries: DataFrame) -> DataFrame:
    """Incidents with their summaries; one without a usable summary is kept and marked.

    ``summaries`` has one row per incident_id at most: ``summary``,
    ``likely_cause``, ``suggested_actions``, ``provider`` and ``ok``.
    """
    wanted = summaries.select("incident_id", "summary", "likely_cause", "suggested_actions", "provider", "ok")
    joined = incidents.join(wanted, "incident_id", "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return joined.withColumns({
        "summary": F.when(ok, F.col("summary")),
        "likely_cause": F.when(ok, F.col("likely_cause")),
        "suggested_actions": F.when(ok, F.coalesce(F.col("suggested_actions"), no_actions())).otherwise(no_actions()),
        "llm_unavailable": ~ok,
        "llm_provider": F.when(ok, F.col("provider")).otherwise(F.lit(UNAVAILABLE)),
    }).select(*INCIDENTS.names)


def newest_answers(answers: DataFrame) -> DataFrame:
    """The usable answer given last for each incident.

    Unusable answers never count, so none takes the place of a usable one. Of answers
    given at one time the greater text decides, whatever the order of rows; an answer
    stored twice is one answer. Each task keeps one per incident before they meet.
    """
    last = F.max(F.struct("answered_at", "provider", "summary", "likely_cause", "suggested_actions")).alias("_last")
    usable = answers.where(F.col("ok") & F.col("incident_id").isNotNull())
    return usable.groupBy("incident_id").agg(last).select("incident_id", "_last.*", F.lit(True).alias("ok"))


def revise(incidents: DataFrame, answers: DataFrame) -> DataFrame:
    """Stored incidents with the usable answer given last, if there is one; the others as they are.

    The incidents' columns stay as they are, and so does every incident, repeated ones
    too. Answers to unknown incidents wait until theirs is stored. Nothing goes to the
    outbox, so a late answer causes no second message.
    """
    late = newest_answers(answers).select(F.col("incident_id"), F.struct("provider", "summary", "likely_cause", "suggested_actions").alias("_late"))
    answered = F.col("_late").isNotNull()
    given = {
        "summary": F.col("_late.summary"),
        "likely_cause": F.col("_late.likely_cause"),
        "suggested_actions": F.coalesce("_late.suggested_actions", no_actions()),
        "llm_unavailable": F.lit(False),
        "llm_provider": F.col("_late.provider"),
    }
    joined = incidents.join(late, "incident_id", "left")
    return joined.withColumns({c: F.when(answered, v).otherwise(F.col(c)) for c, v in given.items()}).select(*incidents.columns)


def summarize_static(incidents: DataFrame) -> DataFrame:
    """``enrich`` with the built-in summary, which needs no join."""
    return incidents.withColumns(_static_columns()).withColumns({
        "llm_unavailable": F.lit(False),
        "llm_provider": F.lit(NOOP),
    }).select(*INCIDENTS.names)


SUMMARY_SCHEMA = (
    "incident_id string, summary string, likely_cause string, suggested_actions array<string>, "
    "provider string, ok boolean, error string"
)


def summarize_with(
    incidents: DataFrame, summarize: Callable[[pd.DataFrame], pd.DataFrame], provider: str = "custom"
) -> DataFrame:
    """Summaries from a caller's function, run on Arrow batches of incidents in the tasks.

    ``summarize`` gets the context columns and ``incident_id`` and returns
    ``summary``, ``likely_cause`` and ``suggested_actions`` for the same rows, in
    order. A batch whose call fails gives unavailable rows, not a failed job; ``error``
    says what was raised.
    """
    ship_package(incidents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"incident_id": batch["incident_id"], "provider": provider})
            try:
                answer = summarize(batch)
                for column in ("summary", "likely_cause", "suggested_actions"):
                    out[column] = answer[column].to_numpy()
                out["ok"], out["error"] = True, None
            except Exception as failure:  # noqa: BLE001 - the caller's code may raise anything
                out["summary"] = out["likely_cause"] = out["suggested_actions"] = None
                out["ok"], out["error"] = False, f"{type(failure).__name__}: {failure}"
            yield out[["incident_id", "summary", "likely_cause", "suggested_actions", "provider", "ok", "error"]]

    return incidents.select("incident_id", *CONTEXT).mapInPandas(run, SUMMARY_SCHEMA)


def no_actions() -> Column:
    return F.expr("cast(array() as array<string>)")
