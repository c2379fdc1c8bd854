"""Which notifications went out: a claim, a send, an outcome, and what later batches have to know.

    outbox      per batch: the messages it has to send, written before any is sent (the claim)
    attempts    per batch: how often sending began
    deliveries  per batch: the outcome of each message
    notified    per batch: fingerprints that must not be sent again, from the batch before and this one

A batch reads its own folders and the batch before it, never older ones, so the two
hundredth costs what the second does. A fingerprint leaves ``notified`` when it failed, so
that its next incident is sent, or when it has been there for the horizon.

A batch that is retried sends what has no outcome yet. If sending had begun and no outcome was
stored, the process ended in between and the messages may be out: they are sent
again with a higher ``attempt`` for the receiver to tell, or, with ``after_crash="hold"``, not
sent and stored as ``unsure``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobvigil.operators.notify import undelivered, with_payload
from jobvigil.plans.flow import Tables
from jobvigil.schema import DELIVERIES, NOTIFIED, OUTBOX
from jobvigil.sinks.tables import write_batch, write_outbox

#: What sends messages (fingerprint, incident_id, detected_at, payload, batch_id, attempt). It returns nothing or true
#: if all went out, false if none did, or a DataFrame of fingerprint, ok and if it likes error.
Sender = Callable[[DataFrame], "DataFrame | bool | None"]

ATTEMPTS = T.StructType([T.StructField("attempt", T.IntegerType())])
OK, FAILED, UNSURE, LEFT = "ok", "failed", "unsure", "left in the outbox"


def read_batch(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """One batch of a table, empty where there is none; opens no other batch."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def notify_batch(
    incidents: DataFrame, batch_id: int, tables: Tables, send: Sender | None = None, horizon: str = "24 hours", after_crash: str = "resend",
) -> None:
    """Claim the batch's messages, send them, store the outcomes and what the next batch has to know.

    Without a sender the messages are left in the outbox, and count as sent. Of a
    batch that was settled before, nothing is sent again.
    """
    if after_crash not in ("resend", "hold"):
        raise ValueError("after a crash, messages are sent again (resend) or held back (hold)")
    spark = incidents.sparkSession
    before = read_batch(spark, tables.path("notified"), NOTIFIED, batch_id - 1)
    write_outbox(with_payload(undelivered(incidents, before)), tables.path("outbox"), batch_id)
    outbox = spark.read.schema(OUTBOX).parquet(f"{tables.path('outbox')}/batch_id={batch_id}")
    if send is None:
        outcomes = outbox.select("fingerprint", "incident_id", "detected_at", F.lit(0).alias("attempt"), F.lit(LEFT).alias("outcome"), F.lit(None).cast("string").alias("error"))
    else:
        outcomes = _settle(outbox, batch_id, tables, send, after_crash)
    kept = before.where(F.col("until") > F.current_timestamp()).join(outcomes.select("fingerprint"), "fingerprint", "left_anti")
    new = outcomes.where(F.col("outcome") != FAILED).select("fingerprint", "outcome", (F.current_timestamp() + F.expr(f"INTERVAL {horizon}")).alias("until"))
    write_batch(kept.unionByName(new).select(*NOTIFIED.names), tables.path("notified"), batch_id)


def hand_on(spark: SparkSession, batch_id: int, tables: Tables) -> None:
    """A batch without incidents: an empty outbox, and the fingerprints of the batch before that still count."""
    write_outbox(spark.createDataFrame([], OUTBOX), tables.path("outbox"), batch_id)
    before = read_batch(spark, tables.path("notified"), NOTIFIED, batch_id - 1)
    write_batch(before.where(F.col("until") > F.current_timestamp()), tables.path("notified"), batch_id)


def _settle(outbox: DataFrame, batch_id: int, tables: Tables, send: Sender, after_crash: str) -> DataFrame:
    """The stored outcomes of the batch; sends its messages if there are none. An error while a sender's rows are computed fails the batch."""
    spark, path = outbox.sparkSession, tables.path("deliveries")
    if read_batch(spark, path, DELIVERIES, batch_id).isEmpty() and not outbox.isEmpty():
        begun = read_batch(spark, tables.path("attempts"), ATTEMPTS, batch_id).agg(F.max("attempt")).first()[0]
        attempt = (begun or 0) + 1
        if begun is None or after_crash == "resend":
            write_batch(spark.createDataFrame([(attempt,)], ATTEMPTS), tables.path("attempts"), batch_id)
            said = delivery_outcomes(outbox.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "attempt": F.lit(attempt)}), send)
        else:
            attempt, error = begun, "sending began and did not end"
            said = outbox.select("fingerprint", F.lit(UNSURE).alias("outcome"), F.lit(error).alias("error"))
        rows = outbox.join(said, "fingerprint", "left").select(
            "fingerprint", "incident_id", "detected_at", F.lit(attempt).alias("attempt"), F.coalesce("outcome", F.lit(FAILED)).alias("outcome"),
            F.when(F.col("outcome").isNull(), "the sender gave no outcome").otherwise(F.col("error")).alias("error"),
        )
        write_batch(rows.select(*DELIVERIES.names), path, batch_id)
    return read_batch(spark, path, DELIVERIES, batch_id)


def delivery_outcomes(messages: DataFrame, send: Sender) -> DataFrame:
    """fingerprint, outcome and error of each message; what the sender raises is an outcome and does not stop the flow."""
    every = messages.select("fingerprint")
    try:
        said = send(messages)
    except Exception as error:  # noqa: BLE001 - delivery must not stop the flow
        return every.select("fingerprint", F.lit(FAILED).alias("outcome"), F.lit(f"{type(error).__name__}: {error}").alias("error"))
    if isinstance(said, DataFrame):
        error = F.col("error").cast("string") if "error" in said.columns else F.lit(None).cast("string")
        ok = F.coalesce(F.col("ok"), F.lit(False))
        # a fingerprint that is told of more than once went out if any of them did
        told = said.groupBy("fingerprint").agg(F.max(ok).alias("ok"), F.max(error).alias("error"))
        return told.select("fingerprint", F.when(F.col("ok"), OK).otherwise(FAILED).alias("outcome"), F.when(~F.col("ok"), F.col("error")).alias("error"))
    return every.select("fingerprint", F.lit(FAILED if said is False else OK).alias("outcome"), F.lit(None).cast("string").alias("error"))
