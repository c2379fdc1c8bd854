"""Messages go out once: outcomes, failures, crashes between sending and recording, and what later batches read."""

import shutil

import pytest
from pyspark.sql import functions as F

from jobvigil.plans.flow import Tables
from jobvigil.schema import DELIVERIES, INCIDENTS, NOTIFIED, OUTBOX
from jobvigil.sources.tables import read_table
from jobvigil.streaming import ledger


def incidents(spark, *named):
    """Incidents with these fingerprints, one a minute."""
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(named)], "fingerprint string, i int")
    given = {
        "fingerprint": F.col("fingerprint"), "incident_id": F.concat("fingerprint", F.lit("-"), F.col("i")), "severity": F.lit("LOW"), "job_type": F.lit("J"),
        "detected_at": F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("i")), "anomaly_score": F.lit(4.0), "detector_name": F.lit("ewma"),
    }
    return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INCIDENTS))


def told(spark, tables, batch_id):
    rows = ledger.read_batch(spark, tables.path("deliveries"), DELIVERIES, batch_id).collect()
    return {r.fingerprint: (r.outcome, r.attempt, r.error) for r in rows}


def known(spark, tables, batch_id):
    return {r.fingerprint for r in ledger.read_batch(spark, tables.path("notified"), NOTIFIED, batch_id).collect()}


class Receiver:
    def __init__(self, answer=None):
        self.got, self.answer = [], answer

    def __call__(self, messages):
        self.got.append(sorted((r.fingerprint, r.attempt) for r in messages.collect()))
        return self.answer(messages) if self.answer else None


def test_a_fingerprint_goes_out_once_and_a_failed_one_again(spark, tmp_path):
    tables = Tables(str(tmp_path))
    some = Receiver(lambda m: m.where("fingerprint <> 'c'").select("fingerprint", (F.col("fingerprint") != "b").alias("ok"), F.lit("busy").alias("error")))
    ledger.notify_batch(incidents(spark, "a", "b", "b", "c"), 0, tables, some)
    assert some.got == [[("a", 1), ("b", 1), ("c", 1)]]
    assert told(spark, tables, 0) == {"a": ("ok", 1, None), "b": ("failed", 1, "busy"), "c": ("failed", 1, "the sender gave no outcome")}
    down = Receiver(lambda m: 1 / 0)
    ledger.notify_batch(incidents(spark, "a", "b"), 1, tables, down)
    assert told(spark, tables, 1) == {"b": ("failed", 1, "ZeroDivisionError: division by zero")} and known(spark, tables, 1) == {"a"}
    ledger.notify_batch(incidents(spark, "b", "a"), 2, tables, Receiver(lambda m: False))
    ledger.hand_on(spark, 3, tables)
    up = Receiver()
    for _ in range(2):  # the batch is retried after all of it was stored
        ledger.notify_batch(incidents(spark, "c", "b", "a"), 4, tables, up)
    assert up.got == [[("b", 1), ("c", 1)]] and known(spark, tables, 4) == {"a", "b", "c"}


@pytest.mark.parametrize("after_crash, sent, outcome", [("resend", [[("a", 1)], [("a", 2)]], ("ok", 2)), ("hold", [[("a", 1)]], ("unsure", 1))])
def test_a_crash_between_sending_and_recording_is_told_apart(spark, tmp_path, monkeypatch, after_crash, sent, outcome):
    tables, receiver, write = Tables(str(tmp_path)), Receiver(), ledger.write_batch

    def crash(rows, path, batch_id):
        if path.endswith("deliveries"):
            raise KeyboardInterrupt
        write(rows, path, batch_id)

    monkeypatch.setattr(ledger, "write_batch", crash)
    with pytest.raises(KeyboardInterrupt):
        ledger.notify_batch(incidents(spark, "a"), 0, tables, receiver, after_crash=after_crash)
    monkeypatch.setattr(ledger, "write_batch", write)
    for _ in range(2):
        ledger.notify_batch(incidents(spark, "a"), 0, tables, receiver, after_crash=after_crash)
    assert receiver.got == sent and told(spark, tables, 0)["a"][:2] == outcome
    ledger.notify_batch(incidents(spark, "a"), 1, tables, receiver, after_crash=after_crash)
    assert receiver.got == sent
    with pytest.raises(ValueError):
        ledger.notify_batch(incidents(spark, "a"), 2, tables, receiver, after_crash="guess")


def test_a_batch_reads_the_one_before_it_and_no_older_one(spark, tmp_path):
    tables = Tables(str(tmp_path))
    for batch in range(4):
        ledger.notify_batch(incidents(spark, "a", f"only{batch}"), batch, tables)
    for name in ("outbox", "notified"):
        for old in range(3 if name == "notified" else 4):
            shutil.rmtree(f"{tables.path(name)}/batch_id={old}")
    ledger.notify_batch(incidents(spark, "only0", "a", "new"), 4, tables)
    assert [r.fingerprint for r in read_table(spark, tables.path("outbox"), OUTBOX).collect()] == ["new"]


def test_fingerprints_are_forgotten_after_the_horizon(spark, tmp_path):
    tables = Tables(str(tmp_path))
    ledger.notify_batch(incidents(spark, "a"), 0, tables, horizon="0 seconds")
    ledger.hand_on(spark, 1, tables)
    assert known(spark, tables, 0) == {"a"} and known(spark, tables, 1) == set()
    ledger.notify_batch(incidents(spark), 2, tables)
    assert read_table(spark, tables.path("outbox"), OUTBOX).count() == 1
