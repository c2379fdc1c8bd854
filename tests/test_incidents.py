"""Severity, incidents, summaries, notifications and the forest."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobvigil.config import FOREST, Settings
from jobvigil.functions.scores import ERROR_RATE_BANDS, INCIDENT_BANDS, SCORE_BANDS, severity, status_band
from jobvigil.operators import forest, incidents, notify
from jobvigil.operators.detect import observed_features, score
from jobvigil.plans.flow import Tables, find_incidents, load_forest, revised_incidents, train_forest
from jobvigil.schema import INCIDENTS
from jobvigil.sinks.tables import write_answers, write_incidents
from jobvigil.streaming.stream import run_answers


def test_severity_bands(spark):
    cases = [(7.5, "ewma", "HIGH"), (5.0, "ewma", "MEDIUM"), (3.8, "ewma", "LOW"), (4.0, "ewma", "MEDIUM"),
             (6.0, "ewma", "HIGH"), (0.9, FOREST, "HIGH"), (0.7, FOREST, "MEDIUM"), (0.5, FOREST, "LOW"),
             (0.6, FOREST, "MEDIUM"), (0.8, "own", "HIGH")]
    df = spark.createDataFrame(cases, "score double, name string, want string")
    assert df.filter(severity(F.col("score"), F.col("name")) != F.col("want")).count() == 0
    forced = spark.createDataFrame([(5.0,)], "s double").select(severity(F.col("s"), F.lit(FOREST), "zscore").alias("x"))
    assert forced.first().x == "MEDIUM"


def test_status_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.2,), (3.5,), (4.0,), (6.0,)], "v double")
    def colours(bands):
        return [r.c for r in df.select(status_band(F.col("v"), bands).alias("c")).collect()]
    assert colours(ERROR_RATE_BANDS) == ["green", "yellow", "red", "red", "red", "red"]
    assert colours(SCORE_BANDS) == ["green", "green", "green", "yellow", "orange", "red"]
    assert colours(INCIDENT_BANDS) == ["green", "green", "green", "red", "red", "red"]


@pytest.fixture(scope="module")
def report(spark):
    row = [("e1", "ANNUITY_PAYOUT", "2024-06-01 14:32:00", 7.5, "ewma", "why", 120.0, 100.0, 0.01, 5000)]
    df = spark.createDataFrame(row, "event_id string, job_type string, t string, score double, detector_name string, "
                                    "reason string, duration_seconds double, rolling_mean_duration double, "
                                    "error_rate double, row_count long")
    return incidents.to_incidents(df.withColumn("ts", F.col("t").cast("timestamp")))


def test_full_and_degraded_incident(spark, report):
    full = incidents.summarize_static(report).first()
    assert full.asDict().keys() == set(INCIDENTS.names)
    assert full.summary == "Anomaly detected in ANNUITY_PAYOUT — duration 120.0s vs mean 100.0s"
    assert full.likely_cause == "Likely cause: job duration spike detected by ewma"
    assert full.suggested_actions == ["Inspect job logs", "Check upstream data volumes"]
    assert full.severity == "HIGH" and full.llm_provider == "noop" and not full.llm_unavailable
    assert full.fingerprint == "7f6c88bcbc2c13343eaea47400fa5ce2b89449a033dde41039201e8f6d0882ab"
    assert incidents.enrich(report, incidents.static_summary(report)).first() == full
    bare = incidents.enrich(report, incidents.static_summary(report).limit(0)).first()
    assert bare.summary is None and bare.likely_cause is None and bare.suggested_actions == []
    assert bare.llm_unavailable and bare.llm_provider == "unavailable" and bare.incident_id == full.incident_id


def test_prompt(report):
    row = incidents.with_prompt(report).first()
    assert row.prompt == ("Job: ANNUITY_PAYOUT | AnomalyScore: 7.5000 | Duration: 120.0s (rolling mean 100.0s)"
                          " | ErrorRate: 0.0100 | Rows: 5000 | Detector: ewma")
    assert row.system_text.count("\n") == 2


def test_answers(spark):
    cases = {
        '{"summary":"s","likelyCause":"c","severity":"HIGH","suggestedActions":["x","y"]}': ("s", "c", ["x", "y"], True),
        '```json\n{"summary":"s"}\n```': ("s", "", [], True),
        '  ```\n{"likelyCause":"c"}```': ("", "c", [], True),
        '{"severity":"URGENT"}': (None, None, None, False),
        "not json": (None, None, None, False),
        '{"suggestedActions":"z","summary":"s"}': ("s", "", [], True),
    }
    df = spark.createDataFrame([(a,) for a in cases], "answer string").withColumn("incident_id", F.col("answer"))
    for row in incidents.decode_answers(df).collect():
        assert (row.summary, row.likely_cause, row.suggested_actions, row.ok) == cases[row.incident_id]


def test_caller_summaries_and_failures(spark, report):
    def good(batch):
        return pd.DataFrame({"summary": batch["job_type"], "likely_cause": "c", "suggested_actions": [["a"]] * len(batch)})

    def bad(batch):
        raise RuntimeError("no answer")

    assert incidents.enrich(report, incidents.summarize_with(report, good, "mine")).first().llm_provider == "mine"
    assert incidents.enrich(report, incidents.summarize_with(report, bad, "mine")).first().llm_unavailable
    assert incidents.summarize_with(report, good, "mine").first().error is None
    failed = incidents.summarize_with(report, bad, "mine").first()
    assert (failed.ok, failed.error, failed.suggested_actions) == (False, "RuntimeError: no answer", None)


def test_payload_is_json(spark, report):
    full = incidents.summarize_static(report).withColumn("summary", F.lit('a "quoted"\r\nback\\slash'))
    body = json.loads(notify.with_payload(full).first().payload)
    assert body["text"] == "*[HIGH]* Anomaly in *ANNUITY_PAYOUT* — score 7.5000 (detector: ewma)"
    part = body["attachments"][0]
    assert part["color"] == "#D00000"
    assert part["fields"][0] == {"title": "Summary", "value": 'a "quoted"\nback\\slash', "short": False}
    empty = incidents.enrich(report, incidents.static_summary(report).limit(0))
    fields = json.loads(notify.with_payload(empty).first().payload)["attachments"][0]["fields"]
    assert [f["value"] for f in fields[:2]] == ["Anomaly detected (LLM unavailable)", "Unknown"]
    assert fields[3]["value"] == "unavailable"


def test_one_notification_per_fingerprint(spark, report):
    twice = report.unionByName(report.withColumns({"incident_id": F.lit("zz"), "detected_at": F.col("detected_at") + F.expr("INTERVAL 5 MINUTES")}))
    assert [r.incident_id for r in notify.notify_dedupe(twice).collect()] == [report.first().incident_id]
    sent = report.select("fingerprint", F.lit(False).alias("ok"))
    assert notify.undelivered(twice, sent).count() == 1
    assert notify.undelivered(twice, sent.withColumn("ok", F.lit(True))).count() == 0


def test_deliver_reports_failure(report):
    def broken(_):
        raise OSError("down")

    seen = []
    assert notify.deliver(report, lambda df: seen.append(df.count())) and seen == [1]
    assert not notify.deliver(report, broken)


def test_end_to_end_spike(spark, runs):
    rng = random.Random(11)
    quiet = [("ANNUITY_PAYOUT", rng.uniform(160, 220)) for _ in range(10)]
    found = find_incidents(runs(quiet + [("ANNUITY_PAYOUT", rng.uniform(160, 220) * 5.2)])).collect()
    assert [r.job_type for r in found] == ["ANNUITY_PAYOUT"]
    assert found[0].severity == "MEDIUM" and found[0].detector_name == "ewma" and len(found[0].incident_id) == 64


def history(seed):
    rng = np.random.default_rng(seed)
    n = 300
    return pd.DataFrame({
        "event_id": [f"e{i}" for i in range(n)],
        "duration_seconds": rng.normal(10, 2, n), "error_rate": np.maximum(0, rng.normal(0, 0.005, n)),
        "row_count": rng.normal(1000, 100, n), "hour_of_day": rng.integers(0, 24, n), "day_of_week": rng.integers(1, 8, n),
    })


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_tells_spike_from_normal(spark, seed):
    matrix = forest.training_matrix(spark.createDataFrame(history(seed)))
    model = forest.fit_forest(matrix, seed=seed).cache()
    probe = spark.createDataFrame([(500.0, 0.01, 1000, 10, 2), (10.0, 0.01, 1000, 10, 2)], ", ".join(
        f"{c} double" if c in ("duration_seconds", "error_rate") else f"{c} int" for c in forest.FEATURES))
    spike, normal = [r.score for r in forest.forest_score(probe, model).orderBy(F.desc("duration_seconds")).collect()]
    assert 0 < normal < 0.6 < spike < 1
    again = forest.fit_forest(matrix, seed=seed)
    assert again.exceptAll(model).count() == 0
    verdict = forest.forest_verdict(forest.forest_score(probe, model), Settings(forest_threshold=0.6))
    assert {r.anomalous for r in verdict.filter("duration_seconds = 500").collect()} == {True}
    assert verdict.first().reason.endswith("(threshold=0.60)")


def test_forest_draws(spark):
    matrix = spark.range(50_000).select(F.col("id").cast("string").alias("row_key"),
                                        F.array(F.col("id").cast("double")).alias("features"))
    drawn = forest.draw_samples(matrix, 4, 256, 3).groupBy("tree").agg(
        F.count("*").alias("n"), F.count_distinct("row_key").alias("d"), F.avg(F.col("features")[0]).alias("m")).collect()
    assert len(drawn) == 4 and all(r.n == r.d == 256 for r in drawn)
    assert all(20_000 < r.m < 30_000 for r in drawn)


@pytest.mark.parametrize("rows, trees, sample", [(20, 3, 64), (5000, 7, 16), (60_000, 5, 32)])
def test_draws_are_the_lowest_numbers_however_rows_are_dealt(spark, rows, trees, sample):
    frame = spark.range(rows).select(F.concat(F.lit("k"), F.col("id") % (rows - 5)).alias("row_key"), F.array(F.col("id").cast("double")).alias("features"))
    hashed = frame.select("row_key", F.xxhash64(F.lit("draw 3"), "row_key").alias("h")).collect()
    keys, hashes = [r.row_key for r in hashed], np.array([r.h for r in hashed])
    want = {t: sorted(k for _, k in sorted(zip(forest.turns(hashes, t).tolist(), keys))[:sample]) for t in range(trees)}
    for parts in (1, 6):
        drawn = forest.draw_samples(frame.repartition(parts), trees, sample, 3).groupBy("tree").agg(F.sort_array(F.collect_list("row_key")).alias("keys"))
        assert {r.tree: r["keys"] for r in drawn.collect()} == want


def test_forests_that_are_too_large_are_refused_before_they_grow(spark):
    matrix = spark.createDataFrame([("a", [1.0])], "row_key string, features array<double>")
    with pytest.raises(ValueError):
        forest.fit_forest(matrix, trees=4000, sample=1024)


def test_gate_fallback_and_training(spark, runs, tmp_path):
    rng = random.Random(2)
    rows = [("POLICY_RENEWAL", rng.uniform(9, 11)) for _ in range(20)] + [("POLICY_RENEWAL", 80.0)]
    features = observed_features(runs(rows))
    few = forest.training_matrix(features.limit(9))
    assert forest.fit_or_none(few) is None
    last = score(features, FOREST).filter("observation = 21").first()
    assert last.detector_name == FOREST and last.anomalous
    assert last.reason.startswith("isolation-forest not fitted — ewma fallback: duration z-score=")
    path = str(tmp_path / "model")
    assert train_forest(features, path)
    fitted = score(features, FOREST, load_forest(spark, path)).filter("observation = 21").first()
    assert 0 < fitted.score < 1 and fitted.reason.startswith("isolation-forest score=")
    with pytest.raises(ValueError):
        score(features, "other")
    with pytest.raises(ValueError):
        score(features, lambda df: df)


def stored(spark, *ids):
    given = {"llm_unavailable": F.lit(True), "llm_provider": F.lit("unavailable"), "incident_id": F.col("incident_id")}
    rows = spark.createDataFrame([(i,) for i in ids], "incident_id string")
    return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INCIDENTS))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_the_last_usable_answer_counts_in_any_order_of_batches(spark, tmp_path, order):
    tables, form = Tables(str(tmp_path)), "incident_id string, answered_at timestamp, ok boolean, provider string, summary string, likely_cause string, suggested_actions array<string>"
    noon = datetime(2024, 6, 3, 12)
    batches = [
        [("a", noon, True, "p", "first", "c", ["x"]), ("b", noon, False, "p", "no", "c", None), (None, noon, True, "p", "nobody", "c", None)],
        [("a", noon + timedelta(hours=1), True, "p", "second", None, None), ("unknown", noon, True, "p", "s", "c", None), ("t", noon, True, "p", "x", "c", None)],
        [("a", noon + timedelta(hours=2), False, "p", "third", "c", None), ("a", None, True, "p", "undated", "c", None), ("a", noon, None, "p", "zz", "c", None), ("t", noon, True, "p", "y", "c", None)],
    ]
    write_incidents(stored(spark, "a", "b", "c", "t"), tables.path("incidents"), 7)
    untouched = revised_incidents(spark, tables).collect()
    assert len(untouched) == 4 and all(r.llm_unavailable for r in untouched)  # no answers table yet
    for batch_id, number in enumerate((*order, order[0])):  # the last is a repeat under a new id
        write_answers(spark.createDataFrame(batches[number], form), tables.path("answers"), batch_id)
    got = {r.incident_id: r for r in revised_incidents(spark, tables).collect()}
    assert sorted(got) == ["a", "b", "c", "t"]
    assert (got["a"].summary, got["a"].suggested_actions, got["a"].llm_unavailable, got["a"].llm_provider) == ("second", [], False, "p")
    assert got["t"].summary == "y" and got["b"].llm_unavailable and got["c"].summary is None and got["b"].llm_provider == "unavailable"


def test_a_stream_of_answers_revises_and_refuses_another_run(spark, tmp_path):
    tables, source, form = Tables(str(tmp_path / "t")), str(tmp_path / "in"), "incident_id string, answer string, provider string, answered_at timestamp"

    def arrive(*rows):
        spark.createDataFrame(list(rows), form).coalesce(1).write.mode("append").parquet(source)
        run_answers(spark.readStream.schema(form).parquet(source), tables, str(tmp_path / "progress")).awaitTermination()

    noon = datetime(2024, 6, 3, 12)
    write_incidents(stored(spark, "a", "b"), tables.path("incidents"))
    arrive(("b", '{"summary":"late","likelyCause":"c"}', "p", noon), ("a", "not json", "p", noon))
    arrive(("b", "```json\n{}\n```", "p", noon - timedelta(hours=1)))
    got = {r.incident_id: (r.summary, r.llm_unavailable) for r in revised_incidents(spark, tables).collect()}
    assert got == {"a": (None, True), "b": ("late", False)}
    with pytest.raises(StreamingQueryException):
        run_answers(spark.readStream.schema(form).parquet(source), tables, str(tmp_path / "other")).awaitTermination()
