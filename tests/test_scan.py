"""The block scan against a plain loop, and the verdicts drawn from it."""

import random

import pytest
from pyspark.sql import functions as F

from jobvigil.config import DEFAULTS, Settings
from jobvigil.operators.detect import anomalies
from jobvigil.operators.ewma import ewma
from jobvigil.operators.metrics import DELTAS, ORDER, arrange_runs, latest_error_rate, metrics_state, running_metrics
from jobvigil.operators.ordered import BLOCK, ScanSpec, arrange, scan
from jobvigil.plans.flow import scored_runs


def loop(values, alpha):
    out, state = [], None
    for x in values:
        if x is None:
            out.append(None)
            continue
        if state is None:
            state = (x, 0.0, 1)
            z = 0.0
        else:
            mu = alpha * x + (1 - alpha) * state[0]
            sigma = alpha * abs(x - mu) + (1 - alpha) * state[1]
            state = (mu, sigma, state[2] + 1)
            z = (x - mu) / max(sigma, 1e-9)
        out.append((*state, z))
    return out


def shapes():
    rng = random.Random(5)
    return {
        "one hot key": [("a", rng.uniform(1, 100)) for _ in range(3000)] + [("b", rng.uniform(1, 9)) for _ in range(40)],
        "single rows": [(f"k{i:04d}", rng.uniform(1, 9)) for i in range(300)],
        "with gaps": [(rng.choice("abc"), rng.choice([None, rng.uniform(1, 50)])) for _ in range(900)],
        "mostly gaps": [("a", None)] * 400 + [("a", 5.0)] + [("a", None)] * 400 + [("a", 7.0), ("b", None)],
        "steps": [("a", 10.0 if i < 500 else 1000.0) for i in range(1000)],
    }


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize("blocks,alpha", [(1, 0.2), (13, 0.2), (37, 0.02)])
def test_scan_equals_loop(spark, name, blocks, alpha):
    rows = [(key, i, value) for i, (key, value) in enumerate(shapes()[name])]
    df = spark.createDataFrame(rows, "key string, seq long, value double").withColumn("one", F.lit(1).cast("bigint"))
    spec = ScanSpec("key", sums=("one", "value"), value="value", alpha=alpha)
    found = scan(arrange(df, "key", ["seq"], blocks), spec).collect()
    assert len(found) == len(rows)
    by_key = {}
    for key, seq, value in rows:
        by_key.setdefault(key, []).append((seq, value))
    expected = {}
    for key, series in by_key.items():
        count = total = 0
        for (seq, value), state in zip(series, loop([v for _, v in series], alpha)):
            count, total = count + 1, total + (value or 0.0)
            expected[seq] = (count, total, state)
    for row in found:
        count, total, state = expected[row.seq]
        assert row.running_one == count
        assert row.running_value == pytest.approx(total, rel=1e-12)
        if state is None:
            assert row.mu is None and row.observation is None
        else:
            mu, sigma, observation, z = state
            assert row.observation == observation
            assert row.mu == pytest.approx(mu, rel=1e-11)
            assert row.sigma == pytest.approx(sigma, rel=1e-9, abs=1e-9)
            # a gap at rounding noise counts as 0, which shows once sigma is near its floor
            assert row.z == pytest.approx(z, rel=1e-6, abs=2e-5 * abs(row.value))


def test_hot_key_is_split_even_at_one_instant(spark):
    """All rows share key and time; the tie-breaker still cuts them into blocks."""
    df = spark.range(8000).select(
        F.lit("a").alias("key"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id").cast("string").alias("id")
    )
    sizes = [r["count"] for r in arrange(df, "key", ["ts", "id"], 8).groupBy(BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8


def test_scan_does_not_shuffle(spark, runs):
    arranged = arrange_runs(runs([("a", 1.0)] * 20))
    plan = scan(arranged, ScanSpec("job_type", DELTAS, "observed_seconds"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_constant_series_is_never_anomalous(spark, runs):
    scored = scored_runs(runs([("POLICY_RENEWAL", 10.1)] * 50)).collect()
    assert all(r.z == 0.0 and not r.anomalous for r in scored)


def test_spike_after_normal_runs(spark, runs):
    rng = random.Random(42)
    quiet = [("POLICY_RENEWAL", 10 + rng.uniform(-1, 1)) for _ in range(20)]
    found = anomalies(scored_runs(runs(quiet + [("POLICY_RENEWAL", 50.0)]))).collect()
    assert [r.event_id for r in found] == ["e000020"]
    assert found[0].score > 3.5 and found[0].detector_name == "ewma"


def test_jitter_is_quiet_after_settling(spark, runs):
    rng = random.Random(42)
    scored = scored_runs(runs([("CLAIMS_INGEST", 10 + rng.uniform(-1, 1)) for _ in range(100)])).collect()
    assert not any(r.anomalous for r in scored if r.observation > 30)


def test_cold_start_and_warmup(spark, runs):
    rows = {r.observation: r for r in scored_runs(runs([("CLAIMS_INGEST", 10.0)] * 8 + [("CLAIMS_INGEST", 500.0)] * 1)).collect()}
    assert rows[1].score == 0.0 and "cold start" in rows[1].reason and not rows[1].anomalous
    assert rows[9].score > 3.5 and not rows[9].anomalous and "warm-up (9/10" in rows[9].reason
    tenth = scored_runs(runs([("CLAIMS_INGEST", 10.0)] * 9 + [("CLAIMS_INGEST", 500.0)])).filter("observation = 10").first()
    assert tenth.anomalous and tenth.reason.startswith("duration z-score=")


def test_keys_are_independent(spark, runs):
    rng = random.Random(7)
    quiet = [(job, 10 + rng.uniform(-1, 1)) for _ in range(30) for job in ("POLICY_RENEWAL", "CLAIMS_INGEST")]
    rows = quiet + [("POLICY_RENEWAL", 50.0), ("CLAIMS_INGEST", 10.2)]
    late = {r.job_type: r.anomalous for r in scored_runs(runs(rows)).filter("observation = 31").collect()}
    assert late == {"POLICY_RENEWAL": True, "CLAIMS_INGEST": False}


def test_score_stays_below_one_over_alpha(spark, runs):
    rng = random.Random(3)
    quiet = [("CLAIMS_INGEST", 10 + rng.uniform(-1, 1)) for _ in range(30)]
    last = scored_runs(runs(quiet + [("CLAIMS_INGEST", 1e10)])).filter("observation = 31").first()
    assert 4.9 < last.score < 5.0


def test_failed_runs_count_but_are_not_observed(spark, runs):
    rows = running_metrics(runs([("CLAIMS_INGEST", 10.0), ("CLAIMS_INGEST", None), ("CLAIMS_INGEST", 20.0)]))
    last = rows.orderBy(F.desc("ts")).first()
    assert (last.running_count, last.running_duration_seconds, last.running_error_count, last.running_rows) == (3, 30.0, 3, 2000)
    assert last.rolling_mean_duration == 10.0


def test_state_and_gauges(spark, runs):
    events = runs([("CLAIMS_INGEST", 10.0), ("CLAIMS_INGEST", None), ("ANNUITY_PAYOUT", 4.0)])
    state = {r.job_type: r for r in metrics_state(events).collect()}
    assert state["CLAIMS_INGEST"].run_count == 2 and state["CLAIMS_INGEST"].sum_error_count == 1
    rates = {r.job_type: r.error_rate for r in latest_error_rate(events).collect()}
    assert rates == {"CLAIMS_INGEST": 1.0, "ANNUITY_PAYOUT": 0.002, "POLICY_RENEWAL": 0.0}


def test_other_alpha_and_many_keys(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ("l_shipdate", "l_orderkey", "l_linenumber")
    found = ewma(items, "l_quantity", "l_suppkey", order, 0.5).orderBy("l_suppkey", *order).collect()
    by_key = {}
    for r in found:
        by_key.setdefault(r.l_suppkey, []).append(r)
    for rows in by_key.values():
        for row, (mu, sigma, n, z) in zip(rows, loop([r.l_quantity for r in rows], 0.5)):
            assert row.observation == n and row.mu == pytest.approx(mu) and row.sigma == pytest.approx(sigma, abs=1e-9)


def test_settings_are_the_documented_defaults():
    assert DEFAULTS == Settings(
        ewma_alpha=0.2, ewma_threshold=3.5, ewma_warmup=10, forest_trees=100, forest_sample=256,
        forest_threshold=0.65, forest_min_rows=10, dedupe_ttl="24 hours",
    )
    assert ORDER == ("ts", "event_id")
