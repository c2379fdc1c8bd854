"""Plain SQL over the same tables, one statement per query, written independently of Spark.

The statements go straight to the source columns: what the queries get by way of
JSON, duplicates and ordered scans is computed here with joins, window functions
and one recursive table.
"""

from __future__ import annotations


def _stamp(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expression.split('.')[-1]}"


KEYED = """keyed AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""

RUNS = KEYED + """,
named AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'v1' AS schema_version,
    CASE user_id % 3 WHEN 0 THEN 'POLICY_RENEWAL' WHEN 1 THEN 'ANNUITY_PAYOUT' ELSE 'CLAIMS_INGEST' END AS job_type,
    ts,
    CASE event_type WHEN 'click' THEN 'JOB_STARTED' WHEN 'view' THEN 'JOB_PROGRESS'
      WHEN 'error' THEN 'JOB_FAILED' ELSE 'JOB_COMPLETED' END AS event_type,
    value, k, CAST(1000 + 10 * k AS BIGINT) AS volume
  FROM keyed),
runs AS (
  SELECT event_id, schema_version, job_type, ts, event_type, 'run-' || event_id AS run_id,
    CASE WHEN event_type IN ('JOB_STARTED', 'JOB_COMPLETED') THEN 'export.csv' END AS source_file,
    CASE WHEN event_type = 'JOB_STARTED' THEN volume END AS expected_rows,
    CASE WHEN event_type = 'JOB_PROGRESS' THEN volume END AS rows_so_far,
    CASE WHEN event_type = 'JOB_PROGRESS' THEN k END AS progress_percent,
    CASE WHEN event_type = 'JOB_COMPLETED' THEN volume END AS rows_processed,
    CASE WHEN event_type = 'JOB_COMPLETED' THEN value END AS duration_seconds,
    CASE WHEN event_type = 'JOB_COMPLETED' THEN k % 7 END AS error_count,
    CASE WHEN event_type = 'JOB_FAILED' THEN 'SOURCE_ABSENT' END AS error_code,
    CASE WHEN event_type = 'JOB_FAILED' THEN 'source file missing' END AS error_message,
    CASE WHEN event_type = 'JOB_FAILED' THEN k % 4 END AS retry_count
  FROM named)"""

TEXTS = RUNS + """,
texts AS (
  SELECT *, '{"eventId":"' || event_id || '","schemaVersion":"v1","jobType":"' || job_type || '","timestamp":"'
    || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","payload":{"eventType":"' || event_type || '","runId":"' || run_id
    || '"' || CASE event_type
      WHEN 'JOB_STARTED' THEN ',"expectedRows":' || expected_rows || ',"sourceFile":"export.csv"'
      WHEN 'JOB_PROGRESS' THEN ',"rowsProcessedSoFar":' || rows_so_far || ',"progressPercent":' || progress_percent
      WHEN 'JOB_COMPLETED' THEN ',"rowsProcessed":' || rows_processed || ',"durationSeconds":' || duration_seconds
        || ',"errorCount":' || error_count || ',"sourceFile":"export.csv"'
      ELSE ',"errorCode":"SOURCE_ABSENT","errorMessage":"source file missing","retryCount":' || retry_count
      END || '}}' AS value
  FROM runs)"""

DELIVERED = TEXTS + """,
delivered AS (
  SELECT event_id, value, ts AS happened, CAST(NULL AS INTEGER) AS attempt, CAST(NULL AS VARCHAR) AS failure, 0 AS entries
  FROM texts
  UNION ALL
  SELECT event_id, value, ts + INTERVAL 1 HOUR, 1, NULL, 1 FROM texts WHERE event_type = 'JOB_COMPLETED'
  UNION ALL
  SELECT event_id, '{ broken record ' || event_id, ts, retry_count, 'cannot read record ' || event_id, 3
  FROM texts WHERE event_type = 'JOB_FAILED')"""

DELTAS = RUNS + """,
deltas AS (
  SELECT *, CAST(1 AS BIGINT) AS d_runs,
    CASE WHEN event_type = 'JOB_COMPLETED' THEN duration_seconds ELSE CAST(0 AS DOUBLE) END AS d_duration,
    CAST(CASE WHEN event_type = 'JOB_COMPLETED' THEN error_count ELSE 1 END AS BIGINT) AS d_errors,
    CAST(CASE WHEN event_type = 'JOB_COMPLETED' THEN rows_processed ELSE 0 END AS BIGINT) AS d_rows
  FROM runs WHERE event_type IN ('JOB_COMPLETED', 'JOB_FAILED'))"""

STATE_COLUMNS = """CAST(sum(d_runs) AS BIGINT) AS run_count, round(sum(d_duration), 4) AS sum_duration_seconds,
  CAST(sum(d_errors) AS BIGINT) AS sum_error_count, CAST(sum(d_rows) AS BIGINT) AS sum_rows, """ + _stamp("max(ts)", "updated_at")

RUNNING = DELTAS + """,
running AS (
  SELECT *, CAST(sum(d_runs) OVER w AS BIGINT) AS running_count, sum(d_duration) OVER w AS running_duration_seconds,
    CAST(sum(d_errors) OVER w AS BIGINT) AS running_error_count, CAST(sum(d_rows) OVER w AS BIGINT) AS running_rows
  FROM deltas WINDOW w AS (PARTITION BY job_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
rates AS (
  SELECT *, running_duration_seconds / running_count AS rolling_mean_duration,
    CASE WHEN running_rows = 0 THEN 0.0 ELSE CAST(running_error_count AS DOUBLE) / running_rows END AS error_rate
  FROM running),
features AS (
  SELECT *, rows_processed AS row_count, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) AS INTEGER) AS day_of_week,
    row_number() OVER (PARTITION BY job_type ORDER BY ts, event_id) AS n
  FROM rates WHERE event_type = 'JOB_COMPLETED')"""

# The recursion walks all keys at once, one observation further per step.
WALK = """walk AS (
  SELECT grp, n, x AS mu, CAST(0 AS DOUBLE) AS sigma, CAST(0 AS DOUBLE) AS z FROM series WHERE n = 1
  UNION ALL
  SELECT grp, n, mu, sigma, (x - mu) / greatest(sigma, 1e-9) FROM (
    SELECT grp, n, x, mu, CAST(0.2 AS DOUBLE) * abs(x - mu) + CAST(0.8 AS DOUBLE) * before_sigma AS sigma FROM (
      SELECT s.grp, s.n, s.x, CAST(0.2 AS DOUBLE) * s.x + CAST(0.8 AS DOUBLE) * w.mu AS mu, w.sigma AS before_sigma
      FROM walk w JOIN series s ON s.grp = w.grp AND s.n = w.n + 1)))"""

SCORED = RUNNING + """,
series AS (SELECT job_type AS grp, n, duration_seconds AS x FROM features),
""" + WALK + """,
scored AS (
  SELECT f.*, w.mu, w.sigma, w.z, abs(w.z) AS score, 'ewma' AS detector_name,
    CASE WHEN f.n = 1 THEN 'cold start — seeding EWMA state'
      WHEN f.n < 10 THEN printf('warm-up (%d/10 observations) — z=%.2f not scored yet', f.n, w.z)
      ELSE printf('duration z-score=%.2f (mu=%.2fs, sigma=%.2fs)', w.z, w.mu, w.sigma) END AS reason
  FROM features f JOIN walk w ON w.grp = f.job_type AND w.n = f.n)"""

FOUND = SCORED + """,
found AS (
  SELECT *, sha256(event_id || '|ewma') AS incident_id, {severity} AS severity
  FROM scored WHERE n >= 10 AND score > {threshold})"""
BY_ZSCORE = "CASE WHEN score < 4 THEN 'LOW' WHEN score < 6 THEN 'MEDIUM' ELSE 'HIGH' END"
BY_UNIT = "CASE WHEN score < 0.6 THEN 'LOW' WHEN score < 0.8 THEN 'MEDIUM' ELSE 'HIGH' END"
HOUR_TEXT = "strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ')"

REPORTS = SCORED + f""",
reports AS (
  SELECT event_id, job_type, ts, row_count, duration_seconds, sha256(event_id || '|isolation-forest') AS incident_id,
    {BY_UNIT} AS severity, sha256(job_type || '|' || ({BY_UNIT}) || '|' || {HOUR_TEXT}) AS fingerprint,
    round(score, 8) AS score, round(error_rate, 8) AS error_rate,
    round(rolling_mean_duration, 6) AS rolling_mean_duration, CAST(hour(ts) % 6 AS INTEGER) AS h
  FROM scored)"""

# Six micro-batches by id: the mean of a job type walks from batch to batch, and by time within each.
BATCHED = RUNS + """,
numbered AS (
  SELECT *, CAST(event_id AS BIGINT) % 6 AS batch_id,
    row_number() OVER (PARTITION BY job_type ORDER BY CAST(event_id AS BIGINT) % 6, ts, event_id) AS n
  FROM runs WHERE event_type = 'JOB_COMPLETED'),
series AS (SELECT job_type AS grp, n, duration_seconds AS x FROM numbered),
""" + WALK + f""",
graded AS (
  SELECT f.*, abs(w.z) AS score, sha256(event_id || '|ewma') AS incident_id FROM numbered f JOIN walk w ON w.grp = f.job_type AND w.n = f.n
  WHERE f.n >= 10 AND abs(w.z) > 1.5),
told AS (
  SELECT *, sha256(job_type || '|' || ({BY_ZSCORE}) || '|' || {HOUR_TEXT}) AS fingerprint FROM graded),
firsts AS (
  SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY fingerprint, batch_id ORDER BY ts, incident_id) = 1)"""

ANSWERED = REPORTS + """,
answered AS (
  SELECT *, CASE h WHEN 0 THEN 'run ' || event_id || ' slow' WHEN 1 THEN 'fenced ' || event_id END AS summary,
    CASE h WHEN 0 THEN 'load' WHEN 1 THEN '' END AS likely_cause,
    CASE h WHEN 0 THEN 'check; retry' WHEN 1 THEN '' END AS actions, h < 2 AS ok
  FROM reports)"""


def _recursive(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def _found(threshold: float) -> str:
    return FOUND.format(threshold=threshold, severity=BY_ZSCORE)


def _incidents(threshold: float) -> str:
    return _recursive(_found(threshold), f"""SELECT incident_id, 'v1' AS schema_version, job_type,
  round(score, 6) AS anomaly_score, detector_name, sha256(job_type || '|' || severity || '|' || {HOUR_TEXT}) AS fingerprint,
  severity, 'Likely cause: job duration spike detected by ewma' AS likely_cause,
  'Inspect job logs; Check upstream data volumes' AS suggested_actions, false AS llm_unavailable,
  {_stamp("ts", "detected_at")}, 'noop' AS llm_provider FROM found""")


def _windows(source: str, at: str, width: int, slide: int) -> str:
    return f"""placed AS (
  SELECT s.*, make_timestamp((epoch_us({at}) // {slide * 1_000_000} - step) * {slide * 1_000_000}) AS window_start
  FROM {source} s CROSS JOIN (SELECT unnest(range(0, {width // slide})) AS step))"""


EVENT_COLUMNS = f"""event_id, schema_version, job_type, {_stamp("ts")}, event_type, run_id, source_file, expected_rows,
  rows_so_far, progress_percent, rows_processed, duration_seconds, error_count, error_code, error_message, retry_count"""

DEAD = f"""SELECT sha256(epoch_us(happened) || '|1|' || value) AS event_id, value AS raw_payload, 'not_json' AS error, attempt AS retry_count,
  {_stamp("happened", "failed_at")} FROM delivered WHERE failure IS NOT NULL"""

# One decimal, halves away from zero, of a number with few decimals.
ONE_DECIMAL = "CAST(round(CAST({0} AS DECIMAL(18, 6)), 1) AS VARCHAR)"
FOUR_DECIMALS = "CAST(round(CAST({0} AS DECIMAL(18, 8)), 4) AS VARCHAR)"


def _score_text(column: str) -> str:
    return FOUR_DECIMALS.format(column)


PAYLOAD = f"""'{{"text":"*[' || severity || ']* Anomaly in *' || job_type || '* — score ' || {_score_text("score")}
  || ' (detector: isolation-forest)","attachments":[{{"color":"'
  || CASE severity WHEN 'HIGH' THEN '#D00000' WHEN 'MEDIUM' THEN '#FF8800' ELSE '#FFCC00' END
  || '","fields":[{{"title":"Summary","value":"' || coalesce(summary, 'Anomaly detected (LLM unavailable)')
  || '","short":false}},{{"title":"Likely Cause","value":"' || coalesce(likely_cause, 'Unknown')
  || '","short":false}},{{"title":"Incident ID","value":"' || incident_id
  || '","short":true}},{{"title":"LLM Provider","value":"' || CASE WHEN ok THEN 'remote' ELSE 'unavailable' END
  || '","short":true}}]}}]}}'"""

FALLBACK = "'isolation-forest not fitted — ewma fallback: ' || reason"
JOBS = "(VALUES ('POLICY_RENEWAL'), ('ANNUITY_PAYOUT'), ('CLAIMS_INGEST')) jobs(job_type)"
LEVELS = "(VALUES ('LOW'), ('MEDIUM'), ('HIGH')) levels(severity)"

STATEMENTS: dict[str, str] = {
    "published_events": f"WITH {TEXTS} SELECT event_id, job_type AS key, value FROM texts",
    "decoded_events": f"""WITH {RUNS} SELECT {EVENT_COLUMNS} FROM (
  SELECT * FROM runs UNION ALL SELECT * FROM runs WHERE event_type = 'JOB_COMPLETED')""",
    "rejected_records": f"""WITH {DELIVERED} SELECT value, {_stamp("happened", "timestamp")}, 'not_json' AS reject_reason
  FROM delivered WHERE failure IS NOT NULL""",
    "dead_letters_of_rejects": f"WITH {DELIVERED} {DEAD}",
    "dead_letters_of_topic": f"""WITH {DELIVERED}, put AS (
  SELECT *, CASE WHEN failure IS NULL THEN event_id ELSE sha256(epoch_us(happened) || '|1|' || value) END AS id FROM delivered)
SELECT id AS event_id, sha256(value) AS payload_hash, coalesce(failure, 'unknown') AS error,
  coalesce(attempt, 0) AS retry_count, {_stamp("happened", "failed_at")}
FROM put QUALIFY row_number() OVER (PARTITION BY id ORDER BY happened DESC) = 1""",
    "dead_letter_depth": """WITH failed AS (SELECT count(*) AS records FROM events WHERE event_type = 'error')
SELECT 'not_json' AS reject_reason, records FROM failed UNION ALL SELECT 'all', records FROM failed""",
    "next_attempt_headers": f"""WITH {DELIVERED} SELECT sha256(value) AS value_hash, coalesce(attempt, 0) AS retry_count,
  coalesce(attempt, 0) + 1 AS next_count, CASE entries WHEN 3 THEN 2 ELSE 1 END AS header_count,
  coalesce(failure, 'unknown') AS error FROM delivered""",
    "completed_events": f"WITH {RUNS} SELECT {EVENT_COLUMNS} FROM runs WHERE event_type = 'JOB_COMPLETED'",
    "unique_events": f"WITH {RUNS} SELECT {EVENT_COLUMNS} FROM runs",
    "unique_users_per_day": f"""WITH RECURSIVE kept AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL
  SELECT e.user_id, min(e.ts) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 24 HOUR
  GROUP BY e.user_id)
SELECT event_id, user_id, {_stamp("ts")}, event_type, value, props FROM events JOIN kept USING (user_id, ts)
QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1""",
    "events_accepted_again": f"""WITH RECURSIVE {RUNS}, kept AS (
  SELECT job_type, min(ts) AS ts FROM runs GROUP BY job_type
  UNION ALL
  SELECT r.job_type, min(r.ts) FROM kept k JOIN runs r ON r.job_type = k.job_type AND r.ts >= k.ts + INTERVAL 6 HOUR
  GROUP BY r.job_type)
SELECT event_id, job_type, {_stamp("ts")} FROM runs JOIN kept USING (job_type, ts)
QUALIFY row_number() OVER (PARTITION BY job_type, ts ORDER BY event_id) = 1""",
    "delivery_uniqueness": """SELECT count(*) + count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS deliveries,
  count(*) AS unique_events, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS duplicates FROM events""",
    "events_not_seen_before": f"""WITH {RUNS} SELECT event_id, job_type, {_stamp("ts")} FROM runs
WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'JOB_FAILED'""",
    "metric_deltas": f"WITH {DELTAS} SELECT event_id, job_type, d_runs, d_duration, d_errors, d_rows FROM deltas",
    "metrics_state": f"""WITH {DELTAS} SELECT job_type, {STATE_COLUMNS},
  round(sum(d_duration) / sum(d_runs), 6) AS mean_duration_seconds,
  round(CAST(sum(d_errors) AS DOUBLE) / CAST(sum(d_rows) AS DOUBLE), 9) AS error_rate FROM deltas GROUP BY job_type""",
    "metrics_state_lookup": f"""WITH {DELTAS} SELECT job_type, {STATE_COLUMNS} FROM deltas
WHERE job_type = 'CLAIMS_INGEST' GROUP BY job_type""",
    "metrics_state_daily": f"""WITH {DELTAS} SELECT {_stamp("CAST(date_trunc('day', ts) AS TIMESTAMP)", "bucket")}, job_type,
  {STATE_COLUMNS} FROM deltas GROUP BY job_type, date_trunc('day', ts)""",
    "metrics_state_merged": f"WITH {DELTAS} SELECT job_type, {STATE_COLUMNS} FROM deltas GROUP BY job_type",
    "events_processed": f"""WITH {RUNS} SELECT job_type, CASE event_type WHEN 'JOB_STARTED' THEN 'JobStarted'
  WHEN 'JOB_PROGRESS' THEN 'JobProgress' WHEN 'JOB_FAILED' THEN 'JobFailed' ELSE 'JobCompleted' END AS event_class,
  count(*) AS events FROM runs GROUP BY job_type, event_type""",
    "duration_stats": f"""WITH {RUNS} SELECT job_type, count(*) AS runs,
  CAST(sum(CAST(floor(duration_seconds * 1000) AS BIGINT)) AS DOUBLE) / 1000 AS sum_seconds,
  max(floor(duration_seconds * 1000)) / 1000 AS max_seconds
FROM runs WHERE event_type = 'JOB_COMPLETED' GROUP BY job_type""",
    "latest_error_rate": f"""WITH {DELTAS}, newest AS (
  SELECT job_type, CASE WHEN event_type = 'JOB_FAILED' THEN 1.0 ELSE CAST(error_count AS DOUBLE) / rows_processed END AS rate
  FROM deltas QUALIFY row_number() OVER (PARTITION BY job_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT jobs.job_type, CAST(round(coalesce(rate, 0.0), 9) AS DOUBLE) AS error_rate FROM {JOBS} LEFT JOIN newest USING (job_type)""",
    "latest_anomaly_score": _recursive(SCORED, f""", newest AS (
  SELECT job_type, score FROM scored QUALIFY row_number() OVER (PARTITION BY job_type ORDER BY n DESC) = 1)
SELECT jobs.job_type, round(coalesce(score, 0.0), 6) AS score FROM {JOBS} LEFT JOIN newest USING (job_type)"""),
    "running_metrics": f"""WITH {RUNNING} SELECT event_id, job_type, running_count,
  round(running_duration_seconds, 4) AS running_duration_seconds, running_error_count, running_rows,
  round(rolling_mean_duration, 6) AS rolling_mean_duration, round(error_rate, 9) AS rolling_error_rate FROM rates""",
    "feature_vectors": f"""WITH {RUNNING} SELECT event_id, job_type, duration_seconds,
  round(rolling_mean_duration, 6) AS rolling_mean_duration, round(error_rate, 9) AS error_rate, row_count, hour_of_day,
  day_of_week FROM features""",
    "duration_ewma": _recursive(SCORED, """SELECT event_id, job_type, n AS observation, round(mu, 6) AS mu,
  round(sigma, 6) AS sigma, round(z, 6) AS z FROM scored"""),
    "supplier_quantity_ewma": _recursive(f"""ordered AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem),
series AS (SELECT l_suppkey AS grp, n, l_quantity AS x FROM ordered),
{WALK}""", """SELECT l_suppkey, l_orderkey, l_linenumber, o.n AS observation, round(mu, 6) AS mu,
  round(sigma, 6) AS sigma, round(z, 6) AS z FROM ordered o JOIN walk w ON w.grp = o.l_suppkey AND w.n = o.n"""),
    "ewma_verdicts": _recursive(SCORED, """SELECT event_id, job_type, round(score, 6) AS score,
  n >= 10 AND score > 2.5 AS anomalous, reason, detector_name FROM scored"""),
    "fallback_verdicts": _recursive(SCORED, f"""SELECT event_id, job_type, round(score, 6) AS score,
  n >= 10 AND score > 2.5 AS anomalous, {FALLBACK} AS reason, 'isolation-forest' AS detector_name FROM scored"""),
    "custom_verdicts": f"""WITH {RUNNING} SELECT event_id, round(duration_seconds / rolling_mean_duration, 6) AS score,
  duration_seconds / rolling_mean_duration > 3 AS anomalous, 'rows=' || row_count AS reason, 'long-runs' AS detector_name
FROM features""",
    "training_history": f"""WITH {RUNNING} SELECT event_id AS row_key, round(duration_seconds, 6) AS duration_seconds,
  round(error_rate, 6) AS error_rate, CAST(row_count AS DOUBLE) AS row_count, CAST(hour_of_day AS DOUBLE) AS hour_of_day,
  CAST(day_of_week AS DOUBLE) AS day_of_week FROM features""",
    "training_state": f"""WITH {DELTAS} SELECT job_type AS row_key, round(sum(d_duration) / sum(d_runs), 6) AS duration_seconds,
  round(CAST(sum(d_errors) AS DOUBLE) / CAST(sum(d_rows) AS DOUBLE), 6) AS error_rate,
  round(CAST(sum(d_rows) AS DOUBLE) / CAST(sum(d_runs) AS DOUBLE), 6) AS row_count, CAST(0 AS DOUBLE) AS hour_of_day,
  CAST(0 AS DOUBLE) AS day_of_week FROM deltas GROUP BY job_type""",
    "refit_window": f"""WITH {RUNS} SELECT event_id, {_stamp("ts")} FROM runs WHERE event_type = 'JOB_COMPLETED'
  AND ts >= (SELECT max(ts) FROM runs WHERE event_type = 'JOB_COMPLETED') - INTERVAL 7 DAY""",
    "fit_gate": f"""WITH {DELTAS} SELECT 'per job type' AS source, count(DISTINCT job_type) >= 10 AS enough FROM deltas
UNION ALL SELECT 'per job type and day', count(DISTINCT (job_type, date_trunc('day', ts))) >= 10 FROM deltas""",
    "anomalous_runs": _recursive(_found(2.5), """SELECT event_id, job_type, duration_seconds, round(score, 6) AS score
FROM found"""),
    "incidents_default_threshold": _incidents(3.5),
    "incidents_of_records": _incidents(2.5),
    "streamed_incidents": _incidents(2.5),
    "replayed_incidents": _incidents(2.5),
    "resumed_incidents": _incidents(2.5),
    "streamed_messages": f"SELECT job_type, incident_id, severity, fingerprint FROM ({_incidents(2.5)}) found",
    "streamed_dead_letters": f"WITH {DELIVERED} {DEAD}",
    "run_fingerprints": f"""WITH {RUNS} SELECT event_id, sha256(job_type || '|LOW|' || {HOUR_TEXT}) AS low_fingerprint,
  sha256(job_type || '|MEDIUM|' || {HOUR_TEXT}) AS medium_fingerprint,
  sha256(job_type || '|HIGH|' || {HOUR_TEXT}) AS high_fingerprint, CAST(hour(ts) AS INTEGER) AS hour_of_day,
  CAST(isodow(ts) AS INTEGER) AS day_of_week FROM runs""",
    "severity_bands": """SELECT CASE WHEN l_quantity / 7 < 4 THEN 'LOW' WHEN l_quantity / 7 < 6 THEN 'MEDIUM' ELSE 'HIGH' END
  AS by_zscore, CASE WHEN l_discount * 10 < CAST(0.6 AS DOUBLE) THEN 'LOW' WHEN l_discount * 10 < CAST(0.8 AS DOUBLE)
  THEN 'MEDIUM' ELSE 'HIGH' END AS by_unit, count(*) AS items FROM lineitem GROUP BY 1, 2""",
    "incident_prompts": _recursive(REPORTS, f"""SELECT incident_id, 'Job: ' || job_type || ' | AnomalyScore: ' || {_score_text("score")}
  || ' | Duration: ' || {ONE_DECIMAL.format("duration_seconds")} || 's (rolling mean '
  || {ONE_DECIMAL.format("rolling_mean_duration")} || 's) | ErrorRate: ' || {FOUR_DECIMALS.format("error_rate")}
  || ' | Rows: ' || row_count || ' | Detector: isolation-forest' AS prompt, 321 AS system_length FROM reports"""),
    "static_summaries": _recursive(REPORTS, """SELECT incident_id, 'Anomaly detected in ' || job_type || ' — duration '
  || CAST(duration_seconds AS VARCHAR) || 's vs mean ' || CAST(round(rolling_mean_duration, 2) AS VARCHAR) || 's' AS summary,
  'Likely cause: job duration spike detected by isolation-forest' AS likely_cause,
  'Inspect job logs; Check upstream data volumes' AS suggested_actions, 'noop' AS provider, true AS ok FROM reports"""),
    "decoded_answers": _recursive(ANSWERED, """SELECT incident_id, summary, likely_cause, actions AS suggested_actions, ok
FROM answered"""),
    "enriched_incidents": _recursive(ANSWERED, f"""SELECT incident_id, 'v1' AS schema_version, job_type,
  round(score, 6) AS anomaly_score, 'isolation-forest' AS detector_name, fingerprint, severity, likely_cause,
  coalesce(actions, '') AS suggested_actions, NOT ok AS llm_unavailable, {_stamp("ts", "detected_at")},
  CASE WHEN ok THEN 'remote' ELSE 'unavailable' END AS llm_provider, summary FROM answered"""),
    "late_summaries": _recursive(REPORTS, f"""SELECT incident_id, 'v1' AS schema_version, job_type,
  round(score, 6) AS anomaly_score, 'isolation-forest' AS detector_name, fingerprint, severity,
  CASE WHEN h IN (0, 2, 5) THEN 'queue' WHEN h = 1 THEN '' END AS likely_cause,
  CASE WHEN h IN (0, 2, 5) THEN 'wait' ELSE '' END AS suggested_actions, h IN (3, 4) AS llm_unavailable,
  {_stamp("ts", "detected_at")}, CASE WHEN h IN (0, 2, 5) THEN 'late' WHEN h = 1 THEN 'remote' ELSE 'unavailable' END AS llm_provider,
  CASE WHEN h IN (0, 2, 5) THEN 'later ' || event_id WHEN h = 1 THEN 'fenced ' || event_id END AS summary FROM reports"""),
    "custom_summaries": _recursive(REPORTS, """SELECT incident_id, job_type || ' read ' || row_count || ' rows' AS summary,
  'isolation-forest' AS likely_cause, 'look' AS suggested_actions, 'volume' AS provider, true AS ok FROM reports"""),
    "incident_messages": _recursive(_found(2.5), f"""SELECT job_type AS key, '{{"incidentId":"' || incident_id
  || '","schemaVersion":"v1","jobType":"' || job_type || '","anomalyScore":' || CAST(round(score, 4) AS VARCHAR)
  || ',"detectorName":"ewma","fingerprint":"' || sha256(job_type || '|' || severity || '|' || {HOUR_TEXT})
  || '","severity":"' || severity || '","summary":null,"likelyCause":"Likely cause: job duration spike detected by ewma"'
  || ',"suggestedActions":["Inspect job logs","Check upstream data volumes"],"llmUnavailable":false,"detectedAt":"'
  || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","llmProvider":"noop"}}' AS value FROM found"""),
    "notifications_once": _recursive(REPORTS, f"""SELECT fingerprint, incident_id, severity, {_stamp("ts", "detected_at")}
FROM reports QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts, incident_id) = 1"""),
    "undelivered_notifications": _recursive(REPORTS, f"""SELECT fingerprint, incident_id, job_type, {_stamp("ts", "detected_at")}
FROM reports WHERE job_type <> 'POLICY_RENEWAL'
QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts, incident_id) = 1"""),
    "notification_payloads": _recursive(ANSWERED, f"SELECT incident_id, {PAYLOAD} AS payload FROM answered"),
    "throughput": f"""WITH {RUNS}, {_windows("runs", "s.ts", 60, 15)}
SELECT job_type, event_type, {_stamp("window_start")}, count(*) AS events, round(count(*) / CAST(60 AS DOUBLE), 6) AS per_second
FROM placed GROUP BY job_type, event_type, window_start""",
    "dead_letter_rate": f"""WITH {DELIVERED}, {_windows("(SELECT happened FROM delivered WHERE failure IS NOT NULL)", "s.happened", 60, 15)}
SELECT {_stamp("window_start")}, count(*) AS events, round(count(*) / CAST(60 AS DOUBLE), 6) AS per_second
FROM placed GROUP BY window_start""",
    "duration_p95": f"""WITH {RUNS}, {_windows("(SELECT * FROM runs WHERE event_type = 'JOB_COMPLETED')", "s.ts", 300, 15)}
SELECT job_type, {_stamp("window_start")}, count(*) AS runs, quantile_disc(duration_seconds, 0.95) AS p95_seconds
FROM placed GROUP BY job_type, window_start""",
    "incidents_by_severity": _recursive(REPORTS, f"""SELECT levels.severity, count(incident_id) AS incidents
FROM {LEVELS} LEFT JOIN reports USING (severity) GROUP BY levels.severity"""),
    "recent_incidents": _recursive(REPORTS, f""", recent AS (
  SELECT * FROM reports WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 12 HOUR)
SELECT levels.severity, count(incident_id) AS incidents FROM {LEVELS} LEFT JOIN recent USING (severity)
GROUP BY levels.severity"""),
    "incident_windows": _recursive(REPORTS, f"""SELECT {_stamp("time_bucket(INTERVAL 30 MINUTE, ts)", "window_start")},
  count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
  count(*) FILTER (WHERE severity = 'HIGH') AS high FROM reports GROUP BY time_bucket(INTERVAL 30 MINUTE, ts)"""),
    "summary_latency": f"""WITH {RUNS} SELECT {_stamp("date_trunc('minute', ts)", "window_start")},
  round(avg(duration_seconds / 100), 6) AS mean_latency, round(max(duration_seconds / 100), 6) AS max_latency
FROM runs WHERE event_type = 'JOB_COMPLETED' GROUP BY date_trunc('minute', ts)""",
    "error_rate_stats": f"""WITH {DELTAS}, readings AS (
  SELECT job_type, CASE WHEN event_type = 'JOB_FAILED' THEN 1.0 ELSE CAST(error_count AS DOUBLE) / rows_processed END AS rate
  FROM deltas)
SELECT job_type, round(avg(rate), 9) AS mean_error_rate, CAST(round(max(rate), 9) AS DOUBLE) AS max_error_rate
FROM readings GROUP BY job_type""",
    "anomaly_score_stats": _recursive(SCORED, """SELECT job_type, round(avg(score), 6) AS mean_score,
  round(max(score), 6) AS max_score FROM scored GROUP BY job_type"""),
    "status_bands": _recursive(SCORED, """SELECT job_type, CASE WHEN score >= 6 THEN 'red' WHEN score >= 4 THEN 'orange'
  WHEN score >= 3.5 THEN 'yellow' ELSE 'green' END AS score_colour,
  CASE WHEN error_rate >= CAST(0.2 AS DOUBLE) THEN 'red' WHEN error_rate >= CAST(0.05 AS DOUBLE)
  THEN 'yellow' ELSE 'green' END AS error_colour, count(*) AS runs FROM scored GROUP BY 1, 2, 3"""),
    "incident_bands": _recursive(REPORTS, f"""SELECT job_type, {_stamp("date_trunc('hour', ts)", "window_start")}, count(*) AS incidents,
  CASE WHEN count(*) >= 3 THEN 'red' ELSE 'yellow' END AS colour FROM reports GROUP BY job_type, date_trunc('hour', ts)"""),
    "latency_bands": f"""WITH {RUNS}, windows AS (
  SELECT round(avg(duration_seconds / 100), 6) AS mean_latency, round(max(duration_seconds / 100), 6) AS max_latency
  FROM runs WHERE event_type = 'JOB_COMPLETED' GROUP BY date_trunc('minute', ts))
SELECT CASE WHEN mean_latency >= 3 THEN 'red' WHEN mean_latency >= 1 THEN 'yellow' ELSE 'green' END AS mean_colour,
  CASE WHEN max_latency >= 3 THEN 'red' WHEN max_latency >= 1 THEN 'yellow' ELSE 'green' END AS max_colour, count(*) AS windows
FROM windows GROUP BY 1, 2""",
    "dead_letters_of_every_kind": """SELECT ['not_json', 'not_an_object', 'unknown_job_type', 'missing_payload', 'unknown_event_type',
  'bad_timestamp', 'bad_number', 'missing_event_id'][event_id % 8 + 1] AS error, count(*) AS records, count(*) AS dead_letters
FROM events WHERE event_type = 'error' GROUP BY 1""",
    "unique_events_of_copies": f"""WITH {RUNS} SELECT {EVENT_COLUMNS} FROM (SELECT * REPLACE (
  CASE WHEN event_type = 'JOB_COMPLETED' AND CAST(event_id AS BIGINT) % 2 = 1 THEN 'early.csv' ELSE source_file END AS source_file) FROM runs)""",
    "runs_without_numbers": """SELECT CASE user_id % 3 WHEN 0 THEN 'POLICY_RENEWAL' WHEN 1 THEN 'ANNUITY_PAYOUT' ELSE 'CLAIMS_INGEST' END AS job_type,
  count(*) FILTER (event_type = 'error' OR event_id % 5 > 2) AS state_runs, count(*) FILTER (event_type <> 'error' AND event_id % 5 > 2) AS scored_runs,
  count(*) FILTER (event_type <> 'error' AND event_id % 5 <= 2) AS rejects
FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1""",
    "events_read_back": f"WITH {RUNS} SELECT {EVENT_COLUMNS} FROM runs",
    "event_arrays_read_back": f"WITH {RUNS} SELECT {EVENT_COLUMNS} FROM runs",
    "dead_letters_read_back": f"""WITH {DELIVERED} SELECT value, failure AS error, coalesce(attempt, 0) AS retry_count, {_stamp("happened", "timestamp")}
  FROM delivered WHERE failure IS NOT NULL""",
    "metrics_state_read_back": f"WITH {DELTAS} SELECT job_type, {STATE_COLUMNS} FROM deltas GROUP BY job_type",
    "event_arrays_with_rubbish": """WITH documents AS (SELECT DISTINCT event_id // 200 AS number FROM events), bad AS (
  SELECT number, unnest([{'value': '7', 'reason': 'not_an_object'}, {'value': '"text"', 'reason': 'not_an_object'},
    {'value': 'null', 'reason': 'not_an_object'}, {'value': '[1, 2]', 'reason': 'not_an_object'}, {'value': '{"a" 1}', 'reason': 'not_json'},
    CASE WHEN number % 2 = 0 THEN {'value': '{"eventId":"cut', 'reason': 'not_json'} ELSE {'value': '"end"', 'reason': 'not_an_object'} END]) AS one
  FROM documents)
SELECT CAST(event_id AS VARCHAR) AS event_id, NULL AS value, NULL AS reject_reason, CAST(1 AS BIGINT) AS records, CAST(1 AS BIGINT) AS places FROM events
UNION ALL SELECT NULL, one.value, one.reason, count(*), count(*) FROM bad GROUP BY one""",
    "streamed_outbox": _recursive(BATCHED, f"""SELECT fingerprint, incident_id, batch_id, {_stamp("ts", "detected_at")}
FROM firsts QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY batch_id) = 1"""),
    "retried_deliveries": _recursive(BATCHED, """, settled AS (
  SELECT fingerprint, min(batch_id) FILTER (batch_id % 3 <> 2) AS batch_id FROM firsts GROUP BY fingerprint)
SELECT s.fingerprint, CAST(count(s.batch_id) FILTER (f.batch_id = s.batch_id) AS BIGINT) AS delivered,
  CAST(count(*) FILTER (f.batch_id % 3 = 2 AND (s.batch_id IS NULL OR f.batch_id < s.batch_id)) AS BIGINT) AS failures, s.batch_id,
  min(f.incident_id) FILTER (f.batch_id = s.batch_id) AS incident_id
FROM settled s JOIN firsts f ON f.fingerprint = s.fingerprint GROUP BY s.fingerprint, s.batch_id"""),
    "forest_shape": """SELECT CAST(unnest(range(100)) AS INTEGER) AS tree, CAST(least(256, count(*)) AS INTEGER) AS sample_size,
  CAST(1 AS BIGINT) AS leaves_over_inner, true AS one_parent_each, true AS nodes_whole, true AS within_bound
FROM events WHERE event_type IN ('purchase', 'signup')""",
    "forest_draws": """SELECT CAST(unnest(range(40)) AS INTEGER) AS tree, least(64, count(*)) AS drawn, least(64, count(*)) AS keys
FROM events WHERE event_type IN ('purchase', 'signup')""",
    "forest_verdict_rules": f"""WITH {RUNS} SELECT job_type, 'isolation-forest' AS detector_name, count(*) AS runs, count(*) AS scores_in_range,
  count(*) AS verdicts_by_threshold, count(*) AS reasons FROM runs WHERE event_type = 'JOB_COMPLETED' GROUP BY job_type""",
    "refitted_stream": """SELECT CAST(event_id % 3 - 1 AS BIGINT) AS version, count(*) AS events, true AS reported, CAST(0 AS BIGINT) AS differing
FROM events GROUP BY event_id % 3""",
    "metrics_state_streamed": f"WITH {DELTAS} SELECT job_type, {STATE_COLUMNS} FROM deltas GROUP BY job_type",
    "streamed_late_events": """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(CASE event_id % 10 WHEN 0 THEN ts + INTERVAL 900 YEAR
  WHEN 1 THEN ts - INTERVAL 30 DAY ELSE ts END, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events""",
}


def _steady(sql: str) -> str:
    """Round by way of decimals, as the queries do: halves away from zero, float noise cut first."""
    out, start = "", 0
    while (at := sql.find("round(", start)) >= 0:
        depth, end, comma = 1, at + len("round("), -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = sql[at + len("round("):comma], sql[comma + 1:end - 1].strip()
        out += sql[start:at]
        if " AS DECIMAL(" in inner:
            out += sql[at:end]
        else:
            out += f"CAST(round(CAST({_steady(inner)} AS DECIMAL(28, 10)), {digits}) AS DOUBLE)"
        start = end
    return out + sql[start:]


# Panels from stored panes are what they are from the rows.
STATEMENTS |= {f"{name}_of_panes": STATEMENTS[name] for name in ("throughput", "duration_p95", "dead_letter_rate")}

ORACLE: dict[str, str] = {name: _steady(sql) for name, sql in STATEMENTS.items()}
