import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from jobvigil.session import build_session

    session = build_session(
        "jobvigil-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def runs(spark):
    """Build events of one kind of run: rows of (job_type, seconds) or (job_type, None) for a failed run."""
    from datetime import datetime, timedelta

    from jobvigil.schema import EVENTS

    def build(rows, start=datetime(2024, 6, 3, 10), prefix="e"):
        out = []
        for i, (job, seconds) in enumerate(rows):
            row = dict.fromkeys(EVENTS.names)
            row.update(
                event_id=f"{prefix}{i:06d}", schema_version="v1", job_type=job, ts=start + timedelta(minutes=i),
                event_type="JOB_FAILED" if seconds is None else "JOB_COMPLETED", run_id=f"r{i}",
            )
            if seconds is not None:
                row.update(rows_processed=1000, duration_seconds=float(seconds), error_count=i % 3)
            out.append(tuple(row[c] for c in EVENTS.names))
        return spark.createDataFrame(out, EVENTS)

    return build
