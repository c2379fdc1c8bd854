"""Session defaults, the place of checkpoints, and the package on the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ARCHIVE = "jobvigil.zip"


def build_session(app: str = "jobvigil", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # state of streams on disk beside the executor, not in its heap
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # checkpointed blocks go when their DataFrame does, else a long stream keeps them all
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder, since there every task runs
    on the machine that holds it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="jobvigil-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark application."""
    context = spark.sparkContext
    if any(str(path).endswith(ARCHIVE) for path in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="jobvigil-package-")) / ARCHIVE
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
