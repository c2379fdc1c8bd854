"""Small helpers the operators of this package share."""

from __future__ import annotations

import contextlib
import gc
import time

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobvigil.session import ensure_checkpoint_dir, ship_package

#: Fixed: white space between words.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def ready(spark: SparkSession) -> int:
    """Sends the package to the workers, sees to the checkpoint folder, gives the number of shuffle partitions."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Shuffle files that no DataFrame refers to any more go now, not whenever the driver's JVM happens to collect its garbage."""
    context = spark.sparkContext
    # a query is held until the listeners have heard of its end
    with contextlib.suppress(Py4JError):
        context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for pause in (0.5, 0):  # what the first collection finds may hold the rest
        gc.collect()
        context._jvm.System.gc()
        time.sleep(pause)


def trim() -> None:
    """Memory that this worker has freed goes back to the system: workers are kept, and the next stage runs beside what they hold."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_temporary(frame: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, upper or lower case."""
    taken = {c.lower() for c in frame.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


#: Rows of a small table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def small(frame: DataFrame) -> DataFrame:
    """Broadcast, if a count says that it is small."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame
