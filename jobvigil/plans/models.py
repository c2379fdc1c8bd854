"""Versions of a forest, and which of them scores a micro-batch.

``<path>/nodes`` holds the nodes of each version and is never changed; ``<path>/versions``
has a row for each version whose nodes are complete. That row is one file, written
last, so a reader sees the old version or the new one and never a part. One job at a
time may publish. Old versions stay until the caller removes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobvigil.schema import BATCH_MODELS, FOREST_MODEL, MODEL_VERSIONS
from jobvigil.sinks.tables import write_batch
from jobvigil.sources.tables import read_table


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The version that counts now; None before the first."""
    return read_table(spark, f"{path}/versions", MODEL_VERSIONS).agg(F.max("version").alias("last")).first()["last"]


def publish_model(model: DataFrame, path: str) -> int:
    """Store ``model`` as the next version and let it count; an attempt that broke off is overwritten."""
    spark = model.sparkSession
    last = newest_version(spark, path)
    version = 0 if last is None else last + 1
    write_batch(model.select(*FOREST_MODEL.names), f"{path}/nodes", version)
    stored = load_model(spark, path, version)
    row = stored.agg(F.lit(version).cast("long").alias("version"), F.count_distinct("tree").alias("trees"))
    write_batch(row.coalesce(1), f"{path}/versions", version)
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The nodes of a version, of the newest if none is named."""
    version = newest_version(spark, path) if version is None else version
    if version is None:
        raise ValueError(f"{path} holds no model yet")
    return spark.read.schema(FOREST_MODEL).parquet(f"{path}/nodes/batch_id={version}")


def model_of_batch(spark: SparkSession, path: str, choices: str, batch_id: int) -> DataFrame | None:
    """The model a micro-batch is scored by; None while there is none.

    It is the newest version when the batch is first tried. The choice is stored before
    anything is scored, so a batch tried again is scored by the same version even if a
    newer one has come in between.
    """
    made = read_table(spark, choices, BATCH_MODELS).filter(F.col("batch_id") == batch_id).select("version").first()
    if made is None:
        made = (newest_version(spark, path),)
        write_batch(spark.createDataFrame([made], BATCH_MODELS).coalesce(1), choices, batch_id)
    return None if made[0] is None else load_model(spark, path, made[0])
