"""Readers: event topics and files, dead letters, stored tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobvigil.schema import METRICS_STATE, RAW_RECORDS
from jobvigil.session import ship_package
from jobvigil.sinks.topics import DEAD_LETTER_TOPIC, EVENTS_TOPIC

Source = str | dict[str, str]


def read_records(
    spark: SparkSession, source: Source, topic: str, streaming: bool = False, file_format: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Raw key/value records from Kafka options or from files with the same columns.

    Columns a file does not have (headers, offset, ...) come back as null, an absent
    time as that of the file.
    ``file_format`` is ``parquet``, ``json`` or ``text`` (one event per line).
    """
    reader = spark.readStream if streaming else spark.read
    if isinstance(source, dict):
        options = {"startingOffsets": "earliest", "includeHeaders": "true", "subscribe": topic, **source}
        records = reader.format("kafka").options(**options).load()
        return records.withColumns({
            "key": F.col("key").cast("string"), "value": F.col("value").cast("string"),
        })
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if file_format == "text":
        lines = reader.text(source).select("value", F.col("_metadata.file_modification_time").alias("timestamp"))
        absent = [f for f in RAW_RECORDS if f.name not in lines.columns]
        return lines.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}).select(*RAW_RECORDS.names)
    stored = reader.schema(RAW_RECORDS).format(file_format).load(source)
    return stored.withColumn("timestamp", F.coalesce("timestamp", "_metadata.file_modification_time"))


def read_events(spark: SparkSession, source: Source, streaming: bool = False, **options) -> DataFrame:
    """The event topic, from its earliest record."""
    return read_records(spark, source, EVENTS_TOPIC, streaming, **options)


def read_dead_letters(spark: SparkSession, source: Source, streaming: bool = False, **options) -> DataFrame:
    """The dead-letter topic: a reader of its own, with its own progress when streaming."""
    return read_records(spark, source, DEAD_LETTER_TOPIC, streaming, **options)


def read_event_array(spark: SparkSession, path: str) -> DataFrame:
    """Documents that hold a JSON array of events: one raw record per element, whatever it is.

    A record has the element as it is written, the file as its topic, the element's number as its
    offset and the file's time, so that what is no event can be told and found again among
    the dead letters. A document is split by the task that reads it, which holds it
    whole; Spark reads documents of up to 2 GB.
    """
    ship_package(spark)
    documents = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_modification_time")

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from jobvigil.sources.documents import array_elements

        for batch in batches:
            for text, file, time in zip(*(batch.column(i) for i in range(3)), strict=True):
                number, elements = 0, array_elements(text.as_py())
                while some := list(islice(elements, 4096)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some), pa.array([file.as_py()] * len(some)), pa.array(range(number, number + len(some)), pa.int64()), pa.array([time.as_py()] * len(some), time.type)],
                        ["value", "topic", "offset", "timestamp"],
                    )
                    number += len(some)

    elements = documents.mapInArrow(split, "value string, topic string, offset bigint, timestamp timestamp").withColumn("partition", F.lit(0))
    absent = [f for f in RAW_RECORDS if f.name not in elements.columns]
    return elements.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}).select(*RAW_RECORDS.names)


def read_metrics_state(spark: SparkSession, path: str) -> DataFrame:
    """Last stored state per job type; absent numbers read as 0, an absent time as the epoch."""
    state = read_table(spark, path, METRICS_STATE, "job_type")
    filled = [
        F.coalesce(F.col(f.name), _zero(f.dataType)).alias(f.name) for f in METRICS_STATE if f.name != "job_type"
    ]
    return state.select("job_type", *filled)


def metrics_for(state: DataFrame, job_type: str) -> DataFrame:
    """The state of one job type, empty if there is none; the filter reaches the scan."""
    return state.filter(F.col("job_type") == job_type)


def read_table(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None) -> DataFrame:
    """A table written in batches. With ``key``, the last batch's row per key wins."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], full)
    if key is None:
        return rows
    newest = Window.partitionBy(key).orderBy(F.desc("batch_id"))
    return rows.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def refuse_other_run(spark: SparkSession, path: str, batch_id: int) -> None:
    """A run that starts anew counts its batches from the first; later ones in its tables are another run's and would count twice."""
    stored = read_table(spark, path, T.StructType([])).agg(F.max("batch_id").alias("last")).first()["last"]
    if stored is not None and stored > batch_id:
        raise ValueError(f"{path} holds a run up to batch {stored}; use new tables, or go on with its progress folder")


def _zero(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_seconds(F.lit(0))
    return F.lit(0).cast(dtype)
