"""Published models, and the version that scores a micro-batch."""

import pytest
from pyspark.sql import functions as F

from jobvigil.config import FOREST, Settings
from jobvigil.operators.forest import fit_forest
from jobvigil.plans.flow import Tables, load_forest
from jobvigil.plans.models import model_of_batch, newest_version, publish_model
from jobvigil.schema import BATCH_MODELS, INCIDENTS
from jobvigil.sinks.tables import write_batch
from jobvigil.sources.tables import read_table
from jobvigil.streaming.stream import process_batch


@pytest.fixture(scope="module")
def models(spark):
    """Two small forests that differ."""
    matrix = spark.range(60).select(
        F.col("id").cast("string").alias("row_key"),
        F.array(*[(F.col("id") * k % 17).cast("double") for k in (1, 3, 5, 7, 11)]).alias("features"),
    )
    return [fit_forest(matrix, 4, 16, seed).checkpoint() for seed in (1, 2)]


def rows(df):
    return sorted(map(str, df.collect()))


def test_versions(spark, models, tmp_path):
    path = str(tmp_path / "models")
    assert newest_version(spark, path) is None
    with pytest.raises(ValueError, match="no model"):
        load_forest(spark, path)
    # an attempt that broke off before its row was there does not count and is replaced
    write_batch(models[1], f"{path}/nodes", 0)
    assert newest_version(spark, path) is None
    assert publish_model(models[0], path) == 0 and rows(load_forest(spark, path)) == rows(models[0])
    assert publish_model(models[1], path) == 1 == newest_version(spark, path)
    assert rows(load_forest(spark, path)) == rows(models[1]) and rows(load_forest(spark, path, 0)) == rows(models[0])


def test_a_batch_keeps_its_version(spark, models, tmp_path):
    path, choices = str(tmp_path / "models"), str(tmp_path / "choices")
    assert model_of_batch(spark, path, choices, 0) is None
    publish_model(models[0], path)
    assert model_of_batch(spark, path, choices, 0) is None
    assert rows(model_of_batch(spark, path, choices, 1)) == rows(models[0])
    publish_model(models[1], path)
    assert rows(model_of_batch(spark, path, choices, 1)) == rows(models[0])
    assert rows(model_of_batch(spark, path, choices, 2)) == rows(models[1])
    stored = read_table(spark, choices, BATCH_MODELS).orderBy("batch_id").collect()
    assert [(r.batch_id, r.version) for r in stored] == [(0, None), (1, 0), (2, 1)]


def test_batches_are_scored_by_the_version_of_their_time(spark, runs, models, tmp_path):
    tables, path = Tables(str(tmp_path / "out")), str(tmp_path / "models")
    settings = Settings(detector=FOREST, forest_threshold=0.0)
    batches = [runs([("CLAIMS_INGEST", 10.0 + i) for i in range(12)], prefix=p) for p in "abc"]

    def scores(batch_id):
        found = read_table(spark, tables.path("incidents"), INCIDENTS).filter(F.col("batch_id") == batch_id)
        return {r.incident_id: r.anomaly_score for r in found.collect()}

    process_batch(batches[0], 0, tables, settings, model=path)
    assert scores(0) == {}
    publish_model(models[0], path)
    process_batch(batches[1], 1, tables, settings, model=path)
    first = scores(1)
    publish_model(models[1], path)
    process_batch(batches[1], 1, tables, settings, model=path)
    assert len(first) == 12 and scores(1) == first
    process_batch(batches[2], 2, tables, settings, model=path)
    assert len(scores(2)) == 12 and sorted(scores(2).values()) != sorted(first.values())
