"""Exponentially weighted mean and deviation per key, and the verdict drawn from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobvigil.config import DEFAULTS, EWMA, Settings
from jobvigil.functions.scores import cold_start_text, warmup_text, zscore_text
from jobvigil.operators.ordered import ScanSpec, arrange, scan


def ewma(
    df: DataFrame, value: str, key: str, order_by: Sequence[str], alpha: float = DEFAULTS.ewma_alpha
) -> DataFrame:
    """Add ``observation``, ``mu``, ``sigma`` and ``z``.

    Mean and deviation take in the current row first, and z is measured against
    the new ones, so |z| never exceeds 1/alpha. All columns of ``df`` are shuffled
    and checkpointed, so select the wanted ones first.
    """
    return scan(arrange(df, key, order_by), ScanSpec(key, value=value, alpha=alpha))


def ewma_score(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``score``, ``anomalous``, ``reason`` and ``detector_name`` to the output of ``ewma``.

    The first observation seeds the state, the next ones up to the warm-up count
    are scored but never anomalous.
    """
    first = F.col("observation") == 1
    warming = F.col("observation") < settings.ewma_warmup
    size = F.abs("z")
    return df.withColumns({
        "score": F.when(first, F.lit(0.0)).otherwise(size),
        "anomalous": F.when(first | warming, F.lit(False)).otherwise(size > settings.ewma_threshold),
        "reason": F.when(first, cold_start_text())
        .when(warming, warmup_text(F.col("observation"), settings.ewma_warmup, F.col("z")))
        .otherwise(zscore_text(F.col("z"), F.col("mu"), F.col("sigma"))),
        "detector_name": F.lit(EWMA),
    })
