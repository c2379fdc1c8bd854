"""Choice of detector: by name, by model, or a function of the caller's own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobvigil.config import DEFAULTS, EWMA, FOREST, Settings
from jobvigil.functions.scores import fallback_text
from jobvigil.operators.ewma import ewma_score
from jobvigil.operators.forest import forest_score, forest_verdict
from jobvigil.operators.metrics import DELTAS, ORDER, arrange_runs, feature_vectors, name_running
from jobvigil.operators.ordered import ScanSpec, scan

VERDICT = ("score", "anomalous", "reason", "detector_name")
ORDERED = ("observation", "mu", "sigma", "z")
Detector = Callable[[DataFrame], DataFrame]


def observed_features(
    events: DataFrame,
    settings: Settings = DEFAULTS,
    order_by: Sequence[str] = ORDER,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Feature vectors of completed runs with the EWMA columns, from one ordered scan.

    The scan covers failed runs too, since they count in the running sums; they
    are not observed by the EWMA and leave after it. ``keep`` names further event
    columns to carry along.
    """
    spec = ScanSpec("job_type", DELTAS, "observed_seconds", settings.ewma_alpha)
    arranged = arrange_runs(events, order_by, keep)
    return feature_vectors(name_running(scan(arranged, spec, drop=(*DELTAS, "observed_seconds"))))


def score(
    features: DataFrame,
    detector: str | Detector = EWMA,
    model: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add score, anomalous, reason and detector_name to the output of ``observed_features``.

    ``detector`` is ``ewma``, ``isolation-forest`` or any function that adds the
    four columns. Without a model the forest falls back to the EWMA score, under
    the forest's name and with the reason saying so.
    """
    if callable(detector):
        scored = detector(features)
        missing = [c for c in VERDICT if c not in scored.columns]
        if missing:
            raise ValueError(f"the detector did not add {missing}")
        return scored
    if detector == EWMA:
        return ewma_score(features, settings)
    if detector != FOREST:
        raise ValueError(f"unknown detector {detector!r}")
    if model is not None:
        return forest_verdict(forest_score(features, model), settings)
    return ewma_score(features, settings).withColumns({
        "reason": fallback_text(F.col("reason")),
        "detector_name": F.lit(FOREST),
    })


def anomalies(scored: DataFrame) -> DataFrame:
    """Only the runs judged anomalous."""
    return scored.filter(F.col("anomalous"))
