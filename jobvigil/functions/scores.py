"""Scalar expressions on scores, ratios and times. All are built-in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobvigil.config import EWMA

# Upper bounds of LOW and MEDIUM per score scale.
EWMA_BANDS = (4.0, 6.0)
UNIT_BANDS = (0.6, 0.8)

# Lower bounds of the colour bands of the monitoring panels.
ERROR_RATE_BANDS = ((0.05, "yellow"), (0.2, "red"))
SCORE_BANDS = ((3.5, "yellow"), (4.0, "orange"), (6.0, "red"))
INCIDENT_BANDS = ((1.0, "yellow"), (3.0, "red"))
LATENCY_BANDS = ((1.0, "yellow"), (3.0, "red"))

# The reason texts of verdicts.
COLD_START = "cold start — seeding EWMA state"
WARM_UP_FORMAT = "warm-up (%d/%d observations) — z=%.2f not scored yet"
ZSCORE_FORMAT = "duration z-score=%.2f (mu=%.2fs, sigma=%.2fs)"
FOREST_FORMAT = "isolation-forest score=%.4f (threshold=%.2f)"
FALLBACK_PREFIX = "isolation-forest not fitted — ewma fallback: "


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, 0.0 where the denominator is 0 or absent."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom).otherwise(F.lit(0.0))


def hour_utc(ts: Column) -> Column:
    """Hour 0-23 in UTC, whatever the session's zone."""
    return F.pmod(F.floor(_utc_seconds(ts) / 3600), F.lit(24)).cast("int")


def iso_dow(ts: Column) -> Column:
    """ISO day of week in UTC, Monday 1 to Sunday 7; the epoch was a Thursday."""
    return (F.pmod(F.floor(_utc_seconds(ts) / 86400) + 3, F.lit(7)) + 1).cast("int")


def _utc_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def utc_text(ts: Column, hour: bool = False) -> Column:
    """ISO-8601 in UTC with six digits of a second, or of the hour; dates have no zone, so no session's zone shows."""
    micros = F.unix_micros(ts.cast("timestamp"))
    day = F.date_from_unix_date(F.floor(micros / 86_400_000_000).cast("int")).cast("string")
    rest = F.pmod(micros, F.lit(86_400_000_000))
    two = lambda value: F.lpad(F.floor(value).cast("string"), 2, "0")
    if hour:
        return F.concat(day, F.lit("T"), two(rest / 3_600_000_000), F.lit(":00:00Z"))
    return F.concat(
        day, F.lit("T"), two(rest / 3_600_000_000), F.lit(":"), two(rest % 3_600_000_000 / 60_000_000), F.lit(":"),
        two(rest % 60_000_000 / 1_000_000), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )


def severity(score: Column, detector_name: Column, scale: str = "by_detector") -> Column:
    """LOW, MEDIUM or HIGH.

    ``by_detector`` judges only the ``ewma`` detector on the z-score bands and any
    other on the 0-1 bands, so a z-score that comes out of the forest's fallback
    is judged on the 0-1 bands. ``zscore`` and ``unit`` force one of the two.
    """
    def banded(bounds: tuple[float, float]) -> Column:
        return (
            F.when(score < bounds[0], F.lit("LOW"))
            .when(score < bounds[1], F.lit("MEDIUM"))
            .otherwise(F.lit("HIGH"))
        )

    if scale == "zscore":
        return banded(EWMA_BANDS)
    if scale == "unit":
        return banded(UNIT_BANDS)
    return F.when(detector_name == EWMA, banded(EWMA_BANDS)).otherwise(banded(UNIT_BANDS))


def status_band(value: Column, bands: tuple[tuple[float, str], ...]) -> Column:
    """Colour of the highest band whose lower bound the value reaches, else green."""
    highest_first = sorted(bands, key=lambda band: -band[0])
    colour = None
    for bound, name in highest_first:
        colour = F.when(value >= bound, F.lit(name)) if colour is None else colour.when(value >= bound, F.lit(name))
    return colour.otherwise(F.lit("green"))


def cold_start_text() -> Column:
    return F.lit(COLD_START)


def warmup_text(observation: Column, warmup: int, z: Column) -> Column:
    return F.format_string(WARM_UP_FORMAT, observation, F.lit(warmup), z)


def zscore_text(z: Column, mu: Column, sigma: Column) -> Column:
    return F.format_string(ZSCORE_FORMAT, z, mu, sigma)


def forest_text(score: Column, threshold: float) -> Column:
    return F.format_string(FOREST_FORMAT, score, F.lit(float(threshold)))


def fallback_text(reason: Column) -> Column:
    return F.concat(F.lit(FALLBACK_PREFIX), reason)
