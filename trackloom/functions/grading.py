"""Severity, reliability and credibility grades, and display classes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(x: Column, steps: list[tuple[float, object]], last: object) -> Column:
    """The value of the first step that ``x`` reaches."""
    out = None
    for least, value in steps:
        out = F.when(x >= least, value) if out is None else out.when(x >= least, value)
    return out.otherwise(last)


def severity(score: Column) -> Column:
    return ladder(score, [(0.85, "critical"), (0.65, "high"), (0.4, "moderate")], "low")


def reliability(samples: Column, at_altitude: Column | None = None) -> Column:
    """B to E by the number of samples; one grade less, but no less than E, at low altitude."""
    high = ladder(samples, [(8, "B"), (4, "C"), (2, "D")], "E")
    low = ladder(samples, [(8, "C"), (4, "D")], "E")
    return high if at_altitude is None else F.when(at_altitude, high).otherwise(low)


def credibility(score: Column) -> Column:
    return ladder(score, [(0.85, 2), (0.65, 3), (0.45, 4), (0.25, 5)], 6)


def coverage_state(scoreable: Column, fraction: Column) -> Column:
    return F.when(~scoreable, "unscoreable").when(fraction >= 0.5, "degraded").when(fraction > 0, "partial").otherwise("clear")


def phase_note(low: Column, known: Column) -> Column:
    """Of aircraft with a known altitude, how many are below the terminal floor?"""
    return F.when(known == 0, "unknown").when(low == 0, "all above").when(low == known, "all below").otherwise("mixed")


def risk_tone(risk: Column) -> Column:
    return ladder(risk, [(0.8, "alert"), (0.6, "warn")], "calm")


def reliability_tone(grade: Column) -> Column:
    return F.when(grade.isin("A", "B"), "strong").when(grade == "C", "fair").otherwise("weak")


#: Prefixes of type codes and registrations that tell aircraft classes apart.
AIRLINER = ("A2", "A3", "AT7", "B3", "B6", "B7", "B8", "CRJ", "DH8", "E1", "E2", "F7", "MD")
LIGHT = ("A139", "BE", "C1", "C2", "C3", "C4", "DA", "EC", "H", "P28", "P32", "PC", "R44", "R66", "SR")
LIGHT_REGISTRATION = ("N", "VH-", "9V-")


def starts_with_any(x: Column, prefixes: tuple[str, ...]) -> Column:
    return x.rlike("^(" + "|".join(prefixes) + ")")


def plausible_gap(minutes: Column, km: Column, min_minutes: float, min_km: float) -> Column:
    weakest = F.least(minutes / min_minutes, km / min_km)
    return F.when(weakest <= 1.5, "less plausible").when(weakest >= 2.0, "more plausible").otherwise("unclear")


def plausible_incursion(type_code: Column, registration: Column) -> Column:
    code = F.upper(F.trim(F.coalesce(type_code, F.lit(""))))
    return (
        F.when(starts_with_any(code, AIRLINER), "less plausible")
        .when(starts_with_any(code, LIGHT), "more plausible")
        .when((code == "") & F.coalesce(starts_with_any(F.upper(registration), LIGHT_REGISTRATION), F.lit(False)), "more plausible")
        .otherwise("unclear")
    )


def plausible_jamming(observed: Column, min_aircraft: int) -> Column:
    return F.when(observed <= min_aircraft, "less plausible").when(observed >= 2 * min_aircraft, "more plausible").otherwise("unclear")
