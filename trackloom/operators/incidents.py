"""What all detectors share: assembling scored incidents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grading import severity
from ..zones import zone_for

COLUMNS = [
    "incident_id", "icao24", "track_id", "detector", "incident_type", "score", "severity", "reliability", "start_us", "end_us",
    "lat", "lon", "zone_id", "affected_count", "techniques", "evidence", "region",
]


@dataclass(frozen=True, eq=False)
class Spec:
    """How a detector's rows become incidents: its evidence, and further columns (of ``COLUMNS``) as expressions of the rows.

    Expressions name columns and belong to no frame, so a detector makes its specification once for each ``Settings``: putting
    hundreds of expressions together takes longer than planning them.
    """

    detector: str
    technique: str
    kind: str | Column
    evidence: list[Column]
    columns: dict[str, Column]


@cache
def _own(spec: Spec, aircraft: bool, region: bool) -> dict[str, Column]:
    return {
        "track_id": F.lit(None).cast("string"),
        "affected_count": F.lit(None).cast("long"),
        "icao24": F.col("icao24") if aircraft else F.lit(None).cast("string"),
        "region": F.col("region") if region else F.lit(None).cast("string"),
        "incident_type": F.lit(spec.kind) if isinstance(spec.kind, str) else spec.kind,
    } | spec.columns


def _known(rows: DataFrame) -> tuple[bool, bool]:
    return "icao24" in rows.columns, "region" in rows.columns


@cache
def _graded() -> tuple[dict[str, Column], Column]:
    return {"severity": severity(F.col("score")), "zone_id": zone_for(F.col("lat"), F.col("lon"))}, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))


def _finished(out: DataFrame) -> DataFrame:
    grades, score = _graded()
    return out.withColumns(grades).withColumn("score", score).select(*COLUMNS)


def incidents(rows: DataFrame, detector: str, technique: str, kind: str | Column, evidence: list[Column], **columns: Column) -> DataFrame:
    """Rows with the incident's columns and ``evidence`` as a struct of the given columns.

    The severity is of the score as it is, the stored score is cut to [0, 1]; the zone is that of the place.
    """
    return described(rows, Spec(detector, technique, kind, evidence, columns))


@cache
def _described(spec: Spec, aircraft: bool, region: bool) -> list[Column]:
    own = [c.alias(n) for n, c in _own(spec, aircraft, region).items()]
    return [*own, F.struct(*spec.evidence).alias("evidence"), F.lit(spec.detector).alias("detector"), F.array(F.lit(spec.technique)).alias("techniques")]


def described(rows: DataFrame, spec: Spec) -> DataFrame:
    return _finished(rows.select(*_described(spec, *_known(rows))))


@cache
def _by_kind(kind: str, specs: tuple[Spec, ...], aircraft: bool, region: bool) -> list[Column]:
    def pick(values: list[Column]) -> Column:
        out = None
        for spec, v in zip(specs, values, strict=True):
            out = F.when(F.col(kind) == spec.detector, v) if out is None else out.when(F.col(kind) == spec.detector, v)
        return out

    own = [_own(spec, aircraft, region) for spec in specs]
    columns = {n: pick([o[n] for o in own]) for n in own[0]}
    columns |= {"evidence": pick([F.to_json(F.struct(*spec.evidence)) for spec in specs]), "techniques": F.array(pick([F.lit(spec.technique) for spec in specs])), "detector": F.col(kind)}
    return [c.alias(n) for n, c in columns.items()]


def described_by(rows: DataFrame, kind: str, specs: tuple[Spec, ...]) -> DataFrame:
    """Rows of several detectors, told apart by the column ``kind``, in one pass; ``evidence`` is JSON text."""
    return _finished(rows.select(*_by_kind(kind, specs, *_known(rows))))


def flat(df: DataFrame) -> DataFrame:
    """With ``evidence`` as JSON text, so that detectors' incidents can be put together."""
    return df.withColumn("evidence", F.to_json("evidence"))
