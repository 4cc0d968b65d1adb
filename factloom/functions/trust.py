"""Provenance, severity and trust as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default confidence, rank and ranking weight of each provenance.
CONFIDENCE = {"EXTRACTED": 1.0, "RESOLVED": 0.98, "OBSERVED": 1.0, "DECLARED": 1.0, "INFERRED": 0.7, "STALE": 0.0}
PROVENANCE_RANK = {"RESOLVED": 4, "OBSERVED": 4, "EXTRACTED": 3, "DECLARED": 2, "INFERRED": 1, "STALE": 0}
PROVENANCE_WEIGHT = {"OBSERVED": 1.0, "RESOLVED": 1.0, "EXTRACTED": 0.85, "DECLARED": 0.8, "INFERRED": 0.6, "STALE": 0.0}
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
BOUNDARY_RANK = {"declared": 3, "deployment": 2, "cli": 2, "package": 1}
#: Least confidence of an inferred fact that is trusted.
FLOOR = 0.85


def lookup(table: dict, key: Column, default=None) -> Column:
    """The value of ``key`` in a small literal table."""
    out = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return out if default is None else F.coalesce(out, F.lit(default))


def default_confidence(provenance: Column) -> Column:
    return lookup(CONFIDENCE, provenance)


def provenance_rank(provenance: Column) -> Column:
    return lookup(PROVENANCE_RANK, provenance, 0)


def provenance_weight(provenance: Column) -> Column:
    return lookup(PROVENANCE_WEIGHT, provenance, 0.0)


def severity_rank(severity: Column) -> Column:
    return lookup(SEVERITY_RANK, F.lower(severity), 0)


def boundary_rank(kind: Column) -> Column:
    return lookup(BOUNDARY_RANK, kind, 0)


def parse_provenance(text: Column) -> Column:
    """The provenance that a text names, in any case; null for another text."""
    name = F.upper(F.trim(text))
    return F.when(name.isin(list(CONFIDENCE)), name)


def allows(provenance: Column, confidence: Column, floor: float = FLOOR, inferred: bool = False, classes: tuple[str, ...] = ("EXTRACTED", "RESOLVED", "OBSERVED", "DECLARED")) -> Column:
    """Stale facts never pass, inferred ones from ``floor`` on (``inferred``: always), others if their class is listed."""
    return F.when(provenance == "STALE", False).when(provenance == "INFERRED", confidence >= (0.0 if inferred else floor)).otherwise(provenance.isin(*classes))


def claim_allowed(provenance: Column, floor: float = FLOOR) -> Column:
    """A claim without provenance passes; another by its default confidence."""
    return provenance.isNull() | allows(provenance, default_confidence(provenance), floor)
