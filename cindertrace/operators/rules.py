"""The ordered rules. In each, the first condition that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cindertrace.operators.history import MIN_COVERAGE, MIN_MATCHED, RECURRENT_DAYS, Z_LIMIT

# Land-cover shares.
BUILT, CROP, VEGETATION = 0.25, 0.5, 0.5


def first_match(*rules: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def behaviour_rule(has_current: Column, coverage90: Column, active90: Column, matched: Column) -> Column:
    return first_match((~has_current, "B0_NO_CURRENT_FRP"), (coverage90 < MIN_COVERAGE, "B1_LOW_COVERAGE"), (active90 == 0, "B2_NO_EARLIER_DETECTION"), (F.coalesce(matched, F.lit(0)) < MIN_MATCHED, "B3_UNMATCHED_HISTORY"), otherwise="B4_ROBUST_Z")


def behaviour_label(rule: Column, z: Column) -> Column:
    return first_match((rule.isin("B0_NO_CURRENT_FRP", "B1_LOW_COVERAGE", "B3_UNMATCHED_HISTORY"), "INSUFFICIENT_HISTORY"), (rule == "B2_NO_EARLIER_DETECTION", "NEW_OR_TRANSIENT"), (F.abs(z) >= Z_LIMIT, "ABNORMAL_RELATIVE_TO_BASELINE"), otherwise="RECURRENT_WITHIN_BASELINE")


def direction(label: Column, z: Column) -> Column:
    return F.when(label == "ABNORMAL_RELATIVE_TO_BASELINE", F.when(z > 0, "HIGHER").otherwise("LOWER"))


def source_rule(has_context: Column, mapped: Column, thermal: Column, built: Column, crop: Column, vegetation: Column, active90: Column, coverage90: Column) -> Column:
    """mapped, thermal: how many mapped features, and thermal candidates, lie inside the support; shares are null without land cover."""
    return first_match(
        (~has_context, "CONTEXT_UNAVAILABLE_AS_OF"),
        ((mapped > 0) & (thermal == 0), "NON_THERMAL_POWER_CONTEXT"),
        ((thermal > 0) & ((F.coalesce(built, F.lit(0.0)) >= BUILT) | (active90 >= RECURRENT_DAYS)), "S1_INDUSTRIAL"),
        (thermal > 0, "WEAK_INDUSTRIAL_SUPPORT"),
        (crop.isNull(), "LAND_COVER_UNAVAILABLE"),
        ((crop >= CROP) & (active90 < RECURRENT_DAYS) & (coverage90 < MIN_COVERAGE), "INSUFFICIENT_RECURRENCE_COVERAGE"),
        ((crop >= CROP) & (active90 < RECURRENT_DAYS), "S2_AGRICULTURAL_BURN"),
        ((vegetation >= VEGETATION) & (crop < CROP), "S3_VEGETATION_FIRE"),
        otherwise="CONFLICTING_OR_MIXED_EVIDENCE",
    )


def source_label(rule: Column) -> Column:
    return first_match((rule == "S1_INDUSTRIAL", "INDUSTRIAL"), (rule == "S2_AGRICULTURAL_BURN", "AGRICULTURAL_BURN"), (rule == "S3_VEGETATION_FIRE", "VEGETATION_FIRE"), otherwise="UNKNOWN")


def source_subtype(rule: Column, types: Column, flare: Column, active90: Column) -> Column:
    """types: the thermal candidates' facility types."""
    return F.when(rule == "S1_INDUSTRIAL", first_match((F.array_contains(types, "MINE"), "MINING_HEAT"), (flare, "GAS_FLARE"), (active90 >= RECURRENT_DAYS, "OTHER_PERSISTENT_HEAT"), otherwise="UNRESOLVED"))


def priority_rule(source: Column, behaviour: Column, way: Column) -> Column:
    higher = (behaviour == "ABNORMAL_RELATIVE_TO_BASELINE") & (way == "HIGHER")
    new = behaviour == "NEW_OR_TRANSIENT"
    industrial, unknown = source == "INDUSTRIAL", source == "UNKNOWN"
    return first_match(
        (industrial & F.coalesce(higher, F.lit(False)), "P1_HIGH"),
        (industrial & new, "P2_HIGH"),
        (unknown & (F.coalesce(higher, F.lit(False)) | new), "P3_REVIEW"),
        ((behaviour == "INSUFFICIENT_HISTORY") & (industrial | unknown), "P4_MEDIUM"),
        (unknown, "P5_MEDIUM"),
        (industrial, "P6_LOW"),
        otherwise="P7_LOW",
    )
