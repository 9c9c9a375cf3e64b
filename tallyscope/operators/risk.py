"""Risk records and event summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.rules import CONFIDENCE, CROWDING, PROXIMITY, RESTRICTED, STATIONARY, TEMPORAL

#: Risk of each event type, levels in order.
RISK = {STATIONARY: "Low", RESTRICTED: "Medium", CROWDING: "Medium", PROXIMITY: "Low", TEMPORAL: "High"}
LEVELS = ("Low", "Medium", "High")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key) if mapping else F.lit(None).cast("string")


def assess(events: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Events with `risk_level`, `reason` and `confidence_provenance`; confidences of 0 or less become null."""
    mapping = RISK if mapping is None else mapping
    kind, level = F.col("event_type"), _lookup(mapping, F.col("event_type"))
    confidence = F.when(F.col("confidence") > 0, F.col("confidence"))
    provenance = F.when(confidence.isNull(), None).when(kind.isin(*CONFIDENCE), "declared_constant").when(kind == TEMPORAL, "measured")
    reason = F.when(level.isNull(), F.format_string("No risk mapping is configured for event type '%s'.", kind)).otherwise(F.format_string("Configured mapping assigns %s to %s risk.", kind, level))
    return events.withColumns({"risk_level": F.coalesce(level, F.lit("Unknown")), "reason": reason, "confidence_provenance": provenance, "confidence": confidence, "risk_level_is_validated": F.lit(False)})


def summary(records: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Counts by event type and risk level, with the first confidence and the first five frames; most frequent first, ties in
    order of first appearance (E10, E11)."""
    firsts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("s"), "frame"))), 1, 5), lambda x: x["frame"])
    out = records.groupBy(*by, "event_type", "risk_level").agg(F.count(F.lit(1)).alias("events"), F.min_by("confidence", order).alias("confidence"), F.min(order).alias("first_seen"), firsts.alias("frames"))
    return out.orderBy(*by, F.desc("events"), "first_seen")


def overall(records: DataFrame, fired: DataFrame) -> DataFrame:
    """`clip`, `overall_risk`: High if the temporal rule fired, else the highest level of its records, else None."""
    rank = F.when(F.col("risk_level") == "High", 3).when(F.col("risk_level") == "Medium", 2).when(F.col("risk_level") == "Low", 1)
    worst = records.groupBy("clip").agg(F.max(rank).alias("rank"))
    rows = fired.join(worst, "clip", "full_outer")
    return rows.select("clip", F.when(F.coalesce("fired", F.lit(False)), "High").otherwise(F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), F.col("rank") - 1), F.lit("None"))).alias("overall_risk"))
