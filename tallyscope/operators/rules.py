"""Event rules over tracks as window plans.

Stationary fires at every frame of a long enough streak; restricted entry fires on entering; crowding and proximity fire once
for each streak of consecutive frames, and frames without tracks count, so these two need the full spine of frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import geometry as G
from tallyscope.operators import tracks as T

#: Fixed values, equal to those of the system that these results have to match: event names, confidences of rules that have one, and
#: descriptions.
STATIONARY, RESTRICTED, CROWDING, PROXIMITY, TEMPORAL = "Stationary Person", "Restricted Area Entry", "Crowding", "Proximity/Interaction", "Temporal Violence Signal"
CONFIDENCE = {STATIONARY: 0.9, RESTRICTED: 0.95}
DESCRIPTION = {
    STATIONARY: "Person remained stationary for too many consecutive frames.",
    RESTRICTED: "Person entered the predefined restricted region.",
    CROWDING: "Configured simultaneous-person threshold persisted.",
    PROXIMITY: "Tracked persons remained within the configured normalized distance.",
}


@dataclass(frozen=True)
class EventRule:
    """A rule that can be switched off; parameters have the usual defaults."""

    name: str
    enabled: bool = True
    parameters: dict = field(default_factory=dict)
    #: A rule of one's own: from (tracks, spine, rule) to `clip`, `frame`, `object_ids`, `confidence`, `evidence`.
    run: Callable[[DataFrame, DataFrame, EventRule], DataFrame] | None = None

    def get(self, key: str, default):
        return self.parameters.get(key, default)


def named(rules: list[EventRule], fragment: str) -> EventRule | None:
    """The first rule whose name holds a fragment, whatever its case."""
    return next((r for r in rules if fragment.lower() in r.name.lower()), None)


def stationary(tracks: DataFrame, still: float = 3.0, frames: int = 5) -> DataFrame:
    """`clip`, `frame`, `track_id`, `streak` of persons at rest: level-triggered."""
    return T.persons(T.motion(tracks, still, frames)).filter("is_stationary").select("clip", "frame", "track_id", "streak")


def restricted(tracks: DataFrame, region: tuple[float, float, float, float] = (0, 0, 200, 200)) -> DataFrame:
    """`clip`, `frame`, `track_id` of persons inside now and not at their previous appearance."""
    before = T.box_one_back()
    rows = tracks.withColumn("_was", F.when(before[0].isNull(), False).otherwise(G.inside(G.centre(before), region)))
    return T.persons(rows).filter(G.inside(G.centre(G.box()), region) & ~F.col("_was")).select("clip", "frame", "track_id")


def crowding(tracks: DataFrame, spine: DataFrame, least: int, persistence: int) -> DataFrame:
    """`clip`, `frame`, `persons`, `object_ids`: the frame in which `least` persons have stayed for `persistence` frames, once
    for each streak (G4)."""
    if persistence < 1 or least < 1:
        raise ValueError("least and persistence must be at least 1")
    counts = T.persons(tracks).groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("persons"), F.sort_array(F.collect_list("track_id")).alias("object_ids"))
    order = Window.partitionBy("clip").orderBy("frame")
    rows = spine.select("clip", "frame").join(counts, ["clip", "frame"], "left").withColumn("_on", F.coalesce(F.col("persons") >= least, F.lit(False)))
    rows = rows.withColumn("_gap", F.sum((~F.col("_on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.row_number().over(Window.partitionBy("clip", "_gap").orderBy("frame"))
    return rows.filter("_on").withColumn("_place", place).filter(F.col("_place") == persistence).select("clip", "frame", "persons", "object_ids")


def proximity(tracks: DataFrame, nearer: float, persistence: int) -> DataFrame:
    """`clip`, `frame`, `id_a`, `id_b`, `distance`, `diagonal`: the frame in which a pair has been near for `persistence`
    consecutive frames, once for each streak of that pair (G5). Frames are numbered without gaps."""
    if persistence < 1:
        raise ValueError("persistence must be at least 1")
    near = T.pairs(tracks).filter(F.col("distance") <= nearer)
    order = Window.partitionBy("clip", "id_a", "id_b").orderBy("frame")
    rows = near.withColumn("_run", F.col("frame") - F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy("clip", "id_a", "id_b", "_run").orderBy("frame"))
    return rows.withColumn("_place", place).filter(F.col("_place") == persistence).select("clip", "frame", "id_a", "id_b", "distance", "diagonal")


def _event(rows: DataFrame, name: str, text: str, rank: int, object_id, object_ids, evidence, confidence=None) -> DataFrame:
    confidence = F.lit(CONFIDENCE.get(name)).cast("double") if confidence is None else confidence.cast("double")
    return rows.select(
        "clip", "frame", F.lit(name).alias("event_type"), F.lit(text).alias("description"), confidence.alias("confidence"), evidence.alias("evidence"),
        object_id.cast("bigint").alias("object_id"), object_ids.cast("array<bigint>").alias("object_ids"),
        F.struct(F.lit(int(rank > 1)).alias("g"), object_id.cast("bigint").alias("o"), F.lit(rank).alias("r")).alias("_order"),
    )


def detect(tracks: DataFrame, spine: DataFrame, rules: list[EventRule]) -> DataFrame:
    """Events of all enabled rules with `seq`, their order within a clip: by frame, per track stationary before restricted,
    then crowding, then proximity (G6, G7). A rule that is off is no part of the plan."""
    none, parts = F.lit(None), []
    for rule in (r for r in rules if r.enabled):
        if rule.run is not None:
            rows = rule.run(tracks, spine, rule)
            own = _event(rows, rule.name, rule.get("description", rule.name), 4 + len(parts), none, F.col("object_ids"), F.col("evidence"))
            parts.append(own if "confidence" not in rows.columns else _event(rows, rule.name, rule.get("description", rule.name), 4 + len(parts), none, F.col("object_ids"), F.col("evidence"), F.col("confidence")))
        elif rule.name == STATIONARY:
            rows = stationary(tracks, rule.get("movement", 3.0), rule.get("frames", 5))
            parts.append(_event(rows, STATIONARY, DESCRIPTION[STATIONARY], 0, F.col("track_id"), F.array("track_id"), F.array(F.format_string("stationary_frames=%d", F.col("streak")))))
        elif rule.name == RESTRICTED:
            rows = restricted(tracks, rule.get("region", (0, 0, 200, 200)))
            parts.append(_event(rows, RESTRICTED, DESCRIPTION[RESTRICTED], 1, F.col("track_id"), F.array("track_id"), F.array(F.lit("entered_region=true"))))
        elif rule.name == CROWDING:
            rows = crowding(tracks, spine, rule.get("least", 3), rule.get("persistence", 3))
            evidence = F.array(F.format_string("person_count=%d", F.col("persons")), F.lit(f"minimum_person_count={rule.get('least', 3)}"), F.lit(f"persistence_frames={rule.get('persistence', 3)}"))
            parts.append(_event(rows, CROWDING, DESCRIPTION[CROWDING], 2, none, F.col("object_ids"), evidence))
        elif rule.name == PROXIMITY:
            rows = proximity(tracks, rule.get("nearer", 0.1), rule.get("persistence", 3))
            evidence = F.array(F.format_string("normalized_centroid_distance=%.4f", F.col("distance")), F.format_string("person_group_diagonal=%.4f", F.col("diagonal")), F.lit(f"distance_threshold={rule.get('nearer', 0.1)}"), F.lit(f"persistence_frames={rule.get('persistence', 3)}"))
            parts.append(_event(rows, PROXIMITY, DESCRIPTION[PROXIMITY], 3, none, F.array("id_a", "id_b"), evidence))
        else:
            raise ValueError(f"unknown rule {rule.name}")
    if not parts:
        raise ValueError("no rule is enabled")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    seq = F.row_number().over(Window.partitionBy("clip").orderBy("frame", "_order.g", "_order.o", "_order.r", "object_ids"))
    return rows.withColumn("seq", seq.cast("bigint")).drop("_order")


def temporal_events(peaks: DataFrame, alarms: DataFrame) -> DataFrame:
    """At most one event for each clip whose rule fired: confidence is the peak score, the frame (from 1) that of the first
    alarm (G8). `peaks` from `decisions.peaks`, `alarms` from `windows.first_alarm`."""
    rows = alarms.filter("alarmed").join(peaks, "clip")
    return rows.select(
        "clip", (F.col("alarm_frame") + 1).alias("frame"), F.lit(TEMPORAL).alias("event_type"), F.col("score").alias("confidence"),
        F.array(F.format_string("peak_probability=%.6f", F.col("score")), F.format_string("peak_window_index=%d", F.col("window_index"))).alias("evidence"), "time_to_alarm_seconds",
    )


def clip_state(spine: DataFrame, decided: DataFrame) -> DataFrame:
    """Undetermined without windows, else Fight or NonFight."""
    return spine.select("clip").distinct().join(decided, "clip", "left").select("clip", F.when(F.col("fired").isNull(), "Undetermined").when(F.col("fired"), "Fight").otherwise("NonFight").alias("state"))


def fire_fraction(events: DataFrame, spine: DataFrame) -> DataFrame:
    """Of each clip and event type: distinct frames in which it fired, over the clip's frames, at least one."""
    frames = spine.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"))
    fired = events.groupBy("clip", "event_type").agg(F.count_distinct("frame").alias("fired"))
    return fired.join(frames, "clip", "left").select("clip", "event_type", "fired", (F.col("fired") / F.greatest(F.coalesce("frames", F.lit(0)), F.lit(1))).alias("fraction"))
