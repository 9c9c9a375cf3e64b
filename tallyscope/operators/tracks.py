"""Motion of tracked objects: lags count a track's appearances, not frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import geometry as G

PERSON = 0


def _appearances():
    return Window.partitionBy("clip", "track_id").orderBy("frame")


def persons(rows: DataFrame) -> DataFrame:
    """Rows of persons."""
    return rows.filter(F.col("class_id") == PERSON)


def active(rows: DataFrame) -> DataFrame:
    """Tracks matched in the current frame; retained ones have an older `last_seen`."""
    return rows.filter(F.col("last_seen") == F.col("frame"))


def box_one_back() -> tuple[Column, ...]:
    """Box at a track's previous appearance, of whatever class: what rules compare with."""
    return tuple(F.lag(c, 1).over(_appearances()) for c in G.BOX)


def box_two_back() -> tuple[Column, ...]:
    """Box two appearances back: what the spatial feature compares with, so k appearances give max(k - 2, 0) samples."""
    return tuple(F.lag(c, 2).over(_appearances()) for c in G.BOX)


def motion(tracks: DataFrame, still: float = 3.0, frames: int = 5) -> DataFrame:
    """Adds to each appearance: `movement` since the last one, `total_distance`, `appearances`, `streak` of appearances with
    movement of at most `still` pixels (absence doesn't end it), and `is_stationary` (F10, F11)."""
    order = _appearances()
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tracks.withColumn("movement", G.displacement(box_one_back(), G.box()))
    rows = rows.withColumns({"total_distance": F.sum("movement").over(upto), "appearances": F.row_number().over(order).cast("bigint"), "_moved": (F.col("movement") > still).cast("int")})
    rows = rows.withColumn("_run", F.sum("_moved").over(upto))
    run = Window.partitionBy("clip", "track_id", "_run").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("streak", F.sum(1 - F.col("_moved")).over(run).cast("bigint"))
    return rows.withColumn("is_stationary", F.col("streak") >= frames).drop("_moved", "_run")


def speeds(tracks: DataFrame) -> DataFrame:
    """Person appearances with `speed` over two appearances, and `speed_change` between samples of a track."""
    back = box_two_back()
    rows = tracks.withColumns({f"_b{k}": c for k, c in enumerate(back)})
    old = tuple(F.col(f"_b{k}") for k in range(4))
    rows = rows.withColumn("speed", F.when(old[0].isNotNull(), G.displacement(old, G.box()))).drop(*[f"_b{k}" for k in range(4)])
    people = persons(rows).filter(F.col("speed").isNotNull())
    return people.withColumn("speed_change", F.abs(F.col("speed") - F.lag("speed", 1).over(_appearances())))


def diagonals(tracks: DataFrame) -> DataFrame:
    """`clip`, `frame`, `persons`, `diagonal` of frames with persons."""
    return persons(tracks).groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("persons"), G.enclosing_diagonal().alias("diagonal"))


def spatial_feature(tracks: DataFrame, spine: DataFrame) -> DataFrame:
    """One row for each clip: frames, frames without persons, mean persons, mean speed, mean diagonal, and their ratio, a
    ratio of means; null without a sample or with a zero diagonal (E20, G9)."""
    frames = spine.join(diagonals(tracks), ["clip", "frame"], "left").groupBy("clip").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("persons").isNull()).alias("empty_frames"), F.avg(F.coalesce("persons", F.lit(0))).alias("mean_persons"), F.avg("diagonal").alias("diag_mean")
    )
    moved = speeds(tracks).groupBy("clip").agg(F.avg("speed").alias("speed_mean"), F.count("speed").alias("samples"))
    out = frames.join(moved, "clip", "left")
    return out.withColumn("samples", F.coalesce("samples", F.lit(0))).withColumn("spatial", F.try_divide("speed_mean", F.nullif(F.col("diag_mean"), F.lit(0.0))))


def pairs(tracks: DataFrame) -> DataFrame:
    """Person pairs of a frame (smaller id first) with their normalised centre distance (D5, C11). The join is an equality on
    the frame with an order on ids; a frame holds few persons."""
    people = persons(tracks).select("clip", "frame", "track_id", *G.BOX)
    a = people.select("clip", "frame", *[F.col(c).alias(f"a_{c}") for c in ("track_id", *G.BOX)])
    b = people.select("clip", "frame", *[F.col(c).alias(f"b_{c}") for c in ("track_id", *G.BOX)])
    (ax, ay), (bx, by) = G.centre(G.box("a_")), G.centre(G.box("b_"))
    joined = a.join(b, ["clip", "frame"]).filter("a_track_id < b_track_id").join(diagonals(tracks), ["clip", "frame"])
    return joined.select("clip", "frame", F.col("a_track_id").alias("id_a"), F.col("b_track_id").alias("id_b"), "diagonal", G.normalised(F.hypot(ax - bx, ay - by), F.col("diagonal")).alias("distance"))


def confident(detections: DataFrame, least: float) -> DataFrame:
    """Detections of at least a confidence."""
    return detections.filter(F.col("conf") >= least)


def id_persistence(tracks: DataFrame) -> DataFrame:
    """Of each clip: distinct ids, and whether any was seen twice."""
    seen = tracks.groupBy("clip", "track_id").agg(F.count_distinct("frame").alias("n"))
    return seen.groupBy("clip").agg(F.count(F.lit(1)).alias("ids"), F.bool_or(F.col("n") >= 2).alias("persistent"))


def top_detection(detections: DataFrame, class_id: int) -> DataFrame:
    """The most confident detection of a class in each frame, ties to the first; a frame without one fails the query (H9)."""
    best = F.max_by(F.struct("det_idx", "conf", *G.BOX), F.when(F.col("class_id") == class_id, F.struct("conf", -F.col("det_idx"))))
    rows = detections.groupBy("clip", "frame").agg(best.alias("b"), F.count_if(F.col("class_id") == class_id).alias("_n"))
    found = F.when(F.col("_n") > 0, F.col("b")).otherwise(F.raise_error(F.lit(f"a frame without class {class_id}")))
    return rows.withColumn("b", found).select("clip", "frame", "b.*")


def nearest(detections: DataFrame, targets: DataFrame) -> DataFrame:
    """For each frame's target point (`clip`, `frame`, `x`, `y`) the detection of the nearest centre, ties to the first."""
    cx, cy = G.centre(G.box())
    far = (cx - F.col("x")) * (cx - F.col("x")) + (cy - F.col("y")) * (cy - F.col("y"))
    rows = detections.join(targets, ["clip", "frame"])
    return rows.groupBy("clip", "frame").agg(F.min_by("det_idx", F.struct(far.alias("d"), "det_idx")).alias("det_idx"))
