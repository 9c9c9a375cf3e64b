"""Count-based sliding windows, running decisions over them and first alarms.

Every operator takes the columns that partition and order its rows; one clip is the unit of parallelism, and all
windows over a clip share its partitioning, so a chain of them shuffles once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(frames: int, length: int, stride: int) -> list[tuple[int, int]]:
    """First and last frame (inclusive) of every complete window of a clip (F1).

    A window is emitted once it is full and `stride` frames have passed since the last, so with a stride beyond the
    length the first one ends at frame stride - 1. There is no partial window at the end.
    """
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be positive")
    start = max(length, stride) - 1
    return [(last - length + 1, last) for last in range(start, frames, stride)]


def bounds_column(frames: Column, length: int, stride: int) -> Column:
    """`bounds` as an array column of (first, last) for a column of frame counts (F1, F2)."""
    start = max(length, stride) - 1
    ends = F.when(frames > start, F.sequence(F.lit(start).cast("bigint"), frames.cast("bigint") - 1, F.lit(stride).cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.transform(ends, lambda e: F.struct((e - length + 1).alias("first"), e.alias("last")))


def sliding(frames: DataFrame, aggregate: Callable[[str], Column], column: str, length: int, stride: int, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """Aggregate a column over each complete sliding window: `clip`, `window_index`, `first_frame`, `last_frame`, `value`.

    Frames of a clip are numbered from 0 without gaps. One sort per clip; a frame takes part in a bounded ROWS frame.
    """
    start = max(length, stride) - 1
    span = Window.partitionBy(clip).orderBy(frame).rowsBetween(-(length - 1), Window.currentRow)
    f = F.col(frame)
    rows = frames.withColumn("value", aggregate(column).over(span)).filter((f >= start) & ((f - start) % stride == 0))
    return rows.select(clip, F.expr(f"({frame} - {start}) div {stride}").alias("window_index"), (f - (length - 1)).alias("first_frame"), f.alias("last_frame"), "value")


def geometry_mismatches(recorded: DataFrame, frames: DataFrame, length: int, stride: int, limit: int | None = 5) -> DataFrame:
    """Clips whose recorded windows (`clip`, `window_index`, `first_frame`, `last_frame`) differ from those that `frames`
    (`clip`, `frames`) implies; the first `limit` in clip order (F2, A12)."""
    found = recorded.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("window_index", "first_frame", "last_frame"))).alias("w"))
    found = found.select("clip", F.transform("w", lambda x: F.struct(x["first_frame"].cast("bigint").alias("first"), x["last_frame"].cast("bigint").alias("last"))).alias("recorded"))
    expected = frames.select("clip", bounds_column(F.col("frames"), length, stride).alias("expected"))
    wrong = expected.join(found, "clip", "full_outer").filter(~F.col("expected").eqNullSafe(F.col("recorded")) & ~((F.size("expected") == 0) & F.col("recorded").isNull()))
    return wrong.orderBy("clip").limit(limit) if limit else wrong


def prefix(clip: str = "clip", order: str = "window_index"):
    """The windows of a clip up to the current one."""
    return Window.partitionBy(clip).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def first_alarm(windows: DataFrame, holds: Column, fps: float = 30.0) -> DataFrame:
    """One row for each clip: whether a prefix of its windows satisfies the rule, and the first window and frame where it
    does, with seconds (frame + 1) / fps to four places (F7, F8). `holds` is a running condition over `prefix()`."""
    rows = windows.withColumn("_holds", holds)
    at = lambda c: F.min_by(c, F.when(F.col("_holds"), F.col("window_index")))
    out = rows.groupBy("clip").agg(
        F.bool_or("_holds").alias("alarmed"),
        F.min(F.when(F.col("_holds"), F.col("window_index"))).alias("alarm_window_index"),
        at("last_frame").alias("alarm_frame"),
    )
    return out.withColumn("alarm_frame", F.when(F.col("alarmed"), F.col("alarm_frame"))).withColumn("time_to_alarm_seconds", F.round((F.col("alarm_frame") + 1) / fps, 4))


def retraction(windows: DataFrame, prefix_score: Column, threshold: float) -> DataFrame:
    """One row for each clip: whether some prefix crossed the threshold, and whether a later one fell below again."""
    rows = windows.withColumn("_over", F.coalesce(prefix_score >= threshold, F.lit(False)))
    rows = rows.withColumn("_before", F.bool_or("_over").over(prefix()))
    return rows.groupBy("clip").agg(F.bool_or("_over").alias("alarmed"), F.bool_or(F.col("_before") & ~F.col("_over")).alias("retracted"))


def covering(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """The score of each frame (`clip`, `frame`): the largest of the windows that cover it, else that of the last window
    completed before it, else null (D7, G11). A window is spread over its frames, so the join is an equality."""
    spread = windows.select("clip", F.explode(F.sequence("first_frame", "last_frame")).alias("frame"), "score")
    over = spread.groupBy("clip", "frame").agg(F.max("score").alias("covering"))
    done = windows.groupBy("clip", F.col("last_frame").alias("frame")).agg(F.max_by("score", "window_index").alias("completed"))
    last = F.last("completed", ignorenulls=True).over(Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = frames.select("clip", "frame").join(over, ["clip", "frame"], "left").join(done, ["clip", "frame"], "left").withColumn("live", last)
    return rows.select("clip", "frame", F.coalesce("covering", "live").alias("replay"), "live")


def completed_at(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """Windows that end at a frame."""
    return frames.join(windows.withColumnRenamed("last_frame", "frame"), ["clip", "frame"])
