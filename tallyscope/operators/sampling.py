"""Frame sampling within clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(clips: DataFrame, n: int, frames: str = "frames") -> DataFrame:
    """`clip`, `segment`, `start`, `stop` of n equal segments; each holds a frame, even in shorter clips."""
    if n < 1:
        raise ValueError("n must be positive")
    rows = clips.select("clip", F.col(frames).cast("bigint").alias("t"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("segment"))
    start = F.expr(f"segment * t div {n}")
    return rows.select("clip", "t", "segment", start.alias("start"), F.greatest(F.expr(f"(segment + 1) * t div {n}"), start + 1).alias("stop"))


def uniform(clips: DataFrame, n: int, frames: str = "frames") -> DataFrame:
    """`clip`, `segment`, `frame`: the middle of each segment, within the clip."""
    return segments(clips, n, frames).select("clip", "segment", F.least(F.expr("start + (stop - start) div 2"), F.col("t") - 1).alias("frame"))


def jittered(clips: DataFrame, n: int, seed: int, epoch: int, frames: str = "frames") -> DataFrame:
    """A frame of each segment drawn by a digest of (seed, epoch, clip, segment): the same in each run."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col("clip"), F.col("segment")), F.col("stop") - F.col("start"))
    return segments(clips, n, frames).select("clip", "segment", F.least(F.col("start") + drawn, F.col("t") - 1).alias("frame"))


def sample(clips: DataFrame, n: int, mode: str = "uniform", **options) -> DataFrame:
    """Frames by `uniform` or `jittered` sampling, with how many of a clip's samples repeat a frame."""
    if mode not in ("uniform", "jittered"):
        raise ValueError(f"unknown mode {mode}")
    rows = uniform(clips, n) if mode == "uniform" else jittered(clips, n, options["seed"], options["epoch"])
    repeats = F.count(F.lit(1)).over(Window.partitionBy("clip")) - F.size(F.collect_set("frame").over(Window.partitionBy("clip")))
    return rows.withColumn("frames_repeated", repeats)


def described(sampled: DataFrame, mode: str, n: int) -> DataFrame:
    """One line for each clip that says how it was sampled."""
    rows = sampled.groupBy("clip").agg(F.max("frames_repeated").alias("frames_repeated"))
    return rows.withColumn("description", F.concat(F.lit(f"{mode}, {n} segments, "), F.col("frames_repeated").cast("string"), F.lit(" frames repeated")))


def decode(wanted: DataFrame, frames: DataFrame, count: Column) -> DataFrame:
    """Frames for the wanted indices; one past the end gets the last (A4). A join on (clip, frame), never a seek."""
    return wanted.withColumn("frame", F.least("frame", count - 1)).join(frames, ["clip", "frame"])
