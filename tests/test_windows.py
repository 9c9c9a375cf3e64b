"""Sliding windows, decisions, alarms, sampling (F1-F9, E1-E8, D7; traps T14, T19, T22)."""

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import decisions as D
from tallyscope.operators import sampling
from tallyscope.operators import windows as W


def scores(spark, *clips):
    return spark.createDataFrame([(c, i, 8 * i, 8 * i + 15, float(s), "Fight") for c, values in enumerate(clips) for i, s in enumerate(values)], "clip bigint, window_index bigint, first_frame bigint, last_frame bigint, score double, true_label string")


def test_geometry():
    got = W.bounds(150, 16, 8)
    assert len(got) == 17 and got[0] == (0, 15) and got[-1] == (128, 143)
    assert W.bounds(15, 16, 8) == [] and W.bounds(12, 4, 6)[0] == (2, 5)


@pytest.mark.parametrize("frames, length, stride", [(0, 4, 2), (3, 4, 2), (20, 4, 2), (20, 4, 4), (20, 4, 6), (21, 16, 8)])
def test_sliding_matches_a_buffer(spark, frames, length, stride):
    want, buffer, since = [], [], None
    for f in range(frames):
        buffer = [*buffer, f][-length:]
        since = since + 1 if since is not None else f + 1
        if len(buffer) == length and since >= stride:
            want.append((buffer[0], f, max((7 * x) % 11 for x in buffer)))
            since = 0
    df = spark.range(frames).select(F.lit(1).alias("clip"), F.col("id").alias("frame"), ((F.col("id") * 7) % 11).alias("p"))
    got = [(r.first_frame, r.last_frame, r.value) for r in W.sliding(df, F.max, "p", length, stride).orderBy("window_index").collect()]
    assert got == want and [(a, b) for a, b, _ in want] == W.bounds(frames, length, stride)
    assert spark.range(1).select(F.size(W.bounds_column(F.lit(frames), length, stride)).alias("n")).first().n == len(want)


def test_geometry_mismatches_are_found(spark):
    recorded = scores(spark, [1, 1], [1])
    frames = spark.createDataFrame([(0, 31), (1, 31), (2, 10)], "clip bigint, frames bigint")
    assert [r.clip for r in W.geometry_mismatches(recorded, frames, 16, 8).collect()] == [1]


def test_rules(spark):
    df = scores(spark, [0.1, 0.9], [0.5, 0.5])
    fired = lambda name, **p: [r.fired for r in D.decide(df, D.Rule(name, p)).orderBy("clip").collect()]
    assert fired("max", threshold=0.9) == [True, False] and fired("mean", threshold=0.5) == [True, True]
    assert fired("any", threshold=0.5) == [True, True] and fired("k_of_n", threshold=0.5, k=2) == [False, True]
    with pytest.raises(ValueError):
        D.Rule("most", {"threshold": 1}).decide()


def test_top_k_mean_is_not_monotone(spark):
    got = [scores(spark, x).groupBy("clip").agg(D.top_k_mean(2).alias("v")).first().v for x in ([0.9], [0.9, 0.1])]
    assert got == [0.9, 0.5]


def test_consecutive_of_short_clips_is_null(spark):
    got = {r.clip: r.value for r in D.consecutive(scores(spark, [0.9], [0.2, 0.8, 0.7, 0.1]), 2).collect()}
    assert got == {0: None, 1: 0.7}


def test_peak_ties_go_to_the_first_window(spark):
    assert D.peaks(scores(spark, [0.2, 0.9, 0.9])).first().window_index == 1


def test_first_alarm_and_retraction(spark):
    df = scores(spark, [0.1, 0.8, 0.1], [0.1])
    rows = {r.clip: r for r in W.first_alarm(df, D.Rule("max", {"threshold": 0.8}).running()).collect()}
    assert (rows[0].alarm_window_index, rows[0].alarm_frame, rows[0].time_to_alarm_seconds) == (1, 23, 0.8)
    assert not rows[1].alarmed and rows[1].alarm_frame is None
    mean = {r.clip: (r.alarmed, r.retracted) for r in W.retraction(df, F.avg("score").over(W.prefix()), 0.4).collect()}
    assert mean == {0: (True, True), 1: (False, False)}


def test_frame_scores(spark):
    frames = spark.createDataFrame([(0, f) for f in range(30)], "clip bigint, frame bigint")
    got = {r.frame: (r.replay, r.live) for r in W.covering(scores(spark, [0.3, 0.6]), frames).collect()}
    assert got[0] == (0.3, None) and got[10] == (0.6, None) and got[16] == (0.6, 0.3) and got[25] == (0.6, 0.6)


def test_uniform_sampling_golden(spark):
    clips = spark.createDataFrame([("a", 150), ("b", 3)], "clip string, frames int")
    got = {}
    for r in sampling.uniform(clips, 16).orderBy("clip", "segment").collect():
        got.setdefault(r.clip, []).append(r.frame)
    assert got["a"] == [4, 13, 23, 32, 41, 51, 60, 70, 79, 88, 98, 107, 116, 126, 135, 145]
    assert max(got["b"]) == 2 and len(got["b"]) == 16


def test_jitter_stays_in_its_segment_and_repeats(spark):
    clips = spark.createDataFrame([("a", 150)], "clip string, frames int")
    rows = sampling.jittered(clips, 16, 1, 2).join(sampling.segments(clips, 16), ["clip", "segment"]).collect()
    assert all(r.start <= r.frame < r.stop for r in rows)
    assert sampling.sample(clips, 16, "jittered", seed=1, epoch=2).collect() == sampling.sample(clips, 16, "jittered", seed=1, epoch=2).collect()
