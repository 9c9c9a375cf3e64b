"""Tracks, rules and the tracker (F10-F14, G1-G8; traps T1-T6, T18, T21)."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import risk, rules, tracking
from tallyscope.operators import tracks as T

SCHEMA = "clip bigint, frame bigint, track_id bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def frame_of(spark, rows):
    return spark.createDataFrame([(0, f, t, c, 0.9, *map(float, b)) for f, t, c, b in rows], SCHEMA)


def spine_of(spark, n):
    return spark.range(n).select(F.lit(0).cast("bigint").alias("clip"), F.col("id").alias("frame"))


def test_two_appearance_lag(spark):
    for k in range(1, 6):
        got = T.speeds(frame_of(spark, [(3 * f, 1, 0, (10 * f, 0, 10 * f + 4, 4)) for f in range(k)])).collect()
        assert len(got) == max(k - 2, 0) and all(r.speed == 20.0 for r in got)


def test_lag_counts_appearances_of_any_class(spark):
    rows = [(0, 1, 0, (0, 0, 2, 2)), (5, 1, 2, (10, 0, 12, 2)), (9, 1, 0, (30, 0, 32, 2))]
    assert [r.speed for r in T.speeds(frame_of(spark, rows)).collect()] == [30.0]
    assert [r.movement for r in T.motion(frame_of(spark, rows)).orderBy("frame").collect()] == [0.0, 10.0, 20.0]


def test_stationary_fires_in_every_frame_and_survives_absence(spark):
    rows = [(f, 1, 0, (0, 0, 2, 2)) for f in (0, 1, 7, 8)] + [(9, 1, 0, (50, 0, 52, 2))]
    assert [r.frame for r in rules.stationary(frame_of(spark, rows), 3, 2).orderBy("frame").collect()] == [1, 7, 8]


def test_restricted_fires_on_entering(spark):
    inside, outside = (0, 0, 10, 10), (500, 500, 510, 510)
    rows = [(0, 1, 0, inside), (1, 1, 0, inside), (2, 1, 0, outside), (3, 1, 0, inside), (0, 2, 2, inside)]
    assert [(r.frame, r.track_id) for r in rules.restricted(frame_of(spark, rows)).orderBy("frame").collect()] == [(0, 1), (3, 1)]


def test_crowding_fires_once_and_rearms(spark):
    a, b = (0, 0, 10, 10), (20, 0, 30, 10)
    rows = [(f, t, 0, box) for f in (1, 2, 3, 5, 6) for t, box in ((1, a), (2, b))]
    got = rules.crowding(frame_of(spark, rows), spine_of(spark, 8), 2, 2).orderBy("frame").collect()
    assert [(r.frame, r.object_ids) for r in got] == [(2, [1, 2]), (6, [1, 2])]
    assert rules.crowding(frame_of(spark, rows), spine_of(spark, 8), 3, 2).count() == 0
    with pytest.raises(ValueError):
        rules.crowding(frame_of(spark, rows), spine_of(spark, 8), 1, 0)


def test_proximity_sustained(spark):
    rows = [(f, t, 0, box) for f in (1, 2, 3) for t, box in ((4, (0, 0, 10, 10)), (9, (12, 0, 22, 10)))]
    got = rules.proximity(frame_of(spark, rows), 0.5, 2).collect()
    assert [(r.frame, r.id_a, r.id_b) for r in got] == [(2, 4, 9)]
    far = [(1, 1, 0, (0, 0, 2, 2)), (1, 2, 0, (100, 0, 102, 2))]
    assert rules.proximity(frame_of(spark, far), 0.1, 1).count() == 0


def brute_streaks(present, persistence):
    """Frames at which a streak over consecutive frames reaches a length."""
    out, run = [], 0
    for frame, on in enumerate(present):
        run = run + 1 if on else 0
        if run == persistence:
            out.append(frame)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rules_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f, t, rng.choice([0, 0, 2]), (x := rng.randrange(60), y := rng.randrange(60), x + 9, y + 9)) for f in range(25) for t in range(4) if rng.random() < 0.6]
    df = frame_of(spark, rows)
    persons = {f: sorted(t for g, t, c, _ in rows if g == f and c == 0) for f in range(25)}
    want = brute_streaks([len(persons[f]) >= 2 for f in range(25)], 2)
    assert [r.frame for r in rules.crowding(df, spine_of(spark, 25), 2, 2).orderBy("frame").collect()] == want
    boxes = {(f, t): b for f, t, c, b in rows if c == 0}
    pairs = []
    for a in range(4):
        for b in range(a + 1, 4):
            near = []
            for f in range(25):
                if (f, a) in boxes and (f, b) in boxes:
                    own = [boxes[f, t] for t in persons[f]]
                    xs, ys = [v for q in own for v in (q[0], q[2])], [v for q in own for v in (q[1], q[3])]
                    diagonal = np.hypot(max(xs) - min(xs), max(ys) - min(ys))
                    near.append(np.hypot(boxes[f, a][0] - boxes[f, b][0], boxes[f, a][1] - boxes[f, b][1]) / diagonal <= 0.5)
                else:
                    near.append(False)
            pairs += [(f, a, b) for f in brute_streaks(near, 2)]
    assert sorted((r.frame, r.id_a, r.id_b) for r in rules.proximity(df, 0.5, 2).collect()) == sorted(pairs)


def test_event_order_and_disabled_rules(spark):
    rows = [(f, t, 0, box) for f in (0, 1) for t, box in ((1, (0, 0, 10, 10)), (2, (12, 0, 22, 10)))]
    on = [rules.EventRule(n, parameters=p) for n, p in ((rules.STATIONARY, {"frames": 1}), (rules.RESTRICTED, {}), (rules.CROWDING, {"least": 2, "persistence": 1}), (rules.PROXIMITY, {"nearer": 1.0, "persistence": 1}))]
    got = [(r.event_type, r.object_id) for r in rules.detect(frame_of(spark, rows), spine_of(spark, 2), on).orderBy("seq").collect()][:6]
    assert got == [(rules.STATIONARY, 1), (rules.RESTRICTED, 1), (rules.STATIONARY, 2), (rules.RESTRICTED, 2), (rules.CROWDING, None), (rules.PROXIMITY, None)]
    only = rules.detect(frame_of(spark, rows), spine_of(spark, 2), [rules.EventRule(rules.RESTRICTED), rules.EventRule(rules.CROWDING, enabled=False)])
    assert {r.event_type for r in only.collect()} == {rules.RESTRICTED}


def test_risk_records(spark):
    rows = spark.createDataFrame([(0, 1, rules.STATIONARY, 0.9), (0, 2, "Odd", 0.0), (0, 3, rules.TEMPORAL, 0.7)], "clip bigint, frame bigint, event_type string, confidence double")
    got = [(r.risk_level, r.confidence, r.confidence_provenance) for r in risk.assess(rows).orderBy("frame").collect()]
    assert got == [("Low", 0.9, "declared_constant"), ("Unknown", None, None), ("High", 0.7, "measured")]


def simple_tracker(frames, least, max_age):
    """A plain reading of greedy association, for comparison."""
    tracks, nxt, out = {}, 1, []
    for frame, boxes in frames:
        pairs = []
        for order, (k, t) in enumerate(tracks.items()):
            for j, b in enumerate(boxes):
                w, h = min(t[0][2], b[2]) - max(t[0][0], b[0]), min(t[0][3], b[3]) - max(t[0][1], b[1])
                inter = max(w, 0) * max(h, 0)
                area = (t[0][2] - t[0][0]) * (t[0][3] - t[0][1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
                pairs.append((-(inter / area if area > 0 else 0), order, j, k))
        used_t, used_d = set(), set()
        for o, _, j, k in sorted(pairs):
            if -o >= least and k not in used_t and j not in used_d:
                used_t.add(k)
                used_d.add(j)
                tracks[k] = (boxes[j], frame)
        for j, b in enumerate(boxes):
            if j not in used_d:
                tracks[nxt] = (b, frame)
                nxt += 1
        tracks = {k: t for k, t in tracks.items() if frame - t[1] <= max_age}
        out += [(frame, k) for k, t in tracks.items() if t[1] == frame]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tracker_matches_a_plain_one(spark, seed):
    rng = random.Random(seed)
    frames = [(f, [(x := rng.randrange(0, 40, 4), y := rng.randrange(0, 12, 4), x + 12, y + 12) for _ in range(rng.randrange(4))]) for f in range(20)]
    rows = [(0, f, j, 0, 0.5, *map(float, b)) for f, boxes in frames for j, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "clip bigint, frame bigint, det_idx bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    got = [(r.frame, r.track_id) for r in tracking.track(df, spine_of(spark, 20), 0.3, 2).collect()]
    assert sorted(got) == sorted(simple_tracker(frames, 0.3, 2))


def test_retained_tracks_are_filtered(spark):
    rows = pd.DataFrame({"frame": [0, 1], "det_idx": [0, 0], "class_id": [0, 0], "conf": [1.0, 1.0], "x1": [0.0, np.nan], "y1": [0.0, np.nan], "x2": [5.0, np.nan], "y2": [5.0, np.nan]})
    assert len(tracking.run_frames(tracking.State(), 0, rows, 0.3, 30, True)) == 1
    assert len(tracking.run_frames(tracking.State(), 0, rows, 0.3, 30, False)) == 2


def test_top_nearest_and_fraction(spark):
    schema = "clip bigint, frame bigint, det_idx bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
    rows = [(0, 0, 0, 0, 0.5, 0.0, 0.0, 2.0, 2.0), (0, 0, 1, 0, 0.9, 8.0, 0.0, 10.0, 2.0), (0, 0, 2, 2, 1.0, 0.0, 0.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, schema)
    assert T.top_detection(df, 0).first().det_idx == 1
    with pytest.raises(Exception, match="without class"):
        T.top_detection(df, 7).collect()
    point = spark.createDataFrame([(0, 0, 5.0, 1.0)], "clip bigint, frame bigint, x double, y double")
    assert T.nearest(df, point).first().det_idx == 2
    events = spark.createDataFrame([(0, 1, "a"), (0, 1, "a"), (0, 2, "a")], "clip bigint, frame bigint, event_type string")
    assert rules.fire_fraction(events, spine_of(spark, 8)).first().fraction == 0.25


def test_tracker_batches_cut_frames(spark):
    rows = [(c, f, d, d % 2, 0.5, 30.0 * d + f, 0.0, 30.0 * d + f + 20, 20.0 + c) for c in range(4) for f in range(12) for d in range(1 + (f + c) % 3)]
    schema = "clip bigint, frame bigint, det_idx int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame(rows, schema).repartition(3)
    want = []
    for c in range(4):
        one = pd.DataFrame([r for r in rows if r[0] == c], columns=df.columns)
        want += list(tracking.run_frames(tracking.State(), c, one, 0.3, 2, False).itertuples(index=False, name=None))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "2")
        got = [tuple(r) for r in tracking.track(df, None, 0.3, 2, False).collect()]
    finally:
        spark.conf.set(size, before)
    assert sorted(got) == sorted(want) and len(want) > len(rows)


def test_tracker_without_rows(spark):
    empty = spark.createDataFrame([], "clip bigint, frame bigint, det_idx int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert tracking.track(empty).collect() == []
