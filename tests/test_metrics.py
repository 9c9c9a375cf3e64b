"""Metrics, thresholds, intervals and paired tests against hand-computed values (E9, M1-M28, K1-K12; traps T7-T11, T16, T25)."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyscope.operators import intervals, metrics, paired
from tallyscope.operators import thresholds as K

TRUTH = [1, 1, 1, 1, 0, 0, 0, 0]
SCORES = [0.9, 0.8, 0.4, 0.1, 0.7, 0.3, 0.2, 0.05]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(zip(range(8), TRUTH, SCORES)), "doc_id bigint, truth int, score double")


def one(df):
    return df.first().asDict()


def test_confusion_by_hand(rows):
    got = one(metrics.operating(rows.withColumn("fired", F.col("score") >= 0.5).agg(*metrics.confusion())))
    assert (got["tp"], got["fn"], got["fp"], got["tn"]) == (2, 2, 1, 3)
    assert got["recall"] == 0.5 and got["specificity"] == 0.75 and got["accuracy"] == 5 / 8
    assert got["precision"] == pytest.approx(2 / 3)


def test_threshold_is_inclusive(spark):
    one_row = spark.createDataFrame([(1, 0.4)], "truth int, score double")
    assert K.sweep(one_row, [0.4]).first().tp == 1


def test_undefined_conventions(spark):
    none = spark.createDataFrame([(0, 0, 5, 0)], "tp bigint, fp bigint, tn bigint, fn bigint")
    a, b, c = one(metrics.nullable(none)), one(metrics.zeroed(none)), one(metrics.operating(none))
    assert a["precision"] is None and a["recall"] is None and a["f1"] is None
    assert b["precision"] == 0.0 and b["recall"] == 0.0 and b["f1"] == 0.0
    assert c["recall"] == 0.0 and c["precision"] is None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=25))
def test_rank_metrics_match_brute_force(spark, sample):
    df = spark.createDataFrame([(i, t, s / 6) for i, (t, s) in enumerate(sample)], "doc_id bigint, truth int, score double")
    pos, neg = [s for t, s in sample if t], [s for t, s in sample if not t]
    auc = metrics.roc_auc(df).first().roc_auc
    if pos and neg:
        assert auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
        total = 0.0
        for level in sorted(set(pos)):
            tp, seen = sum(p >= level for p in pos), sum(s >= level for _, s in sample)
            total += sum(p == level for p in pos) * tp / seen
        assert metrics.average_precision(df).first().average_precision == pytest.approx(total / len(pos))
    else:
        assert auc is None


def test_two_average_precisions_differ_on_ties(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "doc_id bigint, truth int, score double")
    assert metrics.average_precision(df).first().average_precision == 0.5
    assert metrics.average_precision_rowwise(df).first().average_precision == 1.0


def test_roc_points_are_bracketed(rows):
    points = metrics.roc_points(rows).orderBy("point").collect()
    assert (points[0].fpr, points[0].tpr) == (0, 0) and (points[-1].fpr, points[-1].tpr) == (1, 1) and len(points) == 10
    assert all(a.tpr <= b.tpr and a.fpr <= b.fpr for a, b in zip(points, points[1:]))


def test_sweep_recall_falls_and_thresholds_are_rounded(rows):
    points = K.sweep(rows, K.grid(0.05, 0.95, 0.05)).orderBy("threshold").collect()
    assert len(points) == 19 and [p.threshold for p in points] == [round(0.05 * i, 6) for i in range(1, 20)]
    assert all(a.recall >= b.recall for a, b in zip(points, points[1:]))


def test_recommendation_falls_back_to_youden(rows):
    points = K.sweep(rows, K.grid(0.05, 0.95, 0.05))
    assert one(K.recommend(points, 0.6, 0.3))["basis"] == "constraints met"
    assert one(K.recommend(points, 1.1, 0.0))["basis"] == "largest Youden J"


def test_calibration_counts_null_as_not_fired(spark):
    df = spark.createDataFrame([(1, 0.9), (1, None), (0, 0.8), (0, 0.2)], "truth int, value double")
    got = one(K.calibrate(df, 1))
    assert got["threshold"] == 0.8 and got["fn"] == 1 and got["candidates"] == 3


def test_or_gate_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    data = [(int(t), float(a), float(b)) for t, a, b in zip(rng.integers(0, 2, 40), rng.integers(0, 9, 40) / 9, rng.integers(0, 9, 40) / 9)]
    got = one(K.or_gate(spark.createDataFrame(data, "truth int, a double, b double"), 8, "b", "a", 0.8))
    best = min(
        ((abs(fp - 8), -tp, -th, tp, fp) for th in {b for _, a, b in data if a < 0.8} for tp, fp in [(sum(t for t, a, b in data if a >= 0.8 or b >= th), sum(1 - t for t, a, b in data if a >= 0.8 or b >= th))]),
    )
    assert (got["tp"], got["fp"], got["threshold"]) == (best[3], best[4], -best[2])


def test_published_constants():
    assert intervals.z_of(0.95) == pytest.approx(1.959963984540054)
    assert K.half_even(2.5) == 2 and K.half_even(3.5) == 4


@pytest.mark.parametrize("k, n, low, high", [(311, 394, 0.7464, 0.8267), (160, 200, 0.7391, 0.8495)])
def test_wilson_goldens(spark, k, n, low, high):
    w = spark.range(1).select(intervals.wilson(F.lit(k), F.lit(n)).alias("w")).first().w
    assert (round(w.low, 4), round(w.high, 4)) == (low, high)


def test_wilson_is_exact_at_the_ends(spark):
    w = spark.range(1).select(intervals.wilson(F.lit(0), F.lit(7)).alias("a"), intervals.wilson(F.lit(7), F.lit(7)).alias("b"), intervals.wilson(F.lit(0), F.lit(0)).alias("c")).first()
    assert w.a.low == 0.0 and w.b.high == 1.0 and w.c is None


@pytest.mark.parametrize("b, c, p", [(25, 22, 0.7708669945730264), (46, 29, 0.0639), (0, 0, 1.0), (28, 6, 0.000195), (1500, 1400, None)])
def test_mcnemar(spark, b, c, p):
    got = spark.createDataFrame([(b, c)], "b bigint, c bigint").select(paired.mcnemar_p(F.col("b"), F.col("c")).alias("p")).first().p
    want = p if p is not None else min(1, 2 * sum(math.exp(math.lgamma(b + c + 1) - math.lgamma(i + 1) - math.lgamma(b + c - i + 1) - (b + c) * math.log(2)) for i in range(c + 1)))
    assert got == pytest.approx(want, rel=3e-3)


def test_censored_quantiles_keep_all_rows(spark):
    rows = spark.createDataFrame([("Fight", 1.0), ("Fight", 3.0), ("Fight", None), ("Fight", None)], "true_label string, time_to_alarm_seconds double")
    got = intervals.alarm_quantiles(rows).first()
    assert (got.clips, got.alarmed, got.q25, got.q50, got.q75) == (4, 2, 1.0, 3.0, None)
    assert intervals.summary(rows, "time_to_alarm_seconds").first().median == 2.0


def test_bootstrap_is_repeatable_and_counts_degenerate(spark):
    rows = spark.createDataFrame(list(zip(TRUTH, SCORES, [0] * 4 + [1] * 4)), "truth int, score double, g int")
    a = intervals.bootstrap(rows, intervals.auc, 60).first()
    assert a == intervals.bootstrap(rows, intervals.auc, 60).first() and a.low <= a.point <= a.high and a.discarded == 0
    assert intervals.bootstrap(rows, intervals.auc, 60, cluster="g").first().discarded > 0
    assert intervals.bootstrap(rows, intervals.auc, 60, exact=True).first().used == 60


def test_permutation_test_of_equal_columns(spark):
    rows = spark.createDataFrame([(float(i), float(i), i % 2) for i in range(20)], "a double, b double, g int")
    got = intervals.permutation_test(rows, lambda x, y: float((x * y).sum()), "a", "b", "g", 200).first()
    assert got.p == pytest.approx(1 / 201)


def test_swap_invariance_counts_pairs(spark):
    rows = spark.createDataFrame([(1, 0.5, True), (1, 0.5004, False), (1, 0.9, True), (0, 0.5, False)], "truth int, score double, fired boolean")
    got = paired.swap_invariance(rows, 0.001).first()
    assert (got.pairs, got.sensitive_pairs) == (1, 1)


def test_ordinal_alignment_pads_the_shorter_side(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "x int"), spark.createDataFrame([(9,), (8,)], "y int")
    got = sorted((r.ordinal, r.a and r.a.x, r.b and r.b.y) for r in paired.by_ordinal(a, b, ["x"], ["y"]).collect())
    assert got == [(0, 1, 8), (1, 2, 9), (2, 3, None)]


def test_aligned_refuses_differing_labels(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, label string"), spark.createDataFrame([(1, "y")], "k int, label string")
    assert paired.aligned(a, a, "k", "label").count() == 1
    with pytest.raises(Exception, match="unmatched"):
        paired.aligned(a, b, "k", "label").collect()
