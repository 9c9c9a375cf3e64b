"""Running sums by ranges against sums in Python: ties, nulls, groups, more keys than bounds, empty tables."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import metrics, ordered, paired


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_of_many_keys(spark, monkeypatch, descending):
    monkeypatch.setattr(ordered, "LEVELS", 4)  # 15 bounds for 900 keys
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), x, rng.randrange(4)) for x in rng.sample(range(10_000), 900)]
    got = ordered.running(spark.createDataFrame(rows, "g string, x int, c bigint"), ["x"], {"before": "c"}, ["g"], descending).collect()
    assert len(got) == 900
    for r in got:
        earlier = [c for g, x, c in rows if g == r.g and (x > r.x if descending else x < r.x)]
        assert r.before == sum(earlier)


def test_ranges_are_narrow_and_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LEVELS", 5)
    rows = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("x"))
    sizes = ordered.ranged(rows, ["x"]).groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("_range").collect()
    assert len(sizes) == 32 and max(r.n for r in sizes) < 20_000 / 4
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))


def test_ordinals_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LEVELS", 3)
    rows = [(None, 2), (None, 1)] + [(1.5, k) for k in range(300)] + [(float("nan"), 0), (-1.0, 9)]
    got = paired.numbered(spark.createDataFrame(rows, "x double, k int"), ["x", "k"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(304))
    assert [(r.x, r.k) for r in got[:3]] == [(None, 1), (None, 2), (-1.0, 9)]
    assert [r.k for r in got[3:303]] == list(range(300)) and math.isnan(got[303].x)


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "score double, truth int, doc_id bigint")
    assert metrics.roc_auc(rows).first().roc_auc is None
    assert metrics.average_precision(rows).first().average_precision is None
    assert metrics.average_precision_rowwise(rows).first().average_precision is None
    assert [tuple(r) for r in metrics.roc_points(rows).orderBy("point").collect()] == [(0, 0.0, 0.0), (1, 1.0, 1.0)]
    assert paired.tie_clusters(rows, 0.1).collect() == []


def test_tie_clusters_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LEVELS", 3)
    rng = random.Random(2)
    values = sorted({rng.randrange(3000) for _ in range(700)})
    got = paired.tie_clusters(spark.createDataFrame([(v,) for v in values], "score int"), 5).orderBy("value").collect()
    want, cluster = [], 0
    for k, v in enumerate(values):
        cluster += k > 0 and v - values[k - 1] > 5
        want.append((v, cluster))
    assert [tuple(r) for r in got] == want and cluster > 20


@pytest.mark.parametrize("b, c", [(1100, 1150), (5000, 5400), (1001, 1001), (1500, 9000), (40_000, 40_300)])
def test_mcnemar_of_large_counts(spark, b, c):
    n, k, term, total = b + c, min(b, c), 1, 0
    for i in range(k + 1):
        total += term
        term = term * (n - i) // (i + 1)
    want = min(1.0, float(Fraction(2 * total, 2**n)))
    got = spark.createDataFrame([(b, c)], "b bigint, c bigint").select(paired.mcnemar_p(F.col("b"), F.col("c")).alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-9)
