"""Means that don't depend on the order in which partial sums meet."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.sources import fixtures


@pytest.mark.parametrize("parts", [1, 5])
def test_copies_of_a_clip_have_one_spatial_value(spark, tmp_path, parts):
    """Clips with the same events, in any files: the tie at the sixth place is rounded alike, as a sum in time order has it."""
    draw = random.Random(36)  # their mean lies between two values of six places
    cents = [draw.randrange(40_000) for _ in range(16)]
    at = [(clip, k) for clip in range(1, 400) if clip % 11 for k in range(16)]
    rows = [(100 * clip + k, 1000 + k, clip, "purchase", cents[k] / 100) for clip, k in at]
    draw.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id bigint, at int, user_id bigint, event_type string, value double").withColumn("ts", F.timestamp_seconds("at"))
    events.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    total = 0.0
    for c in cents:
        total += c / 100
    got = {r.spatial for r in fixtures.clip_evidence(spark, str(tmp_path)).collect()}
    assert len(got) == 1 and abs(got.pop() - total / 16 / 100) <= 5.1e-7
    sums = fixtures.mean_in_order(events, "user_id", ["ts", "event_id"], "value")
    assert {r.mean for r in sums.collect()} == {total / 16}
    assert events.repartition(7).groupBy("user_id").agg(F.avg("value").alias("m")).select("m").distinct().count() > 1  # what it replaces


def test_mean_in_order_of_odd_values(spark):
    rows = [(1, 1, None), (2, 1, 2.5), (2, 2, None), (3, 1, math.nan), (3, 2, 1.0), (4, 1, math.inf), (4, 2, 1.0), (5, 1, -0.25), (5, 2, 0.75)]
    df = spark.createDataFrame(rows, "k int, at int, value double")
    got = {r.k: r.mean for r in fixtures.mean_in_order(df, "k", ["at"], "value").collect()}
    assert got[1] is None and got[2] == 2.5 and math.isnan(got[3]) and got[4] == math.inf and got[5] == 0.25
    assert fixtures.mean_in_order(df.limit(0), "k", ["at"], "value").count() == 0
