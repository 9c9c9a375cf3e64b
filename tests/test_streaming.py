"""Streams agree with their batch forms."""

import random

from pyspark.sql import functions as F

from tallyscope.operators import tracking, windows
from tallyscope.streaming import clips


def run(spark, df, transform, folder, by="frame", batches=3):
    """Feed a table in several files, in order, and collect what the stream emits."""
    n = df.select(F.max(by)).first()[0] + 1
    for k in range(batches):
        df.filter((F.col(by) * batches / n).cast("int") == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = transform(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    query.awaitTermination()
    return out


def test_tracker_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, f, j, 0, 0.5, float(x := rng.randrange(30)), 0.0, float(x + 10), 10.0) for c in range(3) for f in range(15) for j in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "clip bigint, frame bigint, det_idx bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    got = run(spark, df, clips.track_stream, tmp_path)
    assert sorted(got) == sorted(tracking.track(df).collect())


def test_window_stream(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 2).alias("clip"), F.expr("id div 2").alias("frame"), ((F.col("id") * 37 % 101) / 101).alias("p"))
    got = run(spark, df, lambda s: clips.window_stream(s, 6, 4), tmp_path)
    assert sorted(map(tuple, got)) == sorted(map(tuple, windows.sliding(df, F.max, "p", 6, 4).collect()))


def test_alarm_stream_emits_once(spark, tmp_path):
    df = spark.createDataFrame([(1, i, 8 * i + 15, s) for i, s in enumerate((0.1, 0.9, 0.2, 0.95))], "clip bigint, window_index bigint, last_frame bigint, score double")
    got = run(spark, df, lambda s: clips.alarm_stream(s, 0.8), tmp_path, "window_index", 2)
    assert [(r.clip, r.window_index, r.last_frame) for r in got] == [(1, 1, 23)]
