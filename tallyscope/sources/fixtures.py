"""Views over the test tables that give the analytics queries their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.operators import windows
from tallyscope.sources.shipping import ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`clip`, `frame` (from 0), `p`: one score for each event of a user, in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return rows.select(F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).cast("bigint").alias("frame"), (F.col("value") / (F.col("value") + 50)).alias("p"))


def window_scores(spark: SparkSession, sf_dir: str, length: int = 16, stride: int = 8) -> DataFrame:
    """`clip`, `window_index`, `first_frame`, `last_frame`, `score`, `true_label` of count-based sliding windows."""
    rows = windows.sliding(frames_scored(spark, sf_dir), F.max, "p", length, stride)
    label = F.when(F.col("clip") % 2 == 0, "Fight").otherwise("NonFight")
    return rows.withColumn("score", F.round("value", 6)).withColumn("true_label", label).drop("value")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id`, `truth`, `score`: labels against a score with many ties."""
    labels, docs = table(spark, sf_dir, "labels").select("doc_id", "toxic"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select("doc_id", F.col("toxic").alias("truth"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"))


def paired_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with a second score."""
    return predictions(spark, sf_dir).withColumn("score_b", ((F.col("doc_id") * 37) % 1000) / F.lit(1000.0))


def mean_in_order(rows: DataFrame, key: str, order: list[str], c: str) -> DataFrame:
    """`key`, `mean` of a column of doubles, added one by one in a unique order: partial sums, which meet in any order, would give
    equal groups means that differ in their last digits, and these round apart. A group's rows pass through its window, on disk if need be."""
    place = Window.partitionBy(key).orderBy(*order)
    upto = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(key, F.struct(F.row_number().over(place).alias("place"), F.sum(c).over(upto).alias("sum"), F.count(c).over(upto).alias("n")).alias("at"))
    last = sums.groupBy(key).agg(F.max("at").alias("at"))
    return last.select(key, F.when(F.col("at.n") > 0, F.col("at.sum") / F.col("at.n")).alias("mean"))


def rounded(c: Column, places: int) -> Column:
    """Doubles rounded as the SQL does it: scaled, the whole number next to that (halves away from zero), scaled back. Spark's `round` goes
    by the decimal digits that a double is printed with, and so takes some ties the other way."""
    whole = F.round(c * F.lit(10.0**places))
    return F.when(F.abs(whole) < F.lit(float("inf")), whole / F.lit(10.0**places)).otherwise(c)


def clip_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`clip`, `temporal_max`, `spatial` (null for some): two independent kinds of evidence for each clip."""
    temporal = window_scores(spark, sf_dir).groupBy("clip").agg(F.max("score").alias("temporal_max"))
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("clip"), "ts", "event_id", "value")
    bought = mean_in_order(bought, "clip", ["ts", "event_id"], "value").select("clip", rounded(F.col("mean") / 100, 6).alias("s"))
    return temporal.join(bought, "clip", "left").select("clip", "temporal_max", F.when(F.col("clip") % 11 != 0, F.col("s")).alias("spatial"))


def frame_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`clip`, `frame` (from 0), `okey`: every frame of a clip, with tracks or without."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return rows.select(F.col("o_custkey").alias("clip"), (F.row_number().over(order) - 1).cast("bigint").alias("frame"), F.col("o_orderkey").alias("okey"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (clip, frame, track) with its box, class and confidence."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice", "l_shipdate")
    rows = frame_spine(spark, sf_dir).join(items, F.col("okey") == F.col("l_orderkey")).withColumn("track_id", F.col("l_suppkey") % 6)
    first = Window.partitionBy("clip", "frame", "track_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    x1, y1, n = (F.col("l_partkey") % 200).cast("double"), 4 * F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return rows.select(
        "clip", "frame", "track_id",
        F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("class_id"),
        ((100 - F.col("l_suppkey") % 50) / F.lit(100.0)).alias("conf"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 20 + 10 * n).alias("x2"), (y1 + 40 + 10 * n).alias("y2"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks without their identity, numbered within each frame."""
    order = Window.partitionBy("clip", "frame").orderBy("track_id")
    return tracks(spark, sf_dir).withColumn("det_idx", (F.row_number().over(order) - 1).cast("bigint")).drop("track_id")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`clip`, `split`, `content`, `size`, `label` (null where not labelled)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip"), F.col("source").alias("split"), F.col("text").alias("content"), F.col("n_chars").alias("size"))
    return docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("clip"), F.col("toxic").alias("label")), "clip", "left")


#: The same views as SQL.
SQL = {
    "frames_scored": "select user_id as clip, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value / (value + 50) as p from events",
    "window_scores": """select clip, (frame - 15) // 8 as window_index, frame - 15 as first_frame, frame as last_frame, round(m, 6) as score,
      case when clip % 2 = 0 then 'Fight' else 'NonFight' end as true_label
      from (select *, max(p) over (partition by clip order by frame rows between 15 preceding and current row) as m from frames_scored)
      where frame >= 15 and (frame - 15) % 8 = 0""",
    "predictions": "select l.doc_id, toxic as truth, (n_chars % 1000) / 1000.0::double as score from labels l join documents d on d.doc_id = l.doc_id",
    "paired_predictions": "select *, ((doc_id * 37) % 1000) / 1000.0::double as score_b from predictions",
    "clip_evidence": """select t.clip, t.temporal_max, case when t.clip % 11 <> 0 then b.s end as spatial
      from (select clip, max(score) as temporal_max from window_scores group by clip) t
      left join (select user_id as clip, round(avg(value) / 100, 6) as s from events where event_type = 'purchase' group by user_id) b on b.clip = t.clip""",
    "frame_spine": "select o_custkey as clip, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as frame, o_orderkey as okey from orders",
    "tracks": """select clip, frame, track_id, case when l_returnflag = 'R' then 2 else 0 end as class_id, (100 - l_suppkey % 50) / 100.0::double as conf,
      cast(l_partkey % 200 as double) as x1, 4 * l_quantity as y1, cast(l_partkey % 200 as double) + 20 + 10 * l_linenumber as x2, 4 * l_quantity + 40 + 10 * l_linenumber as y2
      from (select *, l_suppkey % 6 as track_id, row_number() over (partition by clip, frame, l_suppkey % 6 order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn
        from frame_spine join lineitem on l_orderkey = okey) where rn = 1""",
    "detections": "select * exclude (track_id), row_number() over (partition by clip, frame order by track_id) - 1 as det_idx from tracks",
    "clips": "select d.doc_id as clip, source as split, text as content, n_chars as size, toxic as label from documents d left join labels l on l.doc_id = d.doc_id",
}
_NEEDS = {
    "window_scores": ["frames_scored"], "paired_predictions": ["predictions"], "clip_evidence": ["frames_scored", "window_scores"],
    "tracks": ["frame_spine"], "detections": ["frame_spine", "tracks"],
}


def sql(views: str, query: str) -> str:
    """A query in front of which the named views and what they need are defined."""
    wanted: list[str] = []
    for name in views.split():
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in wanted) + (", " if query.lstrip().startswith("--cte") else " ") + query.replace("--cte", "")
