"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (its smallest node) for the nodes of undirected `edges` (`a`, `b` bigint).

    Self loops and repeated edges do no harm. Each round is a few combined aggregations, whose result is written
    to the shared folder; the stars at least halve the depth of the trees, so the rounds grow as a logarithm.
    """
    now = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.union(small_low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        got = now.agg(F.count(F.lit(1)), F.sum("v"), F.sum("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
