"""Bootstrap intervals from an explicit table of draws.

A draw is a row (`resample`, `slot`, `ordinal`): which unit stands in which slot. Units are numbered rows; all draws are joined to
them and aggregated by resample, so nothing is collected and the same draws give the same interval in any engine. Draws are many
times the units, and never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.operators.ordered import running

#: Bytes that units may have to be broadcast.
BROADCAST_BYTES = 16_000_000


def slots(spark: SparkSession, units: int, resamples: int) -> DataFrame:
    """`resample`, `slot`: as many slots for each resample as there are units. A range, whose size Spark knows before it plans a join."""
    n = max(units, 1)
    return spark.range(resamples * units).selectExpr(f"id div {n}L as resample", f"id % {n}L as slot")


def draws(spark: SparkSession, units: int, resamples: int = 10000, seed: int = 42) -> DataFrame:
    """`resample`, `slot`, `ordinal`: for each resample as many units as there are, drawn by a digest with replacement."""
    rows = slots(spark, max(units, 1), resamples).withColumn("slot", F.col("slot").cast("int"))
    return rows.withColumn("ordinal", F.pmod(F.xxhash64(F.lit(seed), "resample", "slot"), F.lit(max(units, 1))).cast("bigint"))


def drawn_units(units: DataFrame, drawn: DataFrame) -> DataFrame:
    """The unit of each draw. Few units are broadcast, after they have been counted; else both sides are sorted and merged, on disk if need be."""
    few = units.count() * (24 + 8 * len(units.columns)) <= BROADCAST_BYTES
    return drawn.join(F.broadcast(units) if few else units.hint("merge"), "ordinal")


def interval(values: DataFrame, point: DataFrame, confidence: float = 0.95) -> DataFrame:
    """`point`, `low`, `high`, `used`, `discarded` from one `value` for each resample, null ones discarded; both tables are narrow."""
    tail = (1 - confidence) / 2
    spread = values.agg(F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"), F.count("value").alias("used"), F.count_if(F.col("value").isNull()).alias("discarded"))
    return point.crossJoin(spread)  # one row each


def paired_difference(units: DataFrame, drawn: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Interval of the accuracy difference b - a (M14). `units` has `ordinal`, `n`, `right_a`, `right_b`: one row for each clip, or for
    each source with its clips' sums, which are then drawn whole."""
    share = lambda: ((F.sum("right_b") - F.sum("right_a")) / F.sum("n"))
    values = drawn_units(units.select("ordinal", "n", "right_a", "right_b"), drawn).groupBy("resample").agg(share().alias("value"))
    return interval(values, units.agg(share().alias("point")), confidence)


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """How often each `value` occurs, null ones as infinite."""
    return rows.select(*by, F.coalesce("value", F.lit(float("inf"))).alias("value")).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"))


def _reached(upto: str, n: str, q: float) -> Column:
    """Whether the ceil(q n)-th smallest is among the `c` rows that end at place `upto`."""
    place = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col(n)))
    return (F.col(upto) >= place) & (F.col(upto) - F.col("c") < place)


def _finite() -> Column:
    return F.when(F.col("value") < float("inf"), F.col("value"))


def order_statistic(rows: DataFrame, q: float) -> DataFrame:
    """`value` in one row: the ceil(q n)-th smallest of all, where null counts as infinite; null if that is infinite, or without rows."""
    counts = _counted(rows, [])
    placed = running(counts, ["value"], {"before": "c"}, unique=True).withColumn("upto", F.col("before") + F.col("c"))
    return placed.crossJoin(counts.agg(F.sum("c").alias("n"))).filter(_reached("upto", "n", q)).agg(F.max(_finite()).alias("value"))  # one row of totals


def order_statistics(rows: DataFrame, q: float, by: str) -> DataFrame:
    """`by`, `value`: the same within each group. Equal values are combined before the exchange, and a group's rows are passed in order,
    never held together."""
    whole = Window.partitionBy(by)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _counted(rows, [by]).select(by, "value", "c", F.sum("c").over(upto).alias("upto"), F.sum("c").over(whole).alias("n"))
    return placed.filter(_reached("upto", "n", q)).select(by, _finite().alias("value"))


def censored_median(units: DataFrame, drawn: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Interval of the median alarm time over all positives, detected or not (M15). `units` has `ordinal` and `value`, null where no
    alarm came; a resample whose median is not reached is discarded and counted."""
    values = order_statistics(drawn_units(units.select("ordinal", "value"), drawn), 0.5, "resample")
    return interval(values, order_statistic(units, 0.5).withColumnRenamed("value", "point"), confidence)
