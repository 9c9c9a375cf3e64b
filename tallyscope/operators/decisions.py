"""Clip decisions from window scores: rules, scorers and peaks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.operators.windows import prefix

SCORE = "score"


@dataclass(frozen=True)
class Rule:
    """A clip rule: `max`, `mean`, `any` or `k_of_n`, with `threshold` and, for the last, `k`. Thresholds are inclusive."""

    name: str
    params: dict = field(default_factory=dict)

    def decide(self) -> Column:
        """The decision as an aggregate of a clip's windows; no window means no."""
        return F.coalesce(self._over(lambda c: c), F.lit(False))

    def running(self) -> Column:
        """The decision over the windows so far."""
        return F.coalesce(self._over(lambda c: c.over(prefix())), F.lit(False))

    def _over(self, of) -> Column:
        t, s = self.params["threshold"], F.col(SCORE)
        if self.name == "max":
            return of(F.max(s)) >= t
        if self.name == "mean":
            return of(F.avg(s)) >= t
        if self.name == "any":
            return of(F.bool_or(s >= t))
        if self.name == "k_of_n":
            return of(F.count_if(s >= t)) >= self.params["k"]
        raise ValueError(f"unknown rule {self.name}")


def decide(windows: DataFrame, rule: Rule) -> DataFrame:
    """`clip`, `true_label`, `fired`."""
    return windows.groupBy("clip").agg(F.max("true_label").alias("true_label"), rule.decide().alias("fired"))


def top_k_mean(k: int) -> Column:
    """Mean of the k largest scores, or of all if fewer (E6); not monotone in prefixes."""
    best = F.slice(F.sort_array(F.collect_list(SCORE), asc=False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)


def consecutive(windows: DataFrame, n: int) -> DataFrame:
    """`clip`, `value`: the best run of n windows by its weakest score; null stands for minus infinity in shorter clips."""
    order = Window.partitionBy("clip").orderBy("window_index")
    rows = windows.withColumn("_rn", F.row_number().over(order)).withColumn("_low", F.min(SCORE).over(order.rowsBetween(-(n - 1), 0)))
    return rows.groupBy("clip").agg(F.max(F.when(F.col("_rn") >= n, F.col("_low"))).alias("value"))


def scorers(windows: DataFrame) -> DataFrame:
    """`name`, `clip`, `true_label`, `value`: the closed set of six scorers."""
    labels = windows.groupBy("clip").agg(F.max("true_label").alias("true_label"), F.max(SCORE).alias("max"), *[top_k_mean(k).alias(f"top{k}") for k in (2, 3, 5)])
    wide = labels
    for n in (2, 3):
        wide = wide.join(consecutive(windows, n).withColumnRenamed("value", f"cons{n}"), "clip")
    return wide.unpivot(["clip", "true_label"], ["max", "top2", "top3", "top5", "cons2", "cons3"], "name", "value")


def peaks(windows: DataFrame) -> DataFrame:
    """The window of the largest score of each clip; ties go to the lowest index."""
    best = F.max_by(F.struct("window_index", "first_frame", "last_frame", SCORE), F.struct(SCORE, -F.col("window_index")))
    return windows.groupBy("clip").agg(best.alias("b")).select("clip", "b.*")
