"""Grouped folds, balanced samples and training monitors."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.operators import metrics, thresholds


def assign(sizes: list[tuple[str, int]], folds: int) -> dict[str, int]:
    """Sources by size (largest first, then name), each to the least loaded fold; ties to the lowest."""
    heap = [(0, k) for k in range(folds)]
    out = {}
    for source, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        out[source] = k
        heapq.heappush(heap, (load + n, k))
    return out


def grouped_folds(clips: DataFrame, folds: int, source: str = "source") -> DataFrame:
    """`source`, `clips`, `fold`. The greedy choice is sequential, so it runs in one task, over one narrow row for each source."""
    import pandas as pd

    sizes = clips.groupBy(source).agg(F.count(F.lit(1)).alias("clips"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = assign(list(zip(pdf[source], pdf["clips"], strict=True)), folds)
        return pdf[[source, "clips"]].assign(fold=[got[s] for s in pdf[source]])

    kind = clips.schema[source].dataType.simpleString()
    return sizes.groupBy().applyInPandas(run, f"{source} {kind}, clips bigint, fold int")


def cross_validate(rows: DataFrame, folds: int, fpr: float = 0.2, value: str = "value", truth: str = "truth") -> DataFrame:
    """One row for each fold (K11): the threshold calibrated on the other folds at a budget of `fpr` of their negatives (rounded
    half to even), and the counts and metrics on the fold itself. `rows` has `fold`."""
    spread = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    train = spread.filter("fold <> held")
    budget = train.groupBy("held").agg(F.bround(fpr * F.count_if(F.col(truth) == 0), 0).alias("budget"))
    fitted = thresholds.calibrate(train.join(F.broadcast(budget), "held"), F.col("budget"), value, truth, ["held", "budget"]).select("held", "budget", "threshold")
    tested = rows.join(F.broadcast(fitted), F.col("fold") == F.col("held")).withColumn("fired", F.coalesce(F.col(value) >= F.col("threshold"), F.lit(False)))
    return metrics.nullable(tested.groupBy("fold", "budget", "threshold").agg(*metrics.confusion(truth)))


def grouped_split(sources: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """`source`, `part`: whole sources to `eval` until it holds `target` clips, each class near half, the rest to `train`.

    `sources` has `source`, `fights`, `others`. Sources come in an order shuffled by a digest; the choice is sequential over one
    narrow row for each.
    """
    import pandas as pd

    rows = sources.select("source", "fights", "others", F.xxhash64(F.lit(seed), "source").alias("o"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, parts = [target // 2, target - target // 2], []
        pdf = pdf.sort_values(["o", "source"])
        for a, b in zip(pdf["fights"], pdf["others"], strict=True):
            take = a <= left[0] and b <= left[1]
            if take:
                left = [left[0] - a, left[1] - b]
            parts.append("eval" if take else "train")
        return pdf[["source"]].assign(part=parts)

    return rows.groupBy().applyInPandas(run, f"source {sources.schema['source'].dataType.simpleString()}, part string")


def balanced_sample(rows: DataFrame, count: int, key: str = "clip", label: str = "truth", seed: int = 42) -> DataFrame:
    """`count` rows in an order shuffled by a digest: half of them positives, the rest negatives."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    place = F.row_number().over(Window.partitionBy(label).orderBy(order, key))
    quota = F.when(F.col(label) == 1, count // 2).otherwise(count - count // 2)
    return rows.withColumn("_place", place).filter(F.col("_place") <= quota).drop("_place").orderBy(F.xxhash64(F.lit(seed + 1), F.col(key)))


def balanced_head(rows: DataFrame, limit: int | None, classes: int, key: str = "clip", label: str = "truth") -> DataFrame:
    """The first max(1, limit div classes) rows of each class in key order, sorted, at most `limit`; all rows without one."""
    if limit is None:
        return rows
    place = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return rows.withColumn("_place", place).filter(F.col("_place") <= max(1, limit // classes)).drop("_place").orderBy(key).limit(limit)


def monitor(epochs: DataFrame, value: str, patience: int, by: list[str] | None = None) -> DataFrame:
    """Adds `improved`, `best`, epochs `since` the last improvement and `stop` to an epoch table; null never improves."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = epochs.withColumn("improved", F.coalesce(F.col(value) > F.coalesce(F.max(value).over(before), F.lit(float("-inf"))), F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("best", F.max(value).over(upto)).withColumn("_last", F.last(F.when(F.col("improved"), F.col("epoch")), ignorenulls=True).over(upto))
    rows = rows.withColumn("since", F.col("epoch") - F.coalesce("_last", F.min("epoch").over(upto) - 1)).drop("_last")
    return rows.withColumn("stop", F.col("since") >= patience)
