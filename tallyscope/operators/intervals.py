"""Interval estimates: closed forms as columns, resampling as distributed tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def z_of(confidence: float) -> float:
    """Two-sided normal quantile (M9)."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    return NormalDist().inv_cdf((1 + confidence) / 2)


def wilson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """(point, low, high) of a proportion; clamped, exact at 0 and 1; null for n = 0."""
    z = z_of(confidence)
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when(n > 0, F.struct(p.alias("point"), low.alias("low"), high.alias("high")))


def confusion_intervals(counts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """`metric`, `k`, `n`, `point`, `low`, `high`, `random_denominator` from one row of counts; precision and negative
    predictive value only where their denominator isn't 0 (M11)."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    rows = [("accuracy", tp + tn, tp + fp + tn + fn, False), ("recall", tp, tp + fn, False), ("specificity", tn, tn + fp, False), ("false_positive_rate", fp, fp + tn, False), ("precision", tp, tp + fp, True), ("negative_predictive_value", tn, tn + fn, True)]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), k.alias("k"), n.alias("n"), F.lit(r).alias("random_denominator")) for m, k, n, r in rows])
    flat = counts.select(F.explode(each).alias("e")).select("e.*").filter("n > 0 or not random_denominator")
    return flat.withColumn("w", wilson(F.col("k"), F.col("n"), confidence)).select("metric", "k", "n", "w.point", "w.low", "w.high", "random_denominator")


def summary(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, sample deviation (0 for one value), quartiles and extremes, to four places; quartiles linear."""
    c = F.col(column)
    spread = F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))
    parts = {"mean": F.avg(c), "median": F.percentile(c, F.lit(0.5)), "stdev": spread, "min": F.min(c), "p25": F.percentile(c, F.lit(0.25)), "p75": F.percentile(c, F.lit(0.75)), "max": F.max(c)}
    return rows.groupBy(*(by or [])).agg(F.count(c).alias("n"), *[F.round(v, 4).alias(k) for k, v in parts.items()])


def describe(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """mean, median, min, max; all null without values."""
    c = F.col(column)
    return rows.groupBy(*(by or [])).agg(F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"))


def fold_summary(rows: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and count over folds where a metric is defined."""
    return rows.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("folds_defined"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Rows by exact value, in numeric order."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def alarm_quantiles(alarms: DataFrame, time: str = "time_to_alarm_seconds", qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per label: clips, alarms, and order-statistic quantiles over all clips, not alarmed ones standing at infinity.

    Times are first counted by distinct value (frames, so few); the quantile is found on the cumulative counts.
    """
    from pyspark.sql import Window

    value = F.coalesce(F.col(time), F.lit(float("inf")))
    counts = alarms.groupBy("true_label", value.alias("t")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("true_label").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("c").over(Window.partitionBy("true_label"))
    rows = counts.withColumns({"upto": upto, "total": total})
    parts = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("t"))).alias(f"q{round(q * 100)}") for q in qs]
    out = rows.groupBy("true_label").agg(F.max("total").alias("clips"), F.sum(F.when(F.col("t") < float("inf"), F.col("c")).otherwise(0)).alias("alarmed"), *parts)
    return out.select("true_label", "clips", "alarmed", *[F.when(F.col(f"q{round(q * 100)}") < float("inf"), F.col(f"q{round(q * 100)}")).alias(f"q{round(q * 100)}") for q in qs])


#: Rows of an evaluation sample that may come to the driver; for larger ones, `resampling` draws and aggregates without collecting.
SAMPLE_ROWS = 1_000_000


def _sample(rows: DataFrame, order: list[str]) -> pd.DataFrame:
    """A sorted evaluation sample of a counted size."""
    if rows.limit(SAMPLE_ROWS + 1).count() > SAMPLE_ROWS:
        raise ValueError(f"an evaluation sample of more than {SAMPLE_ROWS} rows isn't broadcast")
    return rows.orderBy(*order).toPandas()


Statistic = Callable[[np.ndarray, np.ndarray], float | None]


def accuracy_at(threshold: float) -> Statistic:
    return lambda truth, score: float(((score >= threshold) == (truth == 1)).mean()) if len(truth) else None


def auc(truth: np.ndarray, score: np.ndarray) -> float | None:
    """ROC-AUC by mid-ranks; null with one class."""
    pos, neg = np.sort(score[truth == 1]), np.sort(score[truth == 0])
    if not len(pos) or not len(neg):
        return None
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2 * len(pos) * len(neg)))


def bootstrap(rows: DataFrame, statistic: Statistic, resamples: int = 10000, confidence: float = 0.95, seed: int = 42, cluster: str | None = None, stratified: bool = True, truth: str = "truth", score: str = "score", exact: bool = False) -> DataFrame:
    """Percentile interval of a statistic: `point`, `low`, `high`, `used`, `discarded`.

    The evaluation sample (some hundred to some ten thousand clips; not the corpus) is broadcast; resamples are drawn in
    parallel, each from a generator of its own number, so results don't depend on the cluster. With `exact` one task draws
    all from one generator, in order. Clips are drawn within each class, or whole clusters without classes.
    Undefined statistics are discarded and counted.
    """
    columns = [truth, score] + ([cluster] if cluster else [])
    sample = _sample(rows.select(*columns), columns)
    t, s = sample[truth].to_numpy(), sample[score].to_numpy(float)
    groups = [np.flatnonzero(sample[cluster].to_numpy() == g) for g in sorted(sample[cluster].unique())] if cluster else None
    strata = [np.flatnonzero(t == v) for v in sorted(set(t.tolist()))] if stratified and not cluster else [np.arange(len(t))]
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((t, s, groups, strata))

    def draw(rng: np.random.Generator) -> np.ndarray:
        _, _, own, parts = shared.value
        if own is not None:
            return np.concatenate([own[i] for i in rng.integers(0, len(own), len(own))])
        return np.concatenate([p[rng.integers(0, len(p), len(p))] for p in parts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_t, own_s, _, _ = shared.value
        single = np.random.default_rng(seed)
        for batch in batches:
            values = []
            for number in batch["id"]:
                at = draw(single if exact else np.random.default_rng((seed, int(number))))
                values.append(statistic(own_t[at], own_s[at]))
            yield pd.DataFrame({"value": np.array([np.nan if v is None else v for v in values], float)})

    ids = spark.range(0, resamples, 1, 1 if exact else min(resamples, spark.sparkContext.defaultParallelism))
    values = ids.mapInPandas(run, "value double").select(F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    tail = (1 - confidence) / 2
    point = statistic(t, s) if len(t) else None
    return values.agg(
        F.lit(point).cast("double").alias("point"), F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"),
        F.count("value").alias("used"), F.count_if(F.col("value").isNull()).alias("discarded"),
    )


def permutation_test(rows: DataFrame, statistic: Callable[[np.ndarray, np.ndarray], float], a: str, b: str, block: str, permutations: int = 20000, seed: int = 42) -> DataFrame:
    """How often b, shuffled within blocks, agrees with a as well as observed: `observed`, `at_least`, `p` = (1 + hits) / (1 +
    permutations) (M23). The sample is a paired evaluation table and is broadcast; permutations run in parallel."""
    sample = _sample(rows.select(a, b, block), [block, a, b])
    x, y, g = sample[a].to_numpy(float), sample[b].to_numpy(float), sample[block].to_numpy()
    parts = [np.flatnonzero(g == v) for v in sorted(set(g.tolist()))]
    observed = statistic(x, y)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((x, y, parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_x, own_y, own = shared.value
        for batch in batches:
            hits = 0
            for number in batch["id"]:
                rng, z = np.random.default_rng((seed, int(number))), own_y.copy()
                for part in own:
                    z[part] = own_y[rng.permutation(part)]
                hits += statistic(own_x, z) >= observed
            yield pd.DataFrame({"hits": [hits]})

    got = spark.range(0, permutations, 1, spark.sparkContext.defaultParallelism).mapInPandas(run, "hits bigint").agg(F.sum("hits").alias("at_least"))
    return got.select(F.lit(float(observed)).alias("observed"), "at_least", ((F.col("at_least") + 1) / F.lit(permutations + 1.0)).alias("p"))
