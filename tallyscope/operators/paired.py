"""Paired comparison of two deciders on the same clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import metrics
from tallyscope.operators.ordered import previous, running


def aligned(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """One-to-one join of two result tables; a key on one side alone or a differing label fails the query."""
    left = a.select(F.col(key), F.struct(*a.columns).alias("a"))
    right = b.select(F.col(key), F.struct(*b.columns).alias("b"))
    rows = left.join(right, key, "full_outer")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col(f"a.{label}").eqNullSafe(F.col(f"b.{label}"))
    return rows.withColumn("a", F.when(ok, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("unmatched or relabelled: "), F.col(key).cast("string")))))


def by_ordinal(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Join two tables by their places in explicit orders (D4): `a` and `b` as structs beside `ordinal`.

    Places are running counts over ranges of the order, so no task holds a whole table and a repeated task gives the same
    places if the order is unique.
    """
    return _numbered(a, order_a, "a").join(_numbered(b, order_b, "b"), "ordinal", "full_outer")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `ordinal`, their place from 0 in an explicit order."""
    return _numbered(rows, order, "_row").select("ordinal", "_row.*")


def covered(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Join on a key; a key that `other` lacks fails the query."""
    found = other.withColumn("_found", F.lit(True))
    out = rows.join(found, key, "left")
    return out.withColumn(key, F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not covered: "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))).drop("_found")


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    keys = [f"_o{k}" for k in range(len(order))]
    placed = rows.select(F.struct(*rows.columns).alias(name), *[F.col(c).alias(k) for k, c in zip(keys, order)], F.lit(1).cast("bigint").alias("_one"))
    return running(placed, keys, {"ordinal": "_one"}).select("ordinal", name)


def _log_share(n: Column, k: Column) -> Column:
    """Logarithm of the probability of k heads in n fair throws, by Stirling's series; for k and n - k above 1000."""
    rest, d = n - k, (n - 2 * k) / n
    series = lambda x: 1 / (12 * x) - 1 / (360 * x * x * x)
    return -(k * F.log1p(-d) + rest * F.log1p(d)) + F.log(n / (2 * F.pi() * k * rest)) / 2 + series(n) - series(k) - series(rest)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p-value, capped at 1; 1 without discordant pairs.

    Up to 1000 of the rarer kind all terms are added from the first one up, by logarithms of the binomial coefficients. Beyond
    that they're added from the last and largest one down, 9 * sqrt(n) of them; each one left out is below e-100 of the largest.
    """
    n, k = b + c, F.least(b, c)
    log2 = 0.6931471805599453
    nd, kd = n.cast("double"), k.cast("double")

    def upward(acc: Column, i: Column) -> Column:
        log = F.when(i == 0, -nd * log2).otherwise(acc["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    def downward(acc: Column, j: Column) -> Column:
        share = acc["share"] * (kd - j + 1) / (nd - kd + j)
        return F.struct(share.alias("share"), (acc["sum"] + share).alias("sum"))

    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    small = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(k, F.lit(1000))), start, upward)["sum"]
    first = F.struct(F.lit(1.0).alias("share"), F.lit(1.0).alias("sum"))
    steps = F.least(k, F.ceil(9 * F.sqrt(nd)))
    large = F.exp(_log_share(nd, kd)) * F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(steps, F.lit(1))), first, downward)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(k <= 1000, small).otherwise(large)))


def tables(rows: DataFrame, truth: str = "truth", a: str = "a", b: str = "b") -> DataFrame:
    """2 x 2 tables of correctness, overall and for each class: `stratum`, `both`, `only_a`, `only_b`, `neither`, `p`."""
    ok_a, ok_b = F.col(a) == (F.col(truth) == 1), F.col(b) == (F.col(truth) == 1)
    counts = [F.count_if(ok_a & ok_b).alias("both"), F.count_if(ok_a & ~ok_b).alias("only_a"), F.count_if(~ok_a & ok_b).alias("only_b"), F.count_if(~ok_a & ~ok_b).alias("neither")]
    label = F.when(F.col(truth) == 1, "Fight").otherwise("NonFight").alias("stratum")
    strata = rows.groupBy(label).agg(*counts)
    every = strata.agg(F.lit("overall").alias("stratum"), *[F.sum(c).alias(c) for c in ("both", "only_a", "only_b", "neither")])
    return every.unionByName(strata).withColumn("p", mcnemar_p(F.col("only_a"), F.col("only_b")))


def agreement(truth: str = "truth", a: str = "a", b: str = "b") -> Column:
    """Which of two deciders is right: both, only one, neither."""
    ok_a, ok_b = F.col(a) == (F.col(truth) == 1), F.col(b) == (F.col(truth) == 1)
    return F.when(ok_a & ok_b, "both_correct").when(ok_a, "only_a_correct").when(ok_b, "only_b_correct").otherwise("both_wrong")


def changes(rows: DataFrame, key: str, truth: str = "truth", a: str = "a", b: str = "b") -> DataFrame:
    """Clips whose decision differs, by kind of change from a to b."""
    fight, now = F.col(truth) == 1, F.col(b)
    kind = F.when(fight & now, "fight_gained").when(fight, "fight_lost").when(now, "false_alarm_added").otherwise("false_alarm_removed")
    return rows.filter(F.col(a) != F.col(b)).select(F.col(key), kind.alias("change"))


def verdict(p: Column, difference: Column, level: float = 0.05) -> Column:
    """A: significantly better, B: significantly worse, C: no significant difference, D: no difference at all."""
    return F.when(difference == 0, "D").when(p >= level, "C").when(difference > 0, "A").otherwise("B")


def tie_report(rows: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Distinct values, values shared by several rows, rows in ties."""
    counts = metrics.by_score(rows, score, truth).withColumn("c", F.col("p") + F.col("n"))
    return counts.agg(F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("c") > 1).alias("tied_values"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("rows_in_ties"))


def largest_ties(rows: DataFrame, score: str = "score", truth: str = "truth", limit: int = 5) -> DataFrame:
    """The largest groups of tied rows with their labels."""
    counts = metrics.by_score(rows, score, truth).withColumn("rows", F.col("p") + F.col("n")).filter("rows > 1")
    return counts.orderBy(F.desc("rows"), F.desc("s")).limit(limit).select(F.col("s").alias("score"), "rows", F.col("p").alias("positives"), F.col("n").alias("negatives"))


def tie_clusters(rows: DataFrame, tolerance: float, score: str = "score") -> DataFrame:
    """`value`, `cluster`: distinct scores chained while neighbours lie within the tolerance."""
    values = previous(rows.select(F.col(score).alias("value")).distinct(), "value")
    gaps = values.withColumn("_gap", F.coalesce(F.col("value") - F.col("previous") > tolerance, F.lit(False)).cast("bigint")).drop("previous")
    return running(gaps, ["value"], {"_gaps": "_gap"}).select("value", (F.col("_gaps") + F.col("_gap")).alias("cluster"))


def swap_invariance(rows: DataFrame, tolerance: float, score: str = "score", truth: str = "truth", fired: str = "fired") -> DataFrame:
    """Pairs of rows of one tie cluster and one label, and those whose decisions differ, counted without spelling them out."""
    clusters = tie_clusters(rows, tolerance, score).withColumnRenamed("value", score)
    counts = rows.join(clusters, score).groupBy("cluster", truth).agg(F.count_if(F.col(fired)).alias("yes"), F.count_if(~F.col(fired)).alias("no"))
    n = F.col("yes") + F.col("no")
    return counts.agg(F.sum((n * (n - 1) / 2).cast("bigint")).alias("pairs"), F.sum(F.col("yes") * F.col("no")).alias("sensitive_pairs"))


def rank_bounds(rows: DataFrame, shift: float = 5e-7, score: str = "score", truth: str = "truth") -> DataFrame:
    """Best and worst ROC-AUC and average precision if rounding moved each score by up to `shift`."""
    out = None
    for name, sign in (("best", 1), ("worst", -1)):
        moved = rows.select(F.col(truth), (F.col(score) + F.when(F.col(truth) == 1, sign * shift).otherwise(-sign * shift)).alias(score))
        one = metrics.roc_auc(moved, score, truth).select(F.lit(name).alias("bound"), "roc_auc").crossJoin(metrics.average_precision(moved, score, truth))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def compared(now: DataFrame, recorded: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Recomputed against recorded values: `now`, `recorded`, `difference`, `ok`; missing on either side isn't ok."""
    rows = now.select(key, F.col(value).alias("now")).join(recorded.select(key, F.col(value).alias("recorded")), key, "full_outer")
    rows = rows.withColumn("difference", F.abs(F.col("now") - F.col("recorded")))
    return rows.withColumn("ok", F.coalesce(F.col("difference") <= tolerance, F.col("now").isNull() & F.col("recorded").isNull()))


def alignment_report(rows: DataFrame, a: str, b: str, label_a: str, label_b: str, tolerance: float = 1e-6) -> DataFrame:
    """Label mismatches, rows beyond the tolerance, largest and mean difference, matches at six places."""
    d = F.abs(F.col(a) - F.col(b))
    return rows.agg(F.count_if(F.col(label_a) != F.col(label_b)).alias("label_mismatches"), F.count_if(d > tolerance).alias("over_tolerance"), F.max(d).alias("max_difference"), F.avg(d).alias("mean_difference"), F.count_if(F.round(a, 6) == F.round(b, 6)).alias("equal_at_six"))


def worst_rows(rows: DataFrame, a: str, b: str, limit: int = 10, order: str | None = None) -> DataFrame:
    """The rows of the largest differences, ties in the given order (H6)."""
    return rows.withColumn("difference", F.abs(F.col(a) - F.col(b))).orderBy(F.desc("difference"), *([order] if order else [])).limit(limit)
