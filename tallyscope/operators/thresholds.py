"""Threshold search and rule selection."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.operators import metrics
from tallyscope.operators.ordered import running


def grid(start: float, stop: float, step: float) -> list[float]:
    """Thresholds start + i * step, not rounded (K2)."""
    if step <= 0 or not 0 <= start <= stop <= 1:
        raise ValueError("need 0 <= start <= stop <= 1 and a positive step")
    return [start + i * step for i in range(round((stop - start) / step) + 1)]


def sweep(rows: DataFrame, thresholds: list[float], score: str = "score", truth: str = "truth") -> DataFrame:
    """One operating point for each threshold (K1, K2): compared unrounded and inclusively, stored rounded to six places.

    Each row finds the number of thresholds that it reaches, so rows are aggregated once whatever the length of the grid;
    suffix sums over the (small) grid give the counts.
    """
    reached = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(score) >= t))
    tallies = rows.groupBy(reached.alias("reached")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    slots = rows.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)] + [(0, None)], "slot int, t double")
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    sums = slots.join(tallies, F.col("slot") == F.col("reached"), "left").fillna(0, ["p", "n"])
    counts = sums.select("slot", "t", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(every).alias("P"), F.sum("n").over(every).alias("N"))
    points = counts.filter("slot > 0").select(F.round("t", 6).alias("threshold"), "tp", "fp", (F.col("N") - F.col("fp")).alias("tn"), (F.col("P") - F.col("tp")).alias("fn"))
    return metrics.operating(points)


def recommend(points: DataFrame, precision: float = 0.8, fpr: float = 0.2, accuracy: float | None = None) -> DataFrame:
    """The operating point of most recall (then fewest false positives, then F1, then lowest threshold) that meets the
    floors; if none does, that of the largest Youden J (then fewest false positives, then lowest threshold) (K3, H4)."""
    ok = F.coalesce((F.col("precision") >= precision) & (F.col("fpr") <= fpr) & (F.lit(True) if accuracy is None else F.col("accuracy") >= accuracy), F.lit(False))
    row = F.struct(*points.columns)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    fit = F.max_by(row, F.when(ok, F.struct(F.col("recall"), -F.col("fp"), zero(F.col("f1")), -F.col("threshold"))))
    back = F.max_by(row, F.struct(F.col("youden_j"), -F.col("fp"), -F.col("threshold")))
    got = points.agg(fit.alias("fit"), back.alias("back"), F.count_if(ok).alias("eligible"))
    return got.select(F.when(F.col("eligible") > 0, F.col("fit")).otherwise(F.col("back")).alias("r"), "eligible", F.when(F.col("eligible") > 0, "constraints met").otherwise("largest Youden J").alias("basis")).select("r.*", "eligible", "basis")


def family_search(windows: DataFrame, vote: float = 0.16, precision: float = 0.8, fpr: float = 0.2) -> DataFrame:
    """All rules of the three families with their counts and eligibility (K4): k-of-n votes at `vote` for every k up to
    the most windows of a clip, and max and mean at 0.01 .. 0.99.

    Clips are reduced to (votes, max, mean) once; each family is then a sweep over that small table.
    """
    clips = windows.groupBy("clip").agg((F.max("true_label") == "Fight").cast("int").alias("truth"), F.count_if(F.col("score") >= vote).alias("votes"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    hundredths = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: i / F.lit(100.0))
    most = clips.agg(F.max("n").alias("m"))
    params = [
        most.select(F.lit("votes").alias("rule"), F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("m")), lambda k: k.cast("double"))).alias("param")),
        *[most.select(F.lit(name).alias("rule"), F.explode(hundredths).alias("param")) for name in ("max", "mean")],
    ]
    grids = params[0].union(params[1]).union(params[2])
    values = clips.select("clip", "truth", F.explode(F.create_map(F.lit("votes"), F.col("votes").cast("double"), F.lit("max"), F.col("max"), F.lit("mean"), F.col("mean"))).alias("rule", "value"))
    fired = values.join(F.broadcast(grids), "rule").withColumn("fired", F.col("value") >= F.col("param"))
    points = metrics.zeroed(fired.groupBy("rule", "param").agg(*metrics.confusion()))
    return points.withColumn("eligible", (F.col("precision") >= precision) & (F.col("fpr") <= fpr))


#: Fixed order of simplicity.
SIMPLICITY = {"max": 0, "votes": 1, "mean": 2}


def best_rules(points: DataFrame, limit: int = 10) -> DataFrame:
    """Eligible rules by recall, false positives, F1, simplicity and parameter (H1, H2)."""
    simple = F.create_map(*[F.lit(x) for kv in SIMPLICITY.items() for x in kv])
    return points.filter("eligible").withColumn("simplicity", F.element_at(simple, F.col("rule"))).orderBy(F.desc("recall"), "fp", F.desc("f1"), "simplicity", "param").limit(limit)


def calibrate(rows: DataFrame, budget: Column | int, value: str = "value", truth: str = "truth", by: list[str] | None = None) -> DataFrame:
    """The threshold among distinct values whose false positives lie nearest to the budget; ties go to more true positives,
    then to the higher threshold (K6, K7, H3). Null values never fire but count in the totals.

    Running counts over one descending order of the distinct values replace a scan for each candidate.
    """
    by = by or []
    goal = budget if isinstance(budget, Column) else F.lit(budget)
    totals = rows.groupBy(*by).agg(F.count_if(F.col(truth) == 1).alias("all_p"), F.count_if(F.col(truth) == 0).alias("all_n"))
    counts = running(metrics.by_score(rows, value, truth, by), ["s"], {"above_p": "p", "above_n": "n"}, by, descending=True, unique=True)
    counts = counts.withColumns({"tp": F.col("above_p") + F.col("p"), "fp": F.col("above_n") + F.col("n")})
    joined = counts.join(totals, by) if by else counts.crossJoin(totals)  # one row of totals
    pick = F.min_by(F.struct(F.col("s").alias("threshold"), "tp", "fp", (F.col("all_n") - F.col("fp")).alias("tn"), (F.col("all_p") - F.col("tp")).alias("fn")), F.struct(F.abs(F.col("fp") - goal), -F.col("tp"), -F.col("s")))
    return joined.groupBy(*by).agg(pick.alias("r"), F.count(F.lit(1)).alias("candidates")).select(*by, "r.*", "candidates")


def or_gate(rows: DataFrame, budget: int, swept: str, fixed: str, fixed_at: float, truth: str = "truth") -> DataFrame:
    """Calibrate one arm of an OR gate while the other stays at its threshold (K8): rows that the fixed arm fires count at
    every threshold, so only the rest is swept against what remains of the budget."""
    on = F.coalesce(F.col(fixed) >= fixed_at, F.lit(False))
    held = rows.agg(F.count_if(on & (F.col(truth) == 1)).alias("htp"), F.count_if(on & (F.col(truth) == 0)).alias("hfp"))
    rest = calibrate(rows.filter(~on).crossJoin(held), F.lit(budget) - F.col("hfp"), swept, truth, ["htp", "hfp"])  # one row of counts
    return rest.select("threshold", (F.col("tp") + F.col("htp")).alias("tp"), (F.col("fp") + F.col("hfp")).alias("fp"), "tn", "fn", "candidates")


def promotion(results: DataFrame, incumbent: str = "max", margin: int = 5, blocked: dict[str, str] | None = None) -> DataFrame:
    """Candidates at a common budget, ranked by true positives, false positives, complexity and name, and whether each beats the
    incumbent by the margin; none need win (K12, H5). `results` has `name`, `tp`, `fp`, `complexity`. Candidates `blocked` for a reason
    are never promoted; the reason stands beside them, if any are."""
    base = F.max(F.when(F.col("name") == incumbent, F.col("tp"))).over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("tp"), "fp", "complexity", "name"))
    out = results.withColumn("promoted", (F.col("name") != incumbent) & (F.col("tp") >= base + margin)).withColumn("place", rank)
    if not blocked:
        return out
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in blocked.items() for x in kv]), F.col("name"))
    return out.withColumn("blocked", reason).withColumn("promoted", F.col("promoted") & reason.isNull())


def identical_matrices(swept: DataFrame) -> DataFrame:
    """How many thresholds of a sweep share each confusion matrix, for matrices that several give (K7)."""
    return swept.groupBy("tp", "fp", "tn", "fn").agg(F.count(F.lit(1)).alias("thresholds")).filter("thresholds > 1")


def reproduced(now: DataFrame, recorded: dict[str, int]) -> DataFrame:
    """The same row, or an error at run time if counts differ from the recorded ones."""
    checks = [F.assert_true(F.col(k) == v, f"{k} differs from the recorded {v}") for k, v in recorded.items()]
    return now.filter(F.coalesce(*[c.cast("boolean") for c in checks], F.lit(True)))


def delta(points: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Differences of one-row results of the same rule on two splits (K5)."""
    a, b = points.select(*[F.col(c).alias(f"a_{c}") for c in columns]), other.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    return a.crossJoin(b).select(*[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in columns])  # one row each


def half_even(x: float) -> int:
    """Rounding to even, as budgets are (trap: Spark's `round` is half up; use `bround` on columns)."""
    return int(Decimal(x).quantize(Decimal(1), "ROUND_HALF_EVEN"))
