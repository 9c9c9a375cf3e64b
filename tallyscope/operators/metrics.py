"""Binary classification metrics.

Undefined values follow one of three conventions, each with its own function. Rank metrics need a global order: rows are
first reduced to one for each distinct score, over which `ordered.running` sums by ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.ordered import running

TRUTH, FIRED = "truth", "fired"


def confusion(truth: str = TRUTH, fired: str = FIRED) -> list[Column]:
    """Four counts as aggregates."""
    t, f = F.col(truth) == 1, F.col(fired)
    return [F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(~t & ~f).alias("tn"), F.count_if(t & ~f).alias("fn")]


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def nullable(rows: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from `tp`, `fp`, `tn`, `fn`; undefined is null (M1)."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = rows.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)))


def zeroed(rows: DataFrame) -> DataFrame:
    """The same with undefined as 0 (M2), and the false positive rate."""
    out = nullable(rows).withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("accuracy", "precision", "recall", "f1", "fpr")})


def operating(rows: DataFrame) -> DataFrame:
    """Operating-point metrics: recall, specificity and F1-free rates 0 if undefined, precision and F1 null (M3)."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = nullable(rows).withColumns({"recall": F.coalesce(ratio(tp, tp + fn), F.lit(0.0)), "specificity": F.coalesce(ratio(tn, tn + fp), F.lit(0.0)), "fpr": F.coalesce(ratio(fp, fp + tn), F.lit(0.0))})
    r, s = F.col("recall"), F.col("specificity")
    return out.withColumns({"balanced_accuracy": (r + s) / 2, "youden_j": r + s - 1})


def class_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support with either class as the positive one, from one row of counts (M4)."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    two = rows.select(F.explode(F.array(F.struct(F.lit("NonFight").alias("class"), tn.alias("tp"), fn.alias("fp"), tp.alias("tn"), fp.alias("fn")), F.struct(F.lit("Fight").alias("class"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn")))).alias("c")).select("c.*")
    return nullable(two).select("class", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"), "accuracy")


def by_score(rows: DataFrame, score: str = "score", truth: str = TRUTH, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives for each distinct score; null scores are left out."""
    return rows.filter(F.col(score).isNotNull()).groupBy(*(by or []), F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))


def roc_auc(rows: DataFrame, score: str = "score", truth: str = TRUTH, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """Area under the ROC curve by the rank identity with mid-ranks for ties; null with fewer than `least` of a class."""
    # Totals are read from the last running sums: so all branches of the plan need the same columns and share one exchange.
    sums = running(by_score(rows, score, truth, by), ["s"], {"below_p": "p", "below_n": "n"}, by, unique=True)
    area, p, n = F.col("p") * (2 * F.col("below_n") + F.col("n")), F.col("below_p") + F.col("p"), F.col("below_n") + F.col("n")
    out = sums.groupBy(*(by or [])).agg(F.sum(area).alias("u"), F.max(p).alias("pos"), F.max(n).alias("neg"))
    value = ratio(F.col("u"), 2 * F.col("pos") * F.col("neg"))
    return out.select(*(by or []), "pos", "neg", F.when((F.col("pos") >= least) & (F.col("neg") >= least), value).alias("roc_auc"))


def average_precision(rows: DataFrame, score: str = "score", truth: str = TRUTH, by: list[str] | None = None) -> DataFrame:
    """Average precision over blocks of tied scores; null with a single class (M7, F16)."""
    rows = running(by_score(rows, score, truth, by), ["s"], {"above_p": "p", "above_n": "n"}, by, descending=True, unique=True)
    tp, fp = F.col("above_p") + F.col("p"), F.col("above_n") + F.col("n")
    out = rows.groupBy(*(by or [])).agg(F.sum(F.col("p") * tp / (tp + fp)).alias("a"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return out.select(*(by or []), F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("a") / F.col("pos")).alias("average_precision"))


def _by_row(rows: DataFrame, score: str, truth: str, order: str) -> DataFrame:
    """`t`, and the positives and negatives up to and with each row by descending score, ties in the given order."""
    rows = rows.filter(F.col(score).isNotNull()).select((-F.col(score)).alias("d"), F.col(order).alias("o"), F.col(truth).alias("t"), (1 - F.col(truth)).alias("f"))
    placed = running(rows, ["d", "o"], {"above_p": "t", "above_n": "f"})
    return placed.select("t", (F.col("above_p") + F.col("t")).alias("tp"), (F.col("above_n") + F.col("f")).alias("fp"))


def average_precision_rowwise(rows: DataFrame, score: str = "score", truth: str = TRUTH, order: str = "doc_id") -> DataFrame:
    """Average precision row by row, ties in the given order (M7b); the truth is 0 or 1. Ties are cut into ranges like other rows."""
    placed = _by_row(rows, score, truth, order)
    return placed.agg((F.sum(F.when(F.col("t") == 1, F.col("tp") / (F.col("tp") + F.col("fp")))) / F.nullif(F.count_if(F.col("t") == 1), F.lit(0))).alias("average_precision"))


def roc_points(rows: DataFrame, score: str = "score", truth: str = TRUTH, order: str = "doc_id") -> DataFrame:
    """Points of the ROC curve, one for each row by descending score (ties in the given order), between (0,0) and (1,1) (M8)."""
    scored = rows.filter(F.col(score).isNotNull())
    totals = scored.agg(F.count_if(F.col(truth) == 1).alias("P"), F.count_if(F.col(truth) == 0).alias("N"))
    body = _by_row(rows, score, truth, order).crossJoin(totals)  # one row of totals
    body = body.select((F.col("tp") + F.col("fp")).alias("point"), ratio(F.col("fp"), F.col("N")).alias("fpr"), ratio(F.col("tp"), F.col("P")).alias("tpr"))
    ends = scored.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("point"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")), F.struct((F.col("n") + 1).alias("point"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")))).alias("e"))
    return body.unionByName(ends.select("e.*"))
