"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target by water filling: weights share the corpus, no target exceeds a number of epochs of
its source, and what is left is shared again. A source gives its complete epochs first. For the rest, its
documents are sorted by exponential keys (`-ln(u) / quality weight`, u from a digest of the identifier), sizes
are summed along that order, and the documents up to the budget are taken.

Prefix sums are taken over narrow key ranges of each source, then within the one range in which the budget
ends; so no task sorts a whole source, and the choice of a row is a comparison with its source's threshold.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import sized, staged, whole, with_row_id

#: Weights of the sources in order, repeating, and the epochs that none may exceed.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Fixed pattern: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows aimed at in one key range.
RANGE_ROWS = 2000
NO_ID = -9223372036854775808


def words(text: Column) -> Column:
    """Number of words; null texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(quality: Column) -> Column:
    """Sampling weight of a document: 2 if labelled good, 0.5 if labelled bad, 1 if not labelled."""
    return F.when(quality >= 1, 2.0).when(quality == 0, 0.5).otherwise(1.0)


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """Exponential key of a document; u lies strictly between 0 and 1 and is the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def _keyed(docs: DataFrame, labels: DataFrame | None, seed: str) -> DataFrame:
    """`_rid`, `doc_id`, `source`, `_size`, `_key` of the documents, and `_row`, all their columns."""
    rows = with_row_id(docs.select("doc_id", "source", "text", whole(docs)))
    if labels is None:
        quality = F.lit(None).cast("int")
    else:
        by_doc = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_quality"))
        rows = rows.join(sized(by_doc), F.col("doc_id") == F.col("_labelled"), "left")
        quality = F.col("_quality")
    out = rows.withColumn("_size", words(F.col("text"))).withColumn("_key", sampling_key(F.col("doc_id"), quality_weight(quality), seed))
    return out.drop("_labelled", "_quality", "text")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Water filling over one row for each source (`source`, `source_size`, `rows`): adds `target`.

    Sorted by the ratio of cap to weight, a source is capped exactly if its share of what the earlier caps leave
    would exceed its cap. All sums are integers; the one division comes last.
    """
    cycle = F.array(*map(F.lit, weights))
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        sources.withColumn("rank", rank)
        .withColumn("w", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("ratio", F.expr(f"cap * {lcm(*weights)} div w"))
        .withColumn("all", F.sum("source_size").over(every))
    )
    capped = (F.col("w") * (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))) >= F.col("cap") * F.sum("w").over(onward)
    rows = rows.withColumn("capped", capped)
    held = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    free = F.sum(F.when(F.col("capped"), F.lit(0)).otherwise(F.col("w"))).over(every)
    rows = rows.withColumn("held", held).withColumn("free", free)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * (F.col("all") - F.col("held"))).cast("double") / F.col("free").cast("double"))
    return rows.select("source", "source_size", "rows", target.alias("target"))


def _range(ranges: Column) -> Column:
    """The key range of a row: keys are mapped to (0, 1) without changing their order."""
    return F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * ranges).cast("bigint")


def plan(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row for each source: `source`, `source_size`, `target`, `epochs`, `ranges`, `at` (the range in which the
    budget ends) and `last` (the last row taken in that range, null if none). `keyed` is a staged compact table."""
    per_source = keyed.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goal = (
        staged(targets(per_source, weights, epochs), "targets")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("bigint"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS).cast("bigint"))
    )
    goals = sized(goal)
    placed = keyed.join(goals, keyed["source"].eqNullSafe(goals["source"])).select(keyed["*"], "budget", "ranges").withColumn("range", _range(F.col("ranges")))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy("source", "range", "budget").agg(F.sum("_size").alias("s")).withColumn("upto", F.sum("s").over(along))
    ends = staged(sums.filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("s") <= F.col("budget"))).select("source", F.col("range").alias("at"), (F.col("upto") - F.col("s")).alias("before")), "ends")
    few = sized(ends)
    inside = placed.join(few, placed["source"].eqNullSafe(few["source"]) & (placed["range"] == few["at"])).select(placed["*"], "before")
    order = Window.partitionBy("source").orderBy(_place())
    total = F.col("before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = inside.withColumn("ok", total - F.col("_size") / 2 <= F.col("budget")).filter("ok")
    last = staged(taken.groupBy("source").agg(F.max(_place()).alias("last")), "last")
    out = goal.join(ends.drop("before").withColumnRenamed("source", "s1"), goal["source"].eqNullSafe(F.col("s1")), "left").drop("s1")
    return out.join(last.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2", "budget", "rows")


def _place() -> Column:
    """The place of a row in its source's order."""
    return F.struct(F.col("_key").alias("k"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("i"), F.col("_rid").alias("r"))


def _times(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds to keyed rows their source's plan and `_times`, how often the mix takes each."""
    goals = sized(goals.withColumnRenamed("source", "_source"))
    out = rows.join(goals, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_range", _range(F.col("ranges")))
    also = (F.col("_range") < F.col("at")) | ((F.col("_range") == F.col("at")) & (_place() <= F.col("last")))
    return out.withColumn("_times", F.col("epochs") + F.coalesce(also, F.lit(False)).cast("bigint")).drop("_source", "_range")


def mix_report(docs: DataFrame, labels: DataFrame | None = None, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """How much the mix takes of each document: `doc_id`, `size`, `source_size`, `target`, `taken`.

    `docs` is a table scan with `doc_id`, `text` and `source`; `labels` (`doc_id`, `quality`) may be missing, lack
    documents or repeat them (the best quality counts). A null source is a source of its own, last in order. Null
    and empty texts have size 0. The document in which a budget ends is taken if half of it or more fits. Equal
    keys are ordered by `doc_id`, then by row. An empty table gives no rows.
    """
    keyed = staged(_keyed(docs, labels, seed).select("_rid", "doc_id", "source", "_size", "_key"), "keyed")
    return _times(keyed, plan(keyed, weights, epochs)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).alias("taken")
    )


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mixed corpus with the columns of `docs`: whole documents, each as often as the mix takes it."""
    rows = staged(_keyed(docs, labels, seed), "keyed")  # row numbers are only good within this table
    keyed = rows.select("_rid", "doc_id", "source", "_size", "_key")
    times = _times(rows, plan(keyed, weights, epochs)).filter("_times > 0")
    return times.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).select("_row.*")
