"""Running sums in a global order, without a task that holds all rows.

Rows are dealt into ranges of the order, whose bounds are a sample of distinct keys drawn by digest: the same rows give the
same bounds, also in a repeated task. Sums before a range come from a table with one row for each range and group, sums
within it from a window over that range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the search among bounds; there are one fewer bounds than 2 ** LEVELS, whatever the number of rows.
LEVELS = 8


def ranged(rows: DataFrame, order: list[str], unique: bool = False) -> DataFrame:
    """The rows with `_range`, the number of bounds that their key reaches. Keys compare column by column, nulls first.

    Keys that aren't known to be `unique` are made so first, lest copies of one take the places of other bounds. Unique ones
    are drawn by a digest of all columns: rows and bounds then come from the same exchange, if `rows` ends in one.
    """
    key = F.struct(*order)
    if unique:
        drawn = rows.select(key.alias("k"), F.xxhash64(*rows.columns).alias("h"))
    else:
        drawn = rows.select(key.alias("k")).distinct().withColumn("h", F.xxhash64("k"))
    drawn = drawn.orderBy("h", "k").limit((1 << LEVELS) - 1)
    bounds = drawn.agg(F.array_sort(F.collect_list("k")).alias("_bounds"))

    def search(at: Column, step: Column) -> Column:
        return F.when(F.get("_bounds", at + step - 1) <= key, at + step).otherwise(at)

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(LEVELS))])
    return rows.crossJoin(F.broadcast(bounds)).select(*rows.columns, F.aggregate(steps, F.lit(0), search).alias("_range"))  # one row of bounds


def running(rows: DataFrame, order: list[str], sums: dict[str, str], by: list[str] | None = None, descending: bool = False, unique: bool = False) -> DataFrame:
    """For each name of `sums` the sum of its column over the rows before, in the given order within each group; 0 for the first.

    Rows that come from `ranged` keep their ranges. Of rows with equal keys any may come first.
    """
    by = by or []
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    placed = rows if "_range" in rows.columns else ranged(rows, [*by, *order], unique)
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = totals.select(F.struct(*by, "_range").alias("_key"), *[F.coalesce(F.sum(f"_sum_{name}").over(ahead), F.lit(0)).alias(f"_start_{name}") for name in sums])
    within = Window.partitionBy(*by, "_range").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_in_{name}") for name, c in sums.items()], F.struct(*by, "_range").alias("_key"))
    kept = [c for c in rows.columns if c != "_range"]
    joined = inside.join(starts if by else F.broadcast(starts), "_key")  # without groups at most 2 ** LEVELS rows
    return joined.select(*kept, *[(F.col(f"_start_{name}") + F.col(f"_in_{name}")).alias(name) for name in sums])


def previous(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values with `_range` and `previous`, the next smaller value (null for the smallest)."""
    placed = ranged(rows, [column], unique=True)
    tops = placed.groupBy("_range").agg(F.max(column).alias("_top"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    tops = tops.select("_range", F.max("_top").over(ahead).alias("_last"))
    before = F.lag(column).over(Window.partitionBy("_range").orderBy(column))
    return placed.withColumn("_before", before).join(F.broadcast(tops), "_range").select(*rows.columns, "_range", F.coalesce("_before", "_last").alias("previous"))
