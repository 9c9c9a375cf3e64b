"""Resampling from draws, coverage joins, user rules and last rows."""

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import paired, resampling, rules
from tallyscope.sources import readers


def test_draws_are_even_and_the_same_again(spark):
    drawn = resampling.draws(spark, 10, 300, 7)
    rows = drawn.groupBy("ordinal").count().collect()
    assert {r.ordinal for r in rows} == set(range(10)) and all(220 < r["count"] < 380 for r in rows)
    assert drawn.exceptAll(resampling.draws(spark, 10, 300, 7)).count() == 0 and drawn.count() == 3000


def test_paired_difference_of_equal_deciders_is_zero(spark):
    units = spark.range(20).select(F.col("id").alias("ordinal"), F.lit(1).alias("n"), (F.col("id") % 2).alias("right_a"), (F.col("id") % 2).alias("right_b"))
    got = resampling.paired_difference(units, resampling.draws(spark, 20, 50)).first()
    assert (got.point, got.low, got.high, got.used, got.discarded) == (0, 0, 0, 50, 0)


def test_censored_median(spark):
    units = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None)], "ordinal bigint, value double")
    drawn = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 2, 2), (1, 0, 2), (1, 1, 2), (1, 2, 0)], "resample int, slot int, ordinal bigint")
    got = resampling.censored_median(units, drawn).first()
    assert (got.point, got.low, got.high, got.used, got.discarded) == (2, 1, 1, 1, 1)
    assert resampling.censored_median(units.limit(0), drawn).first().point is None


def test_covered_refuses_missing_keys(spark):
    rows, other = spark.createDataFrame([(1,), (2,)], "clip int"), spark.createDataFrame([(1, 5)], "clip int, s int")
    assert paired.covered(rows.filter("clip = 1"), other, "clip").first().s == 5
    with pytest.raises(Exception, match="not covered: 2"):
        paired.covered(rows, other, "clip").collect()


def test_last_rows_of_a_file(spark, tmp_path):
    path = tmp_path / "w.csv"
    from tallyscope.sources import schemas

    names = [f.split()[0] for f in schemas.WINDOW_SCORE.split(",")]
    line = lambda **v: ",".join(str(v.get(n, 0)) for n in names)
    path.write_text("\n".join([",".join(names), line(clip="a", window_index=0, true_label="Fight"), line(clip="a", window_index=1, true_label="Fight"), line(clip="a", window_index=0, true_label="NonFight")]) + "\n")
    got = readers.window_scores(spark, str(path))
    assert got.columns == names and got.count() == 2 and {r.true_label for r in got.collect()} == {"NonFight"}


def test_rules_by_a_part_of_their_name_and_descriptions():
    every = [rules.EventRule(rules.CROWDING), rules.EventRule(rules.STATIONARY)]
    assert rules.named(every, "station").name == rules.STATIONARY and rules.named(every, "none") is None
    assert set(rules.DESCRIPTION) == {rules.STATIONARY, rules.RESTRICTED, rules.CROWDING, rules.PROXIMITY}


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", [True, False])
def test_draws_are_never_broadcast(spark, monkeypatch, few):
    """Draws are many times the units; their number has to be known when a join is planned."""
    from tallyscope.plans import basics

    if not few:
        monkeypatch.setattr(resampling, "BROADCAST_BYTES", 0)
    n = 20_000
    units = spark.range(n).select(F.col("id").alias("ordinal"), F.lit(1).alias("n"), (F.col("id") % 2).alias("right_a"), (F.col("id") % 3 % 2).alias("right_b"))
    for drawn in (resampling.draws(spark, n, 100), basics._drawn(units, 100)):
        size = int(str(drawn._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert size >= 8 * 100 * n and drawn.count() == 100 * n
        joined = resampling.drawn_units(units, drawn)
        assert ("BroadcastHashJoin [ordinal" in _plan(joined)) == few and ("SortMergeJoin" in _plan(joined)) != few
        got = resampling.paired_difference(units, drawn).first()
        assert got.used == 100 and got.low < got.point < got.high


def test_no_draws_without_units(spark):
    from tallyscope.plans import basics

    units = spark.createDataFrame([], "ordinal bigint, n int, right_a bigint, right_b bigint, value double")
    drawn = basics._drawn(units)
    assert drawn.count() == 0
    for got in (resampling.paired_difference(units, drawn).first(), resampling.censored_median(units, drawn).first()):
        assert (got.point, got.low, got.high, got.used, got.discarded) == (None, None, None, 0, 0)


def test_order_statistics_count_equal_values_and_hold_no_list(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 101) / 4.0).alias("value"))
    own = {g: sorted(float("inf") if r.value is None else r.value for r in rows.filter(f"g = {g}").collect()) for g in range(3)}
    every = sorted(sum(own.values(), []))
    for q in (0.0, 0.25, 0.5, 0.8, 1.0):
        nth = lambda v: (x := v[max(1, -int(-q * len(v) // 1)) - 1]) < float("inf") and x or None  # noqa: E731, B023
        got = resampling.order_statistics(rows, q, "g")
        assert {r.g: r.value or None for r in got.collect()} == {g: nth(v) for g, v in own.items()}
        one = resampling.order_statistic(rows, q).collect()
        assert len(one) == 1 and (one[0].value or None) == nth(every)
        assert "collect_list(value" not in _plan(got)
