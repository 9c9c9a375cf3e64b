"""The registered intervals and tests draw as often as the reference: 10,000 resamples, 20,000 permutations."""

import inspect

import pytest

from tallyscope.operators import intervals
from tallyscope.plans import scores


@pytest.mark.parametrize("query", [scores.bootstrap_ci, scores.bootstrap_clustered])
def test_resamples(spark, small, query):
    row = query(spark, small).first()
    assert row.used + row.discarded == 10000


def test_permutations(spark, small):
    row = scores.permutation_test(spark, small).first()
    assert row.p == pytest.approx((1 + row.at_least) / 20001)


def test_defaults():
    assert inspect.signature(intervals.bootstrap).parameters["resamples"].default == 10000
    assert inspect.signature(intervals.permutation_test).parameters["permutations"].default == 20000
