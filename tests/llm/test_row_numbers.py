"""Row numbers hold although two scans of the same files are split differently."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import common, exact_dedup, jaccard, mixing

WORDS = [f"w{k}" for k in range(500)]


@pytest.fixture
def unsteady(spark, tmp_path, monkeypatch):
    """A table of many files, a third of its texts copies; after each staged table scans are split for another number of cores."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(20, 60))) for _ in range(200)]
    rows = [(i, texts[i % 200], "ab"[i % 2]) for i in range(300)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(9).write.parquet(f"{tmp_path}/docs")
    names = {"spark.sql.leafNodeDefaultParallelism": "1", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    cores = [1]
    write = common.staged

    def staged(df, name):
        out = write(df, name)
        cores[0] = cores[0] % 9 + 4
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores[0]))
        return out

    for module in (common, exact_dedup, jaccard, mixing):
        monkeypatch.setattr(module, "staged", staged)
    docs = spark.read.parquet(f"{tmp_path}/docs")
    yield docs, rows
    for k in names:
        spark.conf.unset(k)


def test_the_fixture_changes_the_numbers(unsteady, spark):
    docs, _ = unsteady
    number = lambda: {r.doc_id: r["_rid"] for r in common.with_row_id(docs).collect()}
    before = number()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "5")
    assert before != number()


def test_exact_dedup_holds(unsteady):
    docs, rows = unsteady
    got = [r.text for r in exact_dedup.deduplicate(docs).collect()]
    assert Counter(got) == Counter({t for _, t, _ in rows})


def test_keep_one_holds(unsteady):
    docs, rows = unsteady
    got = [r.text for r in jaccard.keep_one(docs).collect()]
    assert Counter(got) == Counter({t for _, t, _ in rows})


def test_near_groups_hold(unsteady, spark, tmp_path):
    docs, _ = unsteady
    near = docs.withColumn("text", F.when(F.col("doc_id") >= 200, F.concat("text", F.lit(" tail"))).otherwise(F.col("text")))
    near.repartition(9).write.parquet(f"{tmp_path}/near")
    got = jaccard.near_groups(spark.read.parquet(f"{tmp_path}/near"), 3, 4, 5).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 200 for i in range(300)}


def test_mix_of_repeated_rows_holds(unsteady, spark, tmp_path):
    """Rows of one identifier are told apart by their number alone."""
    docs, _ = unsteady
    docs.select(F.lit(1).alias("doc_id"), F.lit("one two three").alias("text"), "source", F.col("doc_id").alias("at")).repartition(9).write.parquet(f"{tmp_path}/same")
    same = spark.read.parquet(f"{tmp_path}/same")
    report = mixing.mix_report(same).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix(same)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    assert mixed.count() * 3 == report
