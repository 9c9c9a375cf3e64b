"""Paths, dataset hygiene, readers and sinks (A, B, C, D9-D18, E13-E15, I, J, K10-K16, O; traps T20, T23)."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import geometry as G
from tallyscope.functions import paths as P
from tallyscope.operators import dataset, folds, fusion, provenance
from tallyscope.sources import readers, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("path, want", [("a/b/clip_x_12.avi", "clip_x"), ("q/clip.avi", "clip"), ("7_3.mp4", "7"), ("a_b", "a_b")])
def test_source_id(spark, path, want):
    assert value(spark, P.source_id(F.lit(path))) == want


@pytest.mark.parametrize("directory, want", [("Train_Fight", "Fight"), ("train_", "train_"), ("Fight", "Fight")])
def test_normal_label(spark, directory, want):
    assert value(spark, P.normal_label(F.lit(directory), F.lit("train"))) == want


def test_labels_from_paths(spark):
    assert value(spark, P.path_label(F.lit("val/val_Fight/a.avi"))) == "Fight" and value(spark, P.label_index(F.lit("val/val_NonFight/a.avi"))) == 0
    with pytest.raises(Exception, match="no label"):
        value(spark, P.label_index(F.lit("a/b")))


def test_safe_names_are_ascii_bounded_and_distinct(spark):
    a, b = (value(spark, P.safe_name(F.lit(x))) for x in ("d/" + "é" * 90 + "x.avi", "d/…….avi"))
    assert a.isascii() and a.endswith(".avi") and b.startswith("clip__") and len(a) < 90 and a != b
    assert value(spark, P.name_too_long(F.lit("d/" + "é" * 128))) and not value(spark, P.name_too_long(F.lit("d/" + "e" * 128)))


def test_small_functions(spark):
    assert value(spark, P.crc32_hex(F.lit(bytearray(b"abc")))) == "352441C2"
    assert value(spark, P.parsed_evidence(F.array(*map(F.lit, ("a=1", "no", "b=x=y", "a=2"))))) == {"a": "2", "b": "x=y"}
    assert value(spark, P.shown(F.lit(None).cast("double"))) == "n/a" and value(spark, P.shown(F.lit(0.5))) == "0.5000"
    assert value(spark, P.class_name({0: "person"}, F.lit(7))) == "7" and value(spark, P.class_name({0: "person"}, F.lit(0))) == "person"
    assert sum(value(spark, P.softmax(F.array(F.lit(1000.0), F.lit(999.0))))) == pytest.approx(1)
    assert [value(spark, P.contained(F.lit(p))) for p in ("a/b", "../a", "/a", "a/../../b", "a/../b")] == [True, False, False, False, True]
    assert value(spark, P.reencoded(F.lit("é"))) == "Ã©"


def test_geometry(spark):
    box = lambda *b: tuple(F.lit(float(x)) for x in b)
    assert value(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7) and value(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert value(spark, G.clamp(F.lit(-3.7), 10)) == 0 and value(spark, G.clamp(F.lit(99.0), 10)) == 9
    assert value(spark, G.inside((F.lit(10.0), F.lit(0.0)), (0, 0, 10, 10))) and not value(spark, G.inside((F.lit(1.0), F.lit(1.0)), None))
    none = tuple(F.lit(None).cast("double") for _ in range(4))
    assert value(spark, G.displacement(none, box(1, 1, 3, 3))) == 0.0
    assert value(spark, G.normalised(F.lit(1.0), F.lit(0.0))) == float("inf")


def test_cross_split_duplicates(spark):
    rows = spark.createDataFrame([("a", "train", "f", "d"), ("b", "val", "f", "d"), ("c", "val", "f", "e"), ("x", "train", "g", "h"), ("y", "train", "g", "h")], "clip string, split string, fingerprint string, digest string")
    got = dataset.confirmed_groups(rows).collect()
    assert [(r.digest, r.members, r.splits) for r in got] == [("d", 2, 2)]
    assert sorted(r.clip for r in dataset.members_of(rows, dataset.confirmed_groups(rows)).collect()) == ["a", "b"]


def test_reconcile_states(spark):
    entries = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "path string, size bigint")
    disk = spark.createDataFrame([("a", 1), ("b", 9), ("w", 4), ("z", 1)], "path string, size bigint")
    manifest = spark.createDataFrame([("d", "w")], "path string, written string")
    assert {r.path: r.state for r in dataset.reconcile(entries, disk, manifest).collect()} == {"a": "present", "b": "truncated", "c": "missing", "d": "recovered", "z": "unexpected"}


def test_resolution_order(spark):
    disk = spark.createDataFrame([("p", "s", None), ("q", "s", "e")], "path string, safe_name string, reencoded string")
    recorded = spark.createDataFrame([("p",), ("s",), ("e",), ("n",)], "recorded string")
    assert {r.recorded: (r.path, r.method) for r in dataset.resolve(recorded, disk).collect()} == {"p": ("p", "exact"), "s": ("p", "safe_name"), "e": ("q", "encoding"), "n": (None, None)}


def test_splits_and_sets(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "clip string")
    parts = {k: sorted(r.clip for r in df.collect()) for k, df in dataset.evaluation_splits(one("a", "b", "c"), one("b", "z")).items()}
    assert parts == {"primary": ["a", "c"], "excluded": ["b"], "missing": ["z"]}
    sets = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b"), ("z", "c")], "set_name string, clip string")
    assert {(r.a, r.b): r.shared for r in dataset.disjointness(sets).collect()} == {("x", "y"): 1, ("x", "z"): 0, ("y", "z"): 0}


def test_most_common_keeps_first_seen_order(spark):
    rows = spark.createDataFrame(list(enumerate("babca")), "i int, x string")
    assert [(r.x, r.n) for r in dataset.most_common(rows, "x", "i").collect()] == [("b", 2), ("a", 2), ("c", 1)]


def test_checks_and_readiness(spark):
    rows = spark.createDataFrame([("a", "F"), ("a", "N")], "clip string, label string")
    report = dataset.checks({"once": dataset.unique(rows, "clip"), "label": dataset.one_value(rows, "clip", "label")})
    got = dataset.readiness(report).first()
    assert not got.ready and got.failed == 2 and got.failures == ["label", "once"]


def test_folds(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, f"s{rng.randrange(9)}", rng.random(), rng.randrange(2)) for i in range(90)], "clip int, source string, value double, truth int")
    got = folds.grouped_folds(rows, 3)
    joined = rows.join(got.select("source", "fold"), "source")
    proof = dataset.fold_proof(joined).first()
    assert (proof.repeated_clips, proof.shared_sources) == (0, 0)
    assert folds.assign([("a", 5), ("b", 5), ("c", 1)], 2) == {"a": 0, "b": 1, "c": 0}
    result = folds.cross_validate(joined, 3).collect()
    assert len(result) == 3 and sum(r.tp + r.fp + r.tn + r.fn for r in result) == 90
    assert folds.balanced_sample(rows, 10, "clip").groupBy("truth").count().collect()[0]["count"] == 5
    assert folds.balanced_head(rows, None, 2).count() == 90 and folds.balanced_head(rows, 4, 2).count() == 4


def test_monitor(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.4), (4, 0.5), (5, 0.6)], "epoch int, value double")
    got = folds.monitor(rows, "value", 2).orderBy("epoch").collect()
    assert [r.improved for r in got] == [False, True, False, False, True] and [r.stop for r in got] == [False, False, False, True, False]


def test_protocol_digest():
    body = {"temporal": 0.5, "spatial": 0.5, "fused": 0.5, "weight": 0.5, "temporal_reference": [0.1], "spatial_reference": []}
    ok = fusion.load_protocol(json.dumps(body | {"sha256": fusion.canonical_digest(body)}))
    assert ok.weight == 0.5
    with pytest.raises(ValueError):
        fusion.load_protocol(json.dumps(body | {"sha256": "0"}))


def test_percentiles_are_strict_and_agree(spark):
    sample = (0.1, 0.2, 0.2, 0.4)
    rows = spark.createDataFrame([(0.2,), (0.05,), (0.9,)], "v double")
    got = {r.v: r.p for r in rows.select("v", fusion.percentile(F.col("v"), sample).alias("p")).collect()}
    assert got == {0.2: 0.25, 0.05: 0.0, 0.9: 1.0}
    joined = fusion.percentile_by_join(rows, "v", spark.createDataFrame([(x,) for x in sample], "s double"), "s")
    assert {r.v: r.percentile for r in joined.collect()} == got


def test_fusion_keeps_null_spatial(spark):
    rows = spark.createDataFrame([(0.9, None), (None, 0.9)], "temporal_max double, spatial double")
    p = fusion.Protocol(0.5, 0.5, 0.4, 0.5, (0.1,), (0.1,))
    a, b = sorted(fusion.evaluate(rows, p).collect(), key=lambda r: r.temporal_max is None)
    assert a.b0 and not a.b1 and a.f1 and a.f2 and a.spatial_pct is None and a.fused_score == 0.5
    assert not b.available and b.b0 is None and b.f2 is None


def test_readers_and_sinks(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("split,clip,window_index,first_frame,last_frame,true_label,fight_probability\nval,a,0,0,15,Fight,0.500000\nval,a,1,8,23,Fight,0.250000\n")
    rows = readers.carve(spark, str(path), "val", 1)
    assert [r.fight_probability for r in readers.clip_windows(rows, "a").collect()] == [0.5, 0.25]
    assert len(readers.recorded_bounds(rows).first().bounds) == 2
    with pytest.raises(Exception):
        readers.carve(spark, str(path), "train").collect()
    sinks.window_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).orderBy("window_index").first().fight_probability == "0.500000"
    bad = tmp_path / "p.csv"
    bad.write_text("index,true_label\n0,Fight\n")
    with pytest.raises(ValueError):
        readers.predictions(spark, str(bad))
    assert "n/a" in sinks.markdown(spark.createDataFrame([(1, None)], "a int, b double"))
    done = spark.createDataFrame([("a", "p1")], "clip string, protocol string")
    assert sinks.resume(spark.createDataFrame([("a",), ("b",)], "clip string"), done, "clip", "p1").first().clip == "b"
    with pytest.raises(Exception):
        sinks.resume(spark.createDataFrame([("a",)], "clip string"), done, "clip", "p2").collect()
    assert sinks.manifest(rows, "clip", {"v": "1"}).first().rows == 2


def test_archive_listing(spark):
    lines = ["Listing", "Path = d", "Attributes = D_", "", "Path = d/a.avi", "Size = 12", "CRC = AB", "", "Path = d/b.avi", "Size = x"]
    rows = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "listing string, line_no int, line string")
    assert sorted((r.path, r.size, r.crc) for r in readers.archive_entries(rows).collect()) == [("d/a.avi", 12, "AB"), ("d/b.avi", 0, None)]


def test_batches_and_pieces(spark):
    entries = spark.createDataFrame([("z", i, n) for i, n in enumerate((4, 4, 9, 1, 2))], "archive string, seq int, size bigint")
    assert [r.batch for r in provenance.batches(entries, 8).orderBy("seq").collect()] == [0, 0, 1, 2, 2]
    parts = spark.createDataFrame([("z", 0, 3, "352441C2"), ("z", 1, 2, "00000000")], "archive string, seq int, size bigint, crc string")
    stream = spark.createDataFrame([("z", bytearray(b"abcde"))], "archive string, content binary")
    got = provenance.pieces(stream, parts).orderBy("seq").collect()
    assert bytes(got[0].content) == b"abc" and got[0].intact and not got[1].intact


def test_verdict_and_closure(spark):
    rows = spark.createDataFrame([(None, 5), ("x", 0)], "sha string, epochs int")
    got = provenance.verdict(rows, {"no digest": F.col("sha").isNull(), "not trained": F.col("epochs") < 1}, {"few": F.col("epochs") < 9}).collect()
    assert [r.rejections for r in got] == [["no digest"], ["not trained"]] and all(r.warnings == ["few"] and not r.accepted for r in got)
    assert provenance.closure({"a": {"b", "c"}, "b": {"c"}}, ["a"]) == ["c", "b", "a"]
