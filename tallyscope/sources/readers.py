"""Sources with explicit schemas and guards (A1-A18, F2's bounds, N4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions import paths as P
from tallyscope.sources import schemas


@dataclass(frozen=True)
class ScoreSource:
    """Where window scores come from (N4): `replay` of recorded ones or `live` ones of a model. A clip that a source doesn't
    hold has no windows; nothing falls back to the other kind."""

    kind: str
    scores: DataFrame

    def __post_init__(self) -> None:
        if self.kind not in ("replay", "live"):
            raise ValueError(f"unknown kind of source {self.kind}")

    def windows(self, clips: DataFrame) -> DataFrame:
        """The scores of some clips, marked with their kind."""
        return self.scores.join(clips.select("clip").distinct(), "clip", "left_semi").withColumn("source_kind", F.lit(self.kind))


def _guarded(rows: DataFrame, ok, message: str) -> DataFrame:
    """The rows, or an error at run time if an aggregate condition over them fails; one row of checks is joined in."""
    check = rows.agg(F.assert_true(F.coalesce(ok, F.lit(False)), message).alias("_ok"))
    return rows.join(F.broadcast(check), F.col("_ok").isNull()).drop("_ok")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; a missing column or a malformed row fails the read."""
    head = spark.read.text(path).limit(1).first()
    columns = [c.strip() for c in head[0].split(",")] if head else []
    missing = [name for name in (field.split()[0] for field in schema.split(",")) if name not in columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def window_scores(spark: SparkSession, path: str) -> DataFrame:
    """Recorded window scores (A8): of repeated rows of a window the last in the file stands, and every row bears its clip's last label."""
    rows = csv(spark, path, schemas.WINDOW_SCORE).select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("_at"))
    return last_rows(rows, "_at")


def last_rows(rows: DataFrame, at: str) -> DataFrame:
    """Of repeated rows of a window the last by `at`; every row bears the label of its clip's last row."""
    columns = [c for c in rows.columns if c not in (at, "true_label")]
    label = rows.groupBy("clip").agg(F.max_by("true_label", at).alias("true_label"))
    kept = rows.groupBy("clip", "window_index").agg(F.max_by(F.struct(*columns), at).alias("w")).select("w.*")
    return kept.join(label, "clip").select(*[c for c in rows.columns if c != at])


def clip_windows(scores: DataFrame, clip: str) -> DataFrame:
    """One clip's windows in order; none if it isn't there."""
    return scores.filter(F.col("clip") == clip).orderBy("window_index")


def true_label(scores: DataFrame) -> DataFrame:
    """`clip`, `true_label`, one for each clip of `window_scores`."""
    return scores.groupBy("clip").agg(F.max_by("true_label", "window_index").alias("true_label"))


def carve(spark: SparkSession, path: str, split: str, clips: int | None = None) -> DataFrame:
    """Window scores of one split alone, one label for each clip, the expected number of clips; else an error (A10)."""
    rows = window_scores(spark, path)
    rows = _guarded(rows, F.count_if(F.col("split") != split) == 0, f"rows of another split than {split}")
    per = rows.groupBy("clip").agg(F.count_distinct("true_label").alias("n"))
    ok = F.count_if(F.col("n") != 1) == 0
    if clips is not None:
        ok = ok & (F.count(F.lit(1)) == clips)
    check = per.agg(F.assert_true(ok, "a clip has several labels, or clips are missing").alias("_ok"))
    return rows.join(F.broadcast(check), F.col("_ok").isNull()).drop("_ok")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with `truth` from the label; the stored decision is ignored; empty or one-class files are errors."""
    rows = csv(spark, path, schemas.PREDICTION).withColumn("truth", (F.col("true_label") == "Fight").cast("int")).drop("predicted_label")
    return _guarded(rows, (F.count_if(F.col("truth") == 1) > 0) & (F.count_if(F.col("truth") == 0) > 0), "predictions need both classes")


def recorded_bounds(scores: DataFrame) -> DataFrame:
    """`clip`, `bounds`: its windows' (first, last) in order."""
    w = F.array_sort(F.collect_list(F.struct("window_index", "first_frame", "last_frame")))
    return scores.groupBy("clip").agg(F.transform(w, lambda x: F.struct(x["first_frame"].alias("first"), x["last_frame"].alias("last"))).alias("bounds"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """`path` relative to the root, `size`, `split`, `class_directory`, `label`, `readable` of files two folders deep.

    Contents aren't read. Files with other suffixes stay, marked as not readable.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    parts = F.split(F.col("path"), "/")
    rows = raw.select(F.array_join(F.slice(parts, -3, 3), "/").alias("path"), F.col("length").alias("size"), F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("class_directory"))
    return rows.withColumn("label", P.normal_label(F.col("class_directory"), F.col("split"))).withColumn("readable", P.is_video(F.col("path")) & (F.col("size") > 0))


def layout(rows: DataFrame) -> DataFrame:
    """Classes of each split (A5)."""
    return rows.groupBy("split").agg(F.sort_array(F.collect_set("class_directory")).alias("classes"))


def split_paths(rows: DataFrame, split: str) -> DataFrame:
    """Sorted paths of one split."""
    return rows.filter(F.col("split") == split).select("path").orderBy("path")


def metadata(rows: DataFrame) -> DataFrame:
    """Duration from decoded header fields; 0 without a frame rate (A2)."""
    return rows.withColumn("duration_seconds", F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0))


def frames(videos: DataFrame) -> DataFrame:
    """`clip`, `frame` from 0, `image` of arrays of frames (A3)."""
    return videos.select("clip", F.posexplode("images").alias("frame", "image"))


def archive_entries(lines: DataFrame) -> DataFrame:
    """Entries of an archive listing of `key = value` lines (`listing`, `line_no`, `line`): blocks start at `Path`, folders are
    left out, a bad size is 0 (A15)."""
    order = Window.partitionBy("listing").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("block", F.sum(F.col("line").startswith("Path = ").cast("int")).over(order)).filter("block > 0")
    cut = F.split("line", " = ", 2)
    pairs = rows.filter(F.contains("line", F.lit(" = "))).select("listing", "block", F.trim(cut[0]).alias("k"), cut[1].alias("v"))
    entries = pairs.groupBy("listing", "block").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(n) for k, n in (("Path", "path"), ("Size", "size"), ("CRC", "crc"), ("Attributes", "attributes"), ("Folder", "folder"))])
    folder = F.coalesce(F.col("folder") == "+", F.lit(False)) | F.coalesce(F.col("attributes").startswith("D"), F.lit(False))
    return entries.filter(~folder).select("listing", "path", F.coalesce(F.expr("try_cast(size as bigint)"), F.lit(0)).alias("size"), "crc")


def archive_parts(found: DataFrame) -> DataFrame:
    """The first file of each part name in the order of search roots, sorted by name (A16). `found` has `root_order`, `path`."""
    named = found.withColumn("name", P.base_name(F.col("path"))).filter(F.col("name").rlike(r"\.\d{3}$"))
    first = F.row_number().over(Window.partitionBy("name").orderBy("root_order", "path"))
    return named.withColumn("_rn", first).filter("_rn = 1").drop("_rn").orderBy("name")


def uploads(spark: SparkSession, landing: str) -> DataFrame:
    """Stream of uploaded files with an allowed suffix."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(landing)
    return rows.filter(P.is_video(F.col("path"))).drop("content")
