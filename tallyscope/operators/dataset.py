"""Dataset hygiene: splits, duplicates across them, reconciliation, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def candidate_groups(files: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Fingerprints seen in more than one split: cheap evidence."""
    return files.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("members"), F.min("split").alias("_a"), F.max("split").alias("_b")).filter("_a < _b").drop("_a", "_b")


def confirmed_groups(files: DataFrame, fingerprint: str = "fingerprint", digest: str = "digest") -> DataFrame:
    """`fingerprint`, `digest`, `members`, `splits` of files that are equal by full digest in several splits.

    Two phases: only files whose cheap fingerprint crosses splits reach the grouping by digest, which is checked anew.
    """
    rows = files.join(candidate_groups(files, fingerprint).select(fingerprint), fingerprint, "left_semi")
    groups = rows.groupBy(fingerprint, digest).agg(F.count(F.lit(1)).alias("members"), F.count_distinct("split").alias("splits"), F.min("clip").alias("first_clip"))
    return groups.filter("members >= 2 and splits >= 2")


def members_of(files: DataFrame, groups: DataFrame, digest: str = "digest") -> DataFrame:
    """The files of confirmed groups, one row each, so that no group is collected."""
    return files.join(groups.select(digest), digest, "left_semi")


def name_collisions(files: DataFrame, name: str = "stem") -> DataFrame:
    """Names in more than one split."""
    return files.groupBy(name).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("split").alias("splits")).filter("splits > 1")


def evaluation_splits(official: DataFrame, recorded_leaks: DataFrame, key: str = "clip") -> dict[str, DataFrame]:
    """`primary`: official without recorded leaks; `excluded`: leaks that are there; `missing`: leaks that aren't."""
    leaks = recorded_leaks.select(key).distinct()
    return {"primary": official.join(leaks, key, "left_anti"), "excluded": official.join(leaks, key, "left_semi"), "missing": leaks.join(official, key, "left_anti")}


def disjointness(sets: DataFrame) -> DataFrame:
    """Clips that each pair of named sets shares (`set_name`, `clip`), pairs without any included."""
    a, b = sets.select(F.col("set_name").alias("a"), "clip").distinct(), sets.select(F.col("set_name").alias("b"), "clip").distinct()
    shared = a.join(b, "clip").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    names = sets.select("set_name").distinct()
    every = names.select(F.col("set_name").alias("a")).join(names.select(F.col("set_name").alias("b")), F.col("a") < F.col("b"))  # a few names
    return every.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def fold_proof(folds: DataFrame) -> DataFrame:
    """Clips of several folds, and sources that folds share: both 0 in a partition."""
    clips = folds.groupBy("clip").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_clips"))
    sources = folds.groupBy("source").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_sources"))
    return clips.crossJoin(sources)  # one row each


def set_algebra(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Difference, intersection and union of two sets of clips."""
    return {"difference": a.subtract(b), "intersection": a.intersect(b), "union": a.unionByName(b).distinct()}


def resolve(recorded: DataFrame, disk: DataFrame) -> DataFrame:
    """Where a recorded clip lies on disk, and how it was found (D12): by its path, else by its safe name, else by its
    re-encoded name; nothing fuzzy. `disk` has `path`, `safe_name`, `reencoded`; of several the first in order counts."""
    paths = disk.select(F.col("path").alias("recorded"), F.col("path").alias("p1"))
    safe = first_of(disk.filter("safe_name is not null"), ["safe_name"], ["path"]).select(F.col("safe_name").alias("recorded"), F.col("path").alias("p2"))
    coded = first_of(disk.filter("reencoded is not null"), ["reencoded"], ["path"]).select(F.col("reencoded").alias("recorded"), F.col("path").alias("p3"))
    rows = recorded.join(paths, "recorded", "left").join(safe, "recorded", "left").join(coded, "recorded", "left")
    method = F.when(F.col("p1").isNotNull(), "exact").when(F.col("p2").isNotNull(), "safe_name").when(F.col("p3").isNotNull(), "encoding")
    return rows.select("recorded", F.coalesce("p1", "p2", "p3").alias("path"), method.alias("method"))


def reconcile(entries: DataFrame, disk: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """State of each path (`path`, `size`): present, truncated, recovered, missing, and of files on disk that no entry names:
    unexpected (D13, D14). `manifest` maps `path` to the name under which it was written."""
    aliases = manifest.select("path", "written") if manifest is not None else entries.select("path", F.lit(None).cast("string").alias("written")).limit(0)
    named = entries.select("path", F.col("size").alias("expected")).join(aliases, "path", "left").withColumn("on_disk", F.coalesce("written", "path"))
    found = disk.select(F.col("path").alias("on_disk"), F.col("size").alias("actual"))
    rows = named.join(found, "on_disk", "full_outer")
    state = (
        F.when(F.col("path").isNull(), "unexpected").when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "truncated")
        .when(F.col("written").isNotNull(), "recovered").otherwise("present")
    )
    return rows.select(F.coalesce("path", "on_disk").alias("path"), "expected", "actual", state.alias("state"))


def verify_parts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """State of archive parts (`name`, `md5`): OK, MD5_MISMATCH, PRESENT (no digest known), MISSING, UNEXPECTED."""
    rows = expected.select("name", F.col("md5").alias("want"), F.lit(1).alias("_e")).join(found.select("name", F.col("md5").alias("got"), F.lit(1).alias("_f")), "name", "full_outer")
    state = F.when(F.col("_f").isNull(), "MISSING").when(F.col("_e").isNull(), "UNEXPECTED").when(F.col("want").isNull() | F.col("got").isNull(), "PRESENT").when(F.lower("want") == F.lower("got"), "OK").otherwise("MD5_MISMATCH")
    return rows.select("name", state.alias("state"))


def verify_leakage(observed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Duplicate groups (`members` sorted array, `digest`) against recorded ones: unrecorded, vanished, digest_changed."""
    rows = observed.select("members", F.col("digest").alias("now")).join(recorded.select("members", F.col("digest").alias("was")), "members", "full_outer")
    state = F.when(F.col("was").isNull(), "unrecorded").when(F.col("now").isNull(), "vanished").when(F.col("now") != F.col("was"), "digest_changed")
    return rows.withColumn("state", state).filter(F.col("state").isNotNull())


def source_pool(clips: DataFrame, used_sources: DataFrame) -> DataFrame:
    """Clips of sources that no other set uses and none of whose names leaves ASCII (D18): whole sources go."""
    odd = clips.filter(F.col("clip").cast("string").rlike(r"[^\x00-\x7F]")).select("source").distinct()
    return clips.join(odd, "source", "left_anti").join(used_sources.select("source").distinct(), "source", "left_anti")


def source_clusters(clips: DataFrame, source: str = "source") -> DataFrame:
    """Clips, clusters, mean and largest size, clusters of one, clips in larger ones."""
    sizes = clips.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("clips"), F.count(F.lit(1)).alias("clusters"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"),
        F.count_if(F.col("n") == 1).alias("singletons"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("clips_in_multi"),
    )


def facets(files: DataFrame, columns: list[str], readable: list[str] | None = None) -> DataFrame:
    """Frequency tables of several columns in one pass: `facet`, `value`, `n` (E13, E14). Facets named in `readable` skip files
    that can't be read. Each row is spread over its facets, then counted with a partial aggregation."""
    known = set(readable or [])
    parts = [F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value"), (F.col("readable") if c in known else F.lit(True)).alias("use")) for c in columns]
    return files.select(F.explode(F.array(*parts)).alias("f")).filter("f.use").groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def durations(files: DataFrame, column: str = "duration_seconds") -> DataFrame:
    """Shortest, longest and mean duration to four places."""
    return files.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 4).alias("mean"))


def label_counts(rows: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """Rows by label, those without any rows included."""
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    return every.join(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").fillna(0, ["n"])


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Tally of a column with percentages."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))


def most_common(rows: DataFrame, column: str, order: str, limit: int | None = None) -> DataFrame:
    """Values by frequency, ties in order of first appearance (H7, H8)."""
    out = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").drop("_first")
    return out.limit(limit) if limit else out


def checks(named: dict[str, DataFrame]) -> DataFrame:
    """`name`, `passed`, `detail` of one-row queries with `passed` and `detail`, in one table."""
    out = None
    for name, df in named.items():
        row = df.select(F.lit(name).alias("name"), F.coalesce("passed", F.lit(False)).alias("passed"), F.col("detail").cast("string").alias("detail"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no checks")
    return out


def readiness(report: DataFrame, tier: str | None = None) -> DataFrame:
    """Whether all checks passed, how many failed, and their names; for each tier if there is such a column."""
    return report.groupBy(*([tier] if tier else [])).agg(F.bool_and("passed").alias("ready"), F.count_if(~F.col("passed")).alias("failed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failures"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    """Check: each key once."""
    return rows.agg((F.count(key) == F.count_distinct(key)).alias("passed"), F.concat(F.count(key), F.lit(" rows")).alias("detail"))


def one_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Check: each key has one value, such as one label for each clip."""
    per = rows.groupBy(key).agg(F.count_distinct(value).alias("n"))
    return per.agg((F.count_if(F.col("n") != 1) == 0).alias("passed"), F.concat(F.count_if(F.col("n") != 1), F.lit(" keys")).alias("detail"))


def weighted_mean(rows: DataFrame, value: str, weight: str):
    """Mean by size, 0 without any."""
    return rows.agg((F.coalesce(F.sum(F.col(value) * F.col(weight)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(weight), F.lit(0)), F.lit(1))).alias("mean"))


def expected_notes(observed: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Expected counts beside observed ones; a difference is noted, never an error."""
    rows = expected.select(key, F.col(value).alias("expected")).join(observed.select(key, F.col(value).alias("observed")), key, "left")
    return rows.withColumn("note", F.when(F.col("observed").isNull(), "absent").when(F.col("observed") != F.col("expected"), "differs").otherwise("as expected"))
