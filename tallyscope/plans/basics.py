"""Queries over the smaller operators: columns, joins, guards, summaries, reports and resampling, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyscope.functions import geometry as G
from tallyscope.functions import paths as P
from tallyscope.operators import dataset, fusion, intervals, metrics, paired, provenance, resampling, rules, sampling, thresholds, tracks
from tallyscope.operators import windows as W
from tallyscope.plans.scores import query
from tallyscope.sources import fixtures as X
from tallyscope.sources import readers

R9 = lambda c: F.round(c, 9)


@query("tracks", """select clip, frame, track_id, greatest(0, least(cast(trunc(x1) as int), 149)) as left_edge, greatest(0, least(cast(trunc(y2) as int), 99)) as bottom_edge,
  cast(trunc((x1 + x2) / 2) as int) as trail_x, cast(trunc((y1 + y2) / 2) as int) as trail_y,
  greatest(1, cast(trunc(x2 * least(1.0::double, 160.0::double / x2, 120.0::double / y2)) as int)) as fit_w, greatest(1, cast(trunc(y2 * least(1.0::double, 160.0::double / x2, 120.0::double / y2)) as int)) as fit_h,
  cast(ceil(x2 / 32) * 32 as bigint) as net_w, cast(ceil(y2 / 32) * 32 as bigint) as net_h, round(x2 / (ceil(x2 / 32) * 32), 9) as back_x,
  round(x2 / 171, 9) as scale_x, round_even(round(30 * (x2 / 171), 9), 0) as crop_x1, round_even(round((30 + 112) * (x2 / 171), 9), 0) as crop_x2 from tracks""")
def box_columns(spark, sf_dir):
    rows, b = X.tracks(spark, sf_dir), G.box()
    tx, ty = G.trail_point(b)
    fw, fh = G.fitted_size(b[2], b[3], 160, 120)
    nw, nh, bx, _ = G.network_size(b[2], b[3])
    crop = G.crop_in_source(b[2], b[3])
    return rows.select(
        "clip", "frame", "track_id", G.clamp(b[0], 150).alias("left_edge"), G.clamp(b[3], 100).alias("bottom_edge"), tx.alias("trail_x"), ty.alias("trail_y"),
        fw.alias("fit_w"), fh.alias("fit_h"), nw.cast("bigint").alias("net_w"), nh.cast("bigint").alias("net_h"), R9(bx).alias("back_x"),
        R9(crop["scale_x"]).alias("scale_x"), crop["x1"].alias("crop_x1"), crop["x2"].alias("crop_x2"),
    )


_PATHS = """paths as (select doc_id, coalesce(source, 'none') as split, 'data/' || coalesce(source, 'none') || '/' || (case when doc_id % 3 = 0 then upper(coalesce(source, 'none')) || '_Fight' else 'train_NonFight' end)
  || '/v' || (doc_id % 9) || (case doc_id % 4 when 0 then '_x_' || doc_id || '.AVI' when 1 then '_' || doc_id || '.mp4' when 2 then ' é' || doc_id || '.txt' else repeat('é', 130) || '.mov' end) as path, coalesce(text, '') as text, n_chars from documents)"""


def _paths(spark, sf_dir):
    docs, s = X.table(spark, sf_dir, "documents"), F.coalesce("source", F.lit("none"))
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("_x_"), "doc_id", F.lit(".AVI"))).when(k == 1, F.concat(F.lit("_"), "doc_id", F.lit(".mp4"))).when(k == 2, F.concat(F.lit(" é"), "doc_id", F.lit(".txt"))).otherwise(F.concat(F.repeat(F.lit("é"), 130), F.lit(".mov")))
    folder = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper(s), F.lit("_Fight"))).otherwise("train_NonFight")
    return docs.select("doc_id", s.alias("split"), F.concat(F.lit("data/"), s, F.lit("/"), folder, F.lit("/v"), F.col("doc_id") % 9, name).alias("path"), F.coalesce("text", F.lit("")).alias("text"), "n_chars")


@query("clips", f"""--cte {_PATHS}, p as (select *, split_part(path, '/', -1) as base, split_part(path, '/', -2) as dir from paths), s as (select *, regexp_replace(base, '\\.[^.]*$', '') as stem from p)
  select doc_id, lower(regexp_extract(base, '\\.([^.]+)$', 1)) in ('avi', 'm4v', 'mkv', 'mov', 'mp4', 'mpeg', 'mpg') as is_video, regexp_extract(dir, '^[^_]*_(.*)$', 1) as label,
    case when regexp_extract(dir, '^[^_]*_(.*)$', 1) = 'Fight' then 1 else 0 end as label_index,
    case when lower(dir) like lower(split) || '@_%' escape '@' and length(dir) > length(split) + 1 then dir[length(split) + 2 :] else dir end as normal_label,
    case when regexp_full_match(stem, '.+_[0-9]+') then regexp_extract(stem, '^(.+)_([0-9]+)$', 1) else stem end as source_id,
    (case when regexp_replace(stem, '[^A-Za-z0-9_-]', '', 'g') = '' then 'clip' else regexp_replace(stem, '[^A-Za-z0-9_-]', '', 'g')[: 60] end) || '__' || sha1(path)[: 12] || regexp_extract(base, '(\\.[^.]*)$', 1) as safe,
    strlen(base) > 255 as too_long, true as contained, n_chars || ':' || md5(text[: 100]) as fingerprint from s""")
def path_columns(spark, sf_dir):
    rows, p = _paths(spark, sf_dir), F.col("path")
    return rows.select(
        "doc_id", P.is_video(p).alias("is_video"), P.path_label(p).alias("label"), P.label_index(p).alias("label_index"), P.normal_label(F.element_at(F.split(p, "/"), -2), F.col("split")).alias("normal_label"),
        P.source_id(p).alias("source_id"), P.safe_name(p).alias("safe"), P.name_too_long(p).alias("too_long"), P.contained(p).alias("contained"), P.fingerprint(F.col("n_chars"), F.col("text"), 100).alias("fingerprint"),
    )


@query("paired_predictions", """select doc_id, case doc_id % 3 when 0 then 'person' when 1 then 'car' else cast(doc_id % 5 as varchar) end as class_name, cast(doc_id as varchar) as first_value, 'y=z' as second_value, 2 as items,
  case when doc_id % 7 = 0 then 'n/a' else printf('%.3f', score) end as shown, round(exp(score) / (exp(score) + exp(score_b) + 1), 9) as share, score_b as checked from paired_predictions""")
def text_columns(spark, sf_dir):
    """Class names, parsed evidence, shown numbers, class shares, guarded values."""
    rows = X.paired_predictions(spark, sf_dir)
    class_id = F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 + 100).otherwise(F.col("doc_id") % 5)
    rows = rows.withColumn("e", P.parsed_evidence(F.array(F.lit("a=first"), F.lit("nothing"), F.lit("b=y=z"), F.concat(F.lit("a="), F.col("doc_id")))))
    return rows.select(
        "doc_id", P.class_name({100: "person", 101: "car"}, class_id).alias("class_name"), F.col("e")["a"].alias("first_value"), F.col("e")["b"].alias("second_value"), F.size("e").alias("items"),
        P.shown(F.when(F.col("doc_id") % 7 != 0, F.col("score")), 3).alias("shown"), R9(P.softmax(F.array("score", "score_b", F.lit(0.0)))[0]).alias("share"), P.checked(F.col("score_b"), F.col("score_b").between(0, 1), "out of range").alias("checked"),
    )


@query("tracks", "select clip, frame, track_id, conf from tracks where conf >= 0.7 and track_id in (1, 2, 5)")
def filtered_tracks(spark, sf_dir):
    return tracks.confident(X.tracks(spark, sf_dir), 0.7).filter(F.col("track_id").isin(1, 2, 5)).select("clip", "frame", "track_id", "conf")


@query("paired_predictions", "select doc_id, score, score_b from paired_predictions where true")
def aligned_results(spark, sf_dir):
    rows = X.paired_predictions(spark, sf_dir)
    return paired.aligned(rows.select("doc_id", "truth", "score"), rows.select("doc_id", "truth", "score_b"), "doc_id", "truth").select("doc_id", "a.score", "b.score_b")


@query("clip_evidence", """select clip, temporal_max, s as spatial_score, sp as spatial_all from (select clip, temporal_max, spatial as sp, coalesce(spatial, -1.0) as s from clip_evidence)""")
def covered_evidence(spark, sf_dir):
    """Window scores joined to features that have to cover every clip, and to those that needn't."""
    rows = X.clip_evidence(spark, sf_dir)
    full = rows.select("clip", F.coalesce("spatial", F.lit(-1.0)).alias("spatial_score"))
    return paired.covered(rows.select("clip", "temporal_max"), full, "clip").join(rows.filter("spatial is not null").select("clip", F.col("spatial").alias("spatial_all")), "clip", "left")


@query("clips", """--cte disk as (select 'd/' || clip as path, 's' || (clip % 50) as safe, case when clip % 2 = 0 then 'e' || (clip % 80) end as enc from clips), recorded as (select case clip % 4 when 0 then 'd/' || clip when 1 then 's' || clip when 2 then 'e' || clip else 'none' || clip end as r from clips)
  select r as recorded, coalesce(d.path, s.path, e.path) as path, case when d.path is not null then 'exact' when s.path is not null then 'safe_name' when e.path is not null then 'encoding' end as method
  from recorded left join disk d on d.path = r left join (select safe, min(path) as path from disk group by safe) s on s.safe = r left join (select enc, min(path) as path from disk where enc is not null group by enc) e on e.enc = r""")
def resolved_paths(spark, sf_dir):
    clips, c = X.clips(spark, sf_dir).select("clip"), F.col("clip")
    disk = clips.select(F.concat(F.lit("d/"), c).alias("path"), F.concat(F.lit("s"), c % 50).alias("safe_name"), F.when(c % 2 == 0, F.concat(F.lit("e"), c % 80)).alias("reencoded"))
    lead = F.when(c % 4 == 0, "d/").when(c % 4 == 1, "s").when(c % 4 == 2, "e").otherwise("none")
    return dataset.resolve(clips.select(F.concat(lead, c).alias("recorded")), disk)


@query("clips", """--cte g as (select md5(content) as digest, list(clip order by clip) as members from clips where content is not null group by 1 having count(*) > 1), o as (select members, digest from g where len(members) % 2 = 0 or members[1] % 2 = 0), w as (select members, case when members[1] % 3 = 0 then 'other' else digest end as digest from g where members[1] % 5 <> 0)
  select list_aggregate(coalesce(o.members, w.members), 'string_agg', ',') as members, o.digest as now, w.digest as was, case when w.digest is null then 'unrecorded' when o.digest is null then 'vanished' else 'digest_changed' end as state
  from o full join w on o.members = w.members where w.digest is null or o.digest is null or o.digest <> w.digest""")
def leakage_changes(spark, sf_dir):
    rows = X.clips(spark, sf_dir).filter("content is not null")
    groups = rows.groupBy(F.md5("content").alias("digest")).agg(F.array_sort(F.collect_list("clip")).alias("members")).filter(F.size("members") > 1)
    head = F.col("members")[0]
    observed = groups.filter((F.size("members") % 2 == 0) | (head % 2 == 0))
    recorded = groups.filter(head % 5 != 0).withColumn("digest", F.when(head % 3 == 0, "other").otherwise(F.col("digest")))
    return dataset.verify_leakage(observed, recorded).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "now", "was", "state")


@query("clips", """--cte n as (select case when clip % 97 = 0 then 'é' else 'c' end || clip as name, clip % 40 as source from clips) select name as clip, source from n
  where source not in (select source from n where name like 'é%') and source not in (3, 7)""")
def pool_of_sources(spark, sf_dir):
    rows = X.clips(spark, sf_dir).select(F.concat(F.when(F.col("clip") % 97 == 0, "é").otherwise("c"), F.col("clip")).alias("clip"), (F.col("clip") % 40).alias("source"))
    return dataset.source_pool(rows, rows.filter("source in (3, 7)").select("source"))


@query("clips", """select l.label, count(c.clip) as n from (values ('0'), ('1'), ('2')) l(label) left join (select clip, cast(label as varchar) as label from clips) c on c.label = l.label group by l.label""")
def counts_by_label(spark, sf_dir):
    return dataset.label_counts(X.clips(spark, sf_dir).withColumn("label", F.col("label").cast("string")), ["0", "1", "2"])


@query("predictions", """select truth, round(avg(score), 9) as mean, round(quantile_cont(score, 0.5), 9) as median, min(score) as min, max(score) as max from predictions group by truth
  union all select 7, null, null, null, null""")
def described_scores(spark, sf_dir):
    rows = X.predictions(spark, sf_dir)
    each = intervals.describe(rows, "score", ["truth"])
    none = intervals.describe(rows.filter("false"), "score").select(F.lit(7).alias("truth"), "*")
    return each.unionByName(none).withColumns({"mean": R9(F.col("mean")), "median": R9(F.col("median"))})


@query("predictions", """select round(avg(a), 9) as mean, round(stddev_pop(a), 9) as std, count(a) as folds_defined from (select case when doc_id % 9 <> 4 then avg(score) end as a from predictions group by doc_id % 9)""")
def folds_summary(spark, sf_dir):
    rows = X.predictions(spark, sf_dir).groupBy((F.col("doc_id") % 9).alias("fold")).agg(F.avg("score").alias("a")).select(F.when(F.col("fold") != 4, F.col("a")).alias("a"))
    return intervals.fold_summary(rows, "a").select(R9(F.col("mean")).alias("mean"), R9(F.col("std")).alias("std"), "folds_defined")


@query("predictions", "select round(sum(score * (doc_id % 5)) / greatest(sum(doc_id % 5), 1), 9) as mean from predictions")
def weighted_score(spark, sf_dir):
    return dataset.weighted_mean(X.predictions(spark, sf_dir).withColumn("w", F.col("doc_id") % 5), "score", "w").select(R9(F.col("mean")).alias("mean"))


@query("frames_scored", """--cte t as (select clip, count(*) as t from frames_scored group by clip), g as (select clip, t, s, s * t // 16 as a, greatest((s + 1) * t // 16, s * t // 16 + 1) as b from t, (select unnest(range(16)) as s)),
  f as (select clip, least(a + (b - a) // 2, t - 1) as frame from g) select clip, 16 - count(distinct frame) as frames_repeated, 'uniform, 16 segments, ' || (16 - count(distinct frame)) || ' frames repeated' as description from f group by clip""")
def sampling_described(spark, sf_dir):
    clips = X.frames_scored(spark, sf_dir).groupBy("clip").agg(F.count(F.lit(1)).alias("frames"))
    return sampling.described(sampling.sample(clips, 16), "uniform", 16)


@query("window_scores frames_scored", """--cte r as (select * from window_scores where not (clip % 7 = 0 and window_index = 1)), g as (select clip, list(first_frame order by window_index) as first, list(last_frame order by window_index) as last from r group by clip),
  e as (select clip, list_transform(range(0, case when count(*) >= 16 then (count(*) - 16) // 8 + 1 else 0 end), lambda k: k * 8) as first from frames_scored group by clip)
  select e.clip, len(e.first) as expected, coalesce(len(g.first), 0) as recorded from e left join g on g.clip = e.clip where len(e.first) <> coalesce(len(g.first), 0) or (len(e.first) > 0 and e.first <> g.first)""")
def geometry_checked(spark, sf_dir):
    recorded = X.window_scores(spark, sf_dir).filter("not (clip % 7 = 0 and window_index = 1)")
    frames = X.frames_scored(spark, sf_dir).groupBy("clip").agg(F.count(F.lit(1)).alias("frames"))
    got = W.geometry_mismatches(recorded, frames, 16, 8, None)
    return got.select("clip", F.size("expected").cast("bigint").alias("expected"), F.when(F.col("recorded").isNull(), 0).otherwise(F.size("recorded")).cast("bigint").alias("recorded"))


@query("clips", "select clip, k, size from (select clip, clip % 30 as k, size, row_number() over (partition by clip % 30 order by size desc, clip) as rn from clips) where rn = 1")
def first_rows(spark, sf_dir):
    rows = X.clips(spark, sf_dir).select("clip", (F.col("clip") % 30).alias("k"), "size", (-F.col("size")).alias("down"))
    return dataset.first_of(rows, ["k"], ["down", "clip"]).select("clip", "k", "size")


@query("paired_predictions", "select doc_id, round(abs(score - score_b), 9) as difference from paired_predictions order by abs(score - score_b) desc, doc_id limit 10")
def largest_differences(spark, sf_dir):
    return paired.worst_rows(X.paired_predictions(spark, sf_dir), "score", "score_b", 10, "doc_id").select("doc_id", R9(F.col("difference")).alias("difference"))


@query("clips", "select k, n from (select size % 50 as k, count(*) as n, min(clip) as f from clips group by 1) order by n desc, f limit 5")
def commonest_sizes(spark, sf_dir):
    return dataset.most_common(X.clips(spark, sf_dir).withColumn("k", F.col("size") % 50), "k", "clip", 5)


@query("detections", "select clip, frame, det_idx, conf from (select *, row_number() over (partition by clip, frame order by conf desc, det_idx) as rn from detections where class_id = 0) where rn = 1")
def best_detections(spark, sf_dir):
    rows = X.detections(spark, sf_dir)
    with_class = rows.filter("class_id = 0").select("clip", "frame").distinct()
    return tracks.top_detection(rows.join(with_class, ["clip", "frame"], "left_semi"), 0).select("clip", "frame", "det_idx", "conf")


@query("detections", """select clip, frame, det_idx from (select clip, frame, det_idx, row_number() over (partition by clip, frame order by ((x1 + x2) / 2 - 100) * ((x1 + x2) / 2 - 100) + ((y1 + y2) / 2 - frame) * ((y1 + y2) / 2 - frame), det_idx) as rn from detections) where rn = 1""")
def nearest_detections(spark, sf_dir):
    rows = X.detections(spark, sf_dir)
    targets = rows.select("clip", "frame").distinct().withColumns({"x": F.lit(100.0), "y": F.col("frame").cast("double")})
    return tracks.nearest(rows, targets)


@query("clips", """--cte a as (select distinct clip from clips where clip % 2 = 0), b as (select distinct clip from clips where clip % 3 = 0)
  select 'difference' as kind, count(*) as n, sum(clip) as total from (select clip from a except select clip from b) union all select 'intersection', count(*), sum(clip) from (select clip from a intersect select clip from b) union all select 'union', count(*), sum(clip) from (select clip from a union select clip from b)""")
def clip_sets(spark, sf_dir):
    rows = X.clips(spark, sf_dir).select("clip")
    sets = dataset.set_algebra(rows.filter("clip % 2 = 0"), rows.filter("clip % 3 = 0"))
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("clip").alias("total")).select(F.lit(k).alias("kind"), "n", "total") for k, df in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("clips", """--cte f as (select clip, clip % 20 as source, case when clip % 41 = 0 then 9 else clip % 20 % 5 end as fold from clips union all select clip, clip % 20, 8 from clips where clip % 60 = 1)
  select (select count(*) from (select clip from f group by clip having count(*) > 1)) as repeated_clips, (select count(*) from (select source from f group by source having count(distinct fold) > 1)) as shared_sources""")
def fold_partition(spark, sf_dir):
    rows, c = X.clips(spark, sf_dir).select("clip"), F.col("clip")
    folds = rows.select("clip", (c % 20).alias("source"), F.when(c % 41 == 0, 9).otherwise(c % 20 % 5).alias("fold"))
    return dataset.fold_proof(folds.unionByName(rows.filter(c % 60 == 1).select("clip", (c % 20).alias("source"), F.lit(8).alias("fold"))))


@query("clips", """--cte o as (select cast(split as varchar) as split, count(*) as n from clips group by 1), e as (select split, case when n % 2 = 0 then n else n + 1 end as n from o union all select 'nowhere', 5)
  select e.split, e.n as expected, o.n as observed, case when o.n is null then 'absent' when o.n <> e.n then 'differs' else 'as expected' end as note from e left join o on o.split = e.split""")
def noted_counts(spark, sf_dir):
    observed = X.clips(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    expected = observed.select("split", (F.col("n") + F.col("n") % 2).alias("n")).unionByName(spark.createDataFrame([("nowhere", 5)], "split string, n bigint"))
    return dataset.expected_notes(observed, expected, "split", "n")


@query("predictions", """select count(*) filter (score >= 0.5 and truth = 1 and doc_id % 2 = 1) - count(*) filter (score >= 0.5 and truth = 1 and doc_id % 2 = 0) as tp,
  count(*) filter (score >= 0.5 and truth = 0 and doc_id % 2 = 1) - count(*) filter (score >= 0.5 and truth = 0 and doc_id % 2 = 0) as fp from predictions""")
def frozen_rule_delta(spark, sf_dir):
    rows = X.predictions(spark, sf_dir).withColumn("fired", F.col("score") >= 0.5)
    one, two = (rows.filter(F.col("doc_id") % 2 == k).agg(*metrics.confusion()) for k in (0, 1))
    return thresholds.delta(one, two, ["tp", "fp"])


@query("predictions", "select count(*) filter (score >= 0.5 and truth = 1) as tp, count(*) filter (score >= 0.5 and truth = 0) as fp from predictions")
def reproduced_counts(spark, sf_dir):
    """The recorded counts, which a second computation has to reproduce."""
    counts = X.predictions(spark, sf_dir).withColumn("fired", F.col("score") >= 0.5).agg(*metrics.confusion()).select("tp", "fp")
    return thresholds.reproduced(counts, counts.first().asDict())


@query("predictions", """--cte s as (select truth, score + (case when truth = 1 then 1 else -1 end) * k * 0.0005::double as score, k from predictions, (values (1), (-1)) v(k)),
  r as (select k, truth, (rank() over (partition by k order by score) + (count(*) over (partition by k, score) - 1) / 2.0::double) as mid, score from s),
  p as (select k, score, sum(truth) over w as tp, count(*) over w as seen, truth from s window w as (partition by k order by score desc range unbounded preceding))
  select case a.k when 1 then 'best' else 'worst' end as bound, round(a.auc, 9) as roc_auc, round(b.ap, 9) as average_precision
  from (select k, (sum(case when truth = 1 then mid end) - count(*) filter (truth = 1) * (count(*) filter (truth = 1) + 1) / 2.0::double) / (count(*) filter (truth = 1) * count(*) filter (truth = 0)) as auc from r group by k) a
  join (select k, sum(truth * tp / seen::double) / sum(truth) as ap from p group by k) b on b.k = a.k""")
def metric_bounds(spark, sf_dir):
    got = paired.rank_bounds(X.predictions(spark, sf_dir), 0.0005)
    return got.select("bound", R9(F.col("roc_auc")).alias("roc_auc"), R9(F.col("average_precision")).alias("average_precision"))


@query("predictions", """select doc_id % 60 as g, case when count(*) filter (truth = 1) >= 5 and count(*) filter (truth = 0) >= 5 then 1 else 0 end as defined, count(*) filter (truth = 1) as pos from predictions group by 1""")
def auc_where_defined(spark, sf_dir):
    rows = X.predictions(spark, sf_dir).withColumn("g", F.col("doc_id") % 60)
    return metrics.roc_auc(rows, by=["g"], least=5).select("g", F.col("roc_auc").isNotNull().cast("int").alias("defined"), "pos")


@query("predictions", """select coalesce(a.doc_id, b.doc_id) as doc_id, round(abs(a.score - b.s), 9) as difference, coalesce(round(abs(a.score - b.s), 9) <= 0.0005, false) as ok from (select doc_id, score from predictions where doc_id % 7 <> 0) a
  full join (select doc_id, score + (doc_id % 3) / 2500.0::double as s from predictions where doc_id % 11 <> 0) b on b.doc_id = a.doc_id""")
def compared_scores(spark, sf_dir):
    rows = X.predictions(spark, sf_dir)
    recorded = rows.filter("doc_id % 11 <> 0").select("doc_id", (F.col("score") + (F.col("doc_id") % 3) / F.lit(2500.0)).alias("score"))
    return paired.compared(rows.filter("doc_id % 7 <> 0"), recorded, "doc_id", "score", 0.0005).select("doc_id", R9(F.col("difference")).alias("difference"), "ok")


@query("clips", """select clip, concat_ws(',', case when size < 100 then 'small' end, case when split is null then 'no split' end) as reasons, case when label is null then 1 else 0 end as warned, not coalesce(size < 100, false) and split is not null as accepted from clips""")
def artifact_verdicts(spark, sf_dir):
    got = provenance.verdict(X.clips(spark, sf_dir), {"small": F.col("size") < 100, "no split": F.col("split").isNull()}, {"no label": F.col("label").isNull()})
    return got.select("clip", F.array_join("rejections", ",").alias("reasons"), F.size("warnings").alias("warned"), "accepted")


@query("clips", "select w.clip, coalesce(cast(c.label as varchar), 'missing') as label from (select distinct clip from clips) w left join (select clip, label from clips where clip % 2 = 0) c on c.clip = w.clip")
def table_with_gaps(spark, sf_dir):
    rows = X.clips(spark, sf_dir)
    return provenance.or_missing(rows.select("clip").distinct(), rows.filter("clip % 2 = 0").select("clip", "label"), "clip", "label")


@query("clips", """--cte e as (select clip % 10 as archive, clip as seq, size, row_number() over (partition by clip % 10 order by clip) as rn from clips),
  b as (select archive, rn, size as held, 0 as batch, seq, size from e where rn = 1 union all select e.archive, e.rn, case when b.held + e.size > 20000 then e.size else b.held + e.size end, case when b.held + e.size > 20000 then b.batch + 1 else b.batch end, e.seq, e.size from b join e on e.archive = b.archive and e.rn = b.rn + 1)
  select archive, seq, size, batch from b""")
def archive_batches(spark, sf_dir):
    rows = X.clips(spark, sf_dir).select((F.col("clip") % 10).alias("archive"), F.col("clip").alias("seq"), "size")
    return provenance.batches(rows, 20000)


@query("frame_spine tracks", """--cte f as (select clip, frame from tracks group by clip, frame having count(*) >= 4), n as (select clip, count(*) as frames from frame_spine group by clip)
  select f.clip, 'Many' as event_type, count(*) as fired, round(count(*) / n.frames::double, 9) as fraction from f join n on n.clip = f.clip group by f.clip, n.frames""")
def firing_fractions(spark, sf_dir):
    """A rule of one's own beside the usual ones, found by a part of its name; the share of frames in which it fires."""

    def many(rows, spine, rule):
        counts = rows.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("track_id")).alias("object_ids"))
        return counts.filter(F.col("n") >= rule.get("least", 4)).select("clip", "frame", "object_ids", F.lit(0.5).alias("confidence"), F.array(F.format_string("tracks=%d", F.col("n"))).alias("evidence"))

    every = [rules.EventRule("Many", run=many, parameters={"least": 4}), rules.EventRule(rules.STATIONARY, enabled=False)]
    spine = X.frame_spine(spark, sf_dir)
    events = rules.detect(X.tracks(spark, sf_dir), spine, [rules.named(every, "man")])
    return rules.fire_fraction(events, spine).withColumn("fraction", R9(F.col("fraction")))


@query("window_scores", """--cte r as (select clip, window_index, score + k * 0.001::double as score, case when clip % 5 = 0 and k = 2 then 'Other' else true_label end as true_label, window_index * 10 + k as pos from window_scores, (values (0), (2)) v(k) where k = 0 or window_index % 3 = 0)
  select clip, window_index, round(arg_max(score, pos), 9) as score, any_value(l) as true_label from (select *, last_value(true_label) over (partition by clip order by pos rows between unbounded preceding and unbounded following) as l from r) group by clip, window_index""")
def last_rows_win(spark, sf_dir):
    rows = X.window_scores(spark, sf_dir)
    k = F.explode(F.when(F.col("window_index") % 3 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("k", k).select("clip", "window_index", (F.col("score") + F.col("k") * F.lit(0.001)).alias("score"), F.when((F.col("clip") % 5 == 0) & (F.col("k") == 2), "Other").otherwise(F.col("true_label")).alias("true_label"), (F.col("window_index") * 10 + F.col("k")).alias("at"))
    return readers.last_rows(rows, "at").select("clip", "window_index", R9(F.col("score")).alias("score"), "true_label")


@query("predictions", """--cte r as (select 'max' as name, count(*) filter (truth = 1 and score >= 0.6) as tp, count(*) filter (truth = 0 and score >= 0.6) as fp, 1 as complexity from predictions union all select 'mean', count(*) filter (truth = 1 and score >= 0.3), count(*) filter (truth = 0 and score >= 0.3), 2 from predictions
  union all select 'top2', count(*) filter (truth = 1 and score >= 0.2), count(*) filter (truth = 0 and score >= 0.2), 3 from predictions)
  select name, tp, fp, complexity, name <> 'max' and name <> 'top2' and tp >= (select tp from r where name = 'max') + 5 as promoted, row_number() over (order by tp desc, fp, complexity, name) as place, case when name = 'top2' then 'no replay' end as blocked from r""")
def promotion_blocked(spark, sf_dir):
    rows = X.predictions(spark, sf_dir)
    parts = [rows.withColumn("fired", F.col("score") >= t).agg(*metrics.confusion()).select(F.lit(n).alias("name"), "tp", "fp", F.lit(c).alias("complexity")) for n, t, c in (("max", 0.6, 1), ("mean", 0.3, 2), ("top2", 0.2, 3))]
    return thresholds.promotion(parts[0].unionByName(parts[1]).unionByName(parts[2]), blocked={"top2": "no replay"})


@query("predictions", """--cte t as (select 0.0::double + k / 2000.0::double as t from (select unnest(range(2001)) as k)), s as (select count(*) filter (truth = 1 and score >= t) as tp, count(*) filter (truth = 0 and score >= t) as fp, count(*) filter (truth = 0 and score < t) as tn, count(*) filter (truth = 1 and score < t) as fn from t, predictions group by t)
  select tp, fp, tn, fn, count(*) as thresholds from s group by all having count(*) > 1""")
def equal_matrices(spark, sf_dir):
    rows = X.predictions(spark, sf_dir).groupBy("score").agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("q"))
    grid = spark.range(2001).select((F.col("id") / F.lit(2000.0)).alias("t"))  # a grid of thresholds, and what changes at each score
    placed = rows.select(F.ceil(F.col("score") * 2000).cast("bigint").alias("k"), F.col("score"), "p", "q").withColumn("k", F.when(F.col("k") / F.lit(2000.0) > F.col("score"), F.col("k") - 1).otherwise(F.col("k")))
    steps = grid.select(F.round(F.col("t") * 2000).cast("bigint").alias("k")).join(placed.groupBy("k").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), "k", "left").fillna(0, ["p", "q"])
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a fixed grid
    every = steps.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    swept = steps.select("k", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp")).crossJoin(every).select("tp", "fp", (F.col("all_q") - F.col("fp")).alias("tn"), (F.col("all_p") - F.col("tp")).alias("fn"))
    return thresholds.identical_matrices(swept)


_DRAWS = "draws as (select r as resample, s as slot, (r * 7919 + s * 104729 + (r * s) % 613) % (select count(*) from units) as ordinal from (select unnest(range(200)) as r), (select unnest(range((select count(*) from units))) as s))"


def _drawn(units, resamples: int = 200):
    """The table of draws that the SQL builds too."""
    n = units.count()
    r, s = F.col("resample"), F.col("slot")
    return resampling.slots(units.sparkSession, n, resamples).withColumn("ordinal", (r * 7919 + s * 104729 + (r * s) % 613) % n)


def _rounded(df):
    return df.select(*[R9(F.col(c)).alias(c) for c in ("point", "low", "high")], "used", "discarded")


_PAIRED = f"""{_DRAWS}, v as (select resample, (sum(right_b) - sum(right_a)) / sum(n)::double as value from draws join units u on u.ordinal = draws.ordinal group by resample)
  select round((select (sum(right_b) - sum(right_a)) / sum(n)::double from units), 9) as point, round(quantile_cont(value, 0.025), 9) as low, round(quantile_cont(value, 0.975), 9) as high, count(value) as used, count(*) filter (value is null) as discarded from v"""
_RIGHT = "cast((score >= 0.5) = (truth = 1) as bigint) as right_a, cast((score_b >= 0.5) = (truth = 1) as bigint) as right_b"


def _right(rows):
    ok = lambda c: ((F.col(c) >= 0.5) == (F.col("truth") == 1)).cast("bigint")
    return rows.select("doc_id", F.lit(1).alias("n"), ok("score").alias("right_a"), ok("score_b").alias("right_b"))


@query("paired_predictions", f"--cte units as (select row_number() over (order by doc_id) - 1 as ordinal, 1 as n, {_RIGHT} from paired_predictions), {_PAIRED}")
def paired_bootstrap(spark, sf_dir):
    units = paired.numbered(_right(X.paired_predictions(spark, sf_dir)), ["doc_id"])
    return _rounded(resampling.paired_difference(units, _drawn(units)))


@query("paired_predictions", f"--cte units as (select row_number() over (order by source) - 1 as ordinal, * from (select doc_id % 37 as source, count(*) as n, sum(right_a) as right_a, sum(right_b) as right_b from (select doc_id, {_RIGHT} from paired_predictions) group by 1)), {_PAIRED}")
def paired_bootstrap_clustered(spark, sf_dir):
    rows = _right(X.paired_predictions(spark, sf_dir)).groupBy((F.col("doc_id") % 37).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("right_a").alias("right_a"), F.sum("right_b").alias("right_b"))
    units = paired.numbered(rows, ["source"])
    return _rounded(resampling.paired_difference(units, _drawn(units)))


@query("window_scores", f"""--cte a as (select clip, min(case when score >= 0.9 then last_frame end) / 30.0::double as value from window_scores group by clip), units as (select row_number() over (order by clip) - 1 as ordinal, value from a), {_DRAWS},
  m as (select resample, list_sort(list(coalesce(value, 1e300))) as l from draws join units u on u.ordinal = draws.ordinal group by resample union all select -1, list_sort(list(coalesce(value, 1e300))) from units), v as (select resample, case when l[cast(greatest(1, ceil(0.5 * len(l))) as int)] < 1e299 then l[cast(greatest(1, ceil(0.5 * len(l))) as int)] end as value from m)
  select round(max(case when resample = -1 then value end), 9) as point, round(quantile_cont(value, 0.025) filter (resample >= 0), 9) as low, round(quantile_cont(value, 0.975) filter (resample >= 0), 9) as high, count(value) filter (resample >= 0) as used, count(*) filter (value is null and resample >= 0) as discarded from v""")
def median_alarm_bootstrap(spark, sf_dir):
    rows = X.window_scores(spark, sf_dir).groupBy("clip").agg((F.min(F.when(F.col("score") >= 0.9, F.col("last_frame"))) / F.lit(30.0)).alias("value"))
    units = paired.numbered(rows, ["clip"])
    return _rounded(resampling.censored_median(units, _drawn(units)))


@query("window_scores", """--cte d as (select clip, max(score) >= 0.8 as a, avg(score) >= 0.72 as b, clip % 2 = 0 as truth from window_scores group by clip)
  select case when truth then 'Fight' else 'NonFight' end as stratum, list_aggregate(list_sort(list(clip) filter (a and not b)), 'string_agg', ',') as only_a, list_aggregate(list_sort(list(clip) filter (b and not a)), 'string_agg', ',') as only_b, count(*) as clips from d group by truth""")
def confirmatory_changes(spark, sf_dir):
    """Strata of the confirmatory analysis: the clips whose decision changes between two candidates."""
    rows = X.window_scores(spark, sf_dir).groupBy("clip").agg((F.max("score") >= 0.8).alias("a"), (F.avg("score") >= 0.72).alias("b")).withColumn("stratum", F.when(F.col("clip") % 2 == 0, "Fight").otherwise("NonFight"))
    got = fusion.changed_clips(rows, "a", "b", "stratum")
    join = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return got.select("stratum", join("only_a"), join("only_b"), "clips")
