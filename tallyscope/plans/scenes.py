"""Queries over tracks, events and datasets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions import geometry as G
from tallyscope.functions import paths as P
from tallyscope.operators import dataset, risk, rules, sampling, tracking
from tallyscope.operators import decisions as D
from tallyscope.operators import tracks as T
from tallyscope.operators import windows as W
from tallyscope.plans.scores import MAX_RULE, query
from tallyscope.sources import fixtures as X

R6 = lambda c: F.round(c, 6)

_PERSONS = "p as (select * from tracks where class_id = 0), f as (select clip, frame, count(*) as persons, sqrt(pow(max(x2) - min(x1), 2) + pow(max(y2) - min(y1), 2)) as diagonal from p group by clip, frame)"
_PAIRS = f"{_PERSONS}, q as (select a.clip, a.frame, a.track_id as id_a, b.track_id as id_b, diagonal, sqrt(pow((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2, 2) + pow((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2, 2)) / diagonal as distance from p a join p b on a.clip = b.clip and a.frame = b.frame and a.track_id < b.track_id join f on f.clip = a.clip and f.frame = a.frame)"


@query("tracks", f"--cte {_PAIRS} select clip, frame, id_a, id_b, round(distance, 6) as distance from q")
def normalized_pair_distance(spark, sf_dir):
    return T.pairs(X.tracks(spark, sf_dir)).select("clip", "frame", "id_a", "id_b", R6("distance").alias("distance"))


@query("detections", """--cte w as (select a.clip, a.frame, a.det_idx as i, b.det_idx as j, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as o,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as s from detections a join detections b on a.clip = b.clip and a.frame = b.frame and a.det_idx < b.det_idx)
  select clip, frame, i, j, round(case when s - o > 0 then o / (s - o) else 0 end, 6) as iou from w""")
def box_iou_pairs(spark, sf_dir):
    rows = X.detections(spark, sf_dir)
    a = rows.select("clip", "frame", F.col("det_idx").alias("i"), *[F.col(c).alias(f"a_{c}") for c in G.BOX])
    b = rows.select("clip", "frame", F.col("det_idx").alias("j"), *[F.col(c).alias(f"b_{c}") for c in G.BOX])
    return a.join(b, ["clip", "frame"]).filter("i < j").select("clip", "frame", "i", "j", R6(G.iou(G.box("a_"), G.box("b_"))).alias("iou"))


_MOTION = """m as (select *, coalesce(sqrt(pow((x1 + x2) / 2 - lag((x1 + x2) / 2) over w, 2) + pow((y1 + y2) / 2 - lag((y1 + y2) / 2) over w, 2)), 0) as movement, row_number() over w as appearances from tracks window w as (partition by clip, track_id order by frame)),
  g as (select *, sum(cast(movement > 60 as int)) over (partition by clip, track_id order by frame rows unbounded preceding) as run from m),
  s as (select *, sum(cast(movement <= 60 as int)) over (partition by clip, track_id, run order by frame rows unbounded preceding)::bigint as streak from g)"""


@query("tracks", f"--cte {_MOTION} select clip, frame, track_id, round(movement, 6) as movement, appearances, streak from s")
def track_motion(spark, sf_dir):
    return T.motion(X.tracks(spark, sf_dir), 60, 2).select("clip", "frame", "track_id", R6("movement").alias("movement"), "appearances", "streak")


@query("tracks", f"--cte {_MOTION} select clip, frame, track_id, streak from s where class_id = 0 and streak >= 2")
def stationary_events(spark, sf_dir):
    return rules.stationary(X.tracks(spark, sf_dir), 60, 2)


@query("tracks", """--cte i as (select *, (x1 + x2) / 2 between 0 and 100 and (y1 + y2) / 2 between 0 and 100 as inside from tracks), l as (select *, coalesce(lag(inside) over (partition by clip, track_id order by frame), false) as was from i)
  select clip, frame, track_id from l where class_id = 0 and inside and not was""")
def restricted_entries(spark, sf_dir):
    return rules.restricted(X.tracks(spark, sf_dir), (0, 0, 100, 100))


_CROWD = f"""{_PERSONS}, o as (select s.clip, s.frame, coalesce(f.persons >= 2, false) as on_, f.persons from frame_spine s left join f on f.clip = s.clip and f.frame = s.frame),
  n as (select *, sum(cast(not on_ as int)) over (partition by clip order by frame rows unbounded preceding) as gap from o),
  c as (select *, row_number() over (partition by clip, gap order by frame) as place from n where on_)"""


@query("frame_spine tracks", f"--cte {_CROWD} select clip, frame, persons from c where place = 2")
def crowding_events(spark, sf_dir):
    return rules.crowding(X.tracks(spark, sf_dir), X.frame_spine(spark, sf_dir), 2, 2).select("clip", "frame", "persons")


_NEAR = f"""{_PAIRS}, r as (select *, frame - row_number() over (partition by clip, id_a, id_b order by frame) as run from q where distance <= 0.5),
  h as (select *, row_number() over (partition by clip, id_a, id_b, run order by frame) as place from r)"""


@query("tracks", f"--cte {_NEAR} select clip, frame, id_a, id_b, round(distance, 6) as distance from h where place = 2")
def proximity_events(spark, sf_dir):
    return rules.proximity(X.tracks(spark, sf_dir), 0.5, 2).select("clip", "frame", "id_a", "id_b", R6("distance").alias("distance"))


@query("frame_spine tracks", f"""--cte {_PERSONS}, b as (select *, lag(x1, 2) over w as bx1, lag(y1, 2) over w as by1, lag(x2, 2) over w as bx2, lag(y2, 2) over w as by2 from tracks window w as (partition by clip, track_id order by frame)),
  v as (select clip, avg(sqrt(pow((x1 + x2) / 2 - (bx1 + bx2) / 2, 2) + pow((y1 + y2) / 2 - (by1 + by2) / 2, 2))) as speed_mean, count(*) as samples from b where class_id = 0 and bx1 is not null group by clip),
  d as (select s.clip, count(*) as frames, count(*) filter (f.persons is null) as empty_frames, avg(coalesce(f.persons, 0)) as mean_persons, avg(f.diagonal) as diag_mean from frame_spine s left join f on f.clip = s.clip and f.frame = s.frame group by s.clip)
  select d.clip, frames, empty_frames, round(mean_persons, 6) as mean_persons, coalesce(samples, 0) as samples, round(speed_mean / nullif(diag_mean, 0), 6) as spatial from d left join v on v.clip = d.clip""")
def spatial_feature(spark, sf_dir):
    rows = T.spatial_feature(X.tracks(spark, sf_dir), X.frame_spine(spark, sf_dir))
    return rows.select("clip", "frames", "empty_frames", R6("mean_persons").alias("mean_persons"), "samples", R6("spatial").alias("spatial"))


@query("tracks", """--cte b as (select *, lag(x1, 2) over w as bx1, lag(y1, 2) over w as by1, lag(x2, 2) over w as bx2, lag(y2, 2) over w as by2 from tracks window w as (partition by clip, track_id order by frame)),
  v as (select clip, track_id, frame, sqrt(pow((x1 + x2) / 2 - (bx1 + bx2) / 2, 2) + pow((y1 + y2) / 2 - (by1 + by2) / 2, 2)) as speed from b where class_id = 0 and bx1 is not null)
  select clip, track_id, frame, round(speed, 6) as speed, round(abs(speed - lag(speed) over (partition by clip, track_id order by frame)), 6) as speed_change from v""")
def speed_changes(spark, sf_dir):
    return T.speeds(X.tracks(spark, sf_dir)).select("clip", "track_id", "frame", R6("speed").alias("speed"), R6("speed_change").alias("speed_change"))


@query("tracks", "--cte s as (select clip, track_id, count(distinct frame) as n from tracks group by clip, track_id) select clip, count(*) as ids, bool_or(n >= 2) as persistent from s group by clip")
def id_persistence(spark, sf_dir):
    return T.id_persistence(X.tracks(spark, sf_dir))


RULES = [
    rules.EventRule(rules.STATIONARY, parameters={"movement": 60, "frames": 2}),
    rules.EventRule(rules.RESTRICTED, parameters={"region": (0, 0, 100, 100)}),
    rules.EventRule(rules.CROWDING, parameters={"least": 2, "persistence": 2}),
    rules.EventRule(rules.PROXIMITY, parameters={"nearer": 0.5, "persistence": 2}),
]
_EVENTS = f"""{_MOTION.replace("g as", "mg as").replace("from g)", "from mg)")}, {_CROWD}, q as (select a.clip, a.frame, a.track_id as id_a, b.track_id as id_b, sqrt(pow((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2, 2) + pow((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2, 2)) / diagonal as distance
    from p a join p b on a.clip = b.clip and a.frame = b.frame and a.track_id < b.track_id join f on f.clip = a.clip and f.frame = a.frame),
  r as (select *, frame - row_number() over (partition by clip, id_a, id_b order by frame) as run from q where distance <= 0.5), h as (select *, row_number() over (partition by clip, id_a, id_b, run order by frame) as place from r),
  i as (select *, (x1 + x2) / 2 between 0 and 100 and (y1 + y2) / 2 between 0 and 100 as inside from tracks), l as (select *, coalesce(lag(inside) over (partition by clip, track_id order by frame), false) as was from i),
  e as (select clip, frame, 'Stationary Person' as event_type, 0.9::double as confidence, track_id as object_id, 0 as g, 0 as k, [track_id] as ids from s where class_id = 0 and streak >= 2
    union all select clip, frame, 'Restricted Area Entry', 0.95::double, track_id, 0, 1, [track_id] from l where class_id = 0 and inside and not was
    union all select c.clip, c.frame, 'Crowding', null, null, 2, 2, (select list_sort(list(track_id)) from p where p.clip = c.clip and p.frame = c.frame) from c where place = 2
    union all select clip, frame, 'Proximity/Interaction', null, null, 2, 3, [id_a, id_b] from h where place = 2),
  z as (select *, row_number() over (partition by clip order by frame, case when g = 0 then 0 else 1 end, object_id, k, ids) as seq, case event_type when 'Restricted Area Entry' then 'Medium' when 'Crowding' then 'Medium' else 'Low' end as risk_level from e)"""


def _records(spark, sf_dir):
    return risk.assess(rules.detect(X.tracks(spark, sf_dir), X.frame_spine(spark, sf_dir), RULES))


@query("frame_spine tracks", f"""--cte {_EVENTS} select clip, seq, frame, event_type, confidence, object_id, risk_level, case when confidence is not null then 'declared_constant' end as confidence_provenance,
  'Configured mapping assigns ' || event_type || ' to ' || risk_level || ' risk.' as reason from z""")
def risk_records(spark, sf_dir):
    return _records(spark, sf_dir).select("clip", "seq", "frame", "event_type", "confidence", "object_id", "risk_level", "confidence_provenance", "reason")


@query("frame_spine tracks", f"--cte {_EVENTS} select clip, event_type, risk_level, count(*) as events, min_by(confidence, seq) as confidence, min(seq) as first_seen from z group by clip, event_type, risk_level")
def event_summary(spark, sf_dir):
    return risk.summary(_records(spark, sf_dir), ["clip"], F.col("seq")).drop("frames")


@query("frame_spine tracks window_scores", f"""--cte {_EVENTS}, d as (select clip, max(score) >= 0.8 as fired from window_scores group by clip), y as (select clip, bool_or(risk_level = 'Medium') as medium from z group by clip)
  select coalesce(d.clip, y.clip) as clip, case when coalesce(fired, false) then 'High' when y.clip is null then 'None' when medium then 'Medium' else 'Low' end as overall_risk from d full join y on d.clip = y.clip""")
def overall_risk(spark, sf_dir):
    return risk.overall(_records(spark, sf_dir), D.decide(X.window_scores(spark, sf_dir), MAX_RULE).select("clip", "fired"))


@query("window_scores", """--cte a as (select clip, min(case when h then last_frame end) as alarm_frame from (select *, max(score) over (partition by clip order by window_index) >= 0.8 as h from window_scores) group by clip),
  k as (select clip, window_index, score from (select *, row_number() over (partition by clip order by score desc, window_index) as rn from window_scores) where rn = 1)
  select a.clip, alarm_frame + 1 as frame, score as confidence, window_index as peak_window from a join k on k.clip = a.clip where alarm_frame is not null""")
def temporal_events(spark, sf_dir):
    windows = X.window_scores(spark, sf_dir)
    rows = rules.temporal_events(D.peaks(windows), W.first_alarm(windows, MAX_RULE.running()))
    return rows.select("clip", "frame", "confidence", F.element_at(P.parsed_evidence(F.col("evidence")), "peak_window_index").cast("bigint").alias("peak_window"))


@query("frame_spine window_scores", "--cte d as (select clip, max(score) >= 0.8 as fired from window_scores group by clip) select s.clip, case when fired is null then 'Undetermined' when fired then 'Fight' else 'NonFight' end as state from (select distinct clip from frame_spine) s left join d on d.clip = s.clip")
def clip_states(spark, sf_dir):
    return rules.clip_state(X.frame_spine(spark, sf_dir), D.decide(X.window_scores(spark, sf_dir), MAX_RULE))


@query("detections", None)
def greedy_tracker(spark, sf_dir):
    return tracking.track(X.detections(spark, sf_dir), X.frame_spine(spark, sf_dir))


def _files(spark, sf_dir):
    rows = X.clips(spark, sf_dir)
    content = F.encode("content", "UTF-8")
    return rows.withColumns({"fingerprint": P.fingerprint(F.octet_length("content"), content), "digest": F.md5(content)})


@query("clips", """--cte g as (select octet_length(encode(content)) || ':' || md5(encode(content)) as fingerprint, md5(encode(content)) as digest, split, clip from clips)
  select fingerprint, digest, count(*) as members, count(distinct split) as splits, min(clip) as first_clip from g group by fingerprint, digest having count(distinct split) > 1""")
def cross_split_duplicates(spark, sf_dir):
    return dataset.confirmed_groups(_files(spark, sf_dir))


@query("clips", "select size, count(*) as files, count(distinct split) as splits from clips group by size having count(distinct split) > 1")
def name_collisions(spark, sf_dir):
    return dataset.name_collisions(X.clips(spark, sf_dir), "size")


_SPLIT = "o as (select clip from clips where split = 'src0'), k as (select clip from clips where clip % 7 = 0)"


@query("clips", f"--cte {_SPLIT} select 'primary' as part, clip from o where clip not in (select clip from k) union all select 'excluded', clip from o where clip in (select clip from k) union all select 'missing', clip from k where clip not in (select clip from o)")
def split_partition(spark, sf_dir):
    rows = X.clips(spark, sf_dir).select("clip", "split")
    parts = dataset.evaluation_splits(rows.filter("split = 'src0'").select("clip"), rows.filter("clip % 7 = 0").select("clip"))
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), "clip")
        out = one if out is None else out.unionByName(one)
    return out


@query("clips", """--cte s as (select 'even' as n, clip from clips where clip % 2 = 0 union all select 'third', clip from clips where clip % 3 = 0 union all select 'odd', clip from clips where clip % 2 = 1)
  select a.n as a, b.n as b, (select count(*) from s x join s y on x.clip = y.clip where x.n = a.n and y.n = b.n) as shared from (select distinct n from s) a, (select distinct n from s) b where a.n < b.n""")
def disjointness(spark, sf_dir):
    rows = X.clips(spark, sf_dir).select("clip")
    named = [rows.filter(c).select(F.lit(n).alias("set_name"), "clip") for n, c in (("even", "clip % 2 = 0"), ("third", "clip % 3 = 0"), ("odd", "clip % 2 = 1"))]
    return dataset.disjointness(named[0].unionByName(named[1]).unionByName(named[2]))


_HOST = "h as (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as source from pages)"


@query("clips", f"--cte {_HOST}, n as (select source, count(*) as n from h group by source) select sum(n)::bigint as clips, count(*) as clusters, round(avg(n), 6) as mean_size, max(n) as max_size, count(*) filter (n = 1) as singletons, coalesce(sum(n) filter (n > 1), 0)::bigint as clips_in_multi from n")
def source_clusters(spark, sf_dir):
    rows = X.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("source"))
    return dataset.source_clusters(rows).withColumn("mean_size", R6("mean_size"))


@query("clips", "select 'split' as facet, coalesce(split, '(none)') as value, count(*) as n from clips group by all union all select 'label', coalesce(cast(label as varchar), '(none)'), count(*) from clips group by all union all select 'size', cast(size as varchar), count(*) from clips where size > 0 group by all")
def dataset_summary(spark, sf_dir):
    rows = X.clips(spark, sf_dir).withColumn("readable", F.col("size") > 0)
    return dataset.facets(rows, ["split", "label", "size"], ["size"])


@query("clips", """--cte e as (select clip, size from clips where clip % 5 <> 0), d as (select clip, case when clip % 11 = 0 then size - 1 else size end as size from clips where clip % 3 <> 0), m as (select clip from clips where clip % 13 = 0)
  select coalesce(e.clip, d.clip) as path, e.size as expected, d.size as actual, case when e.clip is null then 'unexpected' when d.clip is null then 'missing' when d.size <> e.size then 'truncated' when m.clip is not null then 'recovered' else 'present' end as state
  from e full join d on d.clip = e.clip left join m on m.clip = e.clip""")
def inventory_reconcile(spark, sf_dir):
    rows = X.clips(spark, sf_dir).select(F.col("clip").alias("path"), "size")
    disk = rows.filter("path % 3 <> 0").withColumn("size", F.when(F.col("path") % 11 == 0, F.col("size") - 1).otherwise(F.col("size")))
    manifest = rows.filter("path % 13 = 0").select("path", F.col("path").alias("written"))
    return dataset.reconcile(rows.filter("path % 5 <> 0"), disk, manifest)


@query("clips", """--cte e as (select clip as name, md5(encode(content)) as md5 from clips where clip % 2 = 0), f as (select clip as name, case when clip % 9 = 0 then 'x' when clip % 7 <> 0 then md5(encode(content)) end as md5 from clips where clip % 3 <> 1)
  select coalesce(e.name, f.name) as name, case when f.name is null then 'MISSING' when e.name is null then 'UNEXPECTED' when e.md5 is null or f.md5 is null then 'PRESENT' when e.md5 = f.md5 then 'OK' else 'MD5_MISMATCH' end as state from e full join f on e.name = f.name""")
def archive_parts(spark, sf_dir):
    rows = X.clips(spark, sf_dir).select(F.col("clip").alias("name"), F.md5(F.encode("content", "UTF-8")).alias("md5"))
    found = rows.filter("name % 3 <> 1").withColumn("md5", F.when(F.col("name") % 9 == 0, "x").when(F.col("name") % 7 != 0, F.col("md5")))
    return dataset.verify_parts(rows.filter("name % 2 = 0"), found)


@query("clips", "select clip, s as segment, least(s * size // 16 + (greatest((s + 1) * size // 16, s * size // 16 + 1) - s * size // 16) // 2, size - 1) as frame from clips, (select unnest(range(16)) as s)")
def segment_sampling(spark, sf_dir):
    return sampling.uniform(X.clips(spark, sf_dir).select("clip", "size"), 16, "size")


@query("clips", "select split, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 1) as percent from clips group by split")
def split_shares(spark, sf_dir):
    return dataset.shares(X.clips(spark, sf_dir), "split")


@query("clips", """select 'clips_once' as name, count(clip) = count(distinct clip) as passed from clips union all select 'one_split_per_clip', not exists (select clip from clips group by clip having count(distinct split) <> 1)
  union all select 'labels_known', count(*) filter (label is null) = 0 from clips""")
def readiness_checks(spark, sf_dir):
    rows = X.clips(spark, sf_dir)
    known = rows.agg((F.count_if(F.col("label").isNull()) == 0).alias("passed"), F.count_if(F.col("label").isNull()).alias("detail"))
    return dataset.checks({"clips_once": dataset.unique(rows, "clip"), "one_split_per_clip": dataset.one_value(rows, "clip", "split"), "labels_known": known}).select("name", "passed")
