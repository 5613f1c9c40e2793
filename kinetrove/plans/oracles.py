"""The queries once more in DuckDB SQL, derived independently of the Spark plans where that is possible."""

from __future__ import annotations


def _dbscan(name: str, hits: str, by: str, eps: int, least: int) -> str:
    """CTEs that label ``hits`` (by, frame): cores by a range count, clusters by gaps of cores, others by the nearest core."""
    on = " and ".join(f"c.{k} = {{0}}.{k}" for k in by.split(", "))
    return f"""
{name}_n as (select {by}, frame, count(*) over (partition by {by} order by frame range between {eps} preceding and {eps} following) as n from {hits}),
{name}_gap as (select {by}, frame, case when frame - lag(frame) over (partition by {by} order by frame) <= {eps} then 0 else 1 end as opens from {name}_n where n >= {least}),
{name}_core as (select {by}, frame, sum(opens) over (partition by {by} order by frame) - 1 as label from {name}_gap),
{name} as (
  select {", ".join("c." + k for k in by.split(", "))}, c.frame, cast(case
    when c.frame - p.frame <= {eps} and (q.frame is null or q.frame - c.frame > {eps} or c.frame - p.frame <= q.frame - c.frame) then p.label
    when q.frame - c.frame <= {eps} then q.label else -1 end as bigint) as label
  from {name}_n c asof left join {name}_core p on {on.format("p")} and c.frame >= p.frame
  asof left join {name}_core q on {on.format("q")} and c.frame <= q.frame),
{name}_span as (select {by}, label as event_id, min(frame) as start, max(frame) as stop from {name} where label >= 0 group by {by}, label)"""


GONE = "((vec_id // 20 + j // 9 + 1) % 5 = 0 or (vec_id // 20 + 2 * (j // 9 + 1)) % 7 = 0 or (vec_id + 3 * (j % 9) + 5 * (j // 9 + 1)) % 61 = 0)"
ANGLE = "(case when degrees(atan2({0}, {1})) < 0 then degrees(atan2({0}, {1})) + 360 else degrees(atan2({0}, {1})) end)"
BASE = f"""
with pose as (
  select 'clip' || (vec_id // 250) as clip, vec_id as frame, 'individual' || (j // 9 + 1) as individual,
    ['nose', 'leftEye', 'rightEye', 'stripe1', 'stripe2', 'stripe3', 'stripe4', 'tailBase', 'tailTip'][j % 9 + 1] as bodypart,
    case when not {GONE} then 360 + 300 * embedding[2 * j + 1]::double end as x,
    case when not {GONE} then 450 + 300 * embedding[2 * j + 2]::double end as y
  from embeddings, range(27) t(j)),
frames as (select distinct clip, frame from pose),
fish as (select clip, frame, individual, bool_or(coalesce(x <> 0, false) or coalesce(y <> 0, false)) as here from pose group by all),
nfish as (select clip, frame, count(*) filter (where here) as nfish_frame from fish group by all),
pipe as (select clip, frame, count(*) filter (where bodypart = 'stripe1' and sqrt((x - 360) * (x - 360) + (y - 450) * (y - 450)) <= 60) as nfish_pipe from pose group by all),
held as (select clip, frame, individual, coalesce(sqrt((x - 360) * (x - 360) + (y - 450) * (y - 450)) < 60, false) as in_roi from pose where bodypart = 'stripe1'),
duo as (
  select a.clip, a.frame, a.individual as individual_a, b.individual as individual_b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist
  from pose a join pose b on a.clip = b.clip and a.frame = b.frame and a.individual <> b.individual where a.bodypart = 'nose' and b.bodypart = 'stripe4'),
near as (select f.clip, f.frame, min(dist) as min_dist from frames f left join duo using (clip, frame) group by all),
stripes as (
  select a.clip, a.frame, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as sep
  from pose a join pose b on a.clip = b.clip and a.frame = b.frame and a.individual < b.individual where a.bodypart = 'stripe1' and b.bodypart = 'stripe1' group by all),
present as (select clip, individual, frame from pose group by all having count(x) > 0 or count(y) > 0),
track as (
  select clip, individual, min(frame) as start, max(frame) as stop, count(*) as n
  from (select *, frame - row_number() over (partition by clip, individual order by frame) as run from present) group by clip, individual, run),
segment as (select clip, individual, start, stop from track where n >= 60),
busy as (select clip, frame, nfish_frame as nfish, frame - row_number() over (partition by clip order by frame) as run from nfish where nfish_frame > 0),
longrun as (select *, count(*) over (partition by clip, run) as len from busy),
rise as (select *, case when nfish > lag(nfish) over (partition by clip, run order by frame) and nfish <> 3 then 1 else 0 end as r from longrun where len >= 60),
part as (select *, sum(r) over (partition by clip, run order by frame) as p from rise),
gseg as (
  select clip, row_number() over (partition by clip order by start) - 1 as segment_id, start, stop, n
  from (select clip, min(frame) as start, max(frame) as stop, count(*) as n from part group by clip, run, p having count(*) >= 60)),
sig as (select 'signal' as clip, event_id as frame from events where value < 25),
sigframes as (select 'signal' as clip, event_id as frame from events),
nearhit as (select clip, frame from near where min_dist < 25),
pipehit as (select clip, frame from pipe where nfish_pipe = 2),
duohit as (select clip, individual_a, individual_b, frame from duo where dist < 30),
{_dbscan("sa", "sig", "clip", 15, 15)},
{_dbscan("sb", "sig", "clip", 30, 30)},
{_dbscan("sc", "sig", "clip", 15, 18)},
{_dbscan("mo", "nearhit", "clip", 15, 6)},
{_dbscan("md", "nearhit", "clip", 15, 15)},
{_dbscan("sp", "nearhit", "clip", 150, 30)},
{_dbscan("dp", "pipehit", "clip", 30, 30)},
{_dbscan("dm", "duohit", "clip, individual_a, individual_b", 15, 6)},
annotated as (
  select 'BHVE_group' || (event_id // 97 % 4) as trial, case when value < 1 then event_id / 30 end as temporal_segment_start,
    case when value < 1 and event_id % 5 <> 0 then (event_id + 20 + event_id % 7) / 30 end as temporal_segment_end from events),
anno as (select 'clip' || (event_id // 250) as clip, event_id as start, event_id + 20 as stop from events where value < 1),
span as (select clip, min(frame) as lo, max(frame) as hi from frames group by clip),
strict as (
  select distinct f.clip, f.frame from frames f join anno a on f.clip = a.clip join span s on f.clip = s.clip where
    (lo < start and start < hi and lo < stop and stop < hi and frame >= start and frame < stop)
    or (lo < start and start < hi and not (lo < stop and stop < hi) and frame >= start and frame < hi)
    or (not (lo < start and start < hi) and lo < stop and stop < hi and frame < stop)),
inclusive as (select distinct f.clip, f.frame from frames f join anno a on f.clip = a.clip and f.frame between start and stop),
mfill as (select f.clip, f.frame, coalesce(event_id, -1) as mouthing_event_id from frames f left join md_span s on f.clip = s.clip and f.frame between s.start and s.stop),
dfill as (select f.clip, f.frame, coalesce(event_id, -1) as double_occupancy_event_id from frames f left join dp_span s on f.clip = s.clip and f.frame between s.start and s.stop),
sfill as (select f.clip, f.frame, coalesce(event_id, -1) as spawning_event_id from frames f left join sp_span s on f.clip = s.clip and f.frame between s.start and s.stop),
feat as (
  select f.clip, f.frame, nfish_frame, nfish_pipe, mouthing_event_id, double_occupancy_event_id, spawning_event_id, (f.clip, f.frame) in (select (clip, frame) from strict) as quivering
  from frames f join nfish using (clip, frame) join pipe using (clip, frame) join mfill using (clip, frame) join dfill using (clip, frame) join sfill using (clip, frame)),
cent as (select clip, frame, individual, avg(x) as cx, avg(y) as cy from pose group by all),
d1 as (select *, cx - lag(cx) over w as dx, cy - lag(cy) over w as dy from cent where cx is not null and cy is not null window w as (partition by clip, individual order by frame)),
d2 as (select *, dx - lag(dx) over w as ax, dy - lag(dy) over w as ay from d1 window w as (partition by clip, individual order by frame)),
moved as (select clip, individual, bodypart, frame, x - lag(x) over w as dx, y - lag(y) over w as dy from pose window w as (partition by clip, individual, bodypart order by frame)),
vel as (select clip, individual, bodypart, frame, sqrt(dx * dx + dy * dy) as speed, {ANGLE.format("dx", "dy")} as heading from moved),
mask as (
  select clip, frame, individual from pose group by all
  having count(x) >= 9 and not coalesce(bool_or(x < 280 or y < 280 or x > 440 or y > 620), false) and coalesce(bool_or(x <> 0), false)),
maskrun as (select *, frame - row_number() over (partition by clip, individual order by frame) as run from mask),
kept as (select clip, frame, individual from (select *, count(*) over (partition by clip, individual, run) as len from maskrun) where len >= 10),
rkept as (select clip, frame, individual from (select *, count(*) over (partition by clip, individual, run) as len from maskrun) where len >= 5),
rpose as (select p.* from pose p semi join rkept using (clip, frame, individual)),
rfish as (select clip, frame, count(*) as nfish from (select clip, frame, individual from rpose group by all having bool_or(coalesce(x <> 0, false) or coalesce(y <> 0, false))) group by all),
rlong as (select *, count(*) over (partition by clip, run) as len from (select *, frame - row_number() over (partition by clip order by frame) as run from rfish)),
rpart as (select *, sum(r) over (partition by clip, run order by frame) as p from (
  select *, case when nfish > lag(nfish) over (partition by clip, run order by frame) and nfish <> 3 then 1 else 0 end as r from rlong where len >= 5)),
rseg as (
  select clip, row_number() over (partition by clip order by start) - 1 as segment_id, start, stop, n
  from (select clip, min(frame) as start, max(frame) as stop, count(*) as n from rpart group by clip, run, p having count(*) >= 5)),
excl as (
  select clip, n_original, coalesce(n_kept, 0)::bigint as n_kept, (n_original - coalesce(n_kept, 0))::double / nullif(n_original, 0) as p
  from (select clip, count(*) filter (where nfish_frame > 0) as n_original from nfish group by clip) left join (select clip, sum(n) as n_kept from gseg group by clip) using (clip)),
dens as (select clip, frame, 'near' as feature from nearhit union all select clip, frame, 'two' from pipehit union all select clip, frame, 'quivering' from strict),
roles as (
  select distinct f.clip, f.frame, individual_a, individual_b from frames f join dm_span s on f.clip = s.clip and f.frame between s.start and s.stop)
"""

FLAT = ", ".join(f"round(max(case when individual = 'individual{i}' and bodypart = '{b}' then {c} end), 6) as {s}{i}{c}" for i in (1, 2, 3) for b, s in (("nose", "no"), ("leftEye", "le"), ("rightEye", "re"), ("stripe1", "sa"), ("stripe2", "sb"), ("stripe3", "sc"), ("stripe4", "sd"), ("tailBase", "tb"), ("tailTip", "tt")) for c in ("x", "y"))
STATS = "count({0}) as n_{1}, round(avg({0}), 6) as mean_len, round(max({0}), 6) as max_len, round(min({0}), 6) as min_len, round(median({0}), 6) as med_len, round(stddev_pop({0}), 6) as std_len"
FRACTION = "round(count(*) filter (where {0}) / nullif(count(*), 0), 6)"
OCCUPANCY = ", ".join(f"round(count(*) filter (where nfish_pipe = {k}) / nullif(count(nfish_pipe), 0), 6) as raw_{w}_occupancy_fraction" for k, w in enumerate(("zero", "single", "double", "triple")))
FILLED = "select f.clip, f.frame, coalesce(event_id, -1) as {2} from {0} f left join {1}_span s on f.clip = s.clip and f.frame between s.start and s.stop"
CLOCK = "left(({0})::bigint // 3600 || ':' || lpad((({0})::bigint // 60 % 60)::varchar, 2, '0') || ':' || lpad((({0})::bigint % 60)::varchar, 2, '0'), 7)"
EGO = "atan2(hy - oy, hx - ox)"
SKELETON = [("nose", "leftEye"), ("nose", "rightEye"), ("stripe1", "stripe2"), ("stripe2", "stripe3"), ("stripe3", "stripe4"), ("stripe4", "tailBase"), ("tailBase", "tailTip")]
KINDS = ("mouthing", "double_occupancy", "spawning")

QUERIES = {
    "pose_scan": "select clip, frame, individual, bodypart, round(x, 6) as x, round(y, 6) as y from pose where x is not null",
    "pose_flat_names": f"select clip, frame, {FLAT} from pose group by clip, frame",
    "nfish_frame": "select * from nfish",
    "nfish_pipe": "select * from pipe",
    "in_roi": "select * from held",
    "roi_occupancy_fractions": f"select clip, {OCCUPANCY} from pipe group by clip",
    "min_nose_stripe4": "select clip, frame, round(min_dist, 6) as min_dist from near",
    "ordered_pair_distances": "select clip, frame, individual_a, individual_b, round(dist, 6) as dist from duo",
    "keypoint_pair_dists": """select a.clip, a.frame, a.individual as individual_a, b.individual as individual_b, a.bodypart, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as dist
      from pose a join pose b on a.clip = b.clip and a.frame = b.frame and a.bodypart = b.bodypart and a.individual < b.individual join nfish n on a.clip = n.clip and a.frame = n.frame where nfish_frame >= 2""",
    "all_point_distances": """select a.clip, a.frame, a.individual || ':' || a.bodypart as point_a, b.individual || ':' || b.bodypart as point_b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as dist
      from pose a join pose b on a.clip = b.clip and a.frame = b.frame and a.individual || ':' || a.bodypart < b.individual || ':' || b.bodypart""",
    "min_separation": "select f.clip, round(coalesce(min(sep), 1000), 6) as min_separation from frames f left join stripes using (clip, frame) group by f.clip",
    "tracks": "select * from track",
    "track_summary": f"select {STATS.format('n / 30', 'tracks')} from track",
    "segments": "select * from segment",
    "segment_length_summary": "select count(*) as n_segments, round(avg(stop - start + 1), 6) as mean_len, max(stop - start + 1) as max_len, min(stop - start + 1) as min_len, round(median(stop - start + 1), 6) as med_len from segment",
    "group_segments": "select * from gseg",
    "segment_labels": "select f.clip, f.frame, coalesce(segment_id, -1) as segment_id from frames f left join gseg g on f.clip = g.clip and f.frame between g.start and g.stop",
    "dbscan1d_signal": "select * from sa",
    "dbscan1d_wide": "select * from sb",
    "signal_events_filled": FILLED.format("sigframes", "sc", "event_id"),
    "mouthing_events": FILLED.format("frames", "mo", "mouthing_event_id"),
    "mouthing_events_default": "select * from mfill",
    "mouthing_events_unfilled": "select f.clip, f.frame, coalesce(label, -1) as mouthing_event_id from frames f left join mo using (clip, frame)",
    "spawning_events": "select * from sfill",
    "double_occupancy_events": "select * from dfill",
    "event_summary_hms": f"select clip, event_id, {CLOCK.format('start // 30')} as start, {CLOCK.format('stop // 30')} as stop from sc_span",
    "event_bounds": "select * from sc_span",
    "event_length_stats": f"select clip, {STATS.format('((stop - start) / 30)', 'events')} from sc_span group by clip",
    "mouther_mouthee": """select clip, frame, individual, (clip, frame, individual) in (select (clip, frame, individual_a) from roles) as mouther,
      (clip, frame, individual) in (select (clip, frame, individual_b) from roles) as mouthee, (clip, frame) in (select (clip, frame) from roles) as mouthing from (select distinct clip, frame, individual from pose)""",
    "quivering_strict": "select clip, frame, (clip, frame) in (select (clip, frame) from strict) as quivering from frames",
    "quivering_inclusive": "select clip, frame, (clip, frame) in (select (clip, frame) from inclusive) as quivering from frames",
    "quivering_fraction": "select clip, round(avg(case when (clip, frame) in (select (clip, frame) from strict) then 1.0::double else 0 end), 6) as quivering_fraction from frames group by clip",
    "segmented_pose": "select p.clip, p.individual, frame, bodypart, round(x, 6) as x, round(y, 6) as y, start, stop from pose p join segment s on p.clip = s.clip and p.individual = s.individual and frame between start and stop",
    "segmented_features": """select h.clip, h.frame, h.individual, in_roi, start, stop, roi_occupancy from held h join segment s on h.clip = s.clip and h.individual = s.individual and h.frame between start and stop
      join (select clip, frame, count(*) filter (where in_roi) as roi_occupancy from held group by all) g on h.clip = g.clip and h.frame = g.frame""",
    "annotation_counts": """select t.trial, count(temporal_segment_end - temporal_segment_start) as n
      from (select 'BHVE_group' || unnest([0, 1, 2, 3, 5]) as trial) t left join annotated a on t.trial = a.trial group by t.trial""",
    "annotation_length_quartiles": """select trial, count(temporal_segment_end - temporal_segment_start) as n, round(quantile_cont(temporal_segment_end - temporal_segment_start, 0.25), 6) as q25,
      round(quantile_cont(temporal_segment_end - temporal_segment_start, 0.5), 6) as q50, round(quantile_cont(temporal_segment_end - temporal_segment_start, 0.75), 6) as q75 from annotated group by trial""",
    "clip_annotations": """select clip, greatest(s - first, 0) as start, least(e - first, last - first) as stop
      from (values ('BHVE_group0_000000-000399', 'BHVE_group0', 0, 399), ('BHVE_group1_000100-000499', 'BHVE_group1', 100, 499), ('BHVE_group2_000300-000899.mp4', 'BHVE_group2', 300, 899)) c(clip, trial, first, last)
      join (select trial, round_even(temporal_segment_start * 30, 0)::bigint as s, round_even(temporal_segment_end * 30, 0)::bigint as e from annotated) a using (trial) where e - first >= 0 and s - first <= last - first""",
    "bp_velocities": "select clip, individual, bodypart, frame, round(speed, 6) as speed, round(heading, 6) as heading from vel",
    "rolling_speed": """select clip, individual, bodypart, frame, round(speed, 6) as speed, round(case when count(speed) over w = 31 then avg(speed) over w end, 6) as rollavg_speed,
      round(case when count(speed) over w = 31 then stddev_pop(speed) over w end, 6) as rollstd_speed from vel window w as (partition by clip, individual, bodypart order by frame rows between 15 preceding and 15 following)""",
    "rolling_heading": """select clip, individual, bodypart, frame, round(heading, 6) as heading,
      round(case when m < 0 then m + 360 else m end, 6) as rollavg_heading, round(degrees(sqrt(-2 * ln(case when s * s + c * c > 1 then 1.0 else sqrt(s * s + c * c) end))), 6) as rollstd_heading
      from (select *, degrees(atan2(s, c)) as m from (select *, case when count(heading) over w = 31 then avg(sin(radians(heading))) over w end as s, case when count(heading) over w = 31 then avg(cos(radians(heading))) over w end as c
      from vel window w as (partition by clip, individual, bodypart order by frame rows between 15 preceding and 15 following)))""",
    "rolling_track": """select user_id::varchar as clip, event_id as frame, value, round(case when count(value) over w = 5 then avg(value) over w end, 6) as rollavg_value,
      round(case when count(value) over w = 5 then stddev_pop(value) over w end, 6) as rollstd_value from events window w as (partition by user_id order by event_id rows between 2 preceding and 2 following)""",
    "centroids": "select clip, frame, individual, round(cx, 6) as centroid_x, round(cy, 6) as centroid_y from cent",
    "centroid_kinetics": """select clip, frame, individual, round(cx, 6) as centroid_x, round(cy, 6) as centroid_y, round(sqrt((cx - 360) * (cx - 360) + (cy - 450) * (cy - 450)), 6) as dist_from_roi_center,
      (sqrt((cx - 360) * (cx - 360) + (cy - 450) * (cy - 450)) < 60)::int as is_inside_roi, round(sqrt(dx * dx + dy * dy), 6) as centroid_speed,
      round(sqrt(ax * ax + ay * ay) * cos(atan2(ay, ax) - atan2(dy, dx)), 6) as centroid_tangential_acceleration,
      round(sqrt(ax * ax + ay * ay) * sin(atan2(ay, ax) - atan2(dy, dx)), 6) as centroid_centripetal_acceleration, right(individual, 1)::int as id_number from d2""",
    "roi_relationships": f"""select clip, frame, individual, round(cx, 6) as centroid_x, round(cy, 6) as centroid_y, round(sqrt((cx - 360) * (cx - 360) + (cy - 450) * (cy - 450)), 6) as dist_from_roi_center,
      round({ANGLE.format("(cy - 450)", "(cx - 360)")}, 6) as angle_to_roi_center, coalesce(sqrt((cx - 360) * (cx - 360) + (cy - 450) * (cy - 450)) <= 60, false)::int as is_inside_roi from cent""",
    "intercentroid_angles": f"""select a.clip, a.frame, a.individual as individual_a, b.individual as individual_b, round({ANGLE.format("(a.cy - b.cy)", "(a.cx - b.cx)")}, 6) as angle
      from cent a join cent b on a.clip = b.clip and a.frame = b.frame and a.individual < b.individual""",
    "skeleton_angles": f"""select a.clip, a.frame, a.individual, part_a, part_b, round({ANGLE.format("(a.y - b.y)", "(a.x - b.x)")}, 6) as angle
      from (values {", ".join(str(p) for p in SKELETON)}) s(part_a, part_b) join pose a on a.bodypart = part_a join pose b on b.bodypart = part_b and a.clip = b.clip and a.frame = b.frame and a.individual = b.individual""",
    "ego_frame": f"""select clip, frame, individual, bodypart, round(ox - 360, 6) as origin_x, round(oy - 450, 6) as origin_y,
      round((x - ox) * cos({EGO}) + (y - oy) * sin({EGO}), 6) as ego_x, round((y - oy) * cos({EGO}) - (x - ox) * sin({EGO}), 6) as ego_y
      from (select p.*, o.x as ox, o.y as oy, h.x as hx, h.y as hy from pose p join pose o on o.bodypart = 'stripe1' and p.clip = o.clip and p.frame = o.frame and p.individual = o.individual
      join pose h on h.bodypart = 'nose' and p.clip = h.clip and p.frame = h.frame and p.individual = h.individual where p.bodypart in ('stripe2', 'stripe3', 'stripe4', 'tailBase', 'tailTip'))""",
    "refined_pose": "select clip, frame, individual, bodypart, round(x, 6) as x, round(y, 6) as y from pose semi join kept using (clip, frame, individual) where x is not null",
    "excluded_proportion": "select clip, n_original, n_kept, round(p, 6) as excluded_proportion from excl",
    "exclusion_stats": "select round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std, round(min(p), 6) as min, round(max(p), 6) as max from excl",
    "collated_summary": """select count(distinct clip) as n_videos, count(*) as n_segments, round(count(*) / nullif(count(distinct clip), 0), 6) as avg_segments_per_video, round(avg(n), 6) as avg_len,
      round(median(n), 6) as med_len, min(n) as min_len, sum(n)::bigint as total_frames from gseg""",
    "frame_features": "select * from feat",
    "clip_features": f"""select clip, {FRACTION.format("quivering")} as quivering_fraction,
      {", ".join(f"count(distinct {k}_event_id) filter (where {k}_event_id >= 0) as n_{k}_events, {FRACTION.format(k + '_event_id >= 0')} as {k}_event_fraction" for k in KINDS)},
      max(nfish_frame) as nfish_frame_max, max(nfish_pipe) as nfish_pipe_max, {OCCUPANCY}, 360.0::double as roi_x, 450.0::double as roi_y, 60.0::double as roi_r from feat group by clip""",
    "individual_features": """select h.clip, h.frame, h.individual, in_roi, (h.clip, h.frame, h.individual) in (select (clip, frame, individual_a) from roles) as mouther,
      (h.clip, h.frame, h.individual) in (select (clip, frame, individual_b) from roles) as mouthee, (h.clip, h.frame) in (select (clip, frame) from roles) as mouthing,
      count(*) filter (where in_roi) over (partition by h.clip, h.frame) as roi_occupancy, (h.clip, h.frame) in (select (clip, frame) from inclusive) as quivering from held h""",
    "window_features": """select clip, min(frame) as start, max(frame) as stop, median(nfish_frame) as med_nfish, median(nfish_pipe) as med_nfish_pipe, round(coalesce(min(sep), 1000), 6) as min_separation
      from (select *, frame // 30 as w, min(frame) over (partition by clip) as lo, max(frame) over (partition by clip) as hi from nfish join pipe using (clip, frame) left join stripes using (clip, frame))
      where w * 30 >= lo and w * 30 + 29 <= hi group by clip, w""",
    "window_stripe1_speed": """select clip, min(frame) as start, max(frame) as stop, round(avg(sqrt(dx * dx + dy * dy)), 6) as mean_speed from (
      select *, x - lag(x) over k as dx, y - lag(y) over k as dy
      from (select *, frame // 30 as w, min(frame) over (partition by clip) as lo, max(frame) over (partition by clip) as hi from pose where bodypart = 'stripe1')
      where w * 30 >= lo and w * 30 + 29 <= hi window k as (partition by clip, w, individual order by frame)) group by clip, w""",
    "per_trial_fractions": f"select clip, {', '.join(FRACTION.format(k + '_event_id >= 0') + f' as {k}_event_id_fraction' for k in KINDS)} from feat group by clip",
    "event_counts_max": f"select clip, {', '.join(f'max({k}_event_id) + 1 as n_{k}_event_id' for k in KINDS)} from feat group by clip",
    "event_booleans": f"select clip, frame, {', '.join(f'{k}_event_id >= 0 as {k}' for k in KINDS)} from feat",
    "rmse_per_bodypart": "select bodypart, count(x) as n, round(avg(x - 360), 6) as mean_rmse from pose group by bodypart",
    "avg_heading": "select user_id::varchar as clip, round(degrees(atan2(sum(sin(radians(value * 7 % 360))), sum(cos(radians(value * 7 % 360))))), 6) as avg_heading from events group by user_id",
    "standard_scale": "select clip, frame, individual, round((cx - avg(cx) over ()) / stddev_pop(cx) over (), 6) as centroid_x, round((cy - avg(cy) over ()) / stddev_pop(cy) over (), 6) as centroid_y from cent where cx is not null and cy is not null",
    "nearest_kinematics": """select * from (with n as materialized (select clip, frame, individual, (cx - avg(cx) over ()) / stddev_pop(cx) over () as a, (cy - avg(cy) over ()) / stddev_pop(cy) over () as b, (sp - avg(sp) over ()) / stddev_pop(sp) over () as c, (ds - avg(ds) over ()) / stddev_pop(ds) over () as d
      from (select clip, frame, individual, cx, cy, sqrt(dx * dx + dy * dy) as sp, sqrt((cx - 360) * (cx - 360) + (cy - 450) * (cy - 450)) as ds from d2 where dx is not null))
      select clip, frame, individual, rank::int as rank, round(distance, 6) as distance from (
        select *, row_number() over (partition by clip, frame, individual order by distance) as rank from (
          select p.clip, p.frame, p.individual, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) + (p.d - q.d) * (p.d - q.d)) as distance
          from n p join n q on (p.clip, p.frame, p.individual) <> (q.clip, q.frame, q.individual))) where rank <= 10)""",
    "key_parse": """select key, stem, split_part(stem, '_', 1) || '_' || split_part(stem, '_', 2) as trial, split_part(split_part(stem, '_', 3), '-', 1)::bigint as first, split_part(split_part(stem, '_', 3), '-', 2)::bigint as last,
      regexp_full_match(stem, '(CTRL|BHVE)_group\\d_\\d{6}-\\d{6}') as is_clip, not contains(key, 'BHVE_group8') as kept from (select key, replace(ltrim(key, '/'), '.mp4', '') as stem from (
      select '/' || case when event_id % 2 = 0 then 'BHVE' else 'CTRL' end || '_group' || (user_id % 10) || '_' || lpad(event_id::varchar, 6, '0') || '-' || lpad((event_id + 1799)::varchar, 6, '0') || case when event_id % 3 = 0 then '.mp4' else '' end as key from events))""",
    "roi_shift": "select clip, frame, individual, bodypart, round(x - 360, 6) as x, round(y - 450, 6) as y from pose where x is not null",
    "clip_split": """select 'signal' as clip, event_id // 180 as window, min(event_id) as start, max(event_id) as stop, count(*) as n from events
      where (event_id // 180) * 180 + 179 <= (select max(event_id) from events) group by event_id // 180""",
    "refined_group_segments": "select * from rseg",
    "refined_exclusion": """select clip, n_original, coalesce(n_kept, 0)::bigint as n_kept, round((n_original - coalesce(n_kept, 0))::double / nullif(n_original, 0), 6) as excluded_proportion
      from (select clip, count(*) filter (where nfish_frame > 0) as n_original from nfish group by clip) left join (select clip, sum(n) as n_kept from rseg group by clip) using (clip)""",
    "refined_collation": """select p.clip, segment_id, frame, individual, bodypart, round(x - 360, 6) as x, round(y - 450, 6) as y
      from rpose p join rseg s on p.clip = s.clip and frame between start and stop where x is not null""",
    "clip_features_of_trial": f"""select clip, round(count(*) filter (where quivering) / 378000, 9) as quivering_fraction,
      {", ".join(f"round(count(*) filter (where {k}_event_id >= 0) / 378000, 9) as {k}_event_fraction" for k in KINDS)} from feat group by clip""",
    "clip_split_reference": """select 'signal' as clip, event_id // 1800 as window, min(event_id) as start, max(event_id) as stop, count(*) as n from events
      where (event_id // 1800) * 1800 + 1799 < (select max(event_id) from events) group by event_id // 1800""",
    "centroid_speed_by_differences": "select clip, frame, individual, round(sqrt(ax * ax + ay * ay), 6) as speed from d2",
    "store_pose_key": "select clip, frame, individual, bodypart, round(x, 6) as x, round(y, 6) as y from pose where x is not null and clip = 'clip1'",
    "store_keys": "select distinct clip from pose",
    "pose_csv": "select clip, individual, bodypart, count(*) as n, count(x) as n_x, round(sum(x), 4) as sum_x, round(sum(y), 4) as sum_y from pose group by all",
    "wide_pose": "select clip, frame, individual, bodypart, round(x, 6) as x, round(y, 6) as y from pose where x is not null",
    "collated_pose": """select case when frame % 250 < 125 then clip else 'b' || clip end as clip, frame, count(x) as n from pose
      where frame % 50 < 20 or frame % 50 >= 40 group by pose.clip, frame having count(x) > 0 or count(y) > 0""",
    "tracker_csv": "select clip, frame, individual, bodypart, round(x, 6) as x, round(y, 6) as y from pose where x is not null",
    "kp_error_headed": "select bodypart, count(x) as n, round(avg(x - 360), 6) as mean_rmse from pose group by bodypart",
    "collated_sheet": """select p.clip, segment_id, frame, individual, bodypart, round(x - 360, 6) as x, round(y - 450, 6) as y
      from rpose p join rseg s on p.clip = s.clip and frame between start and stop where x is not null""",
    "event_density": """select clip, feature, point, round(place, 6) as at, round(density, 6) as density from (
      select g.clip, g.feature, point, any_value(place) as place, sum(exp(-(place - frame) * (place - frame) / (2 * h * h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) as density from (
        select *, lo - 3 * h + point * (hi - lo + 6 * h) / 199 as place from (
          select clip, feature, n, lo, hi, s * pow(n, -0.2::double) as h from (select clip, feature, count(*) as n, stddev_samp(frame) as s, min(frame) as lo, max(frame) as hi from dens group by all) where s > 0), (select unnest(range(200))::int as point)) g
      join dens f on f.clip = g.clip and f.feature = g.feature group by g.clip, g.feature, point)""",
    "roi_csv": "select distinct clip, 360.0::double as roi_x, 450.0::double as roi_y, 60.0::double as roi_r, 720 as frame_w, 900 as frame_h from pose",
    "annotation_csv": "select trial, count(*) as n, count(temporal_segment_start) as n_start, count(temporal_segment_end) as n_end, round(sum(temporal_segment_start), 3) as sum_start from annotated group by trial",
    "feature_csvs": "select clip, count(*) as n_frames, case when clip <> 'clip1' then max(nfish_frame) end as nfish_frame_max, round(avg(nfish_frame), 6) as share from nfish group by clip",
    "headerless_csv": "select clip, individual, start, stop from track",
    "empty_event_csv": "select unnest(['clip', 'event_id', 'start', 'stop']) as name, 0::bigint as n_rows",
    "kp_error_csv": "select bodypart, count(x) as n, round(avg(x - 360), 6) as mean_rmse from pose group by bodypart",
    "discovered_files": "select 'clip=' || clip as folder, clip = min(clip) over () as first from (select distinct clip from pose)",
    "hit_session_windows": """select user_id, min(t) as start, max(t) + interval 5 minutes as stop, count(*) as n from (
      select *, sum(opens) over (partition by user_id order by t rows unbounded preceding) as run from (
        select user_id, ts as t, case when ts <= lag(ts) over (partition by user_id order by ts) + interval 5 minutes then 0 else 1 end as opens from events where value < 25))
      group by user_id, run""",
    "rounded_frames": f"select event_id, round_even(event_id / 60 * 30, 0)::bigint as frame, round(event_id / 30, 6) as seconds, {CLOCK.format('event_id // 30')} as clock from events",
}


PELT = """
with recursive hit as (
  select user_id::varchar as clip, list(case when value < 25 then 1 else 0 end order by event_id) as x, list(event_id order by event_id) as frames from events group by user_id
), sums as (
  select clip, frames, len(x) as n, [0::bigint] || [list_sum(x[1:i])::bigint for i in range(1, len(x) + 1)] as p from hit
), dp(clip, n, p, t, f, b) as (
  select clip, n, p, 0::bigint, [0::bigint], []::bigint[] from sums
  union all
  select clip, n, p, t + 1, f || [coalesce(list_min(c), 1000000000000000)], b || [list_max([s for s in range(0, t) if c[s + 1] = list_min(c)])] from (
    select *, [f[s + 1] + (p[t + 2] - p[s + 1]) * (t + 1 - s - p[t + 2] + p[s + 1]) * 1048576 // (t + 1 - s) + 3145728 for s in range(0, t)] as c from dp where t < n)
), whole as (
  select * from dp where t = n
), seg(clip, s, e) as (
  select clip, coalesce(b[n], 0), n from whole
  union all
  select clip, b[s], s from seg join whole using (clip) where s > 0
), event as (
  select clip, s, e, row_number() over (partition by clip order by s) - 1 as event_id from seg join whole using (clip) where 2 * (p[e + 1] - p[s + 1]) > e - s
)
select q.clip, frame, coalesce(event_id, -1) as event_id from (select clip, unnest(frames) as frame, unnest(range(1, n + 1)) as i from sums) q left join event v on v.clip = q.clip and i > s and i <= e
"""


def _areas(name: str, cells: str) -> str:
    """A recursive CTE: the least cell of the 4-connected area of each of ``cells`` (clip, cx, cy), spread from cell to cell."""
    return f"""
{name}(clip, cx, cy, l) using key (clip, cx, cy) as (
  select clip, cx, cy, cy * 144 + cx from {cells}
  union
  select c.clip, c.cx, c.cy, min(p.l) from {name} p, (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(dx, dy), recurring.{name} c
  where c.clip = p.clip and c.cx = p.cx + dx and c.cy = p.cy + dy and p.l < c.l group by c.clip, c.cx, c.cy)"""


RING = "4 * (x * x + y * y) > (2 * r - 1) * (2 * r - 1) and 4 * (x * x + y * y) < (2 * r + 1) * (2 * r + 1)"
REGION = f"""{BASE.replace("with pose", "with recursive pose", 1)},
roccu as (
  select clip, floor(x / 5)::int as cx, floor(y / 5)::int as cy from pose where x >= 0 and x < 720 and y >= 0 and y < 900 group by all having count(*) >= 4),
rfree as (select clip, a.cx::int as cx, b.cy::int as cy from (select distinct clip from roccu), range(144) a(cx), range(180) b(cy) where (clip, a.cx, b.cy) not in (select (clip, cx, cy) from roccu)),
{_areas("rback", "rfree")},
rfill as (select * from roccu union all select clip, cx, cy from (select *, count(*) over (partition by clip, l) as n from rback) where n < 60),
{_areas("rfore", "rfill")},
rmask as (select clip, cx, cy from (select *, count(*) over (partition by clip, l) as n from rfore) where n >= 20),
kern as (select u - 3 as u, [1, 4, 6, 4, 1][u] as s, [-1, -2, 0, 2, 1][u] as d from range(1, 6) t(u)),
rslope as (
  select *, gx * gx + gy * gy as m from (
    select clip, (c.cx - a.u)::int as cx, (c.cy - b.u)::int as cy, sum(a.d * b.s)::bigint as gx, sum(a.s * b.d)::bigint as gy from rmask c, kern a, kern b group by all)
  where cx between 0 and 143 and cy between 0 and 179 and gx * gx + gy * gy > 0),
rturn as (
  select *, case when 5 * abs(gx) <= 2 * abs(gy) then 0 else 1 end as dx,
    case when 5 * abs(gy) <= 2 * abs(gx) then 0 when 5 * abs(gx) <= 2 * abs(gy) then 1 when sign(gx) = sign(gy) then 1 else -1 end as dy from rslope where m >= 4.8 * 4.8),
rthin as (
  select t.*, t.m >= 9.6 * 9.6 as strong from rturn t left join rslope p on p.clip = t.clip and p.cx = t.cx - dx and p.cy = t.cy - dy
  left join rslope q on q.clip = t.clip and q.cx = t.cx + dx and q.cy = t.cy + dy where t.m >= coalesce(p.m, 0) and t.m > coalesce(q.m, 0)),
rfirm(clip, cx, cy) as (
  select clip, cx, cy from rthin where strong
  union
  select t.clip, t.cx, t.cy from rfirm f join rthin t on t.clip = f.clip and abs(t.cx - f.cx) <= 1 and abs(t.cy - f.cy) <= 1),
redge as (select clip, cx, cy, gx, gy from rthin semi join rfirm using (clip, cx, cy)),
ring as (select r, x, y, count(*) over (partition by r) as whole from range(6, 18) a(r), range(-18, 19) b(x), range(-18, 19) c(y) where {RING}),
rvote as (select clip, r::int as r, (cx + x)::int as cx, (cy + y)::int as cy, count(*) as votes, count(*) / any_value(whole) as score from redge, ring where cx + x between 0 and 143 and cy + y between 0 and 179 group by all),
rbest as (select * from (select *, row_number() over (partition by clip order by score desc, r, cy, cx) as k from rvote) where k = 1),
rhigh as (select * from (select *, max(score) over (partition by clip) as top from rvote) where score >= 0.5 * top),
rpeak as (
  select * from rhigh h where not exists (select 1 from rhigh o where o.clip = h.clip and abs(o.r - h.r) <= 1 and abs(o.cx - h.cx) <= 2 and abs(o.cy - h.cy) <= 2
    and (o.score > h.score or o.score = h.score and (o.r, o.cy, o.cx) < (h.r, h.cy, h.cx)))),
rheld as (
  select clip, frame, count(*) filter (where bodypart = 'stripe1' and sqrt((x - (cx + 0.5) * 5) * (x - (cx + 0.5) * 5) + (y - (cy + 0.5) * 5) * (y - (cy + 0.5) * 5)) <= r * 5) as nfish_pipe
  from pose join (select clip, r, cx::double as cx, cy::double as cy from rbest) using (clip) group by clip, frame)
"""

REGIONS = {
    "region_mask": "select * from rmask",
    "region_edges": "select * from redge",
    "region_votes": "select clip, r, cx, cy, votes, round(score, 9) as score from rvote",
    "region_peaks": "select * from (select clip, (row_number() over (partition by clip order by score desc, r, cy, cx))::int as rank, r, cx, cy, round(score, 9) as score from rpeak) where rank <= 3",
    "region_of_clip": "select clip, (cx + 0.5::double) * 5 as roi_x, (cy + 0.5::double) * 5 as roi_y, r::double * 5 as roi_r from rbest",
    "nfish_pipe_found_region": "select * from rheld",
    "occupancy_found_region": f"select clip, {OCCUPANCY} from rheld group by clip",
}
HUE = """
with colours as (
  select 'clip' || (vec_id // 250) as clip, (vec_id % 250)::int as cx, j::int as cy, floor(128 + 400 * embedding[3 * j + 1]::double) as r, floor(128 + 400 * embedding[3 * j + 2]::double) as g, floor(128 + 400 * embedding[3 * j + 3]::double) as b
  from embeddings, range(21) t(j)
), hues as (
  select clip, cx, cy, case when r >= g and r >= b then (g - b) / (greatest(r, g, b) - least(r, g, b)) when g >= b then 2 + (b - r) / (greatest(r, g, b) - least(r, g, b)) else 4 + (r - g) / (greatest(r, g, b) - least(r, g, b)) end / 6 as h
  from colours where greatest(r, g, b) > least(r, g, b)
)
select clip, cx, cy from hues where (case when h < 0 then h + 1 else h end) > 0.4 and (case when h < 0 then h + 1 else h end) < 0.5
"""


def all_oracles() -> dict[str, str]:
    return {name: BASE + sql for name, sql in QUERIES.items()} | {name: REGION + sql for name, sql in REGIONS.items()} | {"hue_mask": HUE, "pelt_events": PELT}
