"""Jobs over events, clocks, registrations, topology, logs and byte streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitstream, joins, ops, timeline
from ..operators.asof import MOST
from ..sources import media
from .views import with_views

DAY = media.DAY


def _branch_nodes(spark, d):
    return media.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("element_id"), F.col("n_regionkey").alias("branch_id"))


def _element_nodes(spark, d):
    return media.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("element_id"), F.lit("Filter").alias("element_type"), F.col("n_name").alias("name"))


def attributed(spark, d):
    out = ops.attribute_events(media.bus_events(spark, d), _element_nodes(spark, d), _branch_nodes(spark, d))
    return out.select("event_id", "event", "element_type", "name", "branch_id")


ATTRIBUTED = "select event_id, event, case when n_name is not null then 'Filter' end as element_type, n_name as name, n_regionkey as branch_id from bus_events left join nation on element_id = n_nationkey"


def summarised(spark, d):
    return ops.event_summary(media.bus_events(spark, d)).withColumn("element_id", F.coalesce("element_id", F.lit(-1)))


SUMMARISED = """select coalesce(element_id, -1) as element_id, count(*) filter (where event = 'Eos') as n_eos, count(*) filter (where event = 'Error') as n_error, count(*) filter (where event = 'Dropped') as n_dropped,
    count(*) filter (where event = 'Seeked') as n_seeked, min(case when event = 'Error' then at end) as first_error_at from bus_events group by 1"""


def paths(spark, d):
    return ops.topology_paths(*media.nodes_edges(spark, d))


PATHS = """with n as (select id, element_type || '(' || name || ')' as text from nodes), walk as (select id, [id] as seen, text from n where id not in (select to_id from edges)
    union all select e.to_id, list_append(w.seen, e.to_id), w.text || ' - ' || m.text from walk w join (select distinct from_id, to_id from edges) e on e.from_id = w.id join n m on m.id = e.to_id where not list_contains(w.seen, e.to_id))
    select 0 as pipeline_id, text as path from walk where id not in (select from_id from edges)"""


def _parsed(spark, d):
    return ops.parse_logs(media.log_lines(spark, d), MOST)


def logs(spark, d):
    cols = ["level", "thread", "pipeline_id", "element", "name", "event", "control", "phase", "outcome", "error", "body"]
    return _parsed(spark, d).select("file", "line_no", F.unix_millis("at").alias("at_ms"), *[F.coalesce(c, F.lit("")).alias(c) for c in cols])


LOGS = """select 'user' || user_id as file, event_id * 10 as line_no, us // 1000 + 1704067200000 as at_ms, case when event_type = 'error' then 'ERROR' else 'INFO' end as level, 'worker:' || (user_id % 4) as thread,
    case when event_id % 5 <> 0 then cast(user_id % 7 as varchar) else '' end as pipeline_id, 'Queue' as element, 'queue' || (user_id % 9) as name,
    case event_type when 'signup' then '' when 'view' then 'eos' when 'error' then 'eos' else 'control' end as event, case when event_type in ('click', 'purchase') then 'Pause' else '' end as control,
    case event_type when 'signup' then '' when 'view' then 'received' when 'click' then 'received' else 'completed' end as phase, case event_type when 'purchase' then 'ok' when 'error' then 'error' else '' end as outcome,
    case when event_type = 'error' then 'code' || event_id else '' end as error,
    case when event_type = 'signup' then 'AppSource(source)#' || event_id || chr(10) || '└── [out] → AppSink(sink)#' || event_id else '' end as body from ev"""


def lifecycles(spark, d):
    return ops.lifecycle(_parsed(spark, d)).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("completed", "took_ms")})


LIFECYCLES = """with p as (select 'user' || user_id as file, 'queue' || (user_id % 9) as name, us // 1000 + 1704067200000 as ms, case when event_type in ('click', 'purchase') then 'Pause' else 'eos' end as what,
      event_type in ('view', 'click') as is_received from ev where event_type <> 'signup'),
    g as (select file, name, what, min(ms) filter (where is_received) as received, min(ms) filter (where not is_received) as completed from p group by all)
    select file, name, what, received, coalesce(completed, -1) as completed, case when completed >= received then completed - received else -1 end as took_ms, completed is null as is_open from g where received is not null"""


def trend(spark, d):
    out = ops.trend_verdict(media.gauge_samples(spark, d), 3, 900.0)
    return out.withColumns({c: F.round(c, 4) for c in ("slope", "standard_error", "resolution")})


TREND = """with s as (select label, count(*) as n, regr_slope(value, i) as slope, regr_sxx(value, i) as sxx, regr_syy(value, i) as syy, regr_sxy(value, i) as sxy from gauge_samples where i > 3 group by label),
    e as (select *, sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) / sqrt(sxx) as se from s)
    select label, n, case when n >= 8 then round(slope, 4) end as slope, case when n >= 8 then round(se, 4) end as standard_error, case when n >= 8 then round(900 + 2 * se, 4) end as resolution,
      case when n < 8 then 'too_few' when 2 * se > 900 then 'too_noisy' when slope > 900 then 'growing' else 'flat' end as verdict from e"""


def active(spark, d):
    e = media.events(spark, d)
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("us").alias("start"), F.max("us").alias("end"))
    s = e.where("event_type = 'signup'").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    nxt = F.lead("us").over(Window.partitionBy("user_id").orderBy("n"))
    pauses = s.withColumn("end", nxt).where("n % 2 = 1").select(F.col("user_id").alias("run_id"), F.col("us").alias("start"), "end")
    return ops_active(runs, pauses)


def ops_active(runs, pauses):
    return timeline.active_time(runs, pauses).select("run_id", "paused", "active")


ACTIVE = """with runs as (select user_id as run_id, min(us) as lo, max(us) as hi from ev group by 1), s as (select user_id as run_id, us, row_number() over w as n, lead(us) over w as nxt from ev where event_type = 'signup' window w as (partition by user_id order by event_id))
    select r.run_id, cast(coalesce(sum(coalesce(nxt, hi) - us), 0) as bigint) as paused, cast(hi - lo - coalesce(sum(coalesce(nxt, hi) - us), 0) as bigint) as active from runs r left join (select * from s where n % 2 = 1) s on r.run_id = s.run_id group by r.run_id, lo, hi"""


def observed(spark, d):
    e = media.events(spark, d).where("event_type = 'purchase'")
    resets = e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"))
    return timeline.observed_duration(media.clock_frames(spark, d), resets, most=MOST).select("stream_id", "seq", "epoch", "duration_ns")


OBSERVED = """with mixed as (select stream_id, seq, pts_ns, 0 as r from clock_frames union all select user_id, event_id, null, 1 from ev where event_type = 'purchase'),
    f as (select * from (select *, sum(r) over (partition by stream_id order by seq rows between unbounded preceding and current row) as epoch from mixed) where r = 0),
    st as (select *, pts_ns - lag(pts_ns) over (partition by stream_id, epoch order by seq) as step from f)
    select stream_id, seq, cast(epoch as bigint) as epoch, coalesce(last_value(case when step > 0 then step end ignore nulls) over (partition by stream_id, epoch order by seq rows between unbounded preceding and current row), 40000000) as duration_ns from st"""

_PLAYED = """origins as (select stream_id, arg_min(pts_ns, (wall_ns, seq)) as o_pts, min(wall_ns) as o_wall from clock_frames group by 1), takes as (select stream_id, min(wall_ns) as t_wall from clock_samples group by 1),
    own as (select c.*, o_pts + t_wall - o_wall as handed, case when not priming then position_ns end as own, coalesce(lag(priming) over (partition by c.stream_id order by wall_ns, seq), true) and not priming and not ended as is_after
      from clock_samples c join takes t on c.stream_id = t.stream_id left join origins o on c.stream_id = o.stream_id and o_wall < t_wall),
    held as (select *, coalesce(last_value(own ignore nulls) over (partition by stream_id order by wall_ns, seq rows between unbounded preceding and 1 preceding), handed) as held from own),
    played as (select stream_id, wall_ns, case when is_after then greatest(position_ns, coalesce(held, position_ns)) else position_ns end as pos, greatest(submitted_ns, case when is_after then greatest(position_ns, coalesce(held, position_ns)) else position_ns end) as sub, running, priming, ended, held from held),
    asked as (select f.*, p.wall_ns as since, p.pos, p.sub, p.running, p.priming, p.ended, p.held from clock_frames f asof left join played p on f.stream_id = p.stream_id and f.wall_ns >= p.wall_ns),
    posed as (select a.*, case when since is null or (ended and not priming) then 'wall' when priming then 'priming' else 'audio' end as master,
      case when since is null then o_pts + wall_ns - o_wall when priming then held when ended then pos + wall_ns - since else least(pos + case when running then wall_ns - since else 0 end, sub) end as position from asked a join origins o on a.stream_id = o.stream_id)"""


def positions(spark, d):
    out = timeline.playback_position(media.clock_frames(spark, d), media.clock_samples(spark, d), MOST)
    return out.select("stream_id", "seq", "master", F.coalesce("position_ns", F.lit(-1)).alias("position_ns"))


POSITIONS = f"with {_PLAYED} select stream_id, seq, master, coalesce(position, -1) as position_ns from posed"


def synced(spark, d):
    out = timeline.sync_video(media.clock_frames(spark, d), media.clock_samples(spark, d), MOST)
    return out.select("stream_id", "seq", "decision", F.coalesce("wait_ns", F.lit(-1)).alias("wait_ns"))


SYNCED = f"""with {_PLAYED}, st as (select *, pts_ns - lag(pts_ns) over (partition by stream_id order by seq) as step from posed),
    du as (select *, coalesce(last_value(case when step > 0 then step end ignore nulls) over (partition by stream_id order by seq rows between unbounded preceding and current row), 40000000) as dur from st)
    select stream_id, seq, case when position is null or master = 'priming' then 'Hold' when pts_ns > position then 'Wait' when master = 'audio' and position - pts_ns > dur then 'Drop' else 'Render' end as decision,
      case when master <> 'priming' and pts_ns > position then pts_ns - position else -1 end as wait_ns from du"""


def newest(spark, d):
    e = media.events(spark, d)
    base = [(F.col("user_id") % 20).alias("input"), F.col("us").alias("at"), F.col("event_id").alias("seq")]
    frames = e.where("event_type = 'click'").select(*base, F.col("event_id").alias("frame_id"))
    marks = e.where("event_type in ('signup', 'error')").select(*base)
    ticks = e.where("event_type = 'view'").select((F.col("user_id") % 20).alias("input"), F.col("us").alias("at"), F.col("event_id").alias("tick_id"))
    return joins.latest_frame(ticks, frames, marks, most=MOST).select("input", "tick_id", F.coalesce("frame_id", F.lit(-1)).alias("frame_id"))


NEWEST = """with r as (select user_id % 20 as input, us as at, case when event_type = 'click' then event_id else -1 end as frame_id from ev where event_type in ('click', 'signup', 'error')), t as (select user_id % 20 as input, us as at, event_id as tick_id from ev where event_type = 'view')
    select t.input, tick_id, coalesce(frame_id, -1) as frame_id from t asof left join r on t.input = r.input and t.at >= r.at"""


def _registered(spark, d):
    e = media.events(spark, d)
    regs = e.where("event_type = 'signup'").select((F.col("user_id") % 40).alias("name"), F.col("event_id").alias("reg_id"), F.col("us").alias("valid_from"))
    mine = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = e.withColumn("reg_id", mine).where("event_type = 'view'").select((F.col("user_id") % 40).alias("name"), "reg_id", F.col("us").alias("at"), "event_id")
    return rows, regs


def current(spark, d):
    live, stale = joins.current_registration(*_registered(spark, d), MOST)
    return live.withColumn("state", F.lit("current")).unionByName(stale.withColumn("state", F.when(F.col("reg_id").isNull(), "unregistered").otherwise("stale"))).select("name", "event_id", "state")


CURRENT = """with regs as (select user_id % 40 as name, event_id as reg_id, us as valid_from, lead(us) over (partition by user_id % 40 order by us, event_id) as valid_to from ev where event_type = 'signup'),
    own as (select *, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as reg_id from ev)
    select o.user_id % 40 as name, o.event_id, case when o.reg_id is null then 'unregistered' when o.us >= r.valid_from and (r.valid_to is null or o.us < r.valid_to) then 'current' else 'stale' end as state from own o left join regs r on o.reg_id = r.reg_id where event_type = 'view'"""


def fanned(spark, d):
    e = media.events(spark, d)
    nxt = F.min(F.when(F.col("event_type") == "error", F.col("us"))).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing))
    branches = e.withColumn("end", nxt).where("event_type = 'signup'").select((F.col("user_id") % 10).alias("tee_id"), F.col("event_id").alias("branch_id"), F.col("us").alias("attached_at"), F.col("end").alias("detached_at"), F.pmod(-F.col("event_id"), F.lit(19)).alias("fails"))
    buffers = e.where("event_type = 'click'").select((F.col("user_id") % 10).alias("tee_id"), F.col("us").alias("at"), F.col("event_id").alias("buffer_id"), F.pmod("event_id", F.lit(19)).alias("fails"))
    # A copy fails where 19 divides buffer_id + branch_id.
    return joins.branch_totals(buffers, branches, "buffer_id", MOST).withColumnRenamed("total", "buffers")


FANNED = """with b as (select user_id % 10 as tee_id, event_id as branch_id, us as attached_at, e as detached_at from (select *, min(case when event_type = 'error' then us end) over (partition by user_id order by event_id rows between 1 following and unbounded following) as e from ev) where event_type = 'signup'),
    f as (select user_id % 10 as tee_id, us as at, event_id as buffer_id from ev where event_type = 'click')
    select b.tee_id, branch_id, count(*) as n, cast(sum(buffer_id) as bigint) as buffers from f join b on f.tee_id = b.tee_id and at >= attached_at and (detached_at is null or at < detached_at) where (buffer_id + branch_id) % 19 <> 0 group by all"""


def inventory(spark, d):
    return bitstream.nal_inventory(bitstream.nal_units(media.nal_payloads(spark, d)))


_WELL_FORMED = "event_type = 'signup' and event_id % 3 = 0"
_BYTES = " ".join(f"when {i} then {len(x) // 2}" for i, (x, _) in enumerate(media.SPS))
_WIDTHS = " ".join(f"when {i} then {width}" for i, (_, width) in enumerate(media.SPS))
INVENTORY = f"""select user_id as stream_id, case event_type when 'signup' then 7 when 'purchase' then 8 when 'view' then 5 when 'click' then 1 else 6 end as nal_type, count(*) as units,
    cast(sum(case when {_WELL_FORMED} then case event_id % {len(media.SPS)} {_BYTES} end else 1 + length(cast(event_id as varchar)) end) as bigint) as bytes from ev group by all"""


def probe_rows(ready):
    return ready.select("stream_id", F.col("run").cast("bigint").alias("run"), "codec", "ready_seq", F.col("sps").isNotNull().alias("has_sps"), F.coalesce("width", F.lit(-1)).alias("width"))


def probed(spark, d):
    return probe_rows(bitstream.probe_codec(media.nal_payloads(spark, d), MOST))


#: {keep}: which payloads there are.
PROBED_OF = f"""with u as (select user_id as stream_id, event_id, event_type, us, (row_number() over (partition by user_id order by event_id) - 1) // 4 as seq from ev),
    g as (select stream_id, seq, max(us) as at, max(case when event_type = 'signup' then event_id end) as a, max(case when event_type = 'purchase' then event_id end) as b from u group by all),
    h as (select *, case when (stream_id + case when stream_id % 5 = 1 then seq // 8 else 0 end) % 3 <> 0 then 'H264' else 'VP8' end as codec from g where {{keep}}),
    c as (select *, case when codec <> lag(codec) over (partition by stream_id order by seq) then 1 else 0 end as new from h),
    n as (select *, cast(sum(new) over (partition by stream_id order by seq) as bigint) as run from c),
    k as (select stream_id, run, codec, seq, max(a) over w as a, max(b) over w as b from n window w as (partition by stream_id, run order by seq rows between unbounded preceding and current row)),
    r as (select * from k where codec = 'VP8' or (a % 3 = 0 and b is not null) qualify row_number() over (partition by stream_id, run order by seq) = 1)
    select stream_id, run, codec, seq as ready_seq, codec = 'H264' as has_sps, case when codec = 'H264' then cast(case a % {len(media.SPS)} {_WIDTHS} end as integer) else -1 end as width from r"""
PROBED = PROBED_OF.format(keep="true")

QUERIES = {
    "attribute_events": (attributed, ATTRIBUTED), "event_summary": (summarised, SUMMARISED), "topology_paths": (paths, PATHS), "parse_logs": (logs, LOGS), "lifecycle_check": (lifecycles, LIFECYCLES), "trend_verdict": (trend, TREND),
    "active_time": (active, ACTIVE), "observed_frame_duration": (observed, OBSERVED), "playback_position": (positions, POSITIONS), "sync_video_to_audio": (synced, SYNCED), "latest_frame_asof": (newest, NEWEST),
    "current_registration": (current, CURRENT), "branch_fanout": (fanned, FANNED), "nal_inventory": (inventory, INVENTORY), "probe_codec_config": (probed, PROBED),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
