"""Jobs over packets, tracks, segments and playlists, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import media_time, rescale, ticks_to_seconds
from ..operators import joins, segments, timeline, tracks
from ..operators.asof import MOST
from ..sources import media
from .views import with_views

DAY = media.DAY
_RESCALE = "cast(sign({x}) * ((2 * abs(cast({x} as hugeint)) * {a} + {b}) // (2 * {b})) as bigint)"


def _sql_rescale(x: str, num1, den1, num2, den2) -> str:
    return _RESCALE.format(x=x, a=f"({num1} * cast({den2} as hugeint))", b=f"({den1} * cast({num2} as hugeint))")


def load_media_tables(spark, d):
    kept = tracks.load_packets(media.packets(spark, d), kinds=["video", "audio"])
    return kept.groupBy("stream_id", "kind").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"))


LOAD = "select stream_id, kind, count(*) as packets, cast(sum(size) as bigint) as bytes from packets where kind in ('video', 'audio') group by all"


def select_tracks(spark, d):
    return tracks.select_tracks(media.packets(spark, d), media.streams(spark, d)).select("stream_id", "track_id", "seq", "pts")


SELECT = "select stream_id, track_id, seq, pts from packets where kind in ('video', 'audio')"


def validate_packets(spark, d):
    good, bad = tracks.validate_packets(media.packets_dirty(spark, d), known_kinds=("video", "audio"))
    both = good.withColumn("error_code", F.lit("ok")).unionByName(bad)
    return both.groupBy("stream_id", "error_code").agg(F.count("*").alias("n"))


VALIDATE = """select stream_id, case when tb_num <= 0 or tb_den <= 0 then 'invalid_time_base' when pts is null then 'missing_pts' when kind not in ('video', 'audio') then 'unsupported_kind'
    when pts < 0 then 'negative_pts' when cast(pts as hugeint) * tb_num * 1000000000 > cast(9223372036854775807 as hugeint) * tb_den then 'timestamp_overflow' else 'ok' end as error_code, count(*) as n from packets_dirty group by all"""


def rescale_pts(spark, d):
    p = media.packets(spark, d)
    pts = F.col("pts") - 1_000_000_000_000
    return p.select("seq", rescale(pts, 1, 1_000_000, 1, 90_000).alias("pts_90k"), rescale(pts, 1, 1_000_000, 1001, 30_000).alias("pts_ntsc"), rescale(pts, 1, 1_000_000, 1, 48_000).alias("pts_48k"))


RESCALE = f"""select seq, {_sql_rescale('(pts - 1000000000000)', 1, 1000000, 1, 90000)} as pts_90k, {_sql_rescale('(pts - 1000000000000)', 1, 1000000, 1001, 30000)} as pts_ntsc,
    {_sql_rescale('(pts - 1000000000000)', 1, 1000000, 1, 48000)} as pts_48k from packets"""


def _outputs(spark, d):
    wanted = media.streams(spark, d).where("kind in ('video', 'audio')")
    return wanted.select("stream_id", "track_id", F.col("track_id").alias("out_track"), F.lit(1).alias("out_num"), F.when(F.col("kind") == "video", 90_000).otherwise(48_000).alias("out_den"))


def rescale_packets(spark, d):
    return tracks.rescale_packets(media.packets(spark, d), _outputs(spark, d)).select("stream_id", "out_track", "seq", "pts", "dts", "duration", "tb_den")


_DEN = "(case when kind = 'video' then 90000 else 48000 end)"
RESCALE_PACKETS = f"""select stream_id, track_id as out_track, seq, {_sql_rescale('pts', 1, 1000000, 1, _DEN)} as pts, {_sql_rescale('dts', 1, 1000000, 1, _DEN)} as dts,
    {_sql_rescale('duration', 1, 1000000, 1, _DEN)} as duration, {_DEN} as tb_den from packets where kind in ('video', 'audio')"""


def seconds(spark, d):
    p = media.packets_dirty(spark, d).where("tb_den > 0 and pts is not null")
    return p.select("seq", F.round(ticks_to_seconds(F.col("pts"), F.col("tb_num"), F.col("tb_den")), 6).alias("seconds"))


SECONDS = "select seq, round(greatest(0.0, cast(pts as double) * tb_num / tb_den), 6) as seconds from packets_dirty where tb_den > 0 and pts is not null"


def rational(spark, d):
    p = media.packets_dirty(spark, d).withColumn("m", media_time(F.col("pts"), F.lit(1001), F.when(F.col("tb_den") > 0, 30_000).otherwise(0)))
    return p.select("seq", F.col("m.numer").cast("string").alias("numer"), F.col("m.denom").alias("denom"), F.col("m.error").alias("error"))


RATIONAL = """select seq, case when error is null then cast(cast(pts as hugeint) * 1001 as varchar) end as numer, case when error is null then cast(30000 as bigint) end as denom, error from (
    select seq, pts, case when pts is null then 'missing_pts' when pts < 0 then 'negative_pts' when tb_den <= 0 then 'invalid_time_base' when cast(pts as hugeint) * 1001 > 18446744073709551615 then 'timestamp_overflow' end as error from packets_dirty)"""


def durations(spark, d):
    p = media.packets(spark, d).withColumn("rate_num", (F.col("seq") % 61).cast("int")).withColumn("rate_den", F.lit(1))
    return tracks.fill_duration(p).select("seq", "duration")


DURATIONS = f"select seq, case when duration <> 0 then duration when seq % 61 > 0 then greatest(1, {_sql_rescale('1', 1, 'greatest(1, seq % 61)', 1, 1000000)}) else 0 end as duration from packets"


def interleaved(spark, d):
    return tracks.interleave(media.packets(spark, d), most=MOST).select("stream_id", "track_id", "seq", "file_seq")


INTERLEAVED = "select stream_id, track_id, seq, row_number() over (partition by stream_id order by dts, track_id, seq) as file_seq from packets"


def merged(spark, d):
    p = media.packets(spark, d)
    parts = [p.where(F.col("kind") == k) for k in tracks.KINDS]
    return tracks.merge_sources(*parts).groupBy("kind", (F.col("pts") / DAY).cast("int").alias("day")).agg(F.count("*").alias("n"), F.min("pts").alias("first"))


MERGED = "select kind, cast(pts // 86400000000 as integer) as day, count(*) as n, min(pts) as first from packets group by all"


def unlinked(spark, d):
    links = media.packets(spark, d).where("is_key and size % 5 = 0").select("stream_id", "track_id").distinct()
    return tracks.unlinked_streams(media.streams(spark, d), links)


UNLINKED = "select * from streams s where not exists (select 1 from packets p where p.stream_id = s.stream_id and p.track_id = s.track_id and is_key and size % 5 = 0)"


def probe(spark, d):
    return tracks.probe_streams(media.packets(spark, d))


PROBE = "select stream_id, track_id, kind, count(*) as packets, min(pts) as first_pts, max(pts) as last_pts from packets group by all"


def counted(spark, d):
    kinds = F.when(F.col("event_type") == "view", "Video").when(F.col("event_type") == "purchase", "Audio").when(F.col("event_type") == "signup", "Eos").otherwise("Packet")
    return tracks.count_buffers(media.events(spark, d).select(F.col("user_id").alias("stream_id"), kinds.alias("kind")))


COUNTED = "select user_id as stream_id, count(*) filter (where event_type in ('click', 'error')) as packets, count(*) filter (where event_type in ('view', 'purchase')) as frames from ev group by user_id"


def finalized(spark, d):
    files = media.events(spark, d).select(F.col("user_id").alias("file_id")).distinct()
    expected = files.withColumn("track_id", F.explode(F.array(*map(F.lit, range(3)))))
    return tracks.finalize_tracks(media.track_events(spark, d), expected)


FINALIZED = """with files as (select distinct user_id as file_id from ev), done as (select file_id, track_id, min(at) as done_at from track_events group by all)
    select f.file_id, cast(3 as bigint) as expected, count(done_at) as finished, count(done_at) = 3 as is_final, case when count(done_at) = 3 then max(done_at) end as finalized_at from files f left join done d on f.file_id = d.file_id group by f.file_id"""


def codecs(spark, d):
    e = media.events(spark, d).select("event_id", F.col("user_id").alias("connection"), F.col("event_type").alias("codec"))
    return tracks.negotiated(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


CODECS = "select user_id as connection, event_type as codec from ev where event_id % 2 = 0 intersect select user_id, event_type from ev where event_id % 2 = 1"


def outbound(spark, d):
    """Views are packets, sign-ups choose a codec, also ones that weren't negotiated."""
    e = media.events(spark, d).select(F.col("user_id").alias("connection"), F.col("event_id").alias("at"), "event_type")
    names = F.array(*map(F.lit, ("view", "click", "purchase", "signup", "error")))
    choices = e.where("event_type = 'signup'").select("connection", "at", F.element_at(names, (F.col("at") % 5 + 1).cast("int")).alias("codec"))
    sent, allowed = e.where("event_type = 'view'").select("connection", "at"), codecs(spark, d)
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), "connection", "at", F.coalesce("codec", F.lit("")).alias("codec"), F.coalesce("error", F.lit("")).alias("error"))
    return rows(tracks.checked_choices(choices, allowed), "choice").unionByName(rows(tracks.outbound_codecs(sent, choices, allowed, MOST), "packet"))


OUTBOUND = f"""with allowed as ({CODECS}), ch as (select user_id as connection, event_id as at, ['view', 'click', 'purchase', 'signup', 'error'][event_id % 5 + 1] as codec from ev where event_type = 'signup'),
    checked as (select *, (connection, codec) in (select (connection, codec) from allowed) as is_ok from ch), ok as (select * from checked where is_ok)
    select 'choice' as kind, connection, at, codec, case when is_ok then '' else 'codec_not_negotiated' end as error from checked
    union all select 'packet', p.user_id, p.event_id, coalesce(ok.codec, ''), case when ok.codec is null then 'codec_not_declared' else '' end from (select * from ev where event_type = 'view') p asof left join ok on p.user_id = ok.connection and p.event_id >= ok.at"""


def _segmented(spark, d):
    wanted = media.streams(spark, d).where("kind in ('video', 'audio')")
    return segments.segment(media.packets(spark, d), DAY, most=MOST, tracks=wanted)


def cut_table(spark, d):
    return segments.keyframe_cuts(media.packets(spark, d), DAY, most=MOST)


CUTS = "select stream_id, segment, at from cuts"


def summary(spark, d):
    return segments.segment_summary(_segmented(spark, d))


SUMMARY = "select * from segment_rows"


def window(spark, d):
    return segments.live_window(segments.segment_summary(_segmented(spark, d)), 3).select("stream_id", "segment", "media_sequence", "bytes")


WINDOW = """select stream_id, segment, min(segment) over (partition by stream_id) as media_sequence, bytes from (
    select *, row_number() over (partition by stream_id order by segment desc) - 1 as k from segment_rows) where k between 1 and 3"""


def expired(spark, d):
    rows = segments.segment_summary(_segmented(spark, d))
    return segments.expired_segments(rows, segments.live_window(rows, 3))


EXPIRED = "select stream_id, segment from (select *, row_number() over (partition by stream_id order by segment desc) - 1 as k from segment_rows) where k not between 1 and 3"


def names(spark, d):
    rows = cut_table(spark, d).select("stream_id", "segment")
    patterns = ["segment_%d.ts", "segment_%05d.ts"]
    bad = F.when(F.col("segment") % 2 == 0, F.lit("segment_%%05d.ts")).otherwise(F.concat(F.lit("seg_%04d_"), F.col("stream_id").cast("string")))
    return rows.select("stream_id", "segment", *[segments.segment_name(p, F.col("segment")).alias(f"name_{i}") for i, p in enumerate(patterns)], segments.has_integer_conversion(bad).alias("is_valid"))


NAMES = "select stream_id, segment, 'segment_' || segment || '.ts' as name_0, 'segment_' || lpad(cast(segment as varchar), 5, '0') || '.ts' as name_1, segment % 2 <> 0 as is_valid from cuts"


def playlists(spark, d):
    rows = segments.live_window(segments.segment_summary(_segmented(spark, d)), None, complete_only=False)
    return segments.playlist_text(rows, base_url="v/", kind="VOD", init="init.mp4", final=True)


PLAYLISTS = """select stream_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || cast(greatest(1, ceil(max(duration) / 1000000)) as bigint) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || min(segment)
    || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || '#EXT-X-MAP:URI="v/init.mp4"' || chr(10)
    || string_agg('#EXTINF:' || printf('%.6f', duration / 1000000) || ',' || chr(10) || 'v/segment_' || lpad(cast(segment as varchar), 5, '0') || '.ts', chr(10) order by segment) || chr(10) || '#EXT-X-ENDLIST' as playlist from segment_rows group by stream_id"""


def seeks(spark, d):
    e = media.events(spark, d).where("event_type = 'purchase'")
    asks = e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("request_id"), (F.col("us") - 3_600_000_000).alias("target"))
    return joins.seek_keyframe(asks, media.packets(spark, d), most=MOST)


SEEKS = """with asks as (select user_id as stream_id, event_id as request_id, us - 3600000000 as target from ev where event_type = 'purchase'), keys as (select stream_id, pts as at from packets where is_key)
    select a.stream_id, request_id, target as requested, coalesce(k.at, (select min(at) from keys f where f.stream_id = a.stream_id), target) as landed from asks a asof left join keys k on a.stream_id = k.stream_id and a.target >= k.at"""


def paced(spark, d):
    p = media.packets(spark, d).where("kind = 'video'")
    first = p.groupBy("stream_id").agg((F.min("pts") * 1000 + 5_000_000).alias("start_ns"))
    rows = p.join(first, "stream_id").withColumn("arrival_ns", F.col("pts") * 1000 + F.col("size") * 1000)
    return timeline.pace_schedule(rows).select("stream_id", "seq", "due_ns", "late_ns", "error")


PACED = """select stream_id, seq, pts * 1000 + 5000000 as due_ns, size * 1000 - 5000000 as late_ns, cast(null as varchar) as error from packets where kind = 'video'"""


def _spliced_input(spark, d):
    e = media.events(spark, d)
    reset = F.sum(F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 1_000_000).cast("bigint")).otherwise(0))
    total = reset.over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 17 != 0, F.col("us") - total).alias("pts"), F.when(F.col("event_id") % 17 != 0, F.col("us") - total).alias("dts"), (F.col("event_type") == "purchase").alias("seek"))


def spliced(spark, d):
    return timeline.splice_timeline(_spliced_input(spark, d), MOST).where("out_pts is not null").select("stream_id", "seq", "out_pts", "out_dts")


SPLICED = """with raw as (select user_id as stream_id, event_id as seq, case when event_id % 17 <> 0 then us - sum(case when event_type = 'purchase' then cast(round(value * 1000000) as bigint) else 0 end) over w end as pts,
    sum(cast(event_type = 'purchase' as integer)) over w as seeks from ev window w as (partition by user_id order by event_id rows between unbounded preceding and current row)),
    timed as (select *, lag(pts) over w as before, seeks > coalesce(lag(seeks) over w, 0) as is_new from raw where pts is not null window w as (partition by stream_id order by seq)),
    shifted as (select *, cast(sum(case when is_new and before is not null then before + 1 - pts else 0 end) over (partition by stream_id order by seq rows between unbounded preceding and current row) as bigint) as offs from timed)
    select r.stream_id, r.seq, cast(r.pts + offs as bigint) as out_pts, cast(r.pts + offs as bigint) as out_dts from raw r join shifted s on r.stream_id = s.stream_id and r.seq = s.seq"""


def zeroed(spark, d):
    p = media.packets(spark, d).withColumn("pts", F.col("pts") - 500_000_000_000 * (F.col("stream_id") % 2))
    return timeline.zero_base(p).select("stream_id", "track_id", "seq", "pts")


ZEROED = """select stream_id, track_id, seq, pts - k + greatest(0, -(first_value(pts - k) over (partition by stream_id, track_id order by seq))) as pts from (select *, 500000000000 * (stream_id % 2) as k from packets)"""


def cadenced(spark, d):
    """Views are ticks; every purchase ends a pause of up to four days."""
    e = media.events(spark, d)
    ticks = e.where("event_type = 'view'")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("us")).cast("bigint")
    pauses = e.where("event_type = 'purchase'").select(F.col("user_id").alias("source"), F.col("us").alias("now"), (F.col("event_id") % 5 * DAY).alias("paused_for"))
    return timeline.cadence(ticks.select(F.col("user_id").alias("source"), n.alias("n"), F.col("us").alias("now")), DAY // 2, pauses, MOST)


CADENCED = """with t as (select user_id as source, us as now, event_type = 'view' as is_tick, event_id % 5 * 86400000000 as paused, row_number() over (partition by user_id order by us) as k,
      count(*) filter (where event_type = 'view') over (partition by user_id order by us) as n from ev where event_type in ('view', 'purchase')),
    walk as (select source, k, n, now, is_tick, case when is_tick then now end as due, case when is_tick then now + 43200000000 end as upcoming from t where k = 1
      union all select t.source, t.k, t.n, t.now, t.is_tick, case when t.is_tick then coalesce(w.upcoming, t.now) end,
        case when t.is_tick then case when coalesce(w.upcoming, t.now) + 43200000000 < t.now then t.now + 43200000000 else coalesce(w.upcoming, t.now) + 43200000000 end
        when w.upcoming + t.paused < t.now then t.now + 43200000000 else w.upcoming + t.paused end
      from walk w join t on t.source = w.source and t.k = w.k + 1)
    select source, n, now, due, case when due + 43200000000 < now then (now - due) // 43200000000 else 0 end as missed from walk where is_tick"""


def steadied(spark, d):
    e = media.events(spark, d).where("event_type = 'click'")
    rows = joins.steady_rate(e.select(F.col("user_id").alias("source"), F.col("us").alias("at"), F.col("event_id").alias("frame_id")), DAY // 4, MOST)
    return rows.groupBy("source").agg(F.count("*").alias("ticks"), F.count_if("is_repeat").alias("repeats"), F.max("run").cast("bigint").alias("longest"), F.sum("frame_id").alias("frames"))


STEADIED = """with f as (select user_id as source, us as at, event_id as frame_id from ev where event_type = 'click'), span as (select source, min(at) as lo, max(at) as hi from f group by source),
    ticks as (select source, unnest(range(lo, hi + 1, 21600000000)) as at from span), got as (select t.source, t.at, f.frame_id from ticks t asof join f on t.source = f.source and t.at >= f.at),
    rep as (select *, coalesce(frame_id = lag(frame_id) over (partition by source order by at), false) as is_repeat from got), runs as (select source, frame_id, count(*) - 1 as run from rep group by all)
    select r.source, count(*) as ticks, count(*) filter (where is_repeat) as repeats, (select max(run) from runs x where x.source = r.source) as longest, cast(sum(frame_id) as bigint) as frames from rep r group by r.source"""

QUERIES = {
    "load_media_tables": (load_media_tables, LOAD), "select_tracks": (select_tracks, SELECT), "validate_packets": (validate_packets, VALIDATE), "rescale_pts": (rescale_pts, RESCALE),
    "rescale_packets": (rescale_packets, RESCALE_PACKETS), "ticks_to_seconds": (seconds, SECONDS), "media_time_rational": (rational, RATIONAL), "fill_duration": (durations, DURATIONS),
    "interleave_tracks": (interleaved, INTERLEAVED), "merge_sources": (merged, MERGED), "unlinked_streams": (unlinked, UNLINKED), "probe_streams": (probe, PROBE), "count_buffers": (counted, COUNTED),
    "finalize_tracks": (finalized, FINALIZED), "negotiated_codecs": (codecs, CODECS), "outbound_codecs": (outbound, OUTBOUND), "keyframe_segments": (cut_table, CUTS), "segment_summary": (summary, SUMMARY), "live_window": (window, WINDOW),
    "expired_segments": (expired, EXPIRED), "segment_name": (names, NAMES), "playlist_text": (playlists, PLAYLISTS), "seek_keyframe": (seeks, SEEKS), "pace_schedule": (paced, PACED),
    "splice_timeline": (spliced, SPLICED), "zero_base_timeline": (zeroed, ZEROED), "cadence_resync": (cadenced, CADENCED), "steady_rate": (steadied, STEADIED),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
