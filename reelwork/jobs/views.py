"""The media tables as SQL text over the given tables, for checking the jobs with another engine."""

from __future__ import annotations

import re

VIEWS = {
    "ev": "select event_id, user_id, event_type, value, epoch_us(ts) - 1704067200000000 as us from events",
    "packets": """select user_id as stream_id, case when event_type in ('view', 'click') then 0 when event_type in ('purchase', 'signup') then 1 else 2 end as track_id,
        case when event_type in ('view', 'click') then 'video' when event_type in ('purchase', 'signup') then 'audio' else 'data' end as kind,
        event_id as seq, us as pts, us as dts, case when event_id % 3 = 0 then 0 else 33333 end as duration, 1 as tb_num, 1000000 as tb_den,
        event_type <> 'click' as is_key, cast(round(value * 100) as bigint) as size from ev""",
    "packets_dirty": """select * replace (case when seq % 17 <> 0 and seq % 23 = 0 then 0 else tb_den end as tb_den,
        case when seq % 17 = 0 then null when seq % 23 = 0 then pts when seq % 29 = 0 then -pts when seq % 31 = 0 then 9223372036854775807 else pts end as pts) from packets""",
    "streams": "select distinct stream_id, track_id, kind from packets",
    "audio_frames": """select label as input, vec_id, frame_idx, label % 2 as mix_id, list_transform(embedding, lambda x: cast(x as double) * 4) as samples, frame_idx * 64 as pts
        from (select *, row_number() over (partition by label order by vec_id) - 1 as frame_idx from embeddings)""",
    "samples": "select input, mix_id, frame_idx, pts + i - 1 as at, samples[i] as v from (select *, unnest(range(1, 65)) as i from audio_frames)",
    "detections": """select l_orderkey as frame_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as det_id,
        l_suppkey % 2 as class_id, round(l_extendedprice / 110000, 6) as score, cast(l_quantity as double) as x, cast(l_partkey % 50 as double) as y,
        cast(20 + l_suppkey % 10 as double) as w, cast(20 + l_partkey % 10 as double) as h from lineitem""",
    "ious": """select a.frame_id, a.class_id, a.det_id as det_a, b.det_id as det_b, a.score as score_a, b.score as score_b,
        greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as inter, a.w * a.h + b.w * b.h as areas
        from detections a join detections b on a.frame_id = b.frame_id and a.class_id = b.class_id and a.det_id < b.det_id""",
    "pixels": """select * exclude (n) from (select p_partkey // 64 as frame_id, (p_partkey % 64) // 8 as "row", p_partkey % 8 as col, (37 * p_partkey) % 256 as r,
        (91 * p_partkey + 5 * p_size) % 256 as g, (53 * p_partkey) % 256 as b, 255 as a, count(*) over (partition by p_partkey // 64) as n from part) where n = 64""",
    "layers": """select s_nationkey as canvas_id, s_suppkey as layer_id, k % 64 - 16 as x, (7 * k) % 36 - 8 as y, 1 + (3 * k) % 40 as w, 1 + (5 * k) % 30 as h,
        16 * (1 + k % 5) as src_w, 9 * (1 + k % 4) as src_h, k % 4 as z_index, (k % 5) / 4 as opacity, k % 6 <> 0 as visible,
        case k % 3 when 0 then 'Stretch' when 1 then 'Contain' else 'Cover' end as fit, (37 * k) % 256 as r, (91 * k) % 256 as g, (53 * k) % 256 as b from (select *, s_suppkey as k from supplier)""",
    "geometry": """select *, case when error is null then x + cast(trunc((w - iw) / 2) as bigint) end as image_x, case when error is null then y + cast(trunc((h - ih) / 2) as bigint) end as image_y,
        case when error is null then iw end as image_w, case when error is null then ih end as image_h from (
        select *, case when w < 1 or w > 16384 or h < 1 or h > 16384 then 'invalid_rect' when opacity < 0 or opacity > 1 then 'invalid_opacity' when src_w <= 0 or src_h <= 0 then 'empty_source' when iw > 16384 or ih > 16384 then 'scaled_too_large' end as error from (
        select *, case when fit = 'Stretch' or by_width then w else greatest(1, (src_w * h + src_h // 2) // src_h) end as iw, case when fit = 'Stretch' then h when by_width then greatest(1, (src_h * w + src_w // 2) // src_w) else h end as ih
        from (select *, case when fit = 'Contain' then w * src_h <= h * src_w else w * src_h > h * src_w end as by_width from layers)))""",
    "covered": """select canvas_id, layer_id, z_index, opacity, r, g, b, x0, y0, x1, y1 from (select *, greatest(image_x, x, 0) as x0, greatest(image_y, y, 0) as y0,
        least(image_x + image_w, x + w, 64) as x1, least(image_y + image_h, y + h, 36) as y1 from geometry where error is null and visible and opacity > 0) where x0 < x1 and y0 < y1""",
    "clock_samples": """select user_id as stream_id, event_id as seq, us * 1000 as wall_ns, us * 1000 + (event_id % 7 - 3) * 10000000 as position_ns,
        us * 1000 + (event_id % 7 - 3) * 10000000 + 86400000000000 as submitted_ns, event_id % 4 <> 0 as running, event_id % 9 = 0 as priming, event_id % 9 <> 0 and event_id % 11 = 0 as ended from ev where event_type = 'purchase'""",
    "clock_frames": "select user_id as stream_id, event_id as seq, us * 1000 as wall_ns, us * 1000 + (event_id % 5 - 2) * 20000000 as pts_ns from ev where event_type in ('view', 'click')",
    "bus_events": """select event_id, case when event_id % 13 <> 0 then user_id % 30 end as element_id, case event_type when 'signup' then 'Eos' when 'error' then 'Error' when 'click' then 'Dropped' else 'Seeked' end as event, us as at,
        case when event_type = 'purchase' then cast(floor(value) as bigint) * 1000000000 end as requested_ns, case when event_type = 'purchase' then cast(floor(value / 10) as bigint) * 10000000000 end as landed_ns from ev where event_type <> 'view'""",
    "nodes": """select 'r' || r_regionkey as id, 'Source' as element_type, r_name as name from region union all select 'n' || n_nationkey, 'Filter', n_name from nation union all select 's' || s_suppkey, 'Sink', s_name from supplier""",
    "edges": """select 'r' || n_regionkey as from_id, 'n' || n_nationkey as to_id from nation union all select 'r' || ((n_regionkey + 1) % 5), 'n' || n_nationkey from nation where n_nationkey % 7 = 0
        union all select 'n' || s_nationkey, 's' || s_suppkey from supplier""",
    "track_events": "select user_id as file_id, event_id % 3 as track_id, case event_type when 'signup' then 'Eos' else 'Stop' end as event, us as at, event_id from ev where event_type in ('signup', 'error')",
    "gauge_samples": "select o_custkey % 50 as label, row_number() over (partition by o_custkey % 50 order by o_orderdate, o_orderkey) as i, o_totalprice as value from orders",
    "keyed": "select *, row_number() over (partition by stream_id order by pts, seq) as n from packets where kind = 'video' and is_key",
    "first_pts": "select stream_id, min(pts) as first from packets group by stream_id",
    "cuts": """select stream_id, cast(0 as bigint) as segment, first as at from first_pts union all select stream_id, segment + 1, (select min(pts) from packets q where q.stream_id = c.stream_id and q.kind = 'video' and q.is_key and q.pts >= c.at + 86400000000)
        from cuts c where (select min(pts) from packets q where q.stream_id = c.stream_id and q.kind = 'video' and q.is_key and q.pts >= c.at + 86400000000) is not null""",
    "segmented": "select p.*, c.segment from packets p asof join cuts c on p.stream_id = c.stream_id and p.pts >= c.at where p.kind in ('video', 'audio')",
    "segment_rows": """select stream_id, segment, min(pts) as start_pts, max(pts + duration) as end_pts, max(pts + duration) - min(pts) as duration, count(*) filter (where kind = 'video') as video_packets,
        count(*) filter (where kind = 'audio') as audio_packets, cast(sum(size) as bigint) as bytes, arg_min(is_key and kind = 'video', (pts, seq)) as starts_with_key from segmented group by stream_id, segment""",
}


def with_views(body: str) -> str:
    """``body`` behind the views that it names, and those that they name."""
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:from|join|from \(select \*, unnest\(.*?\) as i from)\s+{name}\b", text):
                needed[name] = ""
                visit(view)
                del needed[name]
                needed[name] = view

    visit(body)
    return _quoted(_behind(body, needed))


def _quoted(text: str) -> str:
    """The column name at is a word of the SQL grammar."""
    return re.sub(r'(?<!")\bat\b(?!")', '"at"', text)


def _behind(body: str, needed: dict[str, str]) -> str:
    if not needed:
        return body
    return "with recursive " + ", ".join(f"{name} as ({view})" for name, view in needed.items()) + ("," + body.strip()[5:] if body.strip().lower().startswith("with ") else "\n" + body)
