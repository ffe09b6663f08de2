"""Jobs over samples, pixels, layers and detections, with the SQL that checks each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import audio as af
from ..functions.buffers import map_buffers
from ..operators import audio, detect, layers, timeline
from ..operators.asof import MOST
from ..sources import media, synthetic
from .views import with_views


def _round_all(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _exploded(df, *keys):
    return df.select(*keys, F.posexplode("samples").alias("i", "v")).withColumn("v", F.round("v", 6))


def video(spark, d):
    frames = media.table(spark, d, "part").select(F.col("p_partkey").alias("frame_idx"))
    return synthetic.synthetic_video(frames, 8, 6)


VIDEO = "select frame_idx, cast(\"row\" as integer) as \"row\", cast(col as integer) as col, cast((col + \"row\" + frame_idx) % 256 as integer) as y, 128 as u, 128 as v, frame_idx as pts from (select p_partkey as frame_idx, unnest(range(0, 6)) as \"row\" from part), (select unnest(range(0, 8)) as col)"


def tone(spark, d):
    return _round_all(synthetic.synthetic_tone(media.table(spark, d, "orders").select(F.col("o_orderkey").alias("n")), channels=1), "v")


TONE = "select o_orderkey as n, 0 as channel, round(sin(2 * pi() * 440 / 48000 * o_orderkey), 6) as v, o_orderkey as pts from orders"


def gains(spark, d):
    e = media.events(spark, d)
    gain = F.when(F.col("event_id") % 19 == 0, -F.col("value")).otherwise(F.col("value"))
    muted = F.col("event_id") % 7 == 0
    return e.select("event_id", F.round(af.effective_gain(gain, muted), 6).alias("gain"), F.round(af.db_to_gain(-gain / 10), 6).alias("from_db"), F.round(F.when(gain > 0, af.gain_to_db(F.when(gain > 0, gain))), 6).alias("to_db"), af.gain_error(gain).alias("error"))


GAINS = """select event_id, round(case when g < 0 then null when event_id % 7 = 0 then 0.0 else g end, 6) as gain, round(power(10.0, -g / 10 / 20), 6) as from_db, round(case when g > 0 then 20 * log10(case when g > 0 then g else 1 end) end, 6) as to_db,
    case when g < 0 then 'invalid_gain' end as error from (select event_id, case when event_id % 19 = 0 then -value else value end as g from ev)"""


def gained(spark, d):
    f = media.audio_frames(spark, d)
    as_int = F.transform("samples", lambda v: F.round(v * 40_000))
    as_byte = F.transform("samples", lambda v: F.round(F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) * 127) + 128)
    out = f.select("vec_id", F.arrays_zip(af.apply_gain(as_int, F.lit(2.0), "i16").alias("a"), af.apply_gain(as_byte, F.lit(1.5), "u8").alias("b")).alias("z"))
    return out.select("vec_id", F.posexplode("z").alias("i", "z")).select("vec_id", "i", F.col("z.a").alias("i16"), F.col("z.b").alias("u8"))


GAINED = """select vec_id, cast(at - frame_idx * 64 as integer) as i, cast(least(greatest(round(round(v * 40000) * 2.0), -32768), 32767) as bigint) as i16,
    cast(least(greatest(round((round(least(greatest(v, -1.0), 1.0) * 127) + 128 - 128) * 1.5) + 128, 0), 255) as bigint) as u8 from samples s join (select vec_id, input as inp, frame_idx as fi from audio_frames) f on s.input = f.inp and s.frame_idx = f.fi"""


def planar(spark, d):
    f = media.audio_frames(spark, d).select("vec_id", "samples", af.to_planar(F.col("samples"), 2).alias("p"))
    back = af.to_packed(F.col("p"), 2)
    return f.select("vec_id", F.round(F.element_at(F.col("p")[0], 2), 6).alias("left_1"), F.round(F.element_at(F.col("p")[1], -1), 6).alias("right_31"), F.size(F.col("p")[0]).alias("n"), (back == F.col("samples")).alias("is_same"))


PLANAR = "select vec_id, round(samples[3], 6) as left_1, round(samples[64], 6) as right_31, 32 as n, true as is_same from audio_frames"


def mixed(spark, d):
    """Stereo; every seventh frame is missing in all inputs, and blocks don't end where frames do."""
    f = media.audio_frames(spark, d).where("frame_idx % 7 <> 3").withColumn("pts", F.col("frame_idx").cast("bigint") * 32)
    return audio.mix_audio(f, 12, 2).select("mix_id", "block", "pts", F.posexplode("samples").alias("i", "v")).withColumn("v", F.round("v", 6))


MIXED = """with s as (select mix_id, at as slot, v from samples where frame_idx % 7 <> 3), t as (select mix_id, slot, sum(v) as v from s group by all),
    spine as (select mix_id, unnest(range(lo, hi + 1)) as block from (select mix_id, min(slot // 24) as lo, max(slot // 24) as hi from s group by mix_id)), e as (select *, unnest(range(0, 24)) as i from spine)
    select e.mix_id, block, block * 12 as pts, cast(i as integer) as i, round(greatest(least(coalesce(v, 0), 1.0), -1.0), 6) as v from e left join t on t.mix_id = e.mix_id and t.slot = e.block * 24 + i"""


def _gappy(spark, d):
    return media.audio_frames(spark, d).where("vec_id % 11 <> 0").withColumn("n_samples", F.lit(64).cast("bigint"))


def silence(spark, d):
    return audio.fill_silence(_gappy(spark, d), MOST)


SILENCE = """with g as (select input, pts, cast(64 as bigint) as n_samples, lag(pts + 64) over (partition by input order by pts) as e from audio_frames where vec_id % 11 <> 0)
    select input, pts, n_samples, false as is_silence from g union all select input, e, pts - e, true from g where pts > e"""


def loss(spark, d):
    dropped = media.bus_events(spark, d).select((F.col("element_id") % 10).alias("input"), "event")
    return audio.capture_loss(_gappy(spark, d), dropped, MOST)


LOSS = """with g as (select input, greatest(lead(pts) over (partition by input order by pts) - pts - 64, 0) as gap from audio_frames where vec_id % 11 <> 0),
    l as (select input, cast(coalesce(sum(gap), 0) as bigint) as lost_samples, count(*) filter (where gap > 0) as gaps from g group by input), e as (select element_id % 10 as input, count(*) as n from bus_events where event = 'Dropped' group by 1)
    select l.*, coalesce(n, 0) as drop_events from l left join e on l.input = e.input"""


def contiguous(spark, d):
    out = timeline.contiguous_pts(_gappy(spark, d).withColumn("pts", F.col("pts") + 48_000), 1, 48_000, 24_000, MOST)
    return out.select("input", "frame_idx", "out_pts")


CONTIGUOUS = "select input, frame_idx, cast(round((first_value(pts) over w + 48000) / 2) as bigint) + 64 * (row_number() over w - 1) as out_pts from audio_frames where vec_id % 11 <> 0 window w as (partition by input order by frame_idx)"


def rechunked(spark, d):
    f = media.audio_frames(spark, d)
    return _exploded(audio.rechunk(f, 100, f.where("input % 2 = 0").select("input"), MOST), "input", "chunk")


RECHUNKED = """with n as (select input, max(at) + 1 as n from samples group by input) select s.input, at // 100 as chunk, cast(at % 100 as integer) as i, round(v, 6) as v from samples s join n on s.input = n.input where (at // 100 + 1) * 100 <= n or s.input % 2 = 0"""


def ramped(spark, d):
    """Every third frame changes the gain, every fifth resets; one that does both snaps to its own gain."""
    f = media.audio_frames(spark, d)
    changes = f.where("frame_idx % 3 = 0 or frame_idx % 5 = 0").select("input", F.col("pts").alias("at"), F.when(F.col("frame_idx") % 3 == 0, (F.col("vec_id") % 4) / 2).alias("gain"), (F.col("vec_id") % 7 == 0).alias("muted"), (F.col("frame_idx") % 5 == 0).alias("reset"))
    return _exploded(audio.gain_ramp(f, changes, 5_000_000, 48_000, MOST).select("vec_id", "samples"), "vec_id")


RAMPED = """with ch as (select input, pts as at, case when frame_idx % 3 = 0 then case when vec_id % 7 = 0 then 0.0 else (vec_id % 4) / 2 end end as own, frame_idx % 5 = 0 as snaps, row_number() over (partition by input order by pts) as n from audio_frames where frame_idx % 3 = 0 or frame_idx % 5 = 0),
    walk as (select input, n, at, cast(own as double) as g0, cast(own as double) as target, cast(0 as double) as step, cast(0 as bigint) as len from ch where n = 1
      union all select c.input, c.n, case when c.keeps then w.at else c.at end,
        case when c.keeps then w.g0 when c.snaps then c.target when c.at - w.at >= w.len then w.target else w.g0 + w.step * (c.at - w.at) end, c.target,
        case when c.keeps then w.step when c.snaps then 0 else (c.target - case when c.at - w.at >= w.len then w.target else w.g0 + w.step * (c.at - w.at) end) / 240 end, case when c.keeps then w.len when c.snaps then 0 else 240 end
      from walk w, lateral (select q.input, q.n, q.at, q.snaps, coalesce(q.own, w.target) as target, coalesce(q.own, w.target) = w.target and not q.snaps as keeps from ch q where q.input = w.input and q.n = w.n + 1) c),
    lined as (select ch.input, ch.at as seen, w.at, g0, w.target, step, len from ch join walk w on ch.input = w.input and ch.n = w.n)
    select f.vec_id, cast(s.at - f.pts as integer) as i, round(s.v * case when s.at - l.at + 1 >= l.len then l.target else l.g0 + l.step * (s.at - l.at + 1) end, 6) as v
    from samples s join audio_frames f on s.input = f.input and s.frame_idx = f.frame_idx asof join lined l on f.input = l.input and f.pts >= l.seen"""


def resampled(spark, d):
    """Mono, stereo and 5.1 inputs whose rates change, as stereo and as mono."""
    f = media.audio_frames(spark, d).withColumn("rate", F.when(F.floor(F.col("frame_idx") / 10) % 2 == 0, 48_000).otherwise(44_100))
    f = f.withColumn("channels", F.when(F.col("input") % 3 == 0, 1).when(F.col("input") % 3 == 1, 2).otherwise(6)).withColumn("pts", F.col("pts") + 48_000)
    both = [audio.resample(f, 32_000, most=MOST, channels=n).withColumn("to", F.lit(n)) for n in (1, 2)]
    return _round_all(both[0].unionByName(both[1]), "v")


_WEIGHTS = ", ".join(f"({own}, {to}, {o}, {c}, {w!r})" for own in audio.LAYOUTS for to in (1, 2) for o, row in enumerate(audio.mixing_matrix(own, to)) for c, w in enumerate(row))
RESAMPLED = f"""with w as (select * from (values {_WEIGHTS}) w(ch, "to", channel, c, w)),
    f as (select *, case when (frame_idx // 10) % 2 = 0 then 48000 else 44100 end as rate, frame_idx // 10 as run, case input % 3 when 0 then 1 when 1 then 2 else 6 end as ch from audio_frames),
    n as (select input, run, rate, ch, cast(count(*) * (64 // ch) as bigint) as n from f group by input, run, rate, ch),
    o as (select *, n * 32000 // rate as n_out, 32000 + cast(coalesce(sum(n * 32000 // rate) over (partition by input order by run rows between unbounded preceding and 1 preceding), 0) as bigint) as start from n),
    i as (select f.input, run, ch, (f.frame_idx - run * 10) * (64 // ch) + (s.at - f.pts) // ch as k, (s.at - f.pts) % ch as c, v from samples s join f on s.input = f.input and s.frame_idx = f.frame_idx where (s.at - f.pts) // ch < 64 // ch),
    m as (select input, run, k, "to", channel, sum(w * v) as v from i join w using (ch, c) group by all),
    e as (select o.*, w."to", w.channel, unnest(range(0, n_out)) as out_idx from o join (select distinct ch, "to", channel from w) w on o.ch = w.ch)
    select e.input, e.run, e.out_idx, e.start + e.out_idx as pts, cast(e.channel as integer) as channel, cast(e."to" as integer) as "to", round(a.v * (1 - (e.out_idx * e.rate / 32000 - e.out_idx * e.rate // 32000)) + b.v * (e.out_idx * e.rate / 32000 - e.out_idx * e.rate // 32000), 6) as v
    from e join m a on a.input = e.input and a.run = e.run and a."to" = e."to" and a.channel = e.channel and a.k = e.out_idx * e.rate // 32000
    join m b on b.input = e.input and b.run = e.run and b."to" = e."to" and b.channel = e.channel and b.k = least(e.out_idx * e.rate // 32000 + 1, e.n - 1)"""


def placed(spark, d):
    return layers.geometry(media.layers(spark, d)).select("layer_id", "image_x", "image_y", "image_w", "image_h", "error")


PLACED = "select layer_id, image_x, image_y, image_w, image_h, error from geometry"


def ordered(spark, d):
    return layers.z_order(media.layers(spark, d)).select("canvas_id", "layer_id", "draw")


ORDERED = "select canvas_id, layer_id, row_number() over (partition by canvas_id order by z_index, layer_id) as draw from layers"


def covered(spark, d):
    return layers.coverage(layers.geometry(media.layers(spark, d)), *media.CANVAS).select("canvas_id", "layer_id", *[F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")])


COVERED = "select canvas_id, layer_id, x0, y0, x1, y1 from covered"


def composited(spark, d):
    boxes = layers.coverage(layers.geometry(media.layers(spark, d)), *media.CANVAS)
    return layers.composite(layers.covered_pixels(boxes).withColumn("a", F.lit(255)))


_BLEND = "round(round(l.{c} * l.opacity + w.{c} * (1 - l.opacity), 9))"
COMPOSITED = f"""with px as (select *, row_number() over (partition by canvas_id, px, py order by z_index, layer_id) as n from (select *, unnest(range(x0, x1)) as px from (select *, unnest(range(y0, y1)) as py from covered))),
    walk as (select canvas_id, px, py, cast(0 as bigint) as n, cast(0 as double) as r, cast(0 as double) as g, cast(0 as double) as b from px where n = 1
      union all select w.canvas_id, w.px, w.py, l.n, {_BLEND.format(c='r')}, {_BLEND.format(c='g')}, {_BLEND.format(c='b')} from walk w join px l on l.canvas_id = w.canvas_id and l.px = w.px and l.py = w.py and l.n = w.n + 1)
    select canvas_id, px, py, cast(r as integer) as r, cast(g as integer) as g, cast(b as integer) as b from walk qualify row_number() over (partition by canvas_id, px, py order by n desc) = 1"""


def keyed(spark, d):
    return layers.chroma_key(media.pixels(spark, d), (0, 200, 60), 0.35, 0.2).select("frame_id", "row", "col", "a")


KEYED = """select frame_id, "row", col, cast(round(round(least(greatest((sqrt(power(r / 255, 2) + power((g - 200) / 255, 2) + power((b - 60) / 255, 2)) / sqrt(3) - 0.25) / 0.2, 0), 1) * 255, 9)) as integer) as a from pixels"""


def keyed_frames(spark, d):
    """The same on whole frames of packed BGRA bytes."""
    bgra = ("b", "g", "r", "a")
    frames = layers.chroma_key_frames(layers.frames_of_pixels(media.pixels(spark, d), bgra), (0, 200, 60), 0.35, 0.2)
    return layers.pixels_of_frames(frames, bgra).select("frame_id", "row", "col", "a")


KEYED_FRAMES = f'select * replace (cast("row" as integer) as "row", cast(col as integer) as col) from ({KEYED})'


def ycbcr(spark, d):
    return layers.to_ycbcr(media.pixels(spark, d))


_Y = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
_CLAMP = "cast(least(greatest(round(round({x}, 9)), 0), 255) as integer)"
_CB, _CR = _CLAMP.format(x=f"128 + (b - {_Y}) / 1.8556 * 224 / 255"), _CLAMP.format(x=f"128 + (r - {_Y}) / 1.5748 * 224 / 255")
YCBCR = f"""select frame_id, "row", col, {_CLAMP.format(x=f'16 + {_Y} * 219 / 255')} as y, {_CB} as cb, {_CR} as cr from (select frame_id, "row", col, cast(r as double) as r, cast(g as double) as g, cast(b as double) as b from pixels)"""


def subsampled(spark, d):
    return layers.chroma_subsample(media.pixels(spark, d))


SUBSAMPLED = f"""select frame_id, "row", col, {_CB} as cb, {_CR} as cr from (select frame_id, cast("row" // 2 as integer) as "row", cast(col // 2 as integer) as col, avg(r) as r, avg(g) as g, avg(b) as b from pixels group by 1, 2, 3)"""


def _masks(spark, d):
    rows = media.table(spark, d, "nation").where("n_nationkey < 24")
    return rows.select(F.floor(F.col("n_nationkey") / 8).cast("int").alias("row"), (F.col("n_nationkey") % 8).cast("int").alias("col"), ((F.col("n_nationkey") * 41) % 256).alias("coverage"))


def texted(spark, d):
    return layers.composite_text(media.pixels(spark, d), _masks(spark, d), (255, 240, 10)).select("frame_id", "row", "col", "r", "g", "b")


_TEXT = "cast(round(round({v} * (coalesce(m, 0) / 255) + {c} * (1 - coalesce(m, 0) / 255), 9)) as integer)"
TEXTED = f"""select frame_id, p."row", p.col, {_TEXT.format(v=255, c='r')} as r, {_TEXT.format(v=240, c='g')} as g, {_TEXT.format(v=10, c='b')} as b from pixels p
    left join (select n_nationkey // 8 as mr, n_nationkey % 8 as mc, (n_nationkey * 41) % 256 as m from nation where n_nationkey < 24) on p."row" = mr and p.col = mc"""


def scaled(spark, d):
    return _round_all(layers.scale_pixels(media.pixels(spark, d), 5, 6), "r", "g", "b")


def _axis(o: str, n: int) -> str:
    at = f"greatest(({o} + 0.5) * 8 / {n} - 0.5, 0)"
    return f"select {o}, cast(floor({at}) as integer) as i, 1 - ({at} - floor({at})) as w from o{o} union all select {o}, least(cast(floor({at}) as integer) + 1, 7), {at} - floor({at}) from o{o}"


SCALED = f"""with oorow as (select unnest(range(0, 6)) as orow), oocol as (select unnest(range(0, 5)) as ocol), ar as ({_axis('orow', 6)}), ac as ({_axis('ocol', 5)})
    select frame_id, cast(orow as integer) as "row", cast(ocol as integer) as col, round(sum(r * ar.w * ac.w), 6) as r, round(sum(g * ar.w * ac.w), 6) as g, round(sum(b * ar.w * ac.w), 6) as b from pixels p join ar on p."row" = ar.i join ac on p.col = ac.i group by frame_id, orow, ocol"""


def scaled_frames(spark, d):
    """The same on whole frames of packed RGB bytes, rounded to bytes."""
    return layers.pixels_of_frames(layers.scale_frames(layers.frames_of_pixels(media.pixels(spark, d)), 5, 6))


_BYTE = "cast(floor(round({c}, 9) + 0.5) as integer) as {c}"
SCALED_FRAMES = f"select * replace ({', '.join(_BYTE.format(c=c) for c in 'rgb')}) from ({SCALED})"


def decoded(spark, d):
    raw = media.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("output"))
    return _round_all(detect.decode_candidates(raw, 0.25), "score", "x", "y", "w", "h")


DECODED = """select vec_id, cast(list_position(s, list_max(s)) - 1 as integer) as class_id, round(list_max(s), 6) as score, round(o[1] - o[3] / 2, 6) as x, round(o[2] - o[4] / 2, 6) as y, round(o[3], 6) as w, round(o[4], 6) as h
    from (select vec_id, o, o[5:64] as s from (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as o from embeddings)) where list_max(s) >= 0.25"""


def pairs(spark, d):
    return _round_all(detect.iou_pairs(media.detections(spark, d), 0.3), "iou")


PAIRS = "select frame_id, cast(class_id as integer) as class_id, det_a, det_b, round(inter / (areas - inter), 6) as iou from ious where inter / (areas - inter) >= 0.3"


def suppressed(spark, d):
    return detect.nms(media.detections(spark, d), 0.3).select("frame_id", "class_id", "det_id", "score")


SUPPRESSED = """with ranked as (select *, row_number() over (partition by frame_id, class_id order by score desc, det_id) as n from detections),
    hit as (select frame_id, class_id, det_a, det_b from ious where inter / (areas - inter) > 0.3),
    walk as (select frame_id, class_id, cast(0 as bigint) as n, cast([] as bigint[]) as kept from ranked where n = 1
      union all select r.frame_id, r.class_id, r.n, case when exists (select 1 from hit h where h.frame_id = r.frame_id and h.class_id = r.class_id and ((h.det_a = r.det_id and list_contains(w.kept, h.det_b)) or (h.det_b = r.det_id and list_contains(w.kept, h.det_a)))) then w.kept else list_append(w.kept, r.det_id) end
      from walk w join ranked r on r.frame_id = w.frame_id and r.class_id = w.class_id and r.n = w.n + 1),
    last as (select frame_id, class_id, unnest(kept) as det_id from (select * from walk qualify row_number() over (partition by frame_id, class_id order by n desc) = 1))
    select d.frame_id, cast(d.class_id as integer) as class_id, d.det_id, d.score from detections d join last l on d.frame_id = l.frame_id and d.class_id = l.class_id and d.det_id = l.det_id"""


def labelled(spark, d):
    names = media.table(spark, d, "region").select(F.col("r_regionkey").alias("class_id"), F.col("r_name").alias("label")).where("class_id <> 1")
    out = detect.label_detections(media.detections(spark, d), names)
    return out.groupBy("class_id", "label").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


LABELLED = "select cast(class_id as integer) as class_id, r_name as label, count(*) as n, round(max(score), 6) as best from detections left join (select * from region where r_regionkey <> 1) on class_id = r_regionkey group by all"


def top(spark, d):
    return detect.top_detections(media.detections(spark, d), 3).select("frame_id", "det_id", "score", "rank")


TOP = "select frame_id, det_id, score, row_number() over (partition by frame_id order by score desc, det_id) as rank from detections qualify rank <= 3"


def _corners():
    """A detector for checks: one candidate box per frame, from the brightest channel sums."""

    def model(planes: np.ndarray) -> np.ndarray:
        sums = planes.sum(axis=(1, 2), dtype=np.float64)
        return np.array([[4.0, 4.0, 2.0, 2.0, *np.round(sums / 64, 4)]])

    return model


def detected(spark, d):
    frames = layers.frames_of_pixels(media.pixels(spark, d))
    return detect.detect_frames(frames, _corners, 0.5, 0.3).withColumn("score", F.round("score", 4)).select("frame_id", "class_id", "score", "x", "y", "w", "h")


DETECTED = """select frame_id, cast(list_position([r, g, b], greatest(r, g, b)) - 1 as integer) as class_id, round(greatest(r, g, b), 4) as score, cast(3 as double) as x, cast(3 as double) as y, cast(2 as double) as w, cast(2 as double) as h
    from (select frame_id, round(sum(r) / 255 / 64, 4) as r, round(sum(g) / 255 / 64, 4) as g, round(sum(b) / 255 / 64, 4) as b from pixels group by frame_id) where greatest(r, g, b) >= 0.5"""


def mapped(spark, d):
    def halve(row: dict) -> dict:
        if row["event_id"] % 7 == 0:
            raise ValueError(f"event {row['event_id']}")
        return {"event_id": row["event_id"], "half": row["event_id"] // 2}

    out = map_buffers(media.events(spark, d).select("event_id"), halve, "event_id long, half long")
    return out.withColumns({"event_id": F.coalesce("event_id", F.lit(-1)), "half": F.coalesce("half", F.lit(-1)), "error": F.coalesce("error", F.lit(""))})


MAPPED = "select case when event_id % 7 = 0 then -1 else event_id end as event_id, case when event_id % 7 = 0 then -1 else event_id // 2 end as half, case when event_id % 7 = 0 then 'ValueError: event ' || event_id else '' end as error from ev"

QUERIES = {
    "synthetic_video": (video, VIDEO), "synthetic_tone": (tone, TONE), "effective_gain": (gains, GAINS), "apply_gain": (gained, GAINED), "interleave_channels": (planar, PLANAR), "mix_audio": (mixed, MIXED),
    "fill_silence": (silence, SILENCE), "capture_loss": (loss, LOSS), "contiguous_pts": (contiguous, CONTIGUOUS), "rechunk_audio": (rechunked, RECHUNKED), "gain_ramp": (ramped, RAMPED), "resample_audio": (resampled, RESAMPLED),
    "layer_geometry": (placed, PLACED), "z_order": (ordered, ORDERED), "layer_pixel_overlap": (covered, COVERED), "composite_layers": (composited, COMPOSITED), "chroma_key": (keyed, KEYED), "rgb_to_ycbcr": (ycbcr, YCBCR),
    "chroma_subsample": (subsampled, SUBSAMPLED), "composite_text": (texted, TEXTED), "scale_frames": (scaled, SCALED), "scale_frames_packed": (scaled_frames, SCALED_FRAMES), "chroma_key_packed": (keyed_frames, KEYED_FRAMES), "decode_candidates": (decoded, DECODED), "iou_pairs": (pairs, PAIRS), "nms": (suppressed, SUPPRESSED),
    "label_detections": (labelled, LABELLED), "top_detections": (top, TOP), "detect_frames": (detected, DETECTED), "map_buffers": (mapped, MAPPED),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
