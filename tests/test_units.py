"""Exact small cases. Expected values are fixed by the operators' definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwork.functions import audio as af
from reelwork.functions import pixels as pf
from reelwork.functions.buffers import map_buffers
from reelwork.functions.time import media_time, nominal_duration, rescale
from reelwork.operators import asof, audio, bitstream, detect, greedy, joins, layers, ops, segments, timeline, tracks
from reelwork.streaming import live


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or "*").collect()), key=lambda r: [(x is None, x) for x in r])


def test_rescale(spark):
    v = lambda x: F.lit(x).cast("bigint")
    assert one(spark, rescale(v(30), 1001, 30_000, 1, 30_000), rescale(v(3000), 1, 90_000, 1, 90_000)) == (30_030, 3000)
    assert one(spark, rescale(v(1), 1, 2, 1, 1), rescale(v(-1), 1, 2, 1, 1), rescale(v(-3), 1, 4, 1, 1)) == (1, -1, -1)
    assert one(spark, rescale(v((1 << 63) - 1), 1, 1, 1, 2), rescale(v(None), 1, 1, 1, 2), rescale(v(5), 1, 0, 1, 2)) == (None, None, None)
    assert one(spark, rescale(v((1 << 63) - 1), 1, 90_000, 1, 90_000))[0] == (1 << 63) - 1
    assert one(spark, nominal_duration(F.lit(30_000), F.lit(1001), 1, 90_000), nominal_duration(F.lit(0), F.lit(1), 1, 90_000), nominal_duration(F.lit(500), F.lit(1), 1, 25)) == (3003, 0, 1)


def test_media_time(spark):
    got = spark.createDataFrame([(3,), (-1,), (None,), ((1 << 63) - 1,)], "p long").select(media_time(F.col("p"), 1001, 30_000).alias("m")).select("m.*").collect()
    assert [(int(r[0]) if r[0] is not None else None, r[2]) for r in got] == [(3003, None), (None, "negative_pts"), (None, "missing_pts"), (None, "timestamp_overflow")]


def test_time_bases_are_rejected(spark):
    df = spark.createDataFrame([(n, d, 1, "video") for n, d in ((0, 1), (1, 0), (-1, 1), (1, -1), (0, 0), (1, 1))], "tb_num int, tb_den int, pts long, kind string")
    good, bad = tracks.validate_packets(df)
    assert good.count() == 1 and {r["error_code"] for r in bad.collect()} == {"invalid_time_base"} and bad.count() == 5


def test_gain(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, af.apply_gain(arr(20_000, -20_000), F.lit(2.0), "i16"), af.apply_gain(arr(0, 128, 255), F.lit(2.0), "u8"), af.apply_gain(arr(0.75), F.lit(2.0), "f32"), F.round(af.db_to_gain(F.lit(-6.0)), 6), af.db_to_gain(F.lit(float("-inf"))))
    assert got == ([32_767, -32_768], [0, 128, 255], [1.5], round(10 ** (-6 / 20), 6), 0.0)
    assert one(spark, af.apply_gain(arr((1 << 62) + 1, -(1 << 62)), F.lit(4.0), "i64"))[0] == [(1 << 63) - 1, -(1 << 63)]
    assert one(spark, af.effective_gain(F.lit(2.0), F.lit(True)), af.effective_gain(F.lit(-1.0), F.lit(False)), af.to_packed(af.to_planar(arr(1, 2, 3, 4), 2), 2)) == (0.0, None, [1, 2, 3, 4])


def test_gain_ramp_and_restart(spark):
    frames = spark.createDataFrame([(1, i, i, [1.0]) for i in range(30)], "input long, frame_idx long, pts long, samples array<double>")
    changes = spark.createDataFrame([(1, -100, 1.0, False), (1, 0, 1.0, True), (1, 15, 1.0, False)], "input long, at long, gain double, muted boolean")
    got = [round(r["samples"][0], 6) for r in audio.gain_ramp(frames, changes, 10_000_000, 1000).orderBy("pts").collect()]
    assert got[:10] == [round(0.9 - 0.1 * i, 6) for i in range(10)] and got[15:25] == [round(0.1 + 0.1 * i, 6) for i in range(10)]


def test_mix_clips(spark):
    df = spark.createDataFrame([(0, 1, 0, [0.6, 0.1]), (0, 2, 0, [0.6, -0.3]), (0, 1, 2, [-2.0, 0.0])], "mix_id int, input int, pts long, samples array<double>")
    got = {r["block"]: [round(v, 6) for v in r["samples"]] for r in audio.mix_audio(df, 2).collect()}
    assert got == {0: [1.0, -0.2], 1: [-1.0, 0.0]}


def test_geometry_cases(spark):
    cols = "fit string, x int, y int, w int, h int, src_w int, src_h int, opacity double"
    df = spark.createDataFrame([("Contain", 10, 20, 100, 100, 160, 90, 1.0), ("Cover", 10, 20, 100, 100, 160, 90, 1.0), ("Stretch", 0, 0, 5, 5, 0, 9, 1.0), ("Stretch", 0, 0, 0, 5, 1, 9, 1.0), ("Cover", 0, 0, 16_384, 1, 1, 9, 1.0), ("Stretch", 0, 0, 5, 5, 1, 1, 1.5)], cols)
    got = [tuple(r) for r in layers.geometry(df).select("image_x", "image_y", "image_w", "image_h", "error").collect()]
    assert got[:2] == [(10, 42, 100, 56, None), (-29, 20, 178, 100, None)]
    assert [g[4] for g in got[2:]] == ["empty_source", "invalid_rect", "scaled_too_large", "invalid_opacity"]


def test_blending(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 1, 255, 255, 255, 255, 0.5), (0, 1, 0, 1, 2, 0, 0, 255, 255, 1.0), (0, 1, 0, 0, 1, 255, 0, 0, 255, 1.0), (0, 2, 0, 0, 3, 9, 9, 9, 255, 0.0)], "canvas_id int, px int, py int, z_index int, layer_id int, r int, g int, b int, a int, opacity double")
    assert rows(layers.composite(df), "px", "r", "g", "b") == [(0, 128, 128, 128), (1, 0, 0, 255)]


def test_keying_and_colour(spark):
    key = (0, 255, 0)
    alpha = lambda r, g, b: pf.key_alpha(F.lit(r), F.lit(g), F.lit(b), key, 0.15, 0.1)
    got = one(spark, alpha(0, 255, 0), alpha(255, 0, 0), alpha(60, 255, 0))
    assert got[:2] == (0, 255) and 0 < got[2] < 255
    assert tuple(one(spark, pf.rgb_to_ycbcr(F.lit(0.0), F.lit(0.0), F.lit(0.0)))[0]) == (16, 128, 128)


def test_frame_forms_match_pixel_forms(spark):
    px = spark.createDataFrame([(1, r, c, (37 * r + c) % 256, (r * c * 7) % 256, (11 * c) % 256, 255) for r in range(6) for c in range(4)], "frame_id long, row int, col int, r int, g int, b int, a int")
    scaled = {(r["row"], r["col"]): tuple(int(r[c] + 0.5) for c in "rgb") for r in layers.scale_pixels(px, 3, 5).collect()}
    data = bytes(layers.scale_frames(layers.frames_of_pixels(px), 3, 5).first()["pixels"])
    assert {(i // 3, i % 3): tuple(data[3 * i : 3 * i + 3]) for i in range(15)} == scaled
    bgra = b"".join(bytes([r["b"], r["g"], r["r"], 255]) for r in px.orderBy("row", "col").collect())
    keyed = layers.chroma_key_frames(spark.createDataFrame([(1, bytearray(bgra))], "frame_id long, pixels binary"), (30, 20, 10), 0.3, 0.2).first()["pixels"]
    assert [r["a"] for r in layers.chroma_key(px, (30, 20, 10), 0.3, 0.2).orderBy("row", "col").collect()] == list(bytes(keyed)[3::4])


def test_sync_decisions(spark):
    frames = spark.createDataFrame([(1, 1, 5_000_000_000, 1_000_000_000), (1, 2, 5_000_000_000, 2_010_000_000), (2, 3, 5_000_000_000, 1), (3, 4, 1, 1)], "stream_id long, seq long, wall_ns long, pts_ns long")
    clock = spark.createDataFrame([(1, 1, 5_000_000_000, 2_000_000_000, 9_000_000_000, True, False), (2, 1, 1, 5, 9, True, True)], "stream_id long, seq long, wall_ns long, position_ns long, submitted_ns long, running boolean, priming boolean")
    assert rows(timeline.sync_video(frames, clock), "seq", "decision", "wait_ns") == [(1, "Drop", None), (2, "Wait", 10_000_000), (3, "Hold", None), (4, "Render", None)]


def test_clock_masters(spark):
    ms = 1_000_000
    frame = lambda stream, seq, wall, pts: (stream, seq, wall * ms, pts * ms)
    sample = lambda stream, seq, wall, position, submitted, running, priming, ended=False: (stream, seq, wall * ms, position * ms, submitted * ms, running, priming, ended)
    frames = spark.createDataFrame([
        frame(1, 1, 0, 5000), frame(1, 2, 40, 5060), frame(1, 3, 500, 5100),  # no audio: the first frame is the wall's origin
        frame(2, 1, 0, 50), frame(2, 2, 20, 80), frame(2, 3, 30, 70), frame(2, 4, 45, 60),  # audio takes over, not backwards
        frame(3, 1, 10, 1), frame(3, 2, 60, 2000), frame(3, 3, 100, 1500),  # audio ends, the wall goes on
    ], "stream_id long, seq long, wall_ns long, pts_ns long")
    clock = spark.createDataFrame([
        sample(2, 10, 10, 0, 0, True, True), sample(2, 11, 30, 50, 160, True, False), sample(2, 12, 40, 55, 160, False, False),
        sample(3, 10, 0, 1, 2, False, False), sample(3, 11, 50, 2000, 0, False, False, True),
    ], "stream_id long, seq long, wall_ns long, position_ns long, submitted_ns long, running boolean, priming boolean, ended boolean")
    for most in (None, 1):
        got = timeline.playback_position(frames, clock, most).selectExpr("stream_id", "seq", "master", f"position_ns / {ms} as p")
        assert rows(got, "stream_id", "seq", "master", "p") == [
            (1, 1, "wall", 5000), (1, 2, "wall", 5040), (1, 3, "wall", 5500), (2, 1, "wall", 50), (2, 2, "priming", 60), (2, 3, "audio", 60), (2, 4, "audio", 55),
            (3, 1, "audio", 1), (3, 2, "wall", 2010), (3, 3, "wall", 2050),
        ]
        decided = timeline.sync_video(frames, clock, most)
        assert rows(decided, "stream_id", "seq", "decision") == [
            (1, 1, "Render"), (1, 2, "Wait"), (1, 3, "Render"), (2, 1, "Render"), (2, 2, "Hold"), (2, 3, "Wait"), (2, 4, "Wait"), (3, 1, "Render"), (3, 2, "Render"), (3, 3, "Render"),
        ]
    assert rows(timeline.playback_position(frames.drop("pts_ns", "seq"), clock).where("stream_id = 1"), "master", "position_ns") == [("none", None)] * 3


def test_observed_duration_in_pieces(spark):
    f = spark.createDataFrame([(1, q, q * 10 + (q % 3)) for q in range(0, 40, 2)], "stream_id long, seq long, pts_ns long")
    resets = spark.createDataFrame([(1, 9), (1, 10), (1, 31)], "stream_id long, seq long")
    cols = ["seq", "epoch", "duration_ns"]
    for r, most in ((resets, 7), (None, 3)):
        assert rows(timeline.observed_duration(f, r, most=most), *cols) == rows(timeline.observed_duration(f, r), *cols)


def test_fanout_with_and_without_bins(spark):
    buffers = spark.createDataFrame([(1, t, t) for t in range(-30, 60, 7)] + [(2, 5, 99)], "tee_id int, at long, buffer_id long")
    branches = spark.createDataFrame([(1, 1, -20, 15), (1, 2, 0, None), (1, 3, 40, 40), (1, 4, 100, None), (2, 5, 5, 6), (3, 6, 0, None)], "tee_id int, branch_id int, attached_at long, detached_at long")
    plain = rows(joins.branch_fanout(buffers, branches), "branch_id", "buffer_id")
    assert plain == rows(joins.branch_fanout(buffers, branches, bin=10), "branch_id", "buffer_id") and len(plain) > 10
    failed = spark.createDataFrame([(99, 5)], "buffer_id long, branch_id int")
    assert len(rows(joins.branch_fanout(buffers, branches, failed, 10), "branch_id")) == len(plain) - 1


def test_fanout_totals_make_no_copies(spark):
    buffers = spark.createDataFrame([(1, t, t, t % 3 if t % 5 else None) for t in range(-30, 60, 2)] + [(2, 5, 99, 1), (None, 5, 98, 1), (1, None, 97, 1)], "tee_id int, at long, buffer_id long, fails int")
    ends = [(-20, 14), (0, None), (40, 40), (41, 30), (100, None), (-100, 500), (None, 5), (8, 9), (8, 8)]
    branches = spark.createDataFrame([(tee, 20 * tee + i, lo, hi, f) for tee in (1, 2, 3) for i, (lo, hi) in enumerate(ends) for f in (i % 3 if i % 4 else None,)], "tee_id int, branch_id int, attached_at long, detached_at long, fails int")
    copies = joins.branch_fanout(buffers.withColumnRenamed("fails", "b"), branches).where("b is null or fails is null or b <> fails")
    want = rows(copies.groupBy("tee_id", "branch_id").agg(F.count("*").alias("n"), F.sum("buffer_id").alias("total")), "tee_id", "branch_id", "n", "total")
    for most in (None, 10):
        assert rows(joins.branch_totals(buffers, branches, "buffer_id", most), "tee_id", "branch_id", "n", "total") == want and len(want) > 4
    # 50,000 buffers and 50,000 branches of one tee: 1.25 billion copies, had they to be made.
    n = 50_000
    many = spark.range(n).select(F.lit(1).alias("tee_id"), F.col("id").alias("at"), F.col("id").alias("buffer_id"), F.lit(None).cast("int").alias("fails"))
    spans = many.select("tee_id", F.col("buffer_id").alias("branch_id"), F.col("at").alias("attached_at"), F.lit(None).cast("long").alias("detached_at"), "fails")
    got = joins.branch_totals(many, spans, "buffer_id").agg(F.count("*"), F.sum("n"), F.max("total")).first()
    assert tuple(got) == (n, n * (n + 1) // 2, n * (n - 1) // 2)


def test_suppression_takes_all_groups_at_once():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 30, 400)
    group = np.repeat(np.arange(400), sizes)
    x, y, w, h = (rng.integers(lo, hi, len(group)).astype(float) for lo, hi in ((0, 40), (0, 40), (0, 20), (0, 20)))

    def plain(at):
        kept = []
        for i in at:
            over = lambda j: max(0, min(x[i] + w[i], x[j] + w[j]) - max(x[i], x[j])) * max(0, min(y[i] + h[i], y[j] + h[j]) - max(y[i], y[j]))  # noqa: B023, E731
            union = lambda j: w[i] * h[i] + w[j] * h[j] - over(j)  # noqa: B023, E731
            if all((over(j) / union(j) if union(j) > 0 else 0) <= 0.3 for j in kept):
                kept.append(i)
        return kept

    want = [i for g in range(400) for i in plain(np.flatnonzero(group == g))]
    assert detect._kept(group, x, y, w, h, 0.3).tolist() == want and len(want) < len(group)
    assert len(detect._kept(group[:0], x[:0], y[:0], w[:0], h[:0], 0.3)) == 0


def test_mix_of_frames_off_the_grid(spark):
    df = spark.createDataFrame([(0, 1, 1, [0.1, 0.2, 0.3, 0.4, 0.5]), (0, 2, 3, [0.5]), (0, 1, -1, [0.25]), (0, 2, 9, [])], "mix_id int, input int, pts long, samples array<double>")
    got = {r["block"]: [round(v, 6) for v in r["samples"]] for r in audio.mix_audio(df, 2).collect()}
    assert got == {-1: [0.0, 0.25], 0: [0.0, 0.1], 1: [0.2, 0.8], 2: [0.4, 0.5]}


def test_resampling_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(1)
    for rate, out in ((48_000, 32_000), (8000, 48_000), (44_100, 44_100), (44_100, 11_025)):
        samples = r.normal(size=533)
        cuts = [0, 1, 7, 7, 250, 251, 500, 533]
        df = spark.createDataFrame([(1, i, rate, samples[a:z].tolist()) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))], "input int, frame_idx long, rate int, samples array<double>")
        got, spread = ([(x["out_idx"], round(x["v"], 6)) for x in audio.resample(df, out, 16, b).orderBy("out_idx").collect()] for b in (None, 2))
        assert got == spread == [(i, round(v, 6)) for i, v in enumerate(interpolate(samples, rate, out))]


def interpolate(samples, rate, out):
    """The array form of resampling one channel."""
    import numpy as np

    return np.interp(np.arange(len(samples) * out // rate) * rate / out, np.arange(len(samples)), samples)


@pytest.mark.parametrize("channels", [1, 2, 6])
def test_resampling_with_channels(spark, channels):
    import numpy as np

    r = np.random.default_rng(channels)
    runs = [(48_000, r.normal(size=(533, channels))), (44_100, r.normal(size=(120, channels)))]
    rows_, n = [], 0
    for rate, samples in runs:
        for a, z in ((0, 1), (1, 1), (1, 40), (40, len(samples))):
            rows_.append((1, n, rate, channels, 48_000 + n, samples[a:z].ravel().tolist()))
            n += 1
    df = spark.createDataFrame(rows_, "input int, frame_idx long, rate int, channels int, pts long, samples array<double>")
    for to in (1, 2):
        matrix = np.array(audio.mixing_matrix(channels, to))
        assert np.allclose(np.abs(matrix).sum(axis=1), 1)
        want, start = [], 24_000
        for k, (rate, samples) in enumerate(runs):
            each = [interpolate(x, rate, 24_000) for x in (samples @ matrix.T).T]
            want += [(k, i, start + i, c, round(each[c][i], 6)) for i in range(len(each[0])) for c in range(to)]
            start += len(each[0])
        got = [(x["run"], x["out_idx"], x["pts"], x["channel"], round(x["v"], 6)) for x in audio.resample(df, 24_000, 64, channels=to).collect()]
        assert sorted(got) == want
    packed = audio.resample_blocks(df, 24_000, 2, 64).orderBy("pts").collect()
    assert packed[0]["pts"] == 24_000 and all(b["pts"] == a["pts"] + len(a["samples"]) // 2 for a, b in zip(packed, packed[1:], strict=False))


def test_layouts_without_a_matrix_are_errors(spark):
    df = spark.createDataFrame([(1, 0, 8000, 5, [0.0] * 10)], "input int, frame_idx long, rate int, channels int, samples array<double>")
    with pytest.raises(Exception, match="no mixing matrix to 2 channels from 5"):
        audio.resample(df, 8000, channels=2).collect()
    with pytest.raises(ValueError, match="no mixing matrix"):
        audio.mixing_matrix(2, 5)
    assert audio.mixing_matrix(6, 6)[3][3] == 1 and audio.mixing_matrix(1, 6)[2] == [1.0] and audio.mixing_matrix(2, 6)[0] == [1.0, 0.0]


def test_mix_runs_on_through_silence_with_channels_apart(spark):
    df = spark.createDataFrame([(0, 1, 0, [0.1, -0.1, 0.2, -0.2]), (0, 2, 1, [0.5, 0.7]), (0, 1, 7, [0.9, -0.9, 1.0]), (0, 2, 7, [0.9, -0.9]), (1, 1, 5, [0.25, 0.5])], "mix_id int, input int, pts long, samples array<double>")
    got = {(r["mix_id"], r["block"]): (r["pts"], [round(v, 6) for v in r["samples"]]) for r in audio.mix_audio(df, 2, 2).collect()}
    assert got == {(0, 0): (0, [0.1, -0.1, 0.7, 0.5]), (0, 1): (2, [0.0] * 4), (0, 2): (4, [0.0] * 4), (0, 3): (6, [0.0, 0.0, 1.0, -1.0]), (1, 2): (4, [0.0, 0.0, 0.25, 0.5])}
    # A mix of very many silent blocks is made in ranges.
    long = spark.createDataFrame([(0, 1, 0, [0.5]), (0, 1, 300_001, [0.5])], df.schema)
    assert audio.mix_audio(long, 1).agg(F.count("*"), F.sum("block"), F.sum(F.col("samples")[0])).first()[:] == (300_002, 300_001 * 300_002 // 2, 1.0)


def test_steps_of_long_spans(spark, monkeypatch):
    from reelwork.operators import ranges

    monkeypatch.setattr(ranges, "STEPS", 3)
    spans = [(1, 0, 100), (2, -7, -7), (3, 5, 4), (4, None, 9), (5, -20, 23)]
    got = rows(ranges.stepped(spark.createDataFrame(spans, "k int, lo long, hi long"), F.col("lo"), F.col("hi"), 4, "at"), "k", "at")
    assert got == [(k, at) for k, lo, hi in spans if lo is not None for at in range(lo, hi + 1, 4)]


def test_gain_resets(spark):
    frames = spark.createDataFrame([(1, 10 * i, [1.0] * 10) for i in range(6)], "input long, pts long, samples array<double>")
    changes = spark.createDataFrame([(1, 0, 1.0, False, False), (1, 5, None, False, True), (1, 10, 0.0, False, False), (1, 20, None, None, True), (1, 30, 1.0, False, False), (1, 40, 0.5, False, True), (1, 50, 1.0, False, False), (1, 50, None, False, True), (2, 0, None, False, True)], "input long, at long, gain double, muted boolean, reset boolean")
    got = {r["pts"]: [round(v, 6) for v in r["samples"]] for r in audio.gain_ramp(frames, changes, 20_000_000, 1000).collect()}
    ramp = lambda a, step: [round(a + step * (i + 1), 6) for i in range(10)]
    assert got == {0: [1.0] * 10, 10: ramp(1.0, -0.05), 20: [0.0] * 10, 30: ramp(0.0, 0.05), 40: [0.5] * 10, 50: [1.0] * 10}


def test_pauses_keep_the_phase_of_ticks(spark):
    ticks = lambda *t: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(t)], "source long, n long, now long")
    pauses = lambda *p: spark.createDataFrame([(1, *x) for x in p], "source long, now long, paused_for long")
    due = lambda t, p: [r[1] for r in rows(timeline.cadence(t, 100, p), "n", "due")]
    assert due(ticks(0, 600, 700), pauses((590, 500))) == [0, 600, 700]  # 10 of the interval were left
    assert due(ticks(0, 10_100), pauses((10_000, 1))) == [0, 10_100]  # counted short: one interval from the resume
    assert due(ticks(5, 105, 400), pauses((1, 50), (200, 40), (300, 10))) == [5, 105, 400]
    assert due(ticks(0, 100, 250), pauses((250, 50))) == [0, 100, 250] == due(ticks(0, 100, 250), pauses((250, 50), (99, 0)))


def test_pauses_by_brute_force(spark):
    r = random.Random(3)
    events = [(s, t, r.random() < 0.7, r.randint(0, 300)) for s in (1, 2, 3) for t in sorted(r.sample(range(0, 9000), 80))]
    want, n = [], {}
    upcoming: dict = {}
    for s, now, is_tick, held in events:
        if is_tick:
            n[s] = n.get(s, 0) + 1
            due = upcoming.get(s, now)
            missed = (now - due) // 50 if due + 50 < now else 0
            upcoming[s] = now + 50 if due + 50 < now else due + 50
            want.append((s, n[s], due, missed))
        elif s in upcoming:
            upcoming[s] += held
            upcoming[s] = now + 50 if upcoming[s] < now else upcoming[s]
    ticks, k = [], {}
    for s, now, is_tick, _ in events:
        if is_tick:
            k[s] = k.get(s, 0) + 1
            ticks.append((s, k[s], now))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    pauses = spark.createDataFrame([(s, now, held) for s, now, is_tick, held in events if not is_tick], "source long, now long, paused_for long")
    got = rows(timeline.cadence(spark.createDataFrame(ticks, "source long, n long, now long"), 50, pauses), "source", "n", "due", "missed")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(want)


def test_zero_base_cadence_and_active_time(spark):
    p = spark.createDataFrame([(1, 0, 1, -312), (1, 0, 2, 648), (2, 0, 1, 5)], "stream_id long, track_id int, seq long, pts long")
    assert rows(timeline.zero_base(p), "stream_id", "pts") == [(1, 0), (1, 960), (2, 5)]
    ticks = spark.createDataFrame([(1, 1, 0), (1, 2, 160), (1, 3, 165)], "source long, n long, now long")
    assert rows(timeline.cadence(ticks, 10), "n", "due", "missed") == [(1, 0, 0), (2, 10, 15), (3, 170, 0)]
    runs = spark.createDataFrame([(1, 0, 1000), (2, 0, 100)], "run_id int, start long, end long")
    pauses = spark.createDataFrame([(1, 100, 200), (1, 300, 550), (2, -50, None)], "run_id int, start long, end long")
    assert rows(timeline.active_time(runs, pauses), "run_id", "active") == [(1, 650), (2, 0)]


def test_segments_begin_with_keyframes(spark):
    p = spark.createDataFrame([(1, i, i * 10, "video", i % 4 == 0) for i in range(20)] + [(2, i, i * 10, "audio", False) for i in range(10)], "stream_id long, seq long, pts long, kind string, is_key boolean")
    assert rows(segments.keyframe_cuts(p, 50), "stream_id", "at") == [(1, 0), (1, 80), (1, 160), (2, 0), (2, 50)]
    both = [rows(segments.segment(p, 50, most=b), "stream_id", "seq", "segment") for b in (None, 30)]
    assert both[0] == both[1]


def test_windows_names_and_finals(spark):
    s = spark.createDataFrame([(1, i, 4_000_000) for i in range(5)], "stream_id long, segment long, duration long")
    live = segments.live_window(s, 2)
    assert rows(live, "segment", "media_sequence") == [(2, 2), (3, 2)]
    assert rows(segments.expired_segments(s, live), "segment") == [(0,), (1,), (4,)]
    names = spark.createDataFrame([("segment_%d",), ("segment_%05d",), ("%%05d",), ("none",), (None,), ("%d%d",)], "p string")
    assert [r[0] for r in names.select(segments.has_integer_conversion(F.col("p"))).collect()] == [True, True, False, False, False, False]
    events = spark.createDataFrame([(1, 0, "Eos", 5), (1, 0, "Stop", 6), (2, 0, "Eos", 1), (2, 1, "Stop", 9)], "file_id int, track_id int, event string, at long")
    expected = spark.createDataFrame([(f, t) for f in (1, 2, 3) for t in (0, 1)], "file_id int, track_id int")
    assert rows(tracks.finalize_tracks(events, expected), "file_id", "is_final", "finalized_at") == [(1, False, None), (2, True, 9), (3, False, None)]


def test_asof_in_pieces(spark):
    left = spark.createDataFrame([(1, t) for t in (-5, 0, 3, 40, 41)], "k int, at long")
    right = spark.createDataFrame([(1, 0, 1), (1, 3, 2), (1, 3, 3), (1, 20, None)], "k int, at long, v int")
    for most in (None, 1, 2, 100):
        assert rows(asof.asof(left, right, ["k"], "at", F.col("v"), "v", most), "at", "known") == [(-5, None), (0, 1), (3, 3), (40, 3), (41, 3)]
        assert rows(asof.running_sum(right, "v", ["k"], ["at", "v"], "s", asof.find_cuts(right, ["k"], "at", most)), "at", "s") == [(0, 0), (3, 1), (3, 3), (20, 6)]


def test_seeks_without_keyframes(spark):
    asks = spark.createDataFrame([(1, 1, 50), (1, 2, 5), (2, 3, 7)], "stream_id int, request_id int, target long")
    p = spark.createDataFrame([(1, 1, 10, 10, True), (1, 2, 20, 20, False), (1, 3, 60, 60, True)], "stream_id int, seq long, pts long, dts long, is_key boolean")
    assert rows(joins.seek_keyframe(asks, p), "request_id", "landed") == [(1, 10), (2, 10), (3, 7)]


def test_nms_suppresses_by_kept_boxes_only(spark):
    # b overlaps a and goes; c overlaps b alone and stays.
    df = spark.createDataFrame([(1, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 0.8, 4.0, 0.0, 10.0, 10.0), (1, 0, 3, 0.7, 8.0, 0.0, 10.0, 10.0), (1, 1, 4, 0.1, 0.0, 0.0, 0.0, 0.0), (1, 1, 5, 0.1, 0.0, 0.0, 0.0, 0.0)], "frame_id long, class_id int, det_id long, score double, x double, y double, w double, h double")
    assert rows(detect.nms(df, 0.3), "det_id") == [(1,), (3,), (4,), (5,)]
    # A group that goes on over many batches is one group.
    many = spark.createDataFrame([(f, 0, i, 1 - i / 1000, float(i % 7 * 20), 0.0, 10.0, 10.0) for f in (1, 2) for i in range(50)], df.schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    assert rows(detect.nms(many, 0.3), "frame_id", "det_id") == [(f, i) for f in (1, 2) for i in range(7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_units_and_parameter_sets(spark):
    assert bitstream.split_units(b"\x00\x00\x01\x67\x01\x00\x00\x00\x01\x68\x00\x00\x01\x00\x00\x01\x65") == [b"\x67\x01", b"\x68", b"\x65"]
    sps = bytes.fromhex("67640028acd940780227e5c044000003000400000300f03c60c658")
    assert bitstream.frame_size(sps) == (1920, 1080) and bitstream.frame_size(sps[:5]) is None and bitstream.frame_size(b"\x68\x01") is None
    sets = lambda *units: b"".join(b"\x00\x00\x01" + u for u in units)
    schema = "stream_id long, seq long, codec string, payload binary"
    packets = spark.createDataFrame([(1, 1, "H264", sets(b"\x68")), (1, 2, "H264", sets(sps)), (1, 3, "VP8", b"\x01"), (1, 4, "H264", sets(sps)), (1, 5, None, None)], schema)
    assert rows(bitstream.probe_codec(packets), "run", "ready_seq", "width", "height") == [(0, 2, 1920, 1080), (1, 3, None, None), (3, 5, None, None)]
    # A malformed set keeps a stream unready, also one that follows a good set before the other kind.
    more = [(2, 1, "H264", sets(sps[:5], b"\x68")), (2, 2, "H264", sets(b"\x65")), (3, 1, "H264", sets(sps)), (3, 2, "H264", sets(sps[:5], b"\x68")), (3, 4, "H264", sets(sps))]
    assert rows(bitstream.probe_codec(spark.createDataFrame(more, schema)), "stream_id", "ready_seq", "width") == [(3, 4, 1920)]
    # Bytes of no known profile are no set, though they would parse by chance (as 16 x 16 and 16 x 32).
    chance = [b"\x67389139", b"\x6782092282"]
    assert [bitstream.frame_size(u) for u in chance] == [None, None] and bitstream.frame_size(bytes.fromhex("6742001eda0a3640")) == (160, 96)
    more = [(4, i, "H264", sets(u, b"\x68")) for i, u in enumerate([*chance, sps])]
    assert rows(bitstream.probe_codec(spark.createDataFrame(more, schema)), "stream_id", "ready_seq", "width") == [(4, 2, 1920)]


def test_paths_with_fan_in_and_cycles(spark):
    nodes = spark.createDataFrame([(1, i, "T", i) for i in "abcdxy"], "pipeline_id int, id string, element_type string, name string")
    edges = spark.createDataFrame([(1, a, b) for a, b in ("ac", "bc", "cd", "xy", "yx")], "pipeline_id int, from_id string, to_id string")
    assert rows(ops.topology_paths(nodes, edges), "path") == [("T(a) - T(c) - T(d)",), ("T(b) - T(c) - T(d)",)] == rows(ops.topology_paths(nodes, edges, 3), "path")
    with pytest.raises(ValueError, match="more than 2"):
        ops.topology_paths(nodes, edges, 2)


def test_user_errors_are_quarantined(spark):
    df = spark.createDataFrame([(1,), (0,)], "x long")
    out = lambda how: rows(map_buffers(df, lambda r: {"y": 10 // r["x"]}, "y long", how).select(F.coalesce("y", F.lit(-1)).alias("y"), F.coalesce("error", F.lit("")).alias("error")), "y", "error")
    assert [e[:17] for _, e in out("quarantine")] == ["ZeroDivisionError", ""] and out("drop") == [(10, "")]
    with pytest.raises(ValueError, match="on_error"):
        map_buffers(df, lambda r: r, "x long", "ignore")


def test_long_streams_in_pieces(spark):
    p = spark.createDataFrame([(f, q, None if q % 5 == 4 else (q * 37) % 200, (q * 37) % 200, q % 6 == 3) for f in (1, 2) for q in range(40)], "stream_id long, seq long, pts long, dts long, seek boolean")
    cols = ["stream_id", "seq", "out_pts", "out_dts"]
    assert rows(timeline.splice_timeline(p), *cols) == rows(timeline.splice_timeline(p, 7), *cols)
    f = spark.createDataFrame([(1, t, i) for i, t in enumerate((0, 3, 4, 19, 40, 41, 42, 90))], "source long, at long, frame_id long")
    assert rows(joins.steady_rate(f, 5), "at", "frame_id", "is_repeat", "run") == rows(joins.steady_rate(f, 5, 2), "at", "frame_id", "is_repeat", "run")
    a = spark.createDataFrame([(1, i, t, 4, [float(i)] * 4) for i, t in enumerate((0, 4, 9, 13, 30, 34))], "input long, frame_idx long, pts long, n_samples long, samples array<double>")
    assert rows(audio.fill_silence(a)) == rows(audio.fill_silence(a, 2)) and rows(audio.rechunk(a, 5)) == rows(audio.rechunk(a, 5, most=2))


def test_scans_in_pieces_keep_nulls_and_agree_with_windows(spark):
    r = random.Random(4)
    data = [(r.choice([None, 1, 1, 1, 2]), r.choice([None, *range(-9, 30)]), i, r.choice([None, i]), "x") for i in range(300)]
    df = spark.createDataFrame(data, "k int, at long, id long, v long, rest string")
    columns = {"s": ("sum", "v"), "p": ("previous", "v"), "l": ("last", "v")}
    plain = rows(asof.scan(df, ["k"], ["at", "id"], columns))
    assert len(plain) == 300
    for most in (1, 20, 100):
        cuts = asof.find_cuts(df, ["k"], "at", most)
        pieces = cuts.placed(df)
        assert pieces.where("_scan_cut").groupBy("k", "_scan_piece").count().agg(F.max("count")).first()[0] < 150 and pieces.count() == 300
        assert rows(asof.scan(df, ["k"], ["at", "id"], columns, cuts)) == plain
        assert rows(asof.scan(df.withColumn("g", F.col("id") % 3), ["k", "g"], ["at", "id"], columns, cuts)) == rows(asof.scan(df.withColumn("g", F.col("id") % 3), ["k", "g"], ["at", "id"], columns))
        assert rows(asof.following(df, "v", ["k"], ["at", "id"], "n", most), "k", "at", "id", "n") == rows(asof.following(df, "v", ["k"], ["at", "id"], "n"), "k", "at", "id", "n")
    assert asof.find_cuts(df, ["k"], "at", 1000) is None is asof.find_cuts(df.limit(0), ["k"], "at", 1)


def test_nothing_is_sorted_or_written_for_short_streams(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    plan = asof.scan(df, ["k"], ["at"], {"s": ("sum", "at"), "p": ("previous", "at"), "l": ("last", "at")}, asof.find_cuts(df, ["k"], "at", asof.MOST))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_steady_rate_by_brute_force(spark):
    r = random.Random(6)
    frames = [(s, t, i % 7 if s == 1 else i) for s in (1, 2) for i, t in enumerate(sorted(r.choices(range(-50, 400), k=60)))] + [(3, 5, 1), (None, 1, 1), (4, None, 1)]
    want = []
    for s in (1, 2, 3):
        own = [(t, f) for k, t, f in frames if k == s]
        last, run = None, 0
        for at in range(min(own)[0], max(own)[0] + 1, 9):
            shown = max(x for x in own if x[0] <= at)[1]
            run = run + 1 if shown == last else 0
            want.append((s, at, shown, run > 0, run))
            last = shown
    df = spark.createDataFrame(frames, "source long, at long, frame_id long")
    for most in (None, 5):
        assert rows(joins.steady_rate(df, 9, most), "source", "at", "frame_id", "is_repeat", "run") == want


def test_a_long_span_of_ticks(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 9_000_000, 2)], "source long, at long, frame_id long")
    got = joins.steady_rate(df, 3).agg(F.count("*"), F.max("run"), F.sum("at")).first()
    assert got[:] == (3_000_001, 2_999_999, 3 * 3_000_000 * 3_000_001 // 2)


def test_logs_before_any_header_are_no_record(spark):
    head = "2024-01-01T00:00:00.000+00:00 INFO [thread=main] [element=Queue] [name=q] event=eos phase=received"
    lines = spark.createDataFrame([("none", i, f"line {i}") for i in range(50)] + [("late", i, head if i in (5, 8) else f"b{i}") for i in range(10)], "file string, line_no long, line string")
    for most in (None, 3):
        assert rows(ops.parse_logs(lines, most), "file", "line_no", "body") == [("late", 5, "b6\nb7"), ("late", 8, "b9")]


def test_codec_runs_of_one_long_stream(spark):
    packets = spark.createDataFrame([(1, i, "VP8" if i % 50 < 20 else "AV1", b"x") for i in range(400)], "stream_id long, seq long, codec string, payload binary")
    assert rows(bitstream.probe_codec(packets, 30), "run", "codec", "ready_seq") == rows(bitstream.probe_codec(packets), "run", "codec", "ready_seq") == [(2 * k + j, c, 50 * k + o) for k in range(8) for j, (c, o) in enumerate((("VP8", 0), ("AV1", 20)))]


def test_registrations_and_losses_in_pieces(spark):
    regs = spark.createDataFrame([(1, k, 10 * k) for k in range(20)], "name int, reg_id long, valid_from long")
    sent = spark.createDataFrame([(1, k, t) for k in (0, 5, 19, 33) for t in range(0, 250, 7)], "name int, reg_id long, at long")
    plain, pieces = ([rows(x, "reg_id", "at") for x in joins.current_registration(sent, regs, most)] for most in (None, 3))
    assert plain == pieces == [[(k, t) for k, t in rows(sent, "reg_id", "at") if k < 20 and t >= 10 * k and (t < 10 * k + 10 or k == 19)], [(k, t) for k, t in rows(sent, "reg_id", "at") if not (k < 20 and t >= 10 * k and (t < 10 * k + 10 or k == 19))]]
    frames = spark.createDataFrame([(1, 10 * i + i // 4, 10) for i in range(40)], "input int, pts long, n_samples long")
    dropped = spark.createDataFrame([(1, "Dropped")], "input int, event string")
    assert rows(audio.capture_loss(frames, dropped, 5)) == rows(audio.capture_loss(frames, dropped)) == [(1, 9, 9, 1)]


def test_order_in_pieces(spark):
    p = spark.createDataFrame([(f, t, q, None if q == 3 else (q * 7) % 11 * 1000, 1, 1000) for f in (1, 2) for t in (0, 1) for q in range(12)], "stream_id long, track_id int, seq long, dts long, tb_num int, tb_den int")
    whole = rows(tracks.interleave(p), "stream_id", "track_id", "seq", "file_seq")
    assert whole == rows(tracks.interleave(p, most=3), "stream_id", "track_id", "seq", "file_seq")
    assert [r[3] for r in sorted(whole, key=lambda r: (r[0], r[3]))] == [*range(1, 25)] * 2 and {r[3] for r in whole if r[2] == 3} == {1, 2}
    head = "2024-01-01T00:00:00.000+00:00 INFO [thread=main] [element=Queue] [name=q] event=eos phase=received"
    lines = spark.createDataFrame([("f", i, head if i % 5 == 1 else f"body {i}") for i in range(23)], "file string, line_no long, line string")
    assert rows(ops.parse_logs(lines), "line_no", "body") == rows(ops.parse_logs(lines, 4), "line_no", "body")


def drain(spark, files, stream_of, tmp_path, mode="append"):
    from reelwork.jobs.stream_jobs import ROCKSDB

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out, source = [], f"{tmp_path}/in"
    for i, f in enumerate(files):
        f.coalesce(1).write.mode("append").parquet(source)
        stream = stream_of(spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(source))
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).trigger(availableNow=True).start().awaitTermination()
    return out


def at_seconds(df, column, scale=1000):
    return df.withColumn("ts", F.timestamp_millis(F.col(column) * scale + 10**9))


#: A row of another key that moves the watermark past all others.
FAR = 10**6


def test_live_segments_of_audio_and_at_the_end(spark, tmp_path):
    schema = "stream_id long, pts long, seq long, kind string, is_key boolean, size long, has_video boolean, is_end boolean"
    audio_only = [(1, i * 10, i, "audio", False, 1, False, i == 9) for i in range(10)]
    video = [(2, i * 10, i, "video", i % 4 == 0, 1, True, False) for i in range(10)]
    files = [[r for r in audio_only + video if lo <= r[2] < lo + 5] for lo in (0, 5)] + [[(3, FAR, 0, "audio", False, 1, False, False)]]
    frames = [at_seconds(spark.createDataFrame(f, schema), "pts") for f in files]
    got = drain(spark, frames, lambda s: live.stream_segment(s.withWatermark("ts", "1 second"), 30), tmp_path)
    assert sorted(got) == [(1, 0, 0, 3, 3), (1, 1, 30, 3, 3), (1, 2, 60, 3, 3), (1, 3, 90, 1, 1), (2, 0, 0, 4, 4), (2, 1, 40, 4, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_give_the_segments_of_the_batch_form(spark, tmp_path, seed):
    r = random.Random(seed)
    schema = "stream_id long, pts long, seq long, kind string, is_key boolean, size long, has_video boolean, is_end boolean"
    packets = [(k, i, i, "video", r.random() < 0.3, r.randint(1, 9), True, i == 59) for k in (1, 2) for i in range(60)]
    slices = [[p for p in packets if (p[1] + 7919 * (p[1] + p[0]) % 12) // 15 == k] for k in range(5)] + [[(3, FAR, 0, "audio", False, 1, False, False)]]
    for f in slices:
        r.shuffle(f)
    slices[1] += [(1, None, 1, "video", True, 1, True, True), (None, 20, 1, "video", True, 1, True, True)]  # in no segment
    frames = [at_seconds(spark.createDataFrame(f, schema), "pts") for f in slices]
    got = drain(spark, frames, lambda s: live.stream_segment(s.withWatermark("ts", "13 seconds"), 7), tmp_path)
    batch = segments.segment(spark.createDataFrame(packets, schema).withColumn("track_id", F.lit(0)), 7)
    want = batch.groupBy("stream_id", "segment").agg(F.min("pts"), F.count("*"), F.sum("size"))
    assert sorted(got) == sorted(tuple(x) for x in want.collect()) and sum(map(len, slices)) == 123


def test_frames_from_before_an_end_stay_gone(spark, tmp_path):
    row = lambda *f: spark.createDataFrame(list(f), "input long, seq long, event string, frame_id long")
    files = [row((1, 5, "frame", 50)), row((1, 9, "end", None)), row((1, 7, "frame", 70)), row((1, 12, "frame", 120), (1, 11, "end", None)), row((1, 10, "frame", 100))]
    got = drain(spark, files, live.stream_latest, tmp_path, "update")
    assert got == [(1, 5, 50), (1, 9, None), (1, 12, 120)]


def test_codec_of_live_streams(spark, tmp_path):
    sps, small = bytes.fromhex("67640028acd940780227e5c044000003000400000300f03c60c658"), bytes.fromhex("6742001eda0a3640")
    sets = lambda *units: b"".join(b"\x00\x00\x01" + u for u in units)
    packets = [
        (1, 1, "H264", sets(b"\x68\x01")), (1, 2, "H264", sets(b"\x65")), (1, 3, "H264", sets(sps)), (1, 4, "H264", sets(small, b"\x68\x02")), (1, 5, "VP8", b"\x01"), (1, 6, "H264", sets(sps)), (1, 7, "H264", sets(b"\x68\x03")),
        (2, 1, "H264", sets(sps[:5], b"\x68")), (2, 2, "H264", None), (2, 3, "H264", b""), (2, 9, "H264", sets(small)), (4, 2, None, None),
    ]
    schema = "stream_id long, seq long, codec string, payload binary"
    batch = rows(bitstream.probe_codec(spark.createDataFrame(packets, schema)), "stream_id", "run", "codec", "ready_seq", "sps", "pps", "width", "height")
    assert [(r[0], r[1], r[3], r[6]) for r in batch] == [(1, 0, 3, 1920), (1, 1, 5, None), (1, 2, 7, 1920), (2, 0, 9, 160), (4, 0, 2, None)]
    orders = [(3, 1, 2), (5, 4), (7, 6, 9)]
    files = [[p for p in packets if p[1] in seqs] for seqs in orders] + [[(3, FAR, "H264", None)]]
    frames = [at_seconds(spark.createDataFrame(f, schema), "seq") for f in files]
    got = drain(spark, frames, lambda s: live.stream_probe_codec(s.withWatermark("ts", "3 seconds")), tmp_path)
    assert sorted(got) == sorted(batch)


def test_live_codec_takes_no_set_of_unknown_profile(spark, tmp_path):
    sets = lambda *units: b"".join(b"\x00\x00\x01" + u for u in units)
    # Ids as digits, as the media tables hold them, which would parse by chance.
    digits = [b"\x67" + str(i).encode() for i in (101694, 113658, 126619, 389139, 599998)]
    good = bytes.fromhex("6742001eda0a3640")
    packets = [(1, i, "H264", sets(u, b"\x68\x01")) for i, u in enumerate([*digits, good, *digits])]
    schema = "stream_id long, seq long, codec string, payload binary"
    frames = [at_seconds(spark.createDataFrame(f, schema), "seq") for f in (packets[6:2:-1] + packets[:2], packets[2:3] + packets[7:], [(3, FAR, "VP8", None)])]
    got = drain(spark, frames, lambda s: live.stream_probe_codec(s.withWatermark("ts", "20 seconds")), tmp_path)
    assert [(r[0], r[1], r[3], r[6]) for r in got] == [(1, 0, len(digits), 160)]


def test_files_are_forgotten_after_their_time(spark, tmp_path):
    at = lambda *e: spark.createDataFrame([(f, t, "Eos", s, s) for f, t, s in e], "file_id long, track_id int, event string, at long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    files = [at((1, 0, 100), (2, 0, 100)), at((2, 1, 150), (3, 0, 5000)), at((3, 1, 5001), (1, 1, 5002)), at((1, 0, 5003))]
    got = drain(spark, files, lambda s: live.stream_finalize(s.withWatermark("ts", "1 second"), 2, 1_000_000), tmp_path)
    # File 1's first track is forgotten when its second one ends; it is final once both were heard again.
    assert sorted(got) == [(1, 5003), (2, 150), (3, 5001)]


def chain_of(points, start, gap):
    out = [start]
    while later := [v for v in points if v >= out[-1] + gap]:
        out.append(min(later))
    return out


@pytest.mark.parametrize("gap", [1, 7, 60, 10_000])
def test_greedy_chains_fold_or_double(spark, gap):
    r = random.Random(gap)
    points = {k: sorted(r.choices(range(-40, 900), k=n)) for k, n in ((1, 150), (2, 20), (3, 1), (4, 90))}
    starts = {1: -50, 2: points[2][0], 3: points[3][0], 4: 300, 5: 8}
    p = spark.createDataFrame([(k, v) for k, vs in points.items() for v in vs] + [(6, 1), (None, 1), (1, None)], "key long, v long")
    s = spark.createDataFrame([*starts.items(), (None, 3)], "key long, v long")
    want = [(k, n, v) for k, start in sorted(starts.items()) for n, v in enumerate(chain_of(points.get(k, []), start, gap))]
    for most in (None, 30, 1):
        assert rows(greedy.greedy(p, s, gap, most), "key", "n", "v") == want


@pytest.mark.parametrize("with_pauses", [False, True])
def test_cadence_without_a_fold(spark, with_pauses):
    r = random.Random(9)
    ticks, pauses = [], []
    for s in (1, 2, 3):
        now, n = 0, 0
        for _ in range(150):
            now += r.choice([1, 10, 48, 50, 50, 52, 130, 700])
            if with_pauses and r.random() < 0.25:
                pauses.append((s, now, r.choice([0, 5, 60, 400])))
            else:
                n += 1
                ticks.append((s, n, now))
    t = spark.createDataFrame(ticks, "source long, n long, now long")
    p = spark.createDataFrame(pauses, "source long, now long, paused_for long") if with_pauses else None
    folded, spread = (rows(timeline.cadence(t, 50, p, most), "source", "n", "now", "due", "missed") for most in (None, 20))
    assert folded == spread and len(folded) == len(ticks) and sum(x[4] for x in folded) > 50


def test_ramps_of_one_long_input(spark):
    r = random.Random(2)
    changes = [(1, at, r.choice([None, 0.0, 0.5, 1.0]), r.random() < 0.1, r.random() < 0.15) for at in sorted(r.sample(range(3000), 200))]
    df = spark.createDataFrame(changes, "input long, at long, gain double, muted boolean, reset boolean")
    gain = target = None
    step, since, left, want = 0.0, 0, 0, []
    for _, at, g, muted, snaps in changes:
        new = None if g is None else 0.0 if muted else g
        if new is None and (not snaps or target is None):
            continue
        new = target if new is None else new
        if target is None or snaps:
            gain, target, step, since, left = new, new, 0.0, at, 0
        elif new == target:
            continue
        else:
            done = min(left, at - since)
            gain = target if done == left else gain + step * done
            target, since, left, step = new, at, 20, (new - gain) / 20
        want.append((at, round(gain, 9), target, round(step, 9), left))
    for most in (None, 20):
        got = [(a, round(g, 9), t, round(s, 9), n) for a, g, t, s, n in rows(audio.ramps(df, 20, most), "at", "start_gain", "target", "step", "n")]
        assert got == want


@pytest.mark.parametrize("least", [0.05, 0.3, 1.0])
def test_crowded_frames_meet_in_a_grid(spark, least):
    r = random.Random(5)
    size = lambda: r.choice([0.0, 0.3, 1.0, 4.0, 5.0, 8.0, 30.0, 100.0]) * r.choice([1.0, 1.1])
    boxes = [(f, c, i, 0.5, r.choice([r.uniform(-50, 50), 3.0]), r.choice([r.uniform(-50, 50), 3.0]), size(), size()) for f in (1, 2) for c in (0, 1) for i in range(60)]
    df = spark.createDataFrame(boxes, "frame_id long, class_id int, det_id long, score double, x double, y double, w double, h double")
    cols = ["frame_id", "class_id", "det_a", "det_b", "iou"]
    plain = rows(detect.iou_pairs(df, least), *cols)
    assert plain == rows(detect.iou_pairs(df, least, crowd=10), *cols) and plain


def test_comparisons_grow_with_neighbours_only(spark):
    boxes = spark.range(4000).select(F.lit(1).alias("frame_id"), F.lit(0).alias("class_id"), F.col("id").alias("det_id"), (F.col("id") % 100 * 10.0).alias("x"), (F.floor(F.col("id") / 100) * 10.0).alias("y"), F.lit(9.0).alias("w"), F.lit(9.0).alias("h"))
    side = lambda df, s, *more: df.select("frame_id", "class_id", *more, *[F.col(c).alias(f"{s}_{c}") for c in ("det_id", "x", "y", "w", "h")])
    assert detect._neighbours(boxes, 0.3, side).count() < 20 * 4000 < 4000 * 3999 / 2 and detect.iou_pairs(boxes, 0.3).count() == 0


def test_outbound_choices_are_checked(spark):
    allowed = spark.createDataFrame([(1, "VP8"), (1, "H264"), (2, "Opus")], "connection int, codec string")
    choices = spark.createDataFrame([(1, 10, "AV1"), (1, 20, "VP8"), (1, 30, "Opus"), (1, 40, "H264"), (3, 5, "VP8"), (2, 7, None)], "connection int, at long, codec string")
    assert rows(tracks.checked_choices(choices, allowed).where("error is not null"), "connection", "at", "error") == [(1, 10, "codec_not_negotiated"), (1, 30, "codec_not_negotiated"), (2, 7, "codec_not_negotiated"), (3, 5, "codec_not_negotiated")]
    packets = spark.createDataFrame([(1, t) for t in (5, 15, 20, 35, 50)] + [(2, 9), (3, 9)], "connection int, at long")
    got = rows(tracks.outbound_codecs(packets, choices, allowed), "connection", "at", "codec", "error")
    no = "codec_not_declared"
    assert got == [(1, 5, None, no), (1, 15, None, no), (1, 20, "VP8", None), (1, 35, "VP8", None), (1, 50, "H264", None), (2, 9, None, no), (3, 9, None, no)]


def test_folds_see_whole_keys_after_unions_of_aggregates(spark):
    """Where both sides of a union are dealt by the key already, a plain repartition would be left out."""
    p = spark.range(2000).select((F.col("id") % 37).alias("key"), (F.col("id") * 7 % 1000).alias("v"))
    points, starts = p.groupBy("key", "v").count().join(p.groupBy("key").agg(F.max("v").alias("m")), "key"), p.groupBy("key").agg(F.min("v").alias("v"))
    got = greedy.greedy(points, starts, 100)
    assert got.groupBy("key", "n").count().where("count > 1").count() == 0 and got.where("n = 0").count() == 37


def test_segments_share_files_but_are_whole(spark, tmp_path):
    packets = spark.range(6000).selectExpr("id % 300 as stream_id", "id div 300 div 5 as segment", "id as dts", "id % 2 as track_id", "id as seq")
    segments.write_segments(packets, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out").withColumn("file", F.input_file_name())
    each = back.groupBy("stream_id", "name").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    assert rows(each.groupBy("n", "files").count(), "n", "files", "count") == [(5, 1, 1200)]
    assert back.select("name").distinct().count() == 4 and back.select("file").distinct().count() <= 16


def test_ordered_streams_share_few_keys(spark, tmp_path):
    """Many streams in two buckets give what each gives alone, and rows are held in packs."""
    batches = [[(s, f"2024-01-01 00:00:{t:02d}", t * 10 + s, t, "video", True, 1, True, t == 39) for s in range(40) for t in random.Random(s + k).sample(range(10 * k, 10 * k + 10), 10)] for k in range(4)]
    schema = "stream_id int, ts string, pts long, seq int, kind string, is_key boolean, size int, has_video boolean, is_end boolean"
    frames = [spark.createDataFrame(b, schema).withColumn("ts", F.col("ts").cast("timestamp")) for b in batches]
    late = spark.createDataFrame([(99, "2024-01-01 01:00:00", 0, 0, "video", True, 1, True, False)], schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(spark, [*frames, late], lambda s: live.stream_segment(s.withWatermark("ts", "11 seconds"), 45, 2), tmp_path)
    want = [(s, n, 50 * n + s, 5, 5) for s in range(40) for n in range(8)]
    assert sorted(got) == want
    table = live.pa.table({"ms": list(range(20_000))})
    assert len(live._packs(table)) == 3 and live._unpacked(iter(live._packs(table)), {"ms": live.pa.int64()}).equals(table)


def test_playlists_share_files_but_are_whole(spark, tmp_path):
    texts = spark.range(300).selectExpr("id as stream_id", "concat_ws('\n', '#EXTM3U', transform(sequence(0, id % 7), i -> concat('v/', id, '_', i)), '', '#EXT-X-ENDLIST') as playlist")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "a\r\nb\n"), (None, "c\nd"), (1 << 40, "e")], "stream_id long, playlist string")
    segments.write_playlist(texts.union(odd), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out").withColumn("file", F.input_file_name())
    entry = F.array_sort(F.collect_list(F.struct("line", "value")))
    whole = back.groupBy("stream_id").agg(F.count_distinct("file").alias("files"), F.array_join(F.transform(entry, lambda e: e["value"]), "\n").alias("playlist"))
    got = {r["stream_id"]: r["playlist"] for r in whole.collect()}
    assert got == {r["stream_id"]: r["playlist"] or "" for r in texts.union(odd).collect()} and len(got) == 305
    assert whole.where("files > 1").count() == 0 and back.select("file").distinct().count() <= 16
    # Within its file a playlist stands in order, in one place.
    for f in (tmp_path / "out").glob("*.parquet"):
        placed = [(r["stream_id"], r["line"]) for r in spark.read.parquet(f"file://{f}").collect()]
        assert placed == sorted(placed, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    segments.write_playlist(texts, f"file://{tmp_path}/each", each=True)
    assert (tmp_path / "each" / "stream_id=8").is_dir() and next((tmp_path / "each" / "stream_id=8").glob("*.txt")).read_text() == "#EXTM3U\nv/8_0\nv/8_1\n\n#EXT-X-ENDLIST\n"
