"""Layers, pixels and frames: geometry, coverage, blending, keying, colour, scaling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import blend, key_alpha, layer_geometry, rgb_to_ycbcr


def geometry(layers: DataFrame) -> DataFrame:
    """``layers`` with image_x, image_y, image_w, image_h and error."""
    g = layer_geometry(*[F.col(c) for c in ("fit", "x", "y", "w", "h", "src_w", "src_h", "opacity")])
    # Generated as one row, so that filters above don't repeat the whole expression.
    return layers.select(*layers.columns, F.inline(F.array(g)))


def z_order(layers: DataFrame) -> DataFrame:
    """draw: the place of each layer of a canvas from the bottom, by z_index, then by id."""
    return layers.withColumn("draw", F.row_number().over(Window.partitionBy("canvas_id").orderBy("z_index", "layer_id")))


def coverage(placed: DataFrame, width: int, height: int) -> DataFrame:
    """The canvas pixels x0 <= x < x1, y0 <= y < y1 that each visible layer covers, clipped to its
    rectangle and the canvas; layers that cover none, are hidden, transparent or in error go."""
    low = lambda a, b: F.greatest(F.col(a), F.col(b), F.lit(0))
    high = lambda a, n, b, m, most: F.least(F.col(a) + F.col(n), F.col(b) + F.col(m), F.lit(most))
    box = F.struct(low("image_x", "x").alias("x0"), low("image_y", "y").alias("y0"), high("image_x", "image_w", "x", "w", width).alias("x1"), high("image_y", "image_h", "y", "h", height).alias("y1"))
    return placed.where("error is null and visible and opacity > 0").select(*placed.columns, F.inline(F.array(box))).where("x0 < x1 and y0 < y1")


def covered_pixels(boxes: DataFrame) -> DataFrame:
    """One row per covered pixel (px, py) of each layer."""
    rows = boxes.withColumn("py", F.explode(F.sequence("y0", F.col("y1") - 1)))
    return rows.withColumn("px", F.explode(F.sequence("x0", F.col("x1") - 1)))


def composite(pixels: DataFrame, background: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """(canvas_id, px, py, r, g, b): layers blended bottom to top over a background.

    ``pixels``: canvas_id, px, py, z_index, layer_id, r, g, b, a (0..255) and opacity. Every channel
    is rounded after every layer, so this is a fold over the layers of a pixel and not a sum.
    """
    parts = F.array_sort(F.collect_list(F.struct("z_index", "layer_id", F.col("r").cast("int").alias("r"), F.col("g").cast("int").alias("g"), F.col("b").cast("int").alias("b"), (F.col("a") / 255 * F.col("opacity")).alias("alpha"))))
    start = F.struct(*[F.lit(v).alias(c) for v, c in zip(background, "rgb", strict=True)])
    stacked = pixels.where("opacity > 0 and a > 0").groupBy("canvas_id", "px", "py").agg(parts.alias("parts"))
    folded = F.aggregate("parts", start, lambda acc, p: F.struct(*[blend(p[c], acc[c], p["alpha"]).alias(c) for c in "rgb"]))
    return stacked.withColumn("c", folded).select("canvas_id", "px", "py", "c.r", "c.g", "c.b")


def chroma_key(pixels: DataFrame, key: tuple[int, int, int], threshold: float, smoothing: float) -> DataFrame:
    """``pixels`` with alpha in place of a; colours stay."""
    return pixels.withColumn("a", key_alpha(F.col("r"), F.col("g"), F.col("b"), key, threshold, smoothing))


def chroma_key_frames(frames: DataFrame, key: tuple[int, int, int], threshold: float, smoothing: float) -> DataFrame:
    """The same on whole frames whose ``pixels`` are packed BGRA bytes."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(pixels=[keyed(x) for x in pdf["pixels"]])

    def keyed(data: bytes) -> bytes:
        bgra = np.frombuffer(data, np.uint8).reshape(-1, 4).copy()
        d = np.sqrt((((bgra[:, :3].astype(float) - np.array(key[::-1])) / 255) ** 2).sum(axis=1)) / np.sqrt(3)
        t = np.where(d <= threshold, 0.0, 1.0) if smoothing <= 0 else np.clip((d - (threshold - smoothing / 2)) / smoothing, 0, 1)
        bgra[:, 3] = np.floor(np.round(t * 255, 9) + 0.5)
        return bgra.tobytes()

    return frames.mapInPandas(run, frames.schema)


def to_ycbcr(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("_c", rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))).select("frame_id", "row", "col", "_c.*")


def chroma_subsample(pixels: DataFrame) -> DataFrame:
    """(frame_id, row, col, cb, cr) of each 2 x 2 block: the average colour is converted. Frames
    with an odd side are rejected: they give no rows."""
    blocks = pixels.groupBy("frame_id", F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"), F.count("*").alias("n"))
    odd = blocks.where("n < 4").select("frame_id").distinct()
    full = blocks.join(odd, "frame_id", "left_anti")
    return full.withColumn("_c", rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))).select("frame_id", "row", "col", "_c.cb", "_c.cr")


def composite_text(pixels: DataFrame, masks: DataFrame, color: tuple[int, int, int]) -> DataFrame:
    """``pixels`` (frame_id, row, col, r, g, b, a) with one colour blended through a mask (row, col,
    coverage 0..255)."""
    joined = pixels.join(masks, ["row", "col"], "left")
    alpha = F.coalesce(F.col("coverage"), F.lit(0)) / 255
    return joined.withColumns({c: blend(F.lit(v), F.col(c), alpha) for c, v in zip("rgb", color, strict=True)}).drop("coverage")


def scale_pixels(pixels: DataFrame, width: int, height: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Bilinear resize in pixel form: each output pixel asks for its four neighbours, which one
    equi-join brings. Pixel centres lie at half steps; edges repeat."""
    size = pixels.groupBy("frame_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    grid = size.withColumn("orow", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("ocol", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))

    def axis(o: str, n: int, s: str):
        at = F.greatest((F.col(o) + 0.5) * F.col(s) / n - 0.5, F.lit(0.0))
        low = F.floor(at).cast("int")
        return F.array(F.struct(low.alias("i"), (1 - (at - low)).alias("w")), F.struct(F.least(low + 1, F.col(s) - 1).alias("i"), (at - low).alias("w")))

    asks = grid.withColumn("_r", F.explode(axis("orow", height, "h"))).withColumn("_c", F.explode(axis("ocol", width, "w")))
    asks = asks.select("frame_id", "orow", "ocol", F.col("_r.i").alias("row"), F.col("_c.i").alias("col"), (F.col("_r.w") * F.col("_c.w")).alias("weight"))
    got = asks.join(pixels, ["frame_id", "row", "col"]).groupBy("frame_id", "orow", "ocol")
    return got.agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in channels]).withColumnsRenamed({"orow": "row", "ocol": "col"})


def scale_frames(frames: DataFrame, width: int, height: int) -> DataFrame:
    """The same on whole frames of packed 3-channel bytes; the input size may change from frame to
    frame; pts and all else stay. A task holds one Arrow batch of frames."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(pixels=[scaled(p, w, h) for p, w, h in zip(pdf["pixels"], pdf["width"], pdf["height"], strict=True)], width=width, height=height)

    def scaled(data: bytes, w: int, h: int) -> bytes:
        img = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(float)
        (r0, r1, fr), (c0, c1, fc) = ends(height, h), ends(width, w)
        top = img[r0][:, c0] * (1 - fc)[None, :, None] + img[r0][:, c1] * fc[None, :, None]
        low = img[r1][:, c0] * (1 - fc)[None, :, None] + img[r1][:, c1] * fc[None, :, None]
        return np.floor(np.round(top * (1 - fr)[:, None, None] + low * fr[:, None, None], 9) + 0.5).astype(np.uint8).tobytes()

    def ends(n: int, s: int):
        at = np.maximum((np.arange(n) + 0.5) * s / n - 0.5, 0)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, s - 1), at - low

    return frames.mapInPandas(run, frames.schema)


def frames_of_pixels(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(frame_id, width, height, pixels): pixel rows packed into bytes, one frame per row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        data = pdf[list(channels)].to_numpy(np.uint8).tobytes()
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "width": [pdf["col"].max() + 1], "height": [pdf["row"].max() + 1], "pixels": [data]})

    return pixels.groupBy("frame_id").applyInPandas(run, "frame_id long, width int, height int, pixels binary")


def pixels_of_frames(frames: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The inverse: (frame_id, row, col, one column per channel) for each pixel of packed frames."""
    n = len(channels)
    at = frames.select("frame_id", "width", "pixels", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("_i"))
    value = lambda k: F.conv(F.hex(F.substring("pixels", F.col("_i") * n + k + 1, F.lit(1))), 16, 10).cast("int")
    return at.select("frame_id", F.floor(F.col("_i") / F.col("width")).cast("int").alias("row"), (F.col("_i") % F.col("width")).alias("col"), *[value(k).alias(c) for k, c in enumerate(channels)])
