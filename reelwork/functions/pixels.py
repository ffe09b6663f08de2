"""Colour and geometry on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SIDE = 16384


def key_alpha(r: Column, g: Column, b: Column, key: tuple[int, int, int], threshold: float, smoothing: float) -> Column:
    """Alpha from the distance to the key colour: 0 within the threshold, rising over the smoothing
    range around it; a hard step without smoothing."""
    squares = [F.pow((c.cast("double") - k) / 255, F.lit(2.0)) for c, k in zip((r, g, b), key, strict=True)]
    distance = F.sqrt(squares[0] + squares[1] + squares[2]) / F.sqrt(F.lit(3.0))
    if smoothing <= 0:
        return F.when(distance <= threshold, 0).otherwise(255)
    ramp = (distance - (threshold - smoothing / 2)) / smoothing
    return F.round(F.round(F.least(F.greatest(ramp, F.lit(0.0)), F.lit(1.0)) * 255, 9)).cast("int")


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> Column:
    """Full-range RGB to BT.709 limited-range luma and chroma, rounded half away from zero."""
    y = 16 + (0.2126 * r + 0.7152 * g + 0.0722 * b) * 219 / 255
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    cb = 128 + (b - luma) / 1.8556 * 224 / 255
    cr = 128 + (r - luma) / 1.5748 * 224 / 255
    clamp = lambda c: F.least(F.greatest(F.round(F.round(c, 9)), F.lit(0.0)), F.lit(255.0)).cast("int")
    return F.struct(clamp(y).alias("y"), clamp(cb).alias("cb"), clamp(cr).alias("cr"))


def _div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def layer_geometry(fit: Column, x: Column, y: Column, w: Column, h: Column, src_w: Column, src_h: Column, opacity: Column) -> Column:
    """Where an input is drawn in its rectangle: struct image_x, image_y, image_w, image_h, error.

    Stretch fills the rectangle; Contain is the largest that fits, Cover the smallest that fills it;
    both keep the aspect, round to the nearest and are at least 1. The offset is half the difference,
    truncated toward zero.
    """
    x, y, w, h, src_w, src_h = (c.cast("bigint") for c in (x, y, w, h, src_w, src_h))
    inside = lambda c: (c >= 1) & (c <= MOST_SIDE)
    bad_rect = ~(inside(w) & inside(h))
    bad_opacity = F.isnan(opacity) | (opacity < 0) | (opacity > 1)
    empty = (src_w <= 0) | (src_h <= 0)
    ok = ~bad_rect & ~bad_opacity & ~empty
    by_width = F.when(fit == "Contain", w * src_h <= h * src_w).otherwise(w * src_h > h * src_w)
    scaled = lambda s, t, d: F.when(ok, F.greatest(F.lit(1), _div(s * t + _div(d, 2), F.when(d > 0, d))))
    iw = F.when(fit == "Stretch", w).when(by_width, w).otherwise(scaled(src_w, h, src_h))
    ih = F.when(fit == "Stretch", h).when(by_width, scaled(src_h, w, src_w)).otherwise(h)
    error = F.when(bad_rect, "invalid_rect").when(bad_opacity, "invalid_opacity").when(empty, "empty_source").when((iw > MOST_SIDE) | (ih > MOST_SIDE), "scaled_too_large")
    keep = lambda c, name: F.when(error.isNull(), c).alias(name)
    return F.struct(keep(x + _div(w - iw, 2), "image_x"), keep(y + _div(h - ih, 2), "image_y"), keep(iw, "image_w"), keep(ih, "image_h"), error.alias("error"))


def blend(src: Column, dst: Column, alpha: Column) -> Column:
    """src over dst, rounded; the caller folds it layer by layer, as rounding makes order matter."""
    return F.round(F.round(src * alpha + dst * (1 - alpha), 9)).cast("int")
