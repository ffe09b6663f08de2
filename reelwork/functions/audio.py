"""Gain and sample layout on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest and highest value of the integer sample formats.
RANGES = {"u8": (0, 255), "i16": (-(1 << 15), (1 << 15) - 1), "i32": (-(1 << 31), (1 << 31) - 1), "i64": (-(1 << 63), (1 << 63) - 1)}


def db_to_gain(db: Column) -> Column:
    """10 ** (db / 20); minus infinity is 0."""
    return F.when(db == float("-inf"), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), db / 20))


def gain_to_db(gain: Column) -> Column:
    return F.when(gain == 0, F.lit(float("-inf"))).when(gain > 0, 20 * F.log10(F.when(gain > 0, gain)))


def gain_error(gain: Column) -> Column:
    return F.when(gain.isNull() | F.isnan(gain) | (gain < 0) | (gain == float("inf")), F.lit("invalid_gain"))


def effective_gain(gain: Column, muted: Column) -> Column:
    """0 where muted, null where the gain is no finite number from 0."""
    return F.when(gain_error(gain).isNotNull(), F.lit(None).cast("double")).when(muted, F.lit(0.0)).otherwise(gain)


def _scaled(x: Column, gain: Column, fmt: str) -> Column:
    if fmt not in RANGES:
        return x * gain
    low, high = RANGES[fmt]
    middle = 128 if fmt == "u8" else 0
    y = F.greatest(F.round((x - middle) * gain) + middle, F.lit(float(low)))
    return F.when(y >= float(high), F.lit(high)).otherwise(y.cast("bigint"))


def apply_gain(samples: Column, gain: Column, fmt: str) -> Column:
    """Scales an array of samples. Integers round half away from zero and stay in range (u8 around
    128), through doubles, so that 64-bit samples beyond 2 ** 53 are the nearest double's; floats
    ('f32', 'f64') keep what exceeds 1."""
    return F.transform(samples, lambda x: _scaled(x.cast("double"), gain, fmt))


def _every(samples: Column, channels: int, c: int) -> Column:
    return F.filter(samples, lambda x, i: i % channels == c)


def to_planar(samples: Column, channels: int) -> Column:
    """Packed samples as one array per channel."""
    return F.array(*[_every(samples, channels, c) for c in range(channels)])


def to_packed(planes: Column, channels: int) -> Column:
    """The inverse: samples of one instant side by side."""
    instant = lambda i: F.array(*[planes[c][i] for c in range(channels)])
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(planes[0]) - 1), instant))
