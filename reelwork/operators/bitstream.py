"""Units of byte streams and what their parameter sets say."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import find_cuts, previous, running_sum, scan

SPS, PPS = 7, 8


def split_units(data: bytes) -> list[bytes]:
    """The non-empty units between start codes 00 00 01 and 00 00 00 01."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 3:
        return []
    codes = np.flatnonzero((raw[:-2] == 0) & (raw[1:-1] == 0) & (raw[2:] == 1))
    ends = [c - (c > 0 and raw[c - 1] == 0) for c in codes[1:]] + [len(data)]
    return [u for c, e in zip(codes, ends, strict=True) if (u := data[c + 3 : e])]


def nal_units(packets: DataFrame) -> DataFrame:
    """(stream_id, seq, codec, nal_idx, nal_type, nal_bytes, unit) of packets with payloads."""

    def run(batches):
        for b in batches:
            rows = [(s, q, c, i, u[0] & 31, len(u), u) for s, q, c, p in zip(*(x.to_pylist() for x in b.columns), strict=True) if p for i, u in enumerate(split_units(p))]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["stream_id", "seq", "codec", "nal_idx", "nal_type", "nal_bytes", "unit"])

    return packets.select("stream_id", "seq", "codec", "payload").mapInArrow(run, "stream_id long, seq long, codec string, nal_idx int, nal_type int, nal_bytes long, unit binary")


def nal_inventory(units: DataFrame) -> DataFrame:
    return units.groupBy("stream_id", "nal_type").agg(F.count("*").alias("units"), F.sum("nal_bytes").alias("bytes"))


class _Bits:
    """Reads a parameter set's bits; the emulation byte in 00 00 03 is left out."""

    def __init__(self, unit: bytes):
        clean = unit.replace(b"\x00\x00\x03", b"\x00\x00")
        self.bits, self.at = np.unpackbits(np.frombuffer(clean, np.uint8)), 0

    def u(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("the parameter set ends early")
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | int(b)
        self.at += n
        return v

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 31:
                raise ValueError("a code is too long")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


#: Profiles whose parameter sets carry chroma and scaling fields. Fixed values, in the order of the
#: public H.264 standard, whose syntax tables frame_size follows.
_HIGH = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135}
#: All profiles of the standard. Bytes of any other kind may parse by chance, the more the longer they are.
_PROFILES = _HIGH | {66, 77, 88}


def frame_size(sps: bytes) -> tuple[int, int] | None:
    """Width and height that a sequence parameter set states after cropping; None if malformed."""
    try:
        b = _Bits(sps)
        if b.u(8) & 31 != SPS:
            return None
        profile, chroma, separate = b.u(8), 1, 0
        if profile not in _PROFILES:
            return None
        b.u(16)
        b.ue()
        if profile in _HIGH:
            chroma = b.ue()
            if chroma > 3:
                return None
            separate = b.u(1) if chroma == 3 else 0
            b.ue(), b.ue(), b.u(1)
            if b.u(1):
                for i in range(8 if chroma != 3 else 12):
                    if b.u(1):
                        last = nxt = 8
                        for _ in range(16 if i < 6 else 64):
                            nxt = (last + b.se()) % 256 if nxt else 0
                            last = nxt or last
        b.ue()
        order = b.ue()
        if order == 0:
            b.ue()
        elif order == 1:
            b.u(1), b.se(), b.se()
            for _ in range(b.ue()):
                b.se()
        b.ue(), b.u(1)
        width, rows, frames_only = (b.ue() + 1) * 16, b.ue() + 1, b.u(1)
        height = rows * 16 * (2 - frames_only)
        if not frames_only:
            b.u(1)
        b.u(1)
        if b.u(1):
            left, right, top, bottom = b.ue(), b.ue(), b.ue(), b.ue()
            sub = 0 if separate else chroma
            across, down = (2 if sub in (1, 2) else 1), (2 if sub == 1 else 1) * (2 - frames_only)
            width, height = width - across * (left + right), height - down * (top + bottom)
        return (width, height) if width > 0 and height > 0 else None
    except ValueError:
        return None


def frame_sizes(sets: DataFrame) -> DataFrame:
    """(sps, width, height) of the distinct parameter sets (sps); malformed ones are left out."""

    def run(batches):
        for b in batches:
            sizes = [(x, *s) for x in b.column(0).to_pylist() if x and (s := frame_size(x))]
            columns = list(zip(*sizes, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int32()) for c in columns[1:])], names=["sps", "width", "height"])

    return sets.where("sps is not null").select("sps").distinct().mapInArrow(run, "sps binary, width int, height int")


def parameter_sets(packets: DataFrame) -> DataFrame:
    """(stream_id, seq, codec, sps, pps): each payload's last units of the two kinds, null without one."""

    def run(batches):
        for b in batches:
            last = [{u[0] & 31: u for u in split_units(p)} if p else {} for p in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([x.get(t) for x in last], pa.binary()) for t in (SPS, PPS))], names=["stream_id", "seq", "codec", "sps", "pps"])

    return packets.select(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("seq").cast("bigint").alias("seq"), "codec", "payload").mapInArrow(run, "stream_id long, seq long, codec string, sps binary, pps binary")


def probe_codec(packets: DataFrame, most: int | None = None) -> DataFrame:
    """(stream_id, run, codec, ready_seq, sps, pps, width, height) of packets (stream_id, seq, codec,
    payload): one row per stream and codec run that becomes ready. H264 is ready with the first payload
    after which both parameter sets were seen, perhaps in different ones, and the newest sequence set is
    well formed; it states the frame size. Other codecs are ready at their first payload, whatever it
    holds. A change of codec begins a new run, which has seen nothing."""
    payloads, keys = parameter_sets(packets), ["stream_id"]
    cuts = find_cuts(packets, keys, "seq", most)
    rows = previous(payloads.withColumn("_own", F.struct("codec")), ["_own"], keys, ["seq"], ["_before"], cuts)
    changed = F.col("_before").isNotNull() & ~F.col("codec").eqNullSafe(F.col("_before.codec"))
    rows = running_sum(rows.withColumn("_new", changed.cast("bigint")), "_new", keys, ["seq"], "run", cuts).withColumn("run", F.col("run") + F.col("_new"))
    h264 = F.coalesce(F.col("codec") == "H264", F.lit(False))
    known = scan(rows, ["stream_id", "run"], ["seq"], {"sps": ("last", "sps"), "pps": ("last", "pps")}, cuts)
    known = known.withColumns({c: F.when(h264, F.col(c)) for c in ("sps", "pps")})
    sized = known.join(frame_sizes(payloads), "sps", "left")
    ready = sized.where(~h264 | (F.col("width").isNotNull() & F.col("pps").isNotNull()))
    best = ready.groupBy("stream_id", "run", "codec").agg(F.min(F.struct("seq", "sps", "pps", "width", "height")).alias("b"))
    return best.select("stream_id", "run", "codec", F.col("b.seq").alias("ready_seq"), "b.sps", "b.pps", "b.width", "b.height")
