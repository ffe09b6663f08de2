"""Detections: decoding model output, overlap, suppression, labels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import clustered


def decode_candidates(raw: DataFrame, least: float, output: str = "output") -> DataFrame:
    """Model rows [cx, cy, w, h, one score per class]: the best class (the first of equals), its
    score and the top-left box, where the score reaches ``least``."""
    scores = F.slice(output, F.lit(5), F.size(output) - 4)
    best = raw.withColumn("_s", scores).withColumn("score", F.array_max("_s")).where(F.col("score") >= least)
    out = F.col(output)
    return best.select(*[c for c in raw.columns if c != output], (F.array_position("_s", F.col("score")) - 1).cast("int").alias("class_id"), "score", (out[0] - out[2] / 2).alias("x"), (out[1] - out[3] / 2).alias("y"), out[2].alias("w"), out[3].alias("h"))


def iou(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Overlap of two boxes; 0 if their union has no area."""
    across = F.greatest(F.lit(0.0), F.least(a("x") + a("w"), b("x") + b("w")) - F.greatest(a("x"), b("x")))
    down = F.greatest(F.lit(0.0), F.least(a("y") + a("h"), b("y") + b("h")) - F.greatest(a("y"), b("y")))
    union = a("w") * a("h") + b("w") * b("h") - across * down
    return F.when(union > 0, across * down / union).otherwise(F.lit(0.0))


#: Boxes of a class in a frame from which on a grid decides what is compared.
CROWD = 256


def iou_pairs(dets: DataFrame, least: float, crowd: int = CROWD) -> DataFrame:
    """Pairs det_a < det_b of one frame and class that overlap by at least ``least``. The pairs are
    the result; boxes meet only within a class. Where a class has more than ``crowd`` boxes in a frame and
    ``least`` is above 0, only boxes that are near and of like size are compared."""
    cols = ["det_id", "x", "y", "w", "h"]
    side = lambda df, s, *more: df.select("frame_id", "class_id", *more, *[F.col(c).alias(f"{s}_{c}") for c in cols])
    keys = ["frame_id", "class_id"]
    if least <= 0:
        few, crowded = dets, None
    else:
        many = dets.groupBy(*keys).count().where(F.col("count") > crowd).select(*keys)
        few, crowded = dets.join(many, keys, "left_anti"), dets.join(many, keys, "left_semi")
    over = iou(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    out = lambda pairs: pairs.select(*keys, F.least("a_det_id", "b_det_id").alias("det_a"), F.greatest("a_det_id", "b_det_id").alias("det_b"), over.alias("iou")).where(F.col("iou") >= least)
    pairs = out(side(few, "a").join(side(few, "b"), keys).where("a_det_id < b_det_id"))
    return pairs if crowded is None else pairs.unionByName(out(_neighbours(crowded, least, side)))


def _neighbours(dets: DataFrame, least: float, side: Callable[..., DataFrame]) -> DataFrame:
    """Pairs of boxes of one frame and class that could overlap by ``least``. A box's level is the power of
    two in its longer side, and the cells of a level are so wide. Boxes whose longer sides differ by more
    than 1 / least can't overlap so much: each box meets those of its own level and of some below in the
    cells of its level that it touches, and a pair counts in the one cell in which its overlap begins."""
    level = F.floor(F.log2(F.greatest("w", "h"))).cast("int")
    boxes = dets.where("w > 0 and h > 0 and x is not null and y is not null").withColumn("_own", level)
    cell = lambda at: F.floor(at / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")

    def touching(df: DataFrame) -> DataFrame:
        df = df.withColumn("cx", F.explode(F.sequence(cell(F.col("x")), cell(F.col("x") + F.col("w")))))
        return df.withColumn("cy", F.explode(F.sequence(cell(F.col("y")), cell(F.col("y") + F.col("h")))))

    up = math.ceil(-math.log2(least)) if least < 1 else 0
    smaller = touching(boxes.withColumn("level", F.explode(F.sequence("_own", F.col("_own") + up))))
    larger = touching(boxes.withColumn("level", F.col("_own")))
    place = ["frame_id", "class_id", "level", "cx", "cy"]
    met = side(smaller, "a", *place[2:], F.col("_own").alias("a_own")).join(side(larger, "b", *place[2:]), place)
    once = (F.col("a_own") < F.col("level")) | (F.col("a_det_id") < F.col("b_det_id"))
    begins = (cell(F.greatest("a_x", "b_x")) == F.col("cx")) & (cell(F.greatest("a_y", "b_y")) == F.col("cy"))
    return met.where(once & begins)


def _kept(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, most: float) -> np.ndarray:
    """Greedy choice among the boxes of each group (rising numbers), in order: one that overlaps a kept box
    by more than ``most`` goes. All groups take a step at once: the first box that is left in each stays,
    and what it suppresses goes."""
    alive, keep = np.arange(len(x)), []
    while len(alive):
        g = group[alive]
        first = np.append(True, g[1:] != g[:-1])
        keep.append(alive[first])
        i = np.repeat(alive[first], np.diff(np.append(np.flatnonzero(first), len(alive))))[~first]
        alive = alive[~first]
        across = np.maximum(0, np.minimum(x[i] + w[i], x[alive] + w[alive]) - np.maximum(x[i], x[alive]))
        down = np.maximum(0, np.minimum(y[i] + h[i], y[alive] + h[alive]) - np.maximum(y[i], y[alive]))
        inter = across * down
        union = w[i] * h[i] + w[alive] * h[alive] - inter
        alive = alive[np.where(union > 0, inter / np.where(union > 0, union, 1), 0) <= most]
    return np.sort(np.concatenate(keep)) if keep else np.array([], dtype=int)


def nms(dets: DataFrame, most: float, least_score: float = 0.0) -> DataFrame:
    """The boxes that greedy suppression keeps per frame and class: highest score first, equal
    scores by det_id; only kept boxes suppress."""

    cols = ["frame_id", "class_id", "det_id", "score", "x", "y", "w", "h"]
    rows = dets.select(*cols).where(F.col("score") >= least_score)
    # One sorted pass per partition: calling pandas once per (small) group would cost far more.
    parts = clustered(rows, "frame_id", "class_id").sortWithinPartitions("frame_id", "class_id", F.desc("score"), "det_id")

    def each(batches):
        parts: list[pd.DataFrame] = []  # of the last group, which may go on
        for pdf in batches:
            if not len(pdf):
                continue
            f, c = pdf["frame_id"].to_numpy(), pdf["class_id"].to_numpy()
            last = (f == f[-1]) & (c == c[-1])
            if parts and (parts[-1]["frame_id"].iloc[-1] != f[0] or parts[-1]["class_id"].iloc[-1] != c[0]):
                yield groups(pd.concat(parts, ignore_index=True))
                parts = []
            if not last.all():
                yield groups(pd.concat([*parts, pdf[~last]], ignore_index=True))
                parts = []
            parts.append(pdf[last])
        if parts:
            yield groups(pd.concat(parts, ignore_index=True))

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        f, c = pdf["frame_id"].to_numpy(), pdf["class_id"].to_numpy()
        group = np.cumsum(np.append(False, (f[1:] != f[:-1]) | (c[1:] != c[:-1])))
        return pdf.iloc[_kept(group, *(pdf[k].to_numpy(float) for k in "xywh"), most)]

    return parts.mapInPandas(each, rows.schema)


def label_detections(dets: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels``: class_id, label; unknown classes have none."""
    return dets.join(labels, "class_id", "left")


def top_detections(dets: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("frame_id").orderBy(F.desc("score"), "det_id")
    return dets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def detect_frames(frames: DataFrame, load_model: Callable[[], Callable[[np.ndarray], np.ndarray]], least: float, most: float) -> DataFrame:
    """Runs a detector on frames (frame_id, width, height, pixels as RGB bytes): the model is loaded
    once per task, gets a planar float image in 0..1 and gives candidate rows; then threshold and
    suppression."""

    def run(batches):
        model = load_model()
        for pdf in batches:
            for frame, w, h, data in zip(pdf["frame_id"], pdf["width"], pdf["height"], pdf["pixels"], strict=True):
                planes = np.frombuffer(data, np.uint8).reshape(h, w, 3).transpose(2, 0, 1).astype(np.float32) / 255
                out = np.asarray(model(planes), dtype=float)
                if len(out):
                    yield pd.DataFrame({"frame_id": frame, "det_id": np.arange(len(out)), "output": list(out)})

    raw = frames.select("frame_id", "width", "height", "pixels").mapInPandas(run, "frame_id long, det_id long, output array<double>")
    return nms(decode_candidates(raw, least), most)
