"""Greedy chains: from a start, always the first point that lies far enough on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import find_cuts, running_sum, scan
from .staging import clustered, stage


def greedy(points: DataFrame, starts: DataFrame, gap: int, most: int | None = None) -> DataFrame:
    """(key, n, v): the chain of each key of ``starts`` (key, v): number 0 is the start, and each next one
    the least v of ``points`` (key, v) that is at least ``gap`` higher.

    Keys are folded side by side, sorted in partitions, batch by batch. A key with more than ``most``
    points goes over tasks instead: one scan gives each point the one that would follow it, pointers are
    doubled to 2, 4, 8, ... places on, and from the longest to the shortest they mark the chain. Nulls are
    no points.
    """
    points, starts = (df.select("key", F.col("v").cast("bigint").alias("v")).where("key is not null and v is not null") for df in (points, starts))
    cuts = find_cuts(points, ["key"], "v", most)
    if cuts is None:
        return _folded(points, starts, gap)
    hot = cuts.sent(cuts.table.select(F.col("_scan_k0").alias("key")))
    apart = lambda how: (df.join(hot, "key", how) for df in (points, starts))
    return _folded(*apart("left_anti"), gap).unionByName(_doubled(*apart("left_semi"), gap, most))


def _folded(points: DataFrame, starts: DataFrame, gap: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, n = None, 0, 0
        for pdf in batches:
            keys, at, is_point = (pdf[c].to_numpy() for c in ("key", "v", "is_point"))
            edges = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            out, lo = [], 0
            for hi in edges if len(keys) else []:
                if keys[lo] != key or not is_point[lo]:
                    key, last, n = int(keys[lo]), int(at[lo]), 0
                    out.append((key, n, last))
                    lo += 1
                while (i := lo + np.searchsorted(at[lo:hi], last + gap)) < hi:
                    last, n = int(at[i]), n + 1
                    out.append((key, n, last))
                lo = hi
            yield pd.DataFrame(out, columns=["key", "n", "v"]).astype("int64")

    known = points.join(starts.select("key").distinct(), "key", "left_semi").withColumn("is_point", F.lit(True))
    rows = known.unionByName(starts.withColumn("is_point", F.lit(False)))
    return clustered(rows, "key").sortWithinPartitions("key", "is_point", "v").mapInPandas(run, "key long, n long, v long")


def _doubled(points: DataFrame, starts: DataFrame, gap: int, most: int | None) -> DataFrame:
    points = points.distinct()
    nodes = points.unionByName(starts).distinct()
    # Backwards, so that what was seen last before a node's ask is the first point from there on.
    given = points.select("key", (-F.col("v")).alias("_at"), F.lit(0).alias("_side"), F.col("v").alias("next"), F.lit(None).cast("bigint").alias("v"))
    asked = nodes.select("key", (-F.col("v") - gap).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("next"), "v")
    both = given.unionByName(asked)
    found = scan(both, ["key"], ["_at", "_side"], {"next": ("last", "next")}, find_cuts(both, ["key"], "_at", most))
    jumps = [stage(found.where("_side = 1 and next is not null").select("key", "v", "next"), "jumps")]
    while True:
        far = jumps[-1].join(jumps[-1].select("key", F.col("v").alias("next"), F.col("next").alias("_next")), ["key", "next"])
        far = stage(far.select("key", "v", F.col("_next").alias("next")), "jumps")
        if far.isEmpty():
            break
        jumps.append(far)
    chain = stage(starts, "chain")
    for jump in reversed(jumps):
        chain = stage(chain.unionByName(chain.join(jump, ["key", "v"]).select("key", F.col("next").alias("v"))), "chain")
    one = chain.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(one, "_one", ["key"], ["v"], "n", find_cuts(chain, ["key"], "v", most)).select("key", "n", "v")
