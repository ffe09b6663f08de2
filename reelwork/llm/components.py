"""Connected components of a graph of links, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _both_ways(edges: DataFrame) -> DataFrame:
    """One row per end of a link: each link appears under both of its nodes."""
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds m, the least of u and its partners. The minimum is combined before the shuffle, and
    the join back can be split where one u has very many partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node reachable.

    Alternates the large-star and small-star steps until the links stand still; each turn is
    written to the shared folder, so a lost executor costs one turn at most. Rows with a null end
    or equal ends are ignored; repeated links count once; no links give an empty table.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(links, "links")
    before = _signature(now)
    while before[0]:
        large = _with_least(_both_ways(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u keeps its lower partners, and all of them point to the lowest.
        low = _with_least(large)
        nodes = low.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        turn = stage(nodes.where("u <> v").distinct(), "links")
        after = _signature(turn)
        discard(now)
        now = turn
        if after == before:
            break
        before = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
