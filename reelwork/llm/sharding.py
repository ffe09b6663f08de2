"""Resharding by minimum-cost flow: new shard sizes near equal, the fewest bytes moved.

The old layout has one shard per hash class of the text. From the old shards' sizes and the new
capacities one flow is solved in which a byte that stays costs nothing and a byte that moves costs
one; its transfers are cut out of the old shards as blocks of consecutive documents. Documents are
dealt in classes of falling size: each class fills its part of the blocks, and what the ends of its
blocks leave too much or too little is put right by the flow of what is still to be dealt, so that
shards are even but for half a small document at each end of a block. Every shard that gains or loses
documents is then written whole, in the order of its slots; shards that do neither aren't touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, new_path, stage, table

SHARDS, OLD_SHARDS = 24, 16
#: Least sizes of the size classes, largest first; all documents below are the last class.
CLASSES = [1 << 15, 1 << 12, 1 << 10, 1 << 8]
#: Bytes of a shard that one rewritten file spans.
FILE_BYTES = 64 << 20
#: Files grow beyond that where there would be more of them: the first key of each is sent to all tasks
#: (some 10 MB for so many).
MOST_FILES = 100_000


def transfers(have: list[int], room: list[int]) -> list[list[int]]:
    """How many bytes go from each old shard to each new one: all of ``have`` within ``room`` (its
    sum is no less), at least cost. A byte that stays in the shard of its number costs 0, one that
    moves costs 1. Successive shortest paths on a graph of shards: its size is theirs, not the data's."""
    n, m = len(have), len(room)
    flow = [[0] * m for _ in range(n)]
    left, free = list(have), list(room)
    cost = lambda i, j: int(i != j)
    while any(left):
        dist: dict[tuple[str, int], int] = {("o", i): 0 for i in range(n) if left[i]}
        back: dict[tuple[str, int], tuple[str, int]] = {}
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    a, b, c = ("o", i), ("n", j), cost(i, j)
                    if a in dist and dist[a] + c < dist.get(b, 1 << 60):
                        dist[b], back[b], changed = dist[a] + c, a, True
                    if b in dist and flow[i][j] and dist[b] - c < dist.get(a, 1 << 60):
                        dist[a], back[a], changed = dist[b] - c, b, True
        end = min((j for j in range(m) if free[j] and ("n", j) in dist), key=lambda j: dist["n", j])
        path = [("n", end)]
        while path[-1] in back:
            path.append(back[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:], strict=False))
        amount = min([left[path[0][1]], free[end], *(flow[b[1]][a[1]] for a, b in steps if a[0] == "n")])
        for a, b in steps:
            if a[0] == "o":
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        left[path[0][1]] -= amount
        free[end] -= amount
    return flow


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def rooms(left: list[int], need: int) -> list[int]:
    """What each shard still takes: what it lacks to its goal, or less, where shards beyond theirs
    leave the others too much. Its sum is ``need``, which what is lacking adds up to otherwise."""
    open_ = [max(0, x) for x in left]
    while (extra := sum(open_) - need) > 0:
        some = [j for j, x in enumerate(open_) if x]
        for j, less in zip(some, even(extra, len(some)), strict=True):
            open_[j] -= min(open_[j], less)
    return open_


def shares(have: int, room: list[int]) -> list[int]:
    """Cuts ``have`` in proportion to ``room`` (equally, where there is none), exactly to its sum."""
    room = [max(0, r) for r in room]
    total = sum(room)
    ends = [have * sum(room[: i + 1]) // total if total else have * (i + 1) // len(room) for i in range(len(room))]
    return [z - a for a, z in zip([0, *ends], ends, strict=False)]


@dataclass
class Layout:
    """rows: doc_id, th (hash of the text), size, text_crc32, copies, class, old_shard, shard, slot (of
    the first copy) and place (bytes before it in its shard), for each distinct document; old_shards:
    how many there were; total: the bytes of all; moved: those that change shards; least: those of the
    flow, the fewest that can; touched: the shards that gain or lose documents."""

    rows: DataFrame
    old_shards: int
    total: int
    moved: int
    least: int
    touched: list[int]


def _facts(old_shards: int) -> dict[str, Column]:
    """What a document's place depends on, from doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    th, size, of_class = F.xxhash64(text), (F.octet_length(text) + 8).cast("long"), F.lit(len(CLASSES))
    for k in reversed(range(len(CLASSES))):
        of_class = F.when(size >= CLASSES[k], k).otherwise(of_class)
    old_shard = F.pmod(th, F.lit(old_shards)).cast("int")
    return {"doc_id": F.col("doc_id").cast("long"), "th": th, "size": size, "text_crc32": F.crc32(text.cast("binary")), "old_shard": old_shard, "class": of_class.cast("int")}


def _key(facts: dict[str, Column]) -> Column:
    """A string whose order is that of class, old shard, text hash, doc_id (null first), size and CRC-32."""
    digits = lambda c, n: F.lpad(F.hex(c), n, "0")
    signed = lambda c: digits(c.bitwiseXOR(F.lit(-(1 << 63))), 16)
    doc_id = F.when(facts["doc_id"].isNull(), "0").otherwise(F.concat(F.lit("1"), signed(facts["doc_id"])))
    return F.concat(digits(facts["class"], 2), digits(facts["old_shard"], 8), signed(facts["th"]), F.rpad(doc_id, 17, "0"), digits(facts["size"], 16), digits(facts["text_crc32"], 8))


def _documents(docs: DataFrame, old_shards: int) -> DataFrame:
    facts = _facts(old_shards)
    return docs.select(*[c.alias(name) for name, c in facts.items()]).groupBy(*facts).agg(F.count("*").alias("copies"))


def resharded(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> Layout:
    """Plans where each document goes.

    ``docs``: doc_id, text, anything else. Equal texts have one old shard and lie side by side, so
    they stay together unless a block ends among them. Repeated rows are one document of several
    copies and stay together; a null text has no bytes (size 8); a null doc_id is allowed; an empty
    table gives empty shards.
    """
    spark = docs.sparkSession
    order = ["class", "old_shard", "th", "doc_id"]
    # The range partitioner's bounds come from a sample, so equal keys of a hot text are split by
    # doc_id; the stage fixes what lies where.
    ranged = _documents(docs, old_shards).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = stage(ranged, "sizes")
    weight = F.col("size") * F.col("copies")
    chunk = ["class", "old_shard", "part"]
    chunks = rows.groupBy(*chunk).agg(F.sum(weight).alias("bytes"))
    before = Window.partitionBy("class", "old_shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = stage(chunks.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "chunks")
    within = Window.partitionBy(*chunk).orderBy("th", "doc_id", "size", "text_crc32")
    local = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) - weight
    placed = rows.withColumn("local", local).join(chunks.drop("bytes"), chunk).withColumn("offset", F.col("base") + F.col("local")).drop("base", "local")
    placed = stage(placed, "offsets")

    sizes = {(r["class"], r["old_shard"]): r["bytes"] for r in chunks.groupBy("class", "old_shard").agg(F.sum("bytes").alias("bytes")).collect()}  # classes x old shards
    have = [sum(sizes.get((k, i), 0) for k in range(len(CLASSES) + 1)) for i in range(old_shards)]
    total = sum(have)
    goal, filled, cuts, moved, least, touched = even(total, shards), [0] * shards, [], 0, None, set()
    for k in range(len(CLASSES) + 1):
        flow = transfers(have, rooms([g - f for g, f in zip(goal, filled, strict=True)], sum(have)))
        least = sum(x for i, row in enumerate(flow) for j, x in enumerate(row) if i != j) if least is None else least
        own = []
        for i in range(old_shards):
            n = sizes.get((k, i), 0)
            have[i] -= n
            blocks = sorted((j for j in range(shards) if flow[i][j]), key=lambda j: (i != j, j))
            low = 0
            for j, part in zip(blocks, shares(n, [flow[i][j] for j in blocks]), strict=True):
                own.append((k, i, j, low, low + part))
                low += part
        cuts += own
        got = _assigned(placed.where(F.col("class") == k), _cut_table(spark, own)).groupBy("old_shard", "shard").agg(F.sum(weight).alias("bytes"))
        for r in got.collect():  # old shards x shards
            filled[r["shard"]] += r["bytes"]
            if r["shard"] != r["old_shard"]:
                moved += r["bytes"]
                touched |= {r["shard"], r["old_shard"]}

    now = _assigned(placed, _cut_table(spark, cuts))
    places = ["shard", *chunk]
    counts = now.groupBy(*places).agg(F.sum("copies").alias("n"), F.sum(weight).alias("bytes"))
    earlier = Window.partitionBy("shard").orderBy("class", "old_shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    counts = counts.select(*places, before("n").alias("first"), before("bytes").alias("start"))
    upto = Window.partitionBy(*places).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    out = now.withColumn("nth", F.sum("copies").over(upto) - F.col("copies")).withColumn("local", F.sum(weight).over(upto) - weight).join(counts, places)
    out = out.withColumn("slot", F.col("first") + F.col("nth")).withColumn("place", F.col("start") + F.col("local"))
    rows = stage(out.select("doc_id", "th", "size", "text_crc32", "copies", "class", "old_shard", "shard", "slot", "place"), "layout")
    return Layout(rows, old_shards, total, moved, least, sorted(j for j in touched if j < shards))


def _cut_table(spark: SparkSession, cuts: list[tuple]) -> DataFrame:
    """At most classes x (old shards + shards) rows."""
    return spark.createDataFrame(cuts, "k int, i int, shard int, low long, high long")


def _assigned(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """A document goes where its middle byte goes."""
    middle = F.col("offset") + F.floor(F.col("size") * F.col("copies") / 2)
    fits = (F.col("class") == F.col("k")) & (F.col("old_shard") == F.col("i")) & (middle >= F.col("low")) & (middle < F.col("high"))
    return placed.join(F.broadcast(cuts), fits).drop("k", "i", "low", "high")


@dataclass
class Stretches:
    """Where runs of keys go. low: the first key of each stretch, ascending; shard, file (-1: none) and
    first (its first slot) of each; files: how many."""

    low: np.ndarray
    shard: np.ndarray
    file: np.ndarray
    first: np.ndarray
    files: int

    def of(self, key: Column) -> Column:
        @F.pandas_udf("shard int, file int, first long")
        def find(keys: pd.Series) -> pd.DataFrame:
            at = np.searchsorted(self.low, keys.to_numpy().astype(self.low.dtype), side="right") - 1
            return pd.DataFrame({"shard": self.shard[at], "file": self.file[at], "first": self.first[at]})

        return find.asNondeterministic()(key)  # so that a filter on what it gives doesn't run it again


def stretches(layout: Layout, file_bytes: int = FILE_BYTES, most_files: int = MOST_FILES) -> Stretches:
    """The files that touched shards are written to, each a stretch of its shard's bytes, as stretches
    of keys. As a shard is filled from blocks of consecutive keys, these are the files' ends and the
    blocks' ends: at most ``most_files`` and two for each shard, and as many as there are blocks."""
    span = max(file_bytes, -(-layout.total // most_files))
    nth = F.when(F.col("shard").isin(layout.touched), F.floor(F.col("place") / span)).otherwise(-1)
    key = _key({c: F.col(c) for c in layout.rows.columns})
    each = layout.rows.groupBy("class", "old_shard", "shard", nth.alias("nth")).agg(F.min(key).alias("low"), F.min("slot").alias("first")).toPandas().sort_values("low")
    kept = each[each["nth"] >= 0]
    starts = kept.groupby(["shard", "nth"])["first"].min().sort_index()
    file = {place: i for i, place in enumerate(starts.index)}
    places = list(zip(each["shard"], each["nth"], strict=True))
    return Stretches(
        each["low"].to_numpy().astype("S"),
        each["shard"].to_numpy("int32"),
        np.array([file.get(p, -1) for p in places], "int32"),
        np.array([starts[p] if p in file else 0 for p in places], "int64"),
        len(file),
    )


def rewritten(docs: DataFrame, layout: Layout, path: str, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str, str]:
    """Writes every shard that gains or loses documents, with all columns of ``docs`` and the slot, to
    ``path``/(shard)=N and reads them back; the names of the shard and slot columns, which differ from
    those of ``docs``, are given too. Shards that do neither aren't written.

    A file holds a shard's documents within one stretch of its bytes, in the order of their slots, and
    each task writes one file, so that tasks are even however few shards there are. A document's file
    is found from its own columns, so that texts are shuffled once, to their files. Repeated rows of
    one document take consecutive slots.
    """
    shard, slot, to, file, first = fresh(docs, "_shard", "_slot", "_to", "_file", "_first")
    where = stretches(layout, file_bytes)
    key = _key(_facts(layout.old_shards))
    rows = docs.withColumn(to, where.of(key)).select(*docs.columns, F.col(f"{to}.shard").alias(shard), F.col(f"{to}.file").alias(file), F.col(f"{to}.first").alias(first))
    rows = rows.where(F.col(file) >= 0).repartitionById(max(1, where.files), file).sortWithinPartitions(shard, key)
    # A partition is a file, so the low bits of these ids are places within it.
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select(*docs.columns, shard, (F.col(first) + nth).alias(slot))
    rows.write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path), shard, slot


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of rewritten shards as read back from their new files, those of others from the plan."""
    docs = table(spark, sf_dir, "documents")
    layout = resharded(docs)
    files, shard, slot = rewritten(docs.select("doc_id", "text"), layout, new_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    written = files.select("doc_id", size, crc, F.col(shard).cast("int").alias("shard"), F.col(slot).alias("slot"))
    stays = layout.rows.where(~F.col("shard").isin(layout.touched)).withColumn("slot", F.explode(F.sequence("slot", F.col("slot") + F.col("copies") - 1)))
    rows = stays.select("doc_id", "size", "text_crc32", "shard", "slot").unionByName(written)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
