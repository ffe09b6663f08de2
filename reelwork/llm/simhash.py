"""SimHash near-duplicates found through an inverted index of positional bytes.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most three
bits differ in at most three bytes, so they share at least five positional bytes: that count is
the guaranteed minimum. A list per single byte would hold a 256th of all fingerprints and the
tallies would grow with their square, so the index posts each fingerprint under *sets* of four
positional bytes. The fourteen sets {a, b, c, d} with a xor b xor c xor d = 0 have the property
that whichever three bytes differ, one set avoids them all; no link is lost, and a list is chosen
by 32 bits. Within a list the shared positional bytes of each pair are tallied, pairs with five or
more are kept, and their bits are counted to verify them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, stage, table
from .components import components

BYTES = 8
QUADS = [q for q in combinations(range(BYTES), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]

#: Lists longer than this are refined by one more shared byte.
REFINE_FROM = 2048
#: Refined lists longer than this are probed value by value. They share 40 bits, so none has more
#: than 2**24 members.
PROBE_FROM = 20_000


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def simhash(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text: lower-cased A-Z, words between ASCII white space, shingles of
    ``width`` words, repeats included; a bit is set if it is set in over half the shingles' XXH64."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    hashes = np.array([digest(b" ".join(s), 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) per row; a null text counts as empty, whose fingerprint is 0. fp is the
    unsigned value's two's complement."""

    def run(batches):
        for b in batches:
            texts = pc.cast(b.column(1), pa.binary()).to_pylist()
            fps = np.array([simhash(t, width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _joined(fp: np.uint64, others: np.ndarray, bits: int) -> np.ndarray:
    """Which of the others link to fp: the positional bytes are tallied first, then the bits."""
    x = others ^ fp
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    hit = shared >= BYTES - bits
    hit[hit] = np.bitwise_count(x[hit]) <= bits
    return hit


def _spanning(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span each component of one list: from one of its members to the others, so a
    list of n near copies gives n - 1 links and not all its pairs."""
    rest, out = np.unique(fps), []
    if len(rest) > PROBE_FROM:
        return _probed(rest, bits)
    while len(rest) > 1:
        start, todo, rest, seen = rest[0], [rest[0]], rest[1:], []
        while todo and len(rest):
            hit = _joined(todo.pop(), rest, bits)
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                todo += list(found)
                seen.append(found)
        if seen:
            members = np.concatenate(seen)
            out.append((np.full(len(members), start), members))
    return out


def _probed(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same links for a very long list, in time proportional to it: every value within so many
    bits is looked up among the sorted members. Such a list shares five positional bytes (or four,
    if it is no refined list), so only the bits that vary in it are flipped."""
    varies = np.bitwise_or.reduce(fps ^ fps[0])
    free = [np.uint64(1) << np.uint64(i) for i in range(64) if (int(varies) >> i) & 1]
    out = []
    for k in range(1, bits + 1):
        for flip in combinations(free, k):
            other = fps ^ np.bitwise_or.reduce(np.array(flip, dtype=np.uint64))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = (fps[at] == other) & (fps < other)
            if hit.any():
                out.append((fps[hit], other[hit]))
    return out


def _links(postings: DataFrame, bits: int) -> DataFrame:
    """(u, v) from the lists of ``postings`` (mask, key, fp), which must lie sorted in partitions
    by mask and key."""

    def run(batches):
        parts: list[np.ndarray] = []  # of the last list, which may go on
        for b in batches:
            now = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if not now.shape[1]:
                continue
            if parts and (parts[-1][:2, -1] != now[:2, 0]).any():
                yield from found(parts)
                parts = []
            cut = np.flatnonzero((now[:2, 1:] != now[:2, :-1]).any(axis=0))
            if len(cut):
                yield from found([*parts, now[:, : cut[-1] + 1]])
                now, parts = now[:, cut[-1] + 1 :], []
            parts.append(now)
        if parts:
            yield from found(parts)

    def found(parts):
        rows = np.concatenate(parts, axis=1)
        fps = np.ascontiguousarray(rows[2]).view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1, [len(fps)]])
        n, us, vs = np.diff(cuts), [], []
        twos = cuts[:-1][n == 2]
        if len(twos):
            a, b = fps[twos], fps[twos + 1]
            shared = ((a ^ b).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            ok = (shared >= BYTES - bits) & (np.bitwise_count(a ^ b) <= bits)
            us.append(a[ok])
            vs.append(b[ok])
        for i in np.flatnonzero(n > 2):
            for u, v in _spanning(fps[cuts[i] : cuts[i + 1]], bits):
                us.append(u)
                vs.append(v)
        if sum(map(len, us)):
            cols = [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)]
            yield pa.RecordBatch.from_arrays(cols, names=["u", "v"])

    return postings.select("mask", "key", "fp").mapInArrow(run, "u long, v long")


def _postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for m in masks])
    return fps.select("fp", F.explode(entries).alias("e")).select("e.mask", "e.key", "fp")


def _refined(heavy: DataFrame) -> DataFrame:
    """Posts each member of a long list again under one further byte. At most three of the four
    free bytes differ in a linked pair, so one of the four new lists has both."""
    one_more = [F.struct(F.col("mask").bitwiseOR(F.lit(_mask([p])).cast("long")).alias("mask")) for p in range(BYTES)]
    wider = heavy.select("fp", "mask", F.explode(F.array(*one_more)).alias("e")).where("e.mask <> mask")
    return wider.select("e.mask", F.col("fp").bitwiseAND(F.col("e.mask")).alias("key"), "fp").distinct()


def fingerprint_components(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(fp, root) for each distinct fingerprint that links to another one: root is one member of
    its component. ``fps`` has distinct values of ``fp``. Only 3 bits or fewer are supported, as
    the posting sets are made for at most three differing bytes."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    lists = Window.partitionBy("mask", "key")
    shared = stage(_postings(fps, [_mask(q) for q in QUADS]).withColumn("n", F.count("*").over(lists)).where("n > 1"), "postings")
    light = shared.where(F.col("n") <= REFINE_FROM).select("mask", "key", "fp")
    heavy = _refined(shared.where(F.col("n") > REFINE_FROM).select("mask", "key", "fp"))
    links = light.unionByName(heavy).repartition("mask", "key").sortWithinPartitions("mask", "key")
    return components(_links(links, bits)).select(F.col("node").alias("fp"), "root")


def _rooted(rows: DataFrame, first: Column, bits: int) -> DataFrame:
    """(fp, least, root) for each distinct fingerprint of ``rows``: least is the smallest ``first``
    among its rows, root one member of its component."""
    nodes = stage(rows.groupBy("fp").agg(F.min(first).alias("least")), "nodes")
    linked = fingerprint_components(nodes.select("fp"), bits).withColumnRenamed("fp", "f")
    return nodes.join(linked, F.col("fp") == F.col("f"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text, anything else).

    component_id: the smallest doc_id reachable over links, itself included. Null and empty texts
    share fingerprint 0 and link like any other; rows with a null doc_id keep their row but give
    no component_id of their own (it is null if a component has no other); repeated rows stay
    repeated; an empty table gives an empty result; other columns are not read.
    """
    rows = stage(fingerprints(docs, width), "fingerprints")
    nodes = _rooted(rows, F.col("doc_id"), bits)
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = nodes.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return rows.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, anything else) with one row of each component, all columns as they are.

    It is a row that stays, not a doc_id: the one with the smallest doc_id, rows without one last; of
    rows that share it, the first in the table. So every component keeps exactly one row, also where
    ids are null or repeat under different texts. Null and empty texts are one component; an empty
    table gives an empty result. The table is fingerprinted once and written once.
    """
    fp, row = fresh(docs, "_fp", "_row")
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = pc.cast(b.column(at).cast(pa.string()), pa.binary()).to_pylist()
            fps = np.array([simhash(t, width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, fp])

    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    marked = stage(marked.withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    thin = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    keep = _rooted(thin, first, bits).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    return marked.join(keep, row, "left_semi").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
