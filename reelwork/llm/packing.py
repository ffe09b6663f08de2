"""Best-fit packing of documents into training sequences.

Packing is online and bounded: a task holds a fixed number of open bins, found through a bitset
keyed by free space. A piece goes to the open bin with the least space that still fits it; where
none does and all bins are in use, the fullest closes. What a task still has open at its end isn't
closed half empty: those pieces go to a second round, longest first, in few large tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .tokens import default_vocabulary, encoder

OPEN_BINS = 512
SCHEMA = "doc_id long, piece int, start long, length long, {content}, sequence_id long, offset long"
#: What a piece carries: its ids, or their CRC-32 alone.
CONTENT = {False: ("ids", "ids array<int>"), True: ("ids_crc32", "ids_crc32 long")}
#: Tokens that a task of the second round packs, about.
SECOND_ROUND = 4 << 20


class Packer:
    """Open bins by free space. ``spaces`` has bit f set if some open bin has f free tokens."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.spaces, self.bins, self.open = 0, [[] for _ in range(size + 1)], 0

    def _take(self, free: int) -> list:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces &= ~(1 << free)
        return bin_

    def add(self, piece: tuple, length: int) -> list[list]:
        """Puts one piece in; gives the bins that close by that."""
        closed = []
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most_open:
                closed.append(self._take((self.spaces & -self.spaces).bit_length() - 1))
                self.open -= 1
            free, bin_ = self.size, []
            self.open += 1
        bin_.append(piece)
        free -= length
        if free:
            self.bins[free].append(bin_)
            self.spaces |= 1 << free
        else:
            self.open -= 1
            closed.append(bin_)
        return closed

    def rest(self) -> list[list]:
        return [b for level in self.bins for b in level]


def _pieces(ids: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece. Only a document over the size is cut; its first piece takes
    the remainder."""
    first = (len(ids) - 1) % size + 1
    yield 0, ids[:first]
    for at in range(first, len(ids), size):
        yield at, ids[at : at + size]


def _batch(rows: list[tuple], sequence_ids: list[int | None], offsets: list[int | None], digest: bool) -> pa.RecordBatch:
    if digest:
        content = pa.array([r[4] for r in rows], pa.int64())
    else:
        ends = np.append(0, np.cumsum([r[3] for r in rows])).astype(np.int32)
        content = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[4] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)))
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())]
    columns += [content, pa.array(sequence_ids, pa.int64()), pa.array(offsets, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", CONTENT[digest][0], "sequence_id", "offset"])


def _packed(pieces: Iterator[tuple], size: int, most_open: int, base: int, last: bool, digest: bool) -> Iterator[pa.RecordBatch]:
    """Packs (doc_id, piece, start, length, content) rows of one task. Sequence ids are base and a
    task's own count; the pieces still open at the end have none, unless this is the last round."""
    packer, number = Packer(size, most_open), base + (TaskContext.get().partitionId() << 33)
    out: tuple[list, list, list] = ([], [], [])

    def close(bin_: list) -> None:
        nonlocal number
        offset = 0
        for row in bin_:
            out[0].append(row)
            out[1].append(number)
            out[2].append(offset)
            offset += row[3]
        number += 1

    for row in pieces:
        for bin_ in packer.add(row, row[3]):
            close(bin_)
        if len(out[0]) >= 2048:
            yield _batch(*out, digest)
            out = ([], [], [])
    for bin_ in packer.rest():
        if last:
            close(bin_)
        else:
            for row in bin_:
                out[0].append(row)
                out[1].append(None)
                out[2].append(None)
    yield _batch(*out, digest)


def crc32(ids: np.ndarray) -> int:
    """The CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def packed(docs: DataFrame, size: int = 1024, end_id: int = 2, vocabulary: tuple[str, str | None] | None = None, open_bins: int = OPEN_BINS, digest: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset for each piece of each row. With
    ``digest`` a piece has ids_crc32, the CRC-32 of its ids, in their place, and the ids are nowhere
    written.

    A null text counts as empty and gives the end id alone; repeated rows are packed as often as
    they occur; a null doc_id stays null; an empty table gives an empty result; other columns are
    not read. Any text length is whole: pieces of ``size`` tokens, the first one shorter.
    """
    files = vocabulary or default_vocabulary()
    name, column = CONTENT[digest]
    schema = SCHEMA.format(content=column)

    def first_round(batches):
        def pieces():
            encode = encoder(*files).ids
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                    for n, (start, part) in enumerate(_pieces(ids, size)):
                        yield doc_id, n, start, len(part), crc32(part) if digest else part

        return _packed(pieces(), size, open_bins, 0, last=False, digest=digest)

    def second_round(batches):
        def pieces():
            for b in batches:
                content = b.column(4).to_pylist() if digest else (x.values.to_numpy() for x in b.column(4))
                yield from zip(*(b.column(i).to_pylist() for i in range(4)), content, strict=True)

        return _packed(pieces(), size, 2 * size, 1 << 62, last=True, digest=digest)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = stage(rows.mapInArrow(first_round, schema), "packed")
    left = once.where("sequence_id is null").select("doc_id", "piece", "start", "length", name)
    tokens = left.agg(F.sum("length")).first()[0] or 0
    again = left.repartition(max(1, round(tokens / SECOND_ROUND))).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return once.where("sequence_id is not null").unionByName(again.mapInArrow(second_round, schema))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), digest=True)
