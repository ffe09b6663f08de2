"""Best-fit decreasing packing into training sequences, with next to no padding.

Overlong documents are first cut into full windows; what is left of them and all shorter documents go,
longest first, each to the open window with the least room that still holds it. A segment tree over the
remaining capacities finds that window. The room that is left then is filled too: the emptiest windows
are taken apart, and their pieces are cut to fill the others exactly. What a task has in the end is one
window, which leaves as sequences whose lengths are powers of two, and these aren't padded.

A task packs what it reads, in pools of bounded size, so nothing is shuffled and no piece waits for
another task; a lost task is done again by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import CONTENT, crc32
from .tokens import default_vocabulary, encoder

#: Tokens that are packed together, at most but for one document's.
POOL = 4 << 20
#: Rows of a batch that leaves.
BATCH = 2048


class RoomTree:
    """Open windows by remaining capacity. Leaf c of a segment tree counts those with c tokens left, an
    inner node those below it; the tightest window for a piece is the first leaf from its length on."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.windows: list[list[list]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: list, room: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` that some open window has."""
        node, count = length + self.width, self.count
        if not count[node]:
            while node & 1 or not count[node + 1]:  # up, until a subtree to the right has one
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.width

    def take(self, room: int) -> list:
        self._add(room, -1)
        return self.windows[room].pop()

    def rest(self) -> list[tuple[int, list]]:
        """(room, window) of all open windows, the fullest first."""
        return [(room, w) for room, ws in enumerate(self.windows) for w in ws]


#: A piece: doc_id, its place in the document, its ids, the document's tokens.
Piece = tuple[int | None, int, np.ndarray, int]


def best_fit(pieces: list[Piece], size: int) -> tuple[list[list[Piece]], list[tuple[int, list[Piece]]]]:
    """Best fit of pieces in falling order of length: full windows, and (room, window) of the others."""
    tree, full = RoomTree(size), []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        length = len(piece[2])
        room = tree.tightest(length)
        window = tree.take(room) if room is not None else []
        room = size if room is None else room
        window.append(piece)
        if room == length:
            full.append(window)
        else:
            tree.put(window, room - length)
    return full, tree.rest()


def _cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[:at], total), (doc_id, start + at, ids[at:], total)


def fill(windows: list[tuple[int, list[Piece]]]) -> tuple[list[list[Piece]], list[Piece]]:
    """Fills windows, given fullest first, from the emptiest ones: whole pieces where they fit, else cut
    ones. Gives the full windows and the pieces of the one that can't be filled."""
    full, low, high = [], 0, len(windows) - 1
    while low < high:
        room, window = windows[low]
        from_window = windows[high][1]
        while room and from_window:
            piece = from_window.pop()
            if len(piece[2]) > room:
                piece, more = _cut(piece, room)
                from_window.append(more)
            window.append(piece)
            room -= len(piece[2])
        if room:  # the donor is used up
            windows[low], high = (room, window), high - 1
        else:
            full.append(window)
            low += 1
    left = windows[low][1] if windows and low == high else []
    return full, left


def tails(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces in sequences whose lengths are falling powers of two."""
    left = sum(len(p[2]) for p in pieces)
    pieces = list(reversed(pieces))
    while left:
        room, out = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            piece = pieces.pop()
            if len(piece[2]) > room:
                piece, more = _cut(piece, room)
                pieces.append(more)
            out.append(piece)
            room -= len(piece[2])
        yield out


def _sequences(docs: Iterator[tuple[int | None, np.ndarray]], size: int, pool_tokens: int) -> Iterator[list[Piece]]:
    pool: list[Piece] = []
    tokens = 0
    for doc_id, ids in docs:
        whole = len(ids) - len(ids) % size
        for at in range(0, whole, size):
            yield [(doc_id, at, ids[at : at + size], len(ids))]
        if whole < len(ids):
            pool.append((doc_id, whole, ids[whole:].copy() if whole else ids, len(ids)))
            tokens += len(ids) - whole
        if tokens >= pool_tokens:
            full, rest = best_fit(pool, size)
            filled, pool = fill(rest)
            yield from full
            yield from filled
            tokens = sum(len(p[2]) for p in pool)
    full, rest = best_fit(pool, size)
    filled, pool = fill(rest)
    yield from full
    yield from filled
    yield from tails(pool)


def packed_decreasing(docs: DataFrame, size: int = 1024, end_id: int = 0, vocabulary: tuple[str, str | None] | None = None, digest: bool = False, pool_tokens: int = POOL) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset for each piece of each row. With
    ``digest`` a piece has ids_crc32, the CRC-32 of its ids, in their place.

    A null text counts as empty and gives the end id alone; repeated rows are packed as often as they
    occur; a null doc_id stays null; pieces of equal length are taken in the order read; an empty table
    gives an empty result; other columns are not read. Texts are whole, whatever their length.
    """
    files = vocabulary or default_vocabulary()
    name, column = CONTENT[digest]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        if digest:
            content = pa.array(columns[3], pa.int64())
        else:
            ends = np.append(0, np.cumsum([len(x) for x in columns[3]])).astype(np.int32)
            content = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[3]).astype(np.int32) if rows else np.zeros(0, np.int32)))
        arrays = [content if i == 3 else pa.array(c, pa.int64()) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        encode, number, rows = encoder(*files).ids, TaskContext.get().partitionId() << 33, []

        def read():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield doc_id, np.append(encode(text.as_py() or ""), np.uint32(end_id))

        for sequence in _sequences(read(), size, pool_tokens):
            offset = 0
            for doc_id, start, ids, total in sequence:
                rows.append((doc_id, start, len(ids), crc32(ids) if digest else ids, total, number, offset))
                offset += len(ids)
            number += 1
            if len(rows) >= BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, start long, length long, {column}, doc_tokens long, sequence_id long, offset long")


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_decreasing(table(spark, sf_dir, "documents"), digest=True)
