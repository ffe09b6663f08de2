"""Periodic runs of words in documents, and texts without their repetitions.

A run is a longest stretch of words that repeats with some smallest period at least ``times`` times.
Every word of a run occurs at least so often in it. So a word that is rarer within its segment can't be in
one, and splits the segment; what is left is split again by the counts within the parts, until nothing
changes. Most prose ends there. The surviving segments are scanned by lags: for windows of 1, 2, 4, ...
words, each place gets the distance to the next place with an equal window; a stretch of places with one
distance q is a run of period q. A window of w words, w/2 < q <= w, holds a whole period, so that within a
run nothing nearer equals it. Every step is a sort or a scan of arrays: n log(n)^2 for any text, also one
that is periodic as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words whose arrays are held at a time, but for one document's.
SLICE = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def surviving(words: np.ndarray, doc: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recursive frequency splitting. words: a number for each word, doc: the number of its document.
    Gives the places that stay, each word's name within its segment, and the end of its segment."""
    at, name, segment = np.arange(len(words)), words, doc
    done = []
    while len(at):
        # Equal words of different segments are different words from here on.
        name = np.unique(segment * (int(name.max()) + 1) + name, return_inverse=True)[1]
        frequent = np.bincount(name)[name] >= times
        segment = np.unique(segment, return_inverse=True)[1]
        split = np.bincount(segment, weights=~frequent) > 0
        stable = ~split[segment]
        done.append((at[stable], name[stable], segment[stable]))
        left = ~stable & frequent
        at, name, segment = at[left], name[left], segment[left]
        if len(at):
            begins = np.append(True, (np.diff(at) != 1) | (np.diff(segment) != 0))
            segment = np.cumsum(begins) - 1
            long = np.bincount(segment)[segment] >= least
            at, name, segment = at[long], name[long], segment[long]
    if not done:
        return (np.zeros(0, np.int64),) * 3
    rounds = np.concatenate([np.full(len(a), k) for k, (a, _, _) in enumerate(done)])
    at, name, segment = (np.concatenate(x) for x in zip(*done, strict=True))
    _, name = np.unique(rounds * (int(name.max(initial=0)) + 1) + name, return_inverse=True)
    _, segment = np.unique(rounds * (int(segment.max(initial=0)) + 1) + segment, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, name, segment = at[order], name[order], segment[order]
    ends = np.zeros(int(segment.max(initial=-1)) + 1, np.int64)
    np.maximum.at(ends, segment, at + 1)
    return at, name, ends[segment]


def lag_scan(at: np.ndarray, name: np.ndarray, end: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) of all runs among places, names and segment ends as ``surviving`` gives them."""
    found, w = [], 1
    while len(at):
        order = np.argsort(name, kind="stable")
        here, there = order[:-1], order[1:]
        same = name[here] == name[there]
        lag = np.zeros(len(at), np.int64)
        lag[here[same]] = at[there[same]] - at[here[same]]
        i = np.flatnonzero((lag > w // 2) & (lag <= w))
        if len(i):
            breaks = np.flatnonzero((np.diff(at[i]) != 1) | (np.diff(lag[i]) != 0))
            first, last = i[np.append(0, breaks + 1)], i[np.append(breaks, len(i) - 1)]
            period = lag[first]
            length = at[last] - at[first] + period + w
            ok = length >= np.maximum(least, times * period)
            found.append(np.stack([at[first][ok], length[ok], period[ok]], axis=1))
        # Windows twice as long, of those that occur more than once.
        often = np.bincount(name)[name] > 1
        at, name, end = at[often], name[often], end[often]
        if len(at):
            half = np.minimum(np.searchsorted(at, at + w), len(at) - 1)
            whole = (at[half] == at + w) & (at + 2 * w <= end)
            pair = name[whole] * (int(name.max()) + 1) + name[half[whole]]
            at, name, end = at[whole], np.unique(pair, return_inverse=True)[1], end[whole]
        w *= 2
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _judged(docs: list[tuple[int | None, list[bytes]]], least: int, times: int) -> pa.RecordBatch:
    sizes = np.array([len(words) for _, words in docs], np.int64)
    starts = np.append(0, np.cumsum(sizes))
    words, base = np.empty(starts[-1], np.int64), 0
    for k, (_, text) in enumerate(docs):
        known: dict[bytes, int] = {}
        words[starts[k] : starts[k + 1]] = [known.setdefault(w, len(known)) for w in text]
        words[starts[k] : starts[k + 1]] += base
        base += len(known)
    runs = lag_scan(*surviving(words, np.repeat(np.arange(len(docs)), sizes), least, times), least, times)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(docs)))).astype(np.int32)
    texts = []
    for k, (_, text) in enumerate(docs):
        own = runs[ends[k] : ends[k + 1]]
        if len(own):
            keep = np.ones(len(text), bool)
            for start, length, period in own:
                keep[start - starts[k] + period : start - starts[k] + length] = False
            text = [text[i] for i in np.flatnonzero(keep)]
        texts.append(b" ".join(text))
    fields = [pa.array(runs[:, 0] - starts[owner], pa.int64()), pa.array(runs[:, 1], pa.int64()), pa.array(runs[:, 2], pa.int64())]
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    columns = [pa.array([d for d, _ in docs], pa.int64()), pa.array(sizes), listed, pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "text"])


def collapsed(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES, slice_words: int = SLICE) -> DataFrame:
    """doc_id, n_words, runs and text of each row of ``docs`` (doc_id, text, anything else).

    runs: start (word number), length and smallest period of each maximal run of at least ``least`` words
    and ``times`` (3 or more) periods, in order of start and period. text: the words, one space between
    them, without those that some run holds after its first period; of nested and overlapping runs each
    drops its own. Words are what stands between spaces and U+0009 to U+000D.

    A null or empty text has no words; a null doc_id stays null; repeated rows are judged alike; texts are
    whole, whatever their length; an empty table gives an empty result; other columns are not read.
    """
    if times < 3:
        raise ValueError("a run has at least three periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((doc_id, (text.as_py() or b"").split()))  # bytes split at these six characters alone
                words += len(held[-1][1])
                if words >= slice_words:
                    yield _judged(held, least, times)
                    held, words = [], 0
        if held:
            yield _judged(held, least, times)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """``text`` with a periodic end in about a tenth of the documents: with h the CRC-32 of the decimal
    doc_id and g = h / 10, where 10 divides h, every word from a = g % n on is the word p further back,
    but for the first p of them, p = 1 + (n - a) / (3 + g % 8)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    div = lambda a, b: F.call_function("div", a, b)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), div(h, F.lit(10).cast("long"))
    a = F.pmod(g, n)
    p = 1 + div(n - a, 3 + F.pmod(g, F.lit(8)))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = div(n - a, p) + 1
    changed = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(period, times.cast("int")))), F.lit(1), n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), changed).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = collapsed(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q"))))
    out = got.withColumn("best", longest)
    length = -F.col("best.l")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), length.alias("length"), F.col("best.q").alias("period"),
        F.call_function("div", 1000 * length, F.col("best.q")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
