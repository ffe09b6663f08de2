"""Token counts of sections, from one encoding of the whole document.

A document is encoded once. Each token covers a span of characters; an interval join over sorted
spans finds the section that it lies in, and a rule says who gets a token that crosses a boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import default_vocabulary, encoder

RULES = ("majority", "first", "last")
#: Holds the tokens that lie in no section.
OUTSIDE = -1
#: Sections that leave a task at a time: a text may have millions.
BATCH = 1 << 18


def token_spans(ids: np.ndarray, data: np.ndarray, bytes_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of a text with the UTF-8 bytes ``data``. Where tokens
    share a character (its bytes are split), each of them covers it."""
    ends = np.cumsum(bytes_of[ids])
    starts = ends - bytes_of[ids]
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each line, its line end included; an empty text has one line."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(chars == 10) + 1
    ends = ends if len(ends) and ends[-1] == len(chars) else np.append(ends, len(chars))
    return np.append(0, ends[:-1]), ends


def allocate(t0: np.ndarray, t1: np.ndarray, s0: np.ndarray, s1: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section (or OUTSIDE) of each token, and whether it crosses a boundary. Sections are sorted
    and don't overlap. majority: the section with most of the token's characters, of equals the
    earlier; first, last: that of the first or last character which is in any."""
    if not len(s0) or not len(t0):
        return np.full(len(t0), OUTSIDE), np.zeros(len(t0), dtype=bool)
    low = np.searchsorted(s1, t0, side="right")  # the first section that ends after the token's start
    high = np.searchsorted(s0, t1, side="left") - 1  # the last section that starts before its end
    inside = low <= high
    crosses = inside & ((low < high) | (s0[np.minimum(low, len(s0) - 1)] > t0) | (s1[np.maximum(high, 0)] < t1))
    got = np.where(inside, low if rule != "last" else high, OUTSIDE)
    if rule == "majority":
        for i in np.flatnonzero(inside & (low < high)):
            k = np.arange(low[i], high[i] + 1)
            got[i] = k[np.argmax(np.minimum(s1[k], t1[i]) - np.maximum(s0[k], t0[i]))]
    return got, crosses


def attributed(docs: DataFrame, sections: str | None = None, rule: str = "majority", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing for each section of each row.

    ``docs``: doc_id, text, and with ``sections`` the name of an array<struct<start:int,end:int>>
    column of character spans; without it, the lines of the text are its sections. Spans are sorted,
    clipped to the text, and where they overlap the later begins where the earlier ends. Tokens in no
    section are counted in section -1, which has null spans and is given only where it has some; so
    the counts of a row always add up to its tokens. n_crossing: those counted tokens that also cover
    characters outside.

    A null text counts as empty; an empty one has one line without tokens; a null section list has no
    sections; repeated rows give repeated results; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    files = vocabulary or default_vocabulary()
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    most = BATCH

    def run(batches):
        code = encoder(*files)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            spans = b.column(2).to_pylist() if sections else None
            out, held = [[] for _ in names], 0
            for i, doc_id in enumerate(ids):
                text = texts[i].as_py() or ""
                s0, s1 = line_sections(text) if spans is None else clipped(spans[i], len(text))
                tokens = code.ids(text)
                t0, t1 = token_spans(tokens, np.frombuffer(text.encode(), dtype=np.uint8), code.bytes_of) if len(tokens) else (tokens, tokens)
                of, crosses = allocate(t0, t1, s0, s1, rule)
                count = np.bincount(of + 1, minlength=len(s0) + 1)
                crossing = np.bincount(of[crosses] + 1, minlength=len(s0) + 1)
                every = np.arange(OUTSIDE, len(s0)) if count[0] else np.arange(len(s0))
                for at in range(0, len(every), most):
                    k = every[at : at + most]
                    ends = (np.where(k == OUTSIDE, OUTSIDE, s[np.maximum(k, 0)]) if len(s) else k for s in (s0, s1))
                    for column, values in zip(out, ([doc_id] * len(k), k, *ends, count[k + 1], crossing[k + 1]), strict=True):
                        column.append(values)
                    held += len(k)
                    if held >= most:
                        yield batch(out)
                        out, held = [[] for _ in names], 0
            yield batch(out)

    def clipped(rows, n):
        kept = sorted((max(0, r["start"]), min(n, r["end"])) for r in rows or () if r and r["start"] is not None and r["end"] is not None)
        s0, s1, at = [], [], 0
        for a, z in kept:
            a = max(a, at)
            if a < z:
                s0.append(a)
                s1.append(z)
                at = z
        return np.array(s0, dtype=np.int64), np.array(s1, dtype=np.int64)

    def batch(out):
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out[1:]]
        section, start, end, n, crossing = (x.astype(np.int64) for x in flat)
        none = section == OUTSIDE
        columns = [pa.array([x for c in out[0] for x in c], pa.int64()), pa.array(section, pa.int32()), *(pa.array(x, pa.int64(), mask=none) for x in (start, end)), pa.array(n), pa.array(crossing)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(sections)] if sections else []))
    return rows.mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")


def op2_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(table(spark, sf_dir, "documents"))
