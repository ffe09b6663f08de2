"""Quality rules judged by an isolation forest.

Each document gets rule statistics (shares, so that a text's length doesn't matter). Trees of
random splits are grown over a sample of labelled good documents, inside a box that holds all
labelled ones; a document that lies where few good ones are is cut off after few splits. The
threshold on its anomaly score is calibrated on labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["symbols", "capitals", "exclamations", "word_length", "repeat_words", "top_word"]
_SPACE = b" \t\n\v\f\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TAIL = bytes(range(0x80, 0xC0))


def _repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found twice or more, the first one included."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 2_000_000:
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:  # three numbers of this size don't fit in 63 bits: number the pairs first
        pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        windows = pairs * distinct + ids[2:]
    _, at, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts and the rule statistics of one whole text (null: no words)."""
    text = text or b""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    chars = len(joined) - _count(joined, _TAIL)
    symbols, dup, repeat = _count(joined, SYMBOLS), _dup_lines(text), _repeat_words(ids, len(seen))
    base = [n, chars, symbols, dup, repeat]
    if not n:
        return base, [0.0] * len(RULES)
    upper, lower = _count(joined, _UPPER), _count(joined, _LOWER)
    return base, [
        symbols / chars,
        upper / max(1, upper + lower),
        joined.count(b"!") / n,
        min(chars / n, 30.0) / 30,
        repeat / n,
        int(np.bincount(ids).max()) / n,
    ]


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


@dataclass
class Forest:
    """Trees as arrays: the rule that a node splits on (-1: leaf), its value, its left child (the
    right one follows) and, for leaves, the path length. It says nothing where it has no trees."""

    rule: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    sample: int
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1: 2 ** -(mean path length / that of a random tree)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.rule[at] >= 0).any():
                go = at[inner]
                at[inner] = self.left[go] + (x[rows[inner], self.rule[go]] >= self.value[go])
            total += self.path[at]
        return 2 ** -(total / max(1, len(self.roots)) / _mean_path(self.sample))

    def rejects(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x) > self.threshold if len(self.roots) and len(x) else np.zeros(len(x), dtype=bool)


def _mean_path(n: int) -> float:
    """The mean path length of an unsuccessful search in a random binary tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(good: np.ndarray, box: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 7) -> Forest:
    """Isolation trees over samples of the good rows; splits are drawn over the node's part of the
    box (its lowest and highest values), so that room without good rows is cut off early."""
    rng, depth = np.random.default_rng(seed), int(np.ceil(np.log2(max(2, sample)))) + 2
    rule, value, left, path, roots = [], [], [], [], []

    def node() -> int:
        for x in (rule, value, left, path):
            x.append(-1 if x is rule else 0)
        return len(rule) - 1

    for _ in range(trees if len(good) else 0):
        rows = good[rng.choice(len(good), min(sample, len(good)), replace=False)]
        roots.append(node())
        todo = [(roots[-1], rows, box[0].copy(), box[1].copy(), 0)]
        while todo:
            at, own, low, high, deep = todo.pop()
            wide = np.flatnonzero(high > low)
            if len(own) < 2 or deep >= depth or not len(wide):
                path[at] = deep + _mean_path(len(own))
                continue
            k = rng.choice(wide)
            # Half the splits fall within the values that the node's own rows take, half in the box.
            a, b = (own[:, k].min(), own[:, k].max()) if rng.random() < 0.5 else (low[k], high[k])
            cut = rng.uniform(a, b) if b > a else rng.uniform(low[k], high[k])
            rule[at], value[at], left[at] = k, cut, node()
            node()
            below, mid_high, mid_low = own[:, k] < cut, high.copy(), low.copy()
            mid_high[k], mid_low[k] = cut, cut
            todo += [(left[at], own[below], low, mid_high, deep + 1), (left[at] + 1, own[~below], mid_low, high, deep + 1)]
    return Forest(*(np.array(x, dtype=t) for x, t in ((rule, int), (value, float), (left, int), (path, float), (roots, int))), sample=min(sample, max(2, len(good))))


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, price: float = 5.0) -> float:
    """The score above which a document is rejected: the share of bad rows above it, less price
    times that of good rows, is largest; of equals, the middle of the widest gap."""
    scores = forest.scores(x)
    if not good.any():
        return np.inf
    if good.all():
        return float(scores.max() + 0.05)
    values = np.unique(scores)
    ends = np.append(values, values[-1] + 0.05)
    cuts, gaps = (ends[1:] + ends[:-1]) / 2, np.diff(ends)
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts) / len(s)
    gain = above(scores[~good]) - price * above(scores[good])
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float(cuts[best[gaps[best].argmax()]])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(t) for t in pc.cast(texts, pa.binary()).to_pylist()]
    return np.array([f[0] for f in found], dtype=np.int64).reshape(-1, len(BASE)), np.array([f[1] for f in found]).reshape(-1, len(RULES))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the base counts, rules array<double>) per row."""

    def run(batches):
        for b in batches:
            base, rules = _measured(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rules) + 1) * len(RULES), pa.int32()), pa.array(rules.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in base.T), flat], names=["doc_id", *BASE, "rules"])

    return _rows(docs).mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, rules array<double>")


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000) -> Forest:
    """A forest from labelled rows (doc_id, quality 1: good).

    most_labelled bounds the sample that is fitted on: the labelled doc_ids with the lowest hashes,
    and one text of each (the least, where a doc_id repeats). Rows with a null id or label aren't
    used, nor documents that fail the base rules. Without labelled good rows the forest has no trees
    and rejects nothing.
    """
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_quality"))
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    own = own.groupBy(F.col("_id").alias("doc_id")).agg(F.min("text").alias("text"))
    quality = sample.withColumnRenamed("_id", "doc_id")
    got = rule_statistics(own).join(F.broadcast(quality), "doc_id").select(*BASE, "rules", "_quality").toPandas()  # at most most_labelled rows
    if not len(got):
        return grow(np.zeros((0, len(RULES))), np.zeros((2, len(RULES))))
    x, good = np.stack(got["rules"].to_list()), got["_quality"].to_numpy() == 1
    order = np.lexsort(x.T)
    x, good, base = x[order], good[order], got[BASE].to_numpy()[order]
    usable = ~base_failed(base)
    x, good = x[usable], good[usable]
    box = np.stack([x.min(axis=0), x.max(axis=0)]) if len(x) else np.zeros((2, len(RULES)))
    # Trees see the even rows, the threshold the odd ones.
    forest = grow(x[::2][good[::2]], box)
    if len(forest.roots):
        forest.threshold = calibrate(forest, x[1::2], good[1::2]) if len(x) > 1 else np.inf
    return forest


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, base counts, base_failed, score, kept) per row of ``docs`` (doc_id, text, anything
    else). A null text has no words and fails the base rules; repeated rows stay repeated and get
    equal verdicts; an empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # its size: trees x nodes of a sample

    def run(batches):
        for b in batches:
            base, rules = _measured(b.column(1))
            failed, scores = base_failed(base), model.value.scores(rules) if len(rules) else np.zeros(0)
            kept = ~failed & ~(scores > model.value.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(scores), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    return _rows(docs).mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, score double, kept boolean")


def passing(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no shuffle."""
    model, schema, at = docs.sparkSession.sparkContext.broadcast(forest), docs.schema, docs.columns.index("text")

    def run(batches):
        for b in batches:
            base, rules = _measured(b.column(at).cast(pa.string()))
            yield b.filter(pa.array(~base_failed(base) & ~model.value.rejects(rules)))

    return docs.mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *BASE, "base_failed", "kept", "score")
