"""A quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log-likelihood ratio of a logistic model, fitted on a bounded
sample of labelled rows. How good the documents of a host and of a path on it are is estimated from
all documents by grouped aggregation: the share of a host shrinks to the global one and that of a
path to its host's, the more so the fewer documents there are. How strongly is learned from the
spread of the shares (method of moments of a beta-binomial). The prior of a document's path, without
that document, and its evidence give its posterior.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .quality_rules import RULES, statistics

#: Where the rule statistics are cut into indicators.
CUTS = {
    "symbols": [0.002, 0.01, 0.05, 0.15],
    "capitals": [0.05, 0.1, 0.2, 0.5],
    "exclamations": [0.01, 0.05, 0.2, 0.5],
    "word_length": [0.08, 0.12, 0.22, 0.3, 0.5],
    "repeat_words": [0.1, 0.25, 0.5, 0.8],
    "top_word": [0.1, 0.2, 0.3, 0.5],
}
#: Words of the model: those that tell the labels apart best, at most so many.
MOST_WORDS = 512
MOST_LABELLED = 20_000
LEAST_DOCUMENTS = 8
#: Texts that are split into words, or made into indicators, at a time.
SLICE = 200
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def _words(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_PLAIN).split())


@dataclass
class Model:
    """evidence = weights . indicators + bias, the base rate of the sample taken out. Empty: 0."""

    words: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    good_share: float = 0.5

    def indicators(self, texts: list[bytes | None]) -> np.ndarray:
        at = {w: i for i, w in enumerate(self.words)}
        cuts = [(RULES.index(rule), c) for rule, cs in CUTS.items() for c in cs]
        x = np.zeros((len(texts), len(self.words) + len(cuts)), dtype=np.float32)
        for r, text in enumerate(texts):
            text = text or b""
            x[r, [at[w] for w in at.keys() & _words(text)]] = 1
            rules = statistics(text)[1]
            x[r, len(at) :] = [rules[k] >= c for k, c in cuts]
        return x

    def evidence(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        return self.indicators(texts) @ self.weights + self.bias


def _logistic(rows: list[np.ndarray], y: np.ndarray, width: int, penalty: float = 1.0, steps: int = 25, chunk: int = 2000) -> np.ndarray:
    """Weights, the bias last, by Newton's method over rows that are given by the places of their
    ones; only a chunk of them is ever dense."""

    def dense(at: int) -> np.ndarray:
        part = rows[at : at + chunk]
        x = np.zeros((len(part), width + 1))
        x[np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part)] = 1
        x[:, -1] = 1
        return x

    w, ridge = np.zeros(width + 1), np.full(width + 1, penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        hessian, slope = np.diag(ridge), -ridge * w
        for at in range(0, len(rows), chunk):
            x = dense(at)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = hessian + (x * (p * (1 - p))[:, None]).T @ x
            slope = slope + x.T @ (y[at : at + chunk] - p)
        step = np.linalg.solve(hessian, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _slices(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Short slices of Arrow batches and their texts as bytes: what is made of them is never large."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield part, pc.cast(part.column(text), pa.binary()).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """A model of the good documents: quality 1 and not toxic.

    It is fitted on the labelled doc_ids with the lowest hashes, at most most_labelled, and on one
    text of each: the least, where a doc_id repeats. Rows with a null id or quality aren't used; of
    several labels of one document the worse counts. Without labelled documents the model gives no
    evidence.
    """
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(good).alias("good"))
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    own = stage(own.groupBy("_id").agg(F.min("good").alias("good"), F.min("text").alias("text")).select("good", "text"), "labelled")

    def each_word(batches):
        for part, texts in _slices(batches, 1):
            counts: dict[bytes, list[int]] = {}
            for good, text in zip(part.column(0).to_pylist(), texts, strict=True):
                for w in _words(text or b""):
                    seen = counts.setdefault(w, [0, 0])
                    seen[0] += 1
                    seen[1] += good
            values = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(values[:, 0]), pa.array(values[:, 1])], names=["word", "n", "g"])

    total = own.agg(F.count("*"), F.sum("good")).first()
    n, n_good = total[0], total[1] or 0
    if not n:
        return Model()
    share = (n_good + 1) / (n + 2)
    seen = own.mapInArrow(each_word, "word binary, n long, g long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).where(F.col("n") >= LEAST_DOCUMENTS)
    apart = F.pow(F.col("g") - F.col("n") * share, F.lit(2)) / (F.col("n") * share * (1 - share))
    words = [bytes(r["word"]) for r in seen.orderBy(apart.desc(), "word").select("word").limit(MOST_WORDS).collect()]
    model = Model(words)

    def each_row(batches):
        for part, texts in _slices(batches, 1):
            ones = [np.flatnonzero(x).astype(np.int16) for x in model.indicators(texts)]
            ends = np.append(0, np.cumsum([len(o) for o in ones])).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ones, np.zeros(0, np.int16)])))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["good", "ones"])

    got = own.mapInArrow(each_row, "good int, ones array<short>").toPandas()  # at most most_labelled rows
    rows = [np.asarray(o, dtype=np.int16) for o in got["ones"]]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), got["good"].iloc[i]))
    w = _logistic([rows[i] for i in order], got["good"].to_numpy()[order].astype(float), len(words) + sum(map(len, CUTS.values())))
    return Model(words, w[:-1], float(w[-1] - np.log(share / (1 - share))), float(share))


def evidence(docs: DataFrame, model: Model, host: str, path: str) -> DataFrame:
    """(doc_id, host, path, llr) per row; a null host or path counts as an empty one."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_WORDS words

    def run(batches):
        for part, texts in _slices(batches, 3):
            llr = np.clip(known.value.evidence(texts), -30, 30)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(llr.astype(np.float64))], names=["doc_id", "host", "path", "llr"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(host).alias("host"), text(path).alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, llr double")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _concentration(spread: float | None, expected: float | None, room: float | None) -> float:
    """The beta-binomial's prior documents, from the spread of the shares, what chance alone gives
    and what a correlation of one would add; from 1 to 10000."""
    if not room or room <= 0:
        return 100.0
    rho = ((spread or 0.0) - (expected or 0.0)) / room
    return float(min(1e4, max(1.0, 1 / rho - 1))) if rho > 0 else 1e4


def shares(rows: DataFrame, good_share: float) -> tuple[DataFrame, float]:
    """(host, path, n, s, host_share) for each path, and the prior documents of a path. s: the sum of
    the documents' chances to be good under the global share; host_share: the host's posterior mean."""
    chance = _sigmoid(F.col("llr") + float(np.log(good_share / (1 - good_share))))
    paths = stage(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    p = F.col("hs") / F.col("hn")
    v = p * (1 - p)
    g = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("h"), F.sum(F.col("hn") * F.col("hn")).alias("n2"), F.sum(F.col("hs") * p).alias("q"),
        F.sum(F.col("q") - F.col("hs") * p).alias("spread"), F.sum(v * (F.col("k") - 1)).alias("expected"), F.sum(v * (F.col("hn") - F.col("n2") / F.col("hn") - (F.col("k") - 1))).alias("room"),
    ).first()
    m = (g["s"] or 0.0) / (g["n"] or 1)
    var = max(m * (1 - m), 1e-9)
    of_host = _concentration(((g["q"] or 0.0) - (g["s"] or 0.0) * m) / var, g["h"] - 1, (g["n"] or 0) - (g["n2"] or 0) / (g["n"] or 1) - (g["h"] - 1))
    of_path = _concentration(g["spread"], g["expected"], g["room"])
    means = hosts.select(F.col("host").alias("h"), ((F.lit(of_host * m) + F.col("hs")) / (F.col("hn") + of_host)).alias("host_share"))
    return stage(paths.join(means, F.col("host") == F.col("h")).drop("h"), "shares"), of_path


def classified(docs: DataFrame, labels: DataFrame, host: str = "host", path: str = "path", least: float = 0.5) -> DataFrame:
    """doc_id, host, path, evidence, host_share, path_share, quality and kept for each row.

    ``docs``: doc_id, text, the host and path columns, anything else. quality is the posterior chance
    that the document is good, kept whether it reaches ``least``. A null or empty text has only the
    evidence of having no words; repeated rows stay and count as often; without labels all evidence
    is 0 and every document is kept; an empty table gives an empty result.
    """
    model = fit(docs, labels)
    rows = stage(evidence(docs, model, host, path), "evidence")
    known, prior = shares(rows, model.good_share)
    known = known.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_share")
    own = _sigmoid(F.col("llr") + float(np.log(model.good_share / (1 - model.good_share))))
    before = prior * F.col("host_share")
    out = rows.join(known, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    without = (before + F.col("s") - own) / (prior + F.col("n") - 1)
    quality = F.round(_sigmoid(F.col("llr") + _logit(without)), 6)
    if not len(model.weights):
        quality = F.lit(0.5)
    path_share = F.round((before + F.col("s")) / (prior + F.col("n")), 6)
    return out.select("doc_id", "host", "path", F.round("llr", 6).alias("evidence"), F.round("host_share", 6).alias("host_share"), path_share.alias("path_share"), quality.alias("quality"), (quality >= least).alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host="source", path="lang")
