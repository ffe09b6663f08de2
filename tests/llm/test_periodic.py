import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelwork.llm import periodic


def brute(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """All runs, by every lag and stretch; one with a smaller period over it is none."""
    n, runs = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(s <= i and s + k >= i + length for s, k, _ in runs):
                runs.append((i, length, q))
            i = j + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def found(words: list[bytes], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    batch = periodic._judged([(1, words)], least, times)
    return [(r["start"], r["length"], r["period"]) for r in batch.column(2).to_pylist()[0]]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=120), st.sampled_from([(6, 4), (6, 3), (1, 3), (9, 5)]))
def test_runs_by_brute_force(words, limits):
    assert found(words, *limits) == brute(words, *limits)


@pytest.mark.parametrize("seed", range(30))
def test_planted_runs(seed):
    r = random.Random(seed)
    words: list[bytes] = []
    for _ in range(12):
        unit = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(1, 9))] if r.random() < 0.5 else [b"w%d" % r.randint(0, 400) for _ in range(r.randint(1, 60))]
        k = r.randint(len(unit), 7 * len(unit))
        words += [unit[i % len(unit)] for i in range(k)] + [b"z%d" % r.randint(0, 9)] * r.randint(0, 2)
    assert found(words) == brute(words)


def test_splitting_keeps_every_run():
    words = np.array([1, 1, 1, 1, 1, 1, 2, 3, 4, 3, 4, 3, 4, 3, 4, 5, 1, 1])
    at, name, end = periodic.surviving(words, np.zeros(len(words), np.int64), 6, 4)
    assert at.tolist() == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14] and end.tolist() == [6] * 6 + [15] * 8 and len(set(name.tolist())) == 3
    # A word that is frequent in the text but not in its segment splits that segment in a later round.
    words = np.array([7, 1, 7, 2, 7, 3, 7, 8, 8, 7, 8, 8, 8, 8])
    assert len(periodic.surviving(words, np.zeros(len(words), np.int64), 6, 4)[0]) == 0


def collapse(words, runs):
    keep = [True] * len(words)
    for s, n, q in runs:
        keep[s + q : s + n] = [False] * (n - q)
    return " ".join(w for w, k in zip(words, keep, strict=True) if k)


@pytest.mark.parametrize("slice_words", [1, 1000, 1 << 20])
def test_documents_by_brute_force(docs, empty, slice_words):
    docs = docs.withColumn("text", periodic.planted(F.coalesce("doc_id", F.lit(7)), F.col("text")))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.where("not doc_id <=> 42").collect()]
    want = []
    for doc_id, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = brute(words)
        want.append((doc_id, len(words), runs, collapse(words, runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodic.collapsed(docs.where("not doc_id <=> 42"), slice_words=slice_words).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.collapsed(empty).count() == 0
    with pytest.raises(ValueError, match="periods"):
        periodic.collapsed(docs, times=2)


def test_query_by_hand(spark, tmp_path):
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randint(0, 60)) for _ in range(n))
    rows = [(i, prose(40 + 9 * i) if i % 4 else "spam spam\tham\n" * i) for i in range(120)] + [(900, None), (901, ""), (902, "x " * 50), (None, "y " * 8), (903, "a b\u0085c a b\u0085c " * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic.op13_runs(spark, f"file://{tmp_path}").collect()}
    planted = 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        row = got[doc_id]
        assert (row["n_runs"], row["runs_sha256"]) == (len(runs), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
        assert row["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted > 5 and len(got) == len(rows)


def test_a_text_that_is_periodic_as_a_whole():
    started = time.time()
    unit = [b"w%d" % i for i in range(60_000)]
    assert found(unit * 5) == [(0, 300_000, 60_000)]
    assert found([b"a"] * 400_000) == [(0, 400_000, 1)]
    assert time.time() - started < 60
