import random
from collections import Counter

import numpy as np
import xxhash

from reelwork.llm import simhash as m


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs_of):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs_of:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return find


def test_sets_avoid_any_three_bytes():
    from itertools import combinations

    assert len(m.QUADS) == 14
    assert all(any(not set(q) & set(c) for q in m.QUADS) for c in combinations(range(8), 3))


def test_fingerprint_and_xxhash_of_spark(spark, docs):
    from pyspark.sql import functions as F

    assert m.simhash("A b\tc d".encode()) == brute("A b\tc d")
    h = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)
    got = m.near_duplicates(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    assert all(r["fp"] % (1 << 64) == brute(text[r["doc_id"]]) for r in got if r["doc_id"] is not None)


def test_components_by_brute_force(docs):
    got = m.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = sorted({r["fp"] for r in got})
    find = roots((a, b) for a in fps for b in fps if ((a ^ b) % (1 << 64)).bit_count() <= 3)
    least = {}
    for r in got:
        if r["doc_id"] is not None:
            k = find(r["fp"])
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(find(r["fp"])) for r in got)


def test_long_lists_are_refined_and_probed_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base, fps = 0x0123456789ABCDEF, set()
    for _ in range(400):  # a chain-like ball: most members are within a few bits of another
        x = base
        for b in rng.choice(20, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) >> 1 for x in rng.integers(0, 1 << 62, 200)}
    find = roots((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for refine, probe in ((2048, 20_000), (5, 20_000), (5, 3), (2048, 3)):
        monkeypatch.setattr(m, "REFINE_FROM", refine)
        monkeypatch.setattr(m, "PROBE_FROM", probe)
        monkeypatch.setattr(m, "BYTES", 8)
        got = {r["fp"]: r["root"] for r in m.fingerprint_components(df).collect()}
        size = Counter(map(find, fps))
        assert set(got) == {x for x in fps if size[find(x)] > 1}
        assert len({(find(x), r) for x, r in got.items()}) == len({find(x) for x in got})


def test_deduplicated_keeps_one_of_each(docs, empty):
    kept = m.deduplicated(docs).collect()
    assert [r["doc_id"] for r in kept if r["doc_id"] in range(50, 56)] == [50]
    assert sum(r["doc_id"] == 5 for r in kept) == 1
    assert m.deduplicated(docs).columns == docs.columns
    assert m.near_duplicates(empty).count() == 0 and m.deduplicated(empty).count() == 0


def test_deduplicated_keeps_rows_not_ids(spark):
    a, b, c, d = (prose(500 + i, 300) for i in range(4))
    rows = [(None, a), (None, b), (3, c), (5, c), (5, d), (5, d), (None, d), (None, None), (9, ""), (8, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _fp int, _Row int, root int")
    kept = m.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(None, a), (None, b), (3, c), (5, d), (8, None)]))


def test_deduplicated_keeps_one_row_of_each_component(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = sorted({brute(r["text"]) for r in rows})
    find = roots((a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3)
    least = {}
    for r in rows:
        k, at = find(brute(r["text"])), (r["doc_id"] is None, r["doc_id"] or 0)
        least[k] = min(least.get(k, at), at)
    kept = [(find(brute(r["text"])), (r["doc_id"] is None, r["doc_id"] or 0)) for r in m.deduplicated(docs).collect()]
    assert sorted(kept) == sorted(least.items())
