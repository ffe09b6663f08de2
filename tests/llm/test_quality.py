import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from reelwork.llm import packing, pii, quality_classifier, quality_rules, simhash
from test_records import by_hand as surrogates_by_hand

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.append(line)
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered)]


def test_base_counts_by_brute_force():
    r = random.Random(1)
    texts = [None, "", "\n\n", "a b c a b c", "é ñ x\u0085y", "x" * 1000] + ["".join(r.choice(["a ", "b ", "c\n", "ab ", "# ", "é ", "\t", "a b c "]) for _ in range(r.randint(1, 150))) for _ in range(150)]
    for t in texts:
        assert quality_rules.statistics(t.encode() if t is not None else None)[0] == brute(t), t


def test_verdicts_of_every_row(docs, labels, empty):
    forest = quality_rules.fit(docs, labels)
    rows = quality_rules.judged(docs, forest).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = quality_rules.passing(docs, forest)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.judged(empty, forest).count() == 0
    none = quality_rules.fit(docs, labels.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judged(docs, none).collect())
    assert quality_rules.judged(docs, quality_rules.fit(empty, labels)).count() == docs.count()


def test_forest_isolates_what_lies_outside():
    rng = np.random.default_rng(0)
    good, odd = rng.normal(0.3, 0.02, (500, 4)), rng.uniform(0.6, 1, (50, 4))
    box = np.stack([np.zeros(4), np.ones(4)])
    forest = quality_rules.grow(good[:300], box)
    forest.threshold = quality_rules.calibrate(forest, np.vstack([good[300:400], odd[:25]]), np.arange(125) < 100)
    assert forest.rejects(odd[25:]).all() and forest.rejects(good[400:]).mean() < 0.03


def test_rules_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality_rules.judged(docs, forest).where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.97 and got[got["quality"] == 0]["kept"].mean() < 0.2


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.classified(docs, labels.where("doc_id % 2 = 0"), "source", "lang")
    assert got.count() == docs.count()
    held = got.join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "label"), "doc_id").select("label", "toxic", "kept").toPandas()
    assert held[(held["label"] == 1) & (held["toxic"] == 0)]["kept"].mean() > 0.95 and held[held["label"] == 0]["kept"].mean() < 0.2


def test_shares_shrink_with_few_documents(spark):
    rows = [("big", "a", 3.0)] * 400 + [("big", "b", -3.0)] * 400 + [("tiny", "a", -3.0)] + [("other", "a", 3.0)] * 200
    known, _ = quality_classifier.shares(spark.createDataFrame(rows, "host string, path string, llr double"), 0.5)
    share = {(r["host"], r["path"]): r["host_share"] for r in known.collect()}
    assert 0.05 < share["tiny", "a"] and share["other", "a"] > 0.9 and abs(share["big", "a"] - 0.5) < 0.05


def test_classifier_edge_cases(docs, labels, empty):
    out = quality_classifier.classified(docs, labels, "source", "lang")
    assert out.count() == docs.count() and out.where("quality is null").count() == 0
    assert quality_classifier.classified(docs, labels.limit(0), "source", "lang").where("not kept").count() == 0
    assert quality_classifier.classified(empty, labels, "source", "lang").count() == 0


def by_hand(llr, host, path, share):
    """Shares and posteriors with plain Python, from the evidence of each row."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p = [sigmoid(x + math.log(share / (1 - share))) for x in llr]
    group = lambda keys: {k: [p[i] for i in range(len(p)) if keys[i] == k] for k in set(keys)}
    hosts, paths = group(host), group(list(zip(host, path, strict=True)))
    mean = lambda v: sum(v) / len(v)

    def strength(groups, centre, var, ends):
        """Prior documents from the spread of the groups' shares around a centre (moments of a
        beta-binomial): what the spread exceeds chance by, against what full correlation would add."""
        spread = sum(len(v) * (mean(v) - centre(k)) ** 2 for k, v in groups.items())
        expected, room = ends
        rho = (spread / var - expected) / room if var else 0
        return rho

    m = mean(p)
    n = len(p)
    rho = strength(hosts, lambda k: m, max(m * (1 - m), 1e-9), (len(hosts) - 1, n - sum(len(v) ** 2 for v in hosts.values()) / n - (len(hosts) - 1)))
    prior = lambda rho: min(1e4, max(1.0, 1 / rho - 1)) if rho > 0 else 1e4
    of_host = prior(rho)
    spread = expected = room = 0.0
    for h, v in hosts.items():
        own = [w for (x, _), w in paths.items() if x == h]
        ph = mean(v)
        spread += sum(len(w) * (mean(w) - ph) ** 2 for w in own)
        expected += ph * (1 - ph) * (len(own) - 1)
        room += ph * (1 - ph) * (len(v) - sum(len(w) ** 2 for w in own) / len(v) - (len(own) - 1))
    of_path = 100.0 if room <= 0 else prior((spread - expected) / room)
    out = []
    for i, x in enumerate(llr):
        v, w = hosts[host[i]], paths[host[i], path[i]]
        host_share = (of_host * m + sum(v)) / (len(v) + of_host)
        path_share = (of_path * host_share + sum(w)) / (of_path + len(w))
        without = (of_path * host_share + sum(w) - p[i]) / (of_path + len(w) - 1)
        without = min(max(without, 1e-6), 1 - 1e-6)
        out.append((host_share, path_share, sigmoid(x + math.log(without / (1 - without)))))
    return out


def test_shares_and_posteriors_by_hand(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.classified(docs, labels, "source", "lang").orderBy("doc_id").collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    llr = [min(30.0, max(-30.0, float(model.evidence([text[r["doc_id"]]])[0]))) for r in rows]
    want = by_hand(llr, [r["host"] for r in rows], [r["path"] for r in rows], model.good_share)
    for r, x, w in zip(rows, llr, want, strict=True):
        assert abs(r["evidence"] - x) < 1e-4
        assert max(abs(a - b) for a, b in zip((r["host_share"], r["path_share"], r["quality"]), w, strict=True)) < 2e-5, (r, w)


def test_words_are_counted_in_slices_alike(spark, monkeypatch):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    whole = quality_classifier.fit(docs, labels)
    monkeypatch.setattr(quality_classifier, "SLICE", 7)
    sliced = quality_classifier.fit(docs, labels)
    assert sliced.words == whole.words and np.allclose(sliced.weights, whole.weights, atol=1e-6) and len(whole.words) > 50
    twice = quality_classifier.fit(docs.unionByName(docs), labels)
    assert twice.words == whole.words and np.allclose(twice.weights, whole.weights, atol=1e-6)


def test_path_lengths_and_scores_by_hand():
    rng = np.random.default_rng(2)
    good, x = rng.normal(0.4, 0.05, (300, 3)), rng.uniform(0, 1, (60, 3))
    forest = quality_rules.grow(good, np.stack([np.zeros(3), np.ones(3)]), trees=20, sample=64)
    harmonic = lambda n: sum(1 / i for i in range(1, n))
    expected = lambda n: 0 if n < 2 else 2 * harmonic(n) - 2 * (n - 1) / n
    assert abs(quality_rules._mean_path(64) - expected(64)) < 0.02
    for row, score in zip(x, forest.scores(x), strict=True):
        lengths = []
        for root in forest.roots:
            at, deep = int(root), 0
            while forest.rule[at] >= 0:
                at, deep = int(forest.left[at]) + int(row[forest.rule[at]] >= forest.value[at]), deep + 1
            assert forest.path[at] >= deep
            lengths.append(forest.path[at])
        assert abs(score - 2 ** -(sum(lengths) / len(lengths) / quality_rules._mean_path(64))) < 1e-9
    scores, labels = forest.scores(x), rng.random(60) < 0.5
    best = max((((~labels) & (scores > t)).sum() / (~labels).sum() - 5 * (labels & (scores > t)).sum() / labels.sum()) for t in [*scores, 2])
    t = quality_rules.calibrate(forest, x, labels)
    assert abs(((~labels) & (scores > t)).sum() / (~labels).sum() - 5 * (labels & (scores > t)).sum() / labels.sum() - best) < 1e-9


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('p')}/{name}"
        step(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_take_effect(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, near, clean, private, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    forest = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in quality.select("doc_id").collect()} == {r[0] for r in quality_rules.judged(docs, forest).where("kept").select("doc_id").collect()}
    groups = simhash.near_duplicates(quality).select("component_id").distinct()
    assert {r[0] for r in near.select("doc_id").collect()} == {r[0] for r in groups.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = {r["doc_id"]: r["text"] for r in near.collect()}, {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(before) - set(after) == {d for d, t in before.items() if any(i in t for i in items)}
    drawn = surrogates_by_hand(after.values(), pii.DEMO_KEY)
    for r in private.collect():
        assert r["n_chars"] == len(r["text"]) and r["text"] == pii.replaced(after[r["doc_id"]], pii.DEMO_KEY, drawn)[0]
    text = {r["doc_id"]: r["text"] for r in private.collect()}
    encode = packing.encoder(*packing.default_vocabulary()).ids
    got = {}
    for r in packed.orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {d: [*encode(t).tolist(), 2] for d, t in text.items()}


def test_run_gives_the_same(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == stages[-1].count() and got.columns == stages[-1].columns


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_each_stage_on_odd_rows(spark, docs, empty, name, step):
    """Nulls, repeats, empty and long texts, clashing names, and no rows."""
    out = step(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        texts = docs.count()
        assert sum(r["piece"] == 0 for r in rows) == texts and step(spark, empty, SF).count() == 0
        return
    assert out.columns == docs.columns and out.schema == docs.schema and step(spark, empty, SF).count() == 0
    before = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    after = Counter((r["doc_id"], r["text"] or "") for r in rows)
    if name == "surrogates":
        assert sum(after.values()) == sum(before.values())
    else:
        assert not after - before
    if name == "decontamination":
        assert after == before
    if name == "near_copies":
        assert set(after.values()) == {1} and sum(i is None for i, _ in after) == 0
