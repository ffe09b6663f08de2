import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelwork.llm import attribution, packing
from reelwork.llm.tokens import default_vocabulary, encoder

JSON, RANKS = default_vocabulary()
SLOW = Tokenizer.from_file(JSON)
SLOW.encode_special_tokens = True


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_both_encoders_agree(text):
    assert encoder(JSON, RANKS).ids(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_long_runs_and_special_strings():
    for text in ("x" * 9000, " " * 9000 + "a", "<|endoftext|>", "a" + "\n" * 5000):
        assert encoder(JSON, RANKS).ids(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 9))
def test_packer_is_bounded_and_best_fit(lengths, most):
    p, closed = packing.Packer(64, most), []
    for i, n in enumerate(lengths):
        frees = sorted(f for f in range(65) for _ in p.bins[f])
        fit = [f for f in frees if f >= n]
        done = p.add((i, n), n)
        assert p.open <= most and p.open == sum(map(len, p.bins))
        if not fit and len(frees) == most:  # the fullest closes first
            assert 64 - sum(x[1] for x in done[0]) == frees[0]
        elif fit:  # the piece went where least is left
            assert sorted(f for f in range(65) for _ in p.bins[f]) == sorted([*(f for k, f in enumerate(frees) if k != frees.index(fit[0])), *([fit[0] - n] if fit[0] > n else [])])
        closed += done
    everything = [x for b in closed + p.rest() for x in b]
    assert sorted(everything) == [(i, n) for i, n in enumerate(lengths)]
    assert all(sum(x[1] for x in b) <= 64 for b in closed + p.rest())


def test_sequences_are_whole_and_gapless(docs, empty):
    got = packing.packed(docs, digest=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, rows in by_doc.items():
        if doc_id in (None, 5):  # several rows
            continue
        ids = np.array([*SLOW.encode(text[doc_id] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and sum(r["length"] for r in rows) == len(ids)
        assert all(r["length"] == 1024 for r in rows[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
    assert len(by_doc[5]) == 3 and packing.packed(empty).count() == 0 and packing.packed(empty, digest=True).count() == 0
    key = lambda r: tuple(-1 if r[c] is None else r[c] for c in ("doc_id", "piece", "start", "length"))
    whole = packing.packed(docs).collect()
    assert sorted((*key(r), r["ids_crc32"]) for r in got) == sorted((*key(r), packing.crc32(np.array(r["ids"]))) for r in whole)


def test_attribution_by_brute_force(docs, empty):
    for rule in attribution.RULES:
        got = defaultdict(int)
        for r in attribution.attributed(docs, rule=rule).collect():
            if r["doc_id"] is not None:
                got[r["doc_id"], r["section"]] += r["n_tokens"]
        for row in docs.dropDuplicates(["doc_id"]).where("doc_id is not null and doc_id not in (5, 42)").collect():
            text, at, sections = row["text"] or "", 0, []
            for line in text.splitlines(keepends=True) if "\u0085" not in text else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]:
                sections.append((at, at + len(line)))
                at += len(line)
            want = defaultdict(int)
            for a, z in SLOW.encode(text, add_special_tokens=False).offsets:
                over = [(min(e, z) - max(s, a), -k) for k, (s, e) in enumerate(sections) if min(e, z) > max(s, a)]
                k = -max(over)[1] if rule == "majority" else min(-x[1] for x in over) if rule == "first" else max(-x[1] for x in over)
                want[k] += 1
            for k in range(len(sections)):
                assert got[row["doc_id"], k] == want[k], (row["doc_id"], k, rule)
    assert attribution.attributed(empty).count() == 0


def test_sections_leave_in_small_batches(docs, monkeypatch):
    rows = lambda: sorted(map(str, attribution.attributed(docs).collect()))
    whole = rows()
    monkeypatch.setattr(attribution, "BATCH", 3)
    assert rows() == whole and len(whole) > docs.count()


def test_given_sections_and_tokens_outside(spark):
    df = spark.createDataFrame([(1, "hello world again", [(0, 3), (3, 11), (20, 30)]), (2, "hello", None), (3, None, [(0, 5)])], "doc_id long, text string, s array<struct<start:int,end:int>>")
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in attribution.attributed(df, "s").collect()}
    assert got == {(1, 0): (1, 1), (1, 1): (1, 0), (1, -1): (1, 0), (2, -1): (1, 0)}
