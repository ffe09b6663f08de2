import math
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from reelwork.llm import decontamination as dec
from reelwork.llm import licenses as lic


def fewest_to_break(n, masks):
    """The fewest substituted words that leave no place of any mask whole, by dynamic programming
    over which of the last words are substituted."""
    span = max(m[-1] for m in masks) + 1
    state = {(): 0}
    for at in range(n):
        nxt = {}
        for last, cost in state.items():
            for gone in (0, 1):
                now = (*last, gone)[-span:]
                whole = any(len(now) > m[-1] and not any(now[len(now) - 1 - m[-1] + o] for o in m) for m in masks)
                if not whole:
                    nxt[now] = min(nxt.get(now, n + 1), cost + gone)
        state = nxt
    return min(state.values(), default=n + 1)


def test_masks_leave_a_seed_in_items_of_every_length():
    for n in range(1, 200):
        masks = [m for low, high, m in dec.MASKS if low <= n <= high]
        assert fewest_to_break(n, masks) > n - -(-4 * n // 5), n


def brute(doc, item, least=0.8):
    d, i = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (doc, item))
    best = max(((sum(0 <= g + k < len(d) and d[g + k] == w for k, w in enumerate(i)), -g) for g in range(1 - len(i), len(d))), default=(0, 0))
    return (-best[1], best[0]) if i and best[0] >= least * len(i) else None


def test_recall_against_all_diagonals(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(3)) for _ in range(60)]
    items = {n: " ".join(r.choice(vocabulary) for _ in range(n)) for n in range(1, 41)}
    items |= {100: "a " * 9, 101: "b a " * 6, 102: "c", 103: " ".join(items[30].split()[:12])}
    docs = []
    for n in list(items) * 3:
        w = items[n].split()
        for i in r.sample(range(len(w)), r.randint(0, len(w) // 5)):
            w[i] = "zz"
        cut = r.choice([0, 0, 1])
        docs.append(" ".join([r.choice(vocabulary) for _ in range(0 if cut else r.randint(0, 30))] + w[cut:] + [r.choice(vocabulary) for _ in range(r.randint(0, 20))]))
    docs += ["a " * 40, "b a b a b a " * 5, "", None, "a", "c c c"]
    found = dec.overlaps(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]): (x["start"], x["matched"]) for x in found.collect()}
    want = {(d, i): b for d, t in enumerate(docs) for i, item in items.items() if (b := brute(t, item))}
    assert got == want and len(want) > 150


@pytest.mark.parametrize("most", [200_000, 0])
def test_repeated_words_end_soon(spark, monkeypatch, most):
    monkeypatch.setattr(dec, "MOST_BROADCAST", most)
    docs = spark.createDataFrame([(1, "same " * 10_000), (2, "two words " * 5000), (3, "other " * 3)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "same " * 1000), (2, "two words " * 300)], "item_id long, text string")
    start = time.time()
    got = sorted((r["doc_id"], r["item_id"], r["start"], r["matched"]) for r in dec.overlaps(docs, bench).collect())
    assert got == [(1, 1, 0, 1000), (2, 2, 0, 600)] and time.time() - start < 60


@pytest.fixture(scope="module")
def passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    w = item.split()
    changed = " ".join("x" if i in (3, 7, 11) else v for i, v in enumerate(w))
    worse = " ".join("x" if i in (2, 5, 8, 11) else v for i, v in enumerate(w))
    rows = [(1, f"Some text, {item.upper()}! and more"), (2, "start " + changed), (3, worse), (4, " ".join(w[2:])), (5, None), (6, ""), (7, item), (7, item), (None, item), (8, ("filler word " * 20_000) + item)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, item_id int, matched string")
    bench = spark.createDataFrame([(10, item, 1), (9, item, 1), (11, "too short there", 1), (12, None, 1), (13, "", 1)], "item_id long, text string, doc_id int")
    return docs, bench


@pytest.mark.parametrize("most", [200_000, 0])
def test_substitution_tolerant_overlaps(passages, monkeypatch, most):
    monkeypatch.setattr(dec, "MOST_BROADCAST", most)
    docs, bench = passages
    got = {r["doc_id"]: (r["item_id"], r["start"], r["matched"]) for r in dec.overlaps(docs, bench).collect()}
    assert got == {1: (9, 2, 15), 2: (9, 1, 12), 4: (9, -2, 13), 7: (9, 0, 15), None: (9, 0, 15), 8: (9, 40_000, 15)}
    more = docs.unionByName(docs.sparkSession.createDataFrame([(None, "clean", 1, "k"), (7, "clean too", 1, "k")], docs.schema)).withColumns({"_th": F.lit(1), "_SIZE": F.lit(2)})
    kept = dec.decontaminated(more, bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "5", "6", "7", "None"] and kept.columns == more.columns
    assert {r["text"] for r in kept.where("doc_id is null or doc_id = 7").collect()} == {"clean", "clean too"}


def test_decontamination_of_empty_tables(passages, spark):
    docs, bench = passages
    assert dec.overlaps(docs.limit(0), bench).count() == 0 and dec.overlaps(docs, bench.limit(0)).count() == 0
    assert dec.decontaminated(docs, bench.limit(0)).count() == docs.count() and dec.decontaminated(docs.limit(0), bench).count() == 0


def test_short_items_only_where_wanted(spark):
    docs, bench = spark.createDataFrame([(1, "an exact copy here"), (2, "an exact copy")], "doc_id long, text string"), spark.createDataFrame([(1, "An exact copy, here!")], "item_id long, text string")
    assert [r["doc_id"] for r in dec.overlaps(docs, bench).collect()] == [1]
    assert [r["doc_id"] for r in dec.decontaminated(docs, bench).collect()] == [2]
    assert dec.decontaminated(docs, bench, least_words=5).count() == 2


@pytest.mark.parametrize("name", ["op4", "op5"])
def test_sql_gives_the_same(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    query, sql = (dec.op4_decontamination, dec.OP4_SQL) if name == "op4" else (lic.op5_licenses, lic.OP5_SQL)
    got, want = query(spark, d), con.execute(sql)
    cols = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, con.execute(f"select {', '.join(cols)} from ({sql})").fetchall())), want


def test_licences_are_found_and_inherited(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    long_header = "word " * 500
    rows = [
        ("a/LICENSE", mit), ("a/b/x.txt", long_header), ("a/b/c/y.txt", f"{long_header}\n# {gpl}\n{long_header}"), ("a/d/COPYING.md", f"text\n{gpl}"), ("a/d/e/z.txt", "nothing"), ("q/z.txt", "Der Die Das"), ("top.txt", None), (None, ""),
        ("ab/x.txt", "not below a"), ("a/b/x.txt", long_header), ("v/" + "deep/" * 40 + "f.txt", "the license of the version under this work"), ("v/LICENSE", gpl + "\r\n" + mit),
    ]
    files = spark.createDataFrame([(*r, "c", 1) for r in rows], "path string, text string, license string, dir int")
    got = {r["path"]: (r["license"], r["how"], r["license_dir"]) for r in lic.licensed(files).collect()}
    assert got["a/LICENSE"] == ("MIT", "own", None) and got["a/b/x.txt"] == ("MIT", "inherited", "a")
    assert got["a/b/c/y.txt"] == ("GPL-3.0", "own", None) and got["a/d/e/z.txt"] == ("GPL-3.0", "inherited", "a/d")
    assert got["q/z.txt"] == got["top.txt"] == got[""] == got["ab/x.txt"] == (None, "none", None)
    assert got["v/LICENSE"][0] == "GPL-3.0" and got["v/" + "deep/" * 40 + "f.txt"] == ("GPL-3.0", "inherited", "v")
    assert len(got) == len({r[0] for r in rows}) and lic.licensed(files.limit(0)).count() == 0


def test_refused_files_tell_what_they_come_closest_to(spark):
    refused = "Redistribution in source forms, with modification, is permitted to members provided that conditions are met"
    rows = [("x/f", refused), ("y/f", "Released under the MIT License."), ("z/f", "Der Die Das"), ("n/f", None)]
    got = {r["path"]: r for r in lic.licensed(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["x/f"]["license"] is None and got["x/f"]["nearest"] == "BSD-3-Clause" and 0.3 < got["x/f"]["nearest_cosine"] < lic.LEAST_COSINE
    assert got["y/f"]["nearest"] == "MIT" and got["y/f"]["nearest_cosine"] == got["y/f"]["cosine"] >= lic.LEAST_COSINE
    assert all(got[p][c] is None for p in ("z/f", "n/f") for c in ("nearest", "nearest_cosine", "cosine"))


GPL = """/*
 * This program is free software: you can redistribute it and/or
 * modify it under the terms of the GNU General Public License as
 * published by the Free Software Foundation, either version 3 of
 * the License, or (at your option) any later version.
 */
int main() { return 0; }"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
# * Neither the name of the copyright holder nor the names of its
#   contributors may be used to endorse or promote products derived from
#   this software without specific prior written permission."""
FOUND = {
    "wrapped/gpl3.c": (GPL, "GPL-3.0"), "wrapped/gpl2.c": (GPL.replace("version 3", "version 2"), "GPL-2.0"), "wrapped/agpl.c": (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0"), "wrapped/bsd.py": (BSD, "BSD-3-Clause"), "wrapped/mit.txt": (MIT, "MIT"),
    "wrapped/apache.py": ("# Copyright 2021 Jane Doe. Licensed under the Apache\n# License, Version 2.0 (the \"License\"); you may not use this file\n# except in compliance with the License.\nx = 1", "Apache-2.0"),
    "in/a": ("Copyright 2021 Jane Doe. Licensed under the Apache License, Version 2.0.", "Apache-2.0"), "in/b": ("// This file is part of Foo. Released under the MIT License.", "MIT"), "in/c": ("Copyright 2020 Acme Inc. Released under the MIT License. All rights reserved.", "MIT"),
    "spdx/a": ("// SPDX-License-Identifier: MIT\nlong text follows " * 3, "MIT"), "spdx/b": ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), "spdx/c": ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), "spdx/d": ("SPDX-License-Identifier: SSPL-1.0", None),
    "no/a": ("A license to use this version under the work", None), "no/b": ("permission is hereby asked of any person", None), "no/c": (None, None), "no/d": ("license " * 3000, None),
}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_wrapped_embedded_and_named_licences(spark, monkeypatch, most):
    monkeypatch.setattr(lic, "MOST_BROADCAST", most)
    files = spark.createDataFrame([(p, t, 1, 2) for p, (t, _) in FOUND.items()] + [(f"prose/{i}/x", "the use of this work is free to any person under the sun", 1, 2) for i in range(50)], "path string, text string, th int, start int")
    got = {r["path"]: (r["license"], r["how"]) for r in lic.licensed(files).collect()}
    own = {p: (got[p][0] if got[p][1] == "own" else None) for p in FOUND}
    assert own == {p: v for p, (_, v) in FOUND.items()}


def test_cosines_by_brute_force(spark):
    r = random.Random(4)
    words = "the license under version work released mit of and software permission granted free".split()
    texts = {f"d{i}/f": " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + r.choice(["", " Released under the MIT License. ", " This work is licensed under the GNU General Public License, version 3", "\nPermission is hereby granted, free of charge, to any person"]) for i in range(60)}
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs, n = {p: split(t) for p, t in texts.items()}, len(texts)
    idf = lambda t: math.log((n + 1) / (sum(t in d for d in docs.values()) + 1)) + 1 if any(t in split(s) for _, s, _ in lic.TEMPLATES) else math.log(n + 1) + 1
    idfs = {t: idf(t) for t in {t for d in docs.values() for t in d} | {t for _, s, _ in lic.TEMPLATES for t in split(s)}}
    vector = lambda terms: {t: terms.count(t) * idfs[t] for t in terms}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want, near = {}, {}
    for p, d in docs.items():
        for license, statement, least in lic.TEMPLATES:
            own = split(statement)
            v = vector(own)
            order, heavy = sorted(v, key=lambda t: (v[t], t)), set()
            for i in range(len(order)):
                if norm({t: v[t] for t in order[: i + 1]}) / norm(v) >= least * 0.999:
                    heavy.add(order[i])
            for start in {at - o for at, t in enumerate(d) for o, x in enumerate(own) if x == t and t in heavy}:
                inside = vector(d[max(0, start) : start + len(own)])
                cosine = round(sum(x * v.get(t, 0) for t, x in inside.items()) / norm(v) / norm(inside), 6)
                near[p] = min(near.get(p, 0), -cosine)
                if cosine >= least:
                    want[p] = min(want.get(p, (0, 0, "z")), (-cosine, -len(d[max(0, start) : start + len(own)]), license))
    want = {p: (c, license) for p, (c, _, license) in want.items()}
    rows = lic.licensed(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()
    nearest = {x["path"]: -x["nearest_cosine"] for x in rows if x["nearest"]}
    assert set(nearest) == set(near) and all(abs(nearest[p] - near[p]) < 2e-6 for p in near) and len(near) > len(want)
    got = {x["path"]: (-x["cosine"], x["license"]) for x in rows if x["how"] == "own"}
    assert len(got) > 30 and set(got) == set(want) and all(got[p][1] == want[p][1] and abs(got[p][0] - want[p][0]) < 2e-6 for p in got)


def test_labelled_headers(spark):
    """Every statement plain, in a comment, wrapped and within prose, and texts that state no licence."""
    r = random.Random(8)
    prose = "the version of this file is part work and program under terms that any public person may obtain copy software library project source".split()
    sentence = lambda n: " ".join(r.choice(prose) for _ in range(n))
    files, label = [], {}

    def put(text, license):
        files.append((f"{len(files)}/f.c", text))
        label[files[-1][0]] = license

    for license, statement, _ in lic.TEMPLATES:
        put(statement, license)
        lines = re.findall(r".{1,40}(?:\s|$)", statement)
        put("/*\n" + "\n".join(f" * {x.strip()}" for x in lines) + "\n */\nint main() {}", license)
        put(f"{sentence(30)}. {statement} {sentence(30)}", license)
    for i in range(120):
        put(sentence(10 + i), None)
    # The GNU notices and the permissive grants say the same in many words: names that share a family count as right.
    family = lambda x: x and re.sub(r"-(only|or-later)$", "", x)
    got = {x["path"]: x["license"] for x in lic.licensed(spark.createDataFrame(files, "path string, text string")).where("how = 'own'").collect()}
    right = sum(family(got.get(p)) == family(x) for p, x in label.items() if x)
    assert right >= 0.97 * sum(x is not None for x in label.values()) and right >= 0.97 * len(got), (right, len(got), [(x, got.get(p)) for p, x in label.items() if family(x) != family(got.get(p))][:20])


def test_common_statements(spark):
    found = {
        "Licensed under the MIT license.": "MIT", "This project is licensed under the MIT License - see the LICENSE.md file": "MIT", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "// SPDX-License-Identifier: GPL-2.0-only OR MIT": "GPL-2.0-only", "Boost Software License - Version 1.0 - August 17th, 2003": "BSL-1.0", "Eclipse Public License - v 2.0": "EPL-2.0", "GNU General Public License, version 2 or later": "GPL-2.0",
        "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.": "Zlib", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    rows = [(f"d{i}/x", t) for i, t in enumerate(found)]
    got = {x["path"]: x["license"] for x in lic.licensed(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {t: got[p] for p, t in rows} == found
