import hashlib

import pytest
from pyspark.sql import functions as F

from reelwork.llm import manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, columns=manifest.COLUMNS) -> str:
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in columns))


def brute(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over nodes and each one's path."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, under = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for j in range(len(run)):
                for i in at[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha("".join(run)))
            under.append([i for j in range(len(run)) for i in at[k + j]])
        nodes, at = above, under
    return nodes[0], paths


def expected(rows, arity):
    """{(doc_id, leaf): (subroot, path)} and the root."""
    first = lambda x: (x is not None, x if x is None else x.encode() if isinstance(x, str) else x)
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((first(r["doc_id"]), leaf(r), r["doc_id"]))
    subroots, within = [], []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        leaves = sorted(groups[g])
        subroot, paths = brute([x[1] for x in leaves], arity)
        subroots.append(subroot)
        within.append((leaves, paths))
    root, top = brute(subroots, arity)
    out = {}
    for (leaves, paths), subroot, above in zip(within, subroots, top, strict=True):
        for (_, digest, doc_id), path in zip(leaves, paths, strict=True):
            out.setdefault((doc_id, digest), []).append((subroot, [*path, *above]))
    return out, root


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_proofs_by_brute_force(docs, arity):
    want, root = expected(docs.collect(), arity)
    got: dict = {}
    m = manifest.build(docs, arity=arity)
    for r in manifest.proofs(m).withColumn("fold", manifest.folded(F.col("digest"), F.col("path"))).collect():
        assert r["root"] == root == m.root == r["fold"]
        got.setdefault((r["id"], r["digest"]), []).append((r["subroot"], [(p["left"], p["right"]) for p in r["path"]]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_changes_are_found(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = manifest.op11_manifest(spark, f"file://{tmp_path}").collect()
    assert len(rows) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    import zlib

    for r in rows:
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and (text[r["doc_id"]] or "") != (text[r["doc_id"]] or "").lower()
        assert r["verified"] == (not tampered) and r["verified"] == (r["folded_root"] == r["root"])
    upper = docs.withColumn("text", F.upper("text"))
    assert manifest.build(upper).root != manifest.build(docs).root == manifest.build(docs.repartition(7)).root


def test_no_rows_one_row_and_one_source(spark, empty, docs):
    assert manifest.build(empty).root is None and manifest.proofs(manifest.build(empty)).count() == 0
    one = docs.where("doc_id = 42")
    got = manifest.proofs(manifest.build(one)).collect()
    assert len(got) == 1 and got[0]["path"] == [] and got[0]["root"] == got[0]["subroot"] == got[0]["digest"] == leaf(one.first())
    same = docs.where("source = 'src0'")
    want, root = expected(same.collect(), 16)
    assert {r["root"] for r in manifest.proofs(manifest.build(same)).collect()} == {root}


def test_many_sources_and_deep_trees(spark):
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "hot").when(F.col("id") % 5 > 0, F.concat(F.lit("s"), (F.col("id") % 300).cast("string"))).alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.concat(F.lit("é\n"), F.col("id").cast("string")).alias("text"))
    for arity in (2, 16):
        want, root = expected(rows.collect(), arity)
        got = {(r["id"], r["digest"]): [(r["subroot"], [(p["left"], p["right"]) for p in r["path"]])] for r in manifest.proofs(manifest.build(rows, arity=arity)).collect()}
        assert got == want and manifest.build(rows, arity=arity).root == root
