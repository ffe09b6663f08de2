"""Merkle manifest of a table: a root over all rows, and for each row a proof that it is among them.

Every row is a leaf. Within a group the leaves stand in order; each run of ``arity`` consecutive nodes
becomes their parent until one is left, the group's subroot; the subroots, in the order of their groups,
become the root in the same way. A level is one equijoin of nodes with nodes: the node at slot zero of
each run computes its siblings' indices (its own XOR 1 in a binary tree, its own plus 1, 2, ... in
others), finds them by (group, index) and emits the parent. No group is ever gathered: what is collected
is one run, and index, not group, spreads the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """A row's leaf: each value as its UTF-8 byte count, a colon and itself; '-' for a null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, p: digest(p["left"], node, p["right"]))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``part`` and ``row``, and a table (keys, part, first, base, n) by which row - first +
    base is a row's place among the n of its keys, nulls first. Range partitions are sorted by themselves,
    so a hot key is spread; the table has one row per key and partition that it lies in."""
    sorted_rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stage(sorted_rows.withColumn("row", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("row", 33))
    counts = rows.groupBy(*keys, "part").agg(F.min("row").alias("first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    base = F.coalesce(F.sum("_n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, stage(counts.withColumn("base", base).withColumn("n", F.sum("_n").over(own)).drop("_n"), "places")


@dataclass
class Manifest:
    """leaves: key (of the group, from 0 in order), idx, n (leaves of the group), id, kept (a struct of the
    columns asked for) and digest; levels: for each level, from the leaves up, key, run, n and digests of
    its runs; subroots: key, grp and digest; top: the levels above them; root: None for an empty table."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None
    arity: int


def _levels(nodes: DataFrame, arity: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (key, digest) of the trees over nodes (key, idx, n, digest), and the runs of each level."""
    nodes = nodes.select("key", "idx", "n", "digest")
    roots, levels = nodes.where("n = 1").select("key", "digest"), []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = stage(_runs(nodes.where("n > 1"), arity), f"{name}{len(levels)}")
        levels.append(runs)
        nodes = runs.select("key", F.col("run").alias("idx"), _up(F.col("n"), arity).alias("n"), digest(F.array_join("digests", "")).alias("digest"))
        roots = roots.unionByName(nodes.where("n = 1").select("key", "digest"))
        most = -(-most // arity)
    return roots, levels


def _up(n: Column, arity: int) -> Column:
    return F.call_function("div", n + (arity - 1), F.lit(arity).cast("long"))


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """(key, run, n, digests) of each run: the node at its slot zero asks for its siblings by index."""
    zero = nodes.where(F.col("idx") % arity == 0)
    run = F.call_function("div", F.col("idx"), F.lit(arity).cast("long")).alias("run")
    at = F.array(F.col("idx").bitwiseXOR(F.lit(1).cast("long"))) if arity == 2 else F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda k: F.col("idx") + k)
    asked = zero.select("key", run, "n", F.explode(at).alias("idx"))
    found = asked.join(nodes.select("key", "idx", "digest"), ["key", "idx"])
    slots = zero.select("key", run, "n", "idx", "digest").unionByName(found)
    got = slots.groupBy("key", "run").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("s"))
    return got.select("key", "run", "n", F.transform("s", lambda x: x["digest"]).alias("digests"))


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", arity: int = ARITY, keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``keep`` names further columns to carry along with the leaves.

    Nulls are values of their own, and a null group or order comes first; empty and long texts are
    hashed whole; rows that tie in group and order stand in the order of their leaves, so repeated rows
    are leaves of equal digests side by side; other columns are not read; an empty table has no root.
    """
    kept = F.struct(*[c.alias(n) for n, c in (keep or {}).items()]) if keep else F.lit(None)
    rows = docs.select(F.col(group).alias("grp"), F.col(order).alias("id"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"), kept.alias("kept"))
    # Written before the range partitioning, which would else read and hash all texts twice.
    rows, places = _numbered(stage(rows if keep else rows.drop("kept"), "leaves"), ["grp"], ["id", "digest"])
    groups, of_groups = _numbered(places.groupBy("grp").agg(F.max("n").alias("size")), [], ["grp"])
    at = F.col("row") - F.col("first") + F.col("base")
    keys = stage(groups.join(of_groups, "part").select("grp", at.alias("key"), F.col("n").alias("groups")), "groups")
    where = places.alias("p").join(keys.alias("k"), F.col("p.grp").eqNullSafe(F.col("k.grp"))).select(F.col("p.grp").alias("_g"), F.col("p.part").alias("_p"), "first", "base", "n", "key")
    leaves = rows.join(where, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p"))).withColumn("idx", at).drop("_g", "_p", "first", "base", "row", "part")
    roots, levels = _levels(leaves, arity, "level")
    subroots = stage(roots.join(keys, "key"), "subroots")
    top_root, top = _levels(subroots.select(F.lit(0).cast("long").alias("key"), F.col("key").alias("idx"), F.col("groups").alias("n"), "digest"), arity, "top")
    root = top_root.first()  # one row
    return Manifest(leaves, levels, subroots.drop("groups"), top, root["digest"] if root else None, arity)


def _with_path(runs: DataFrame, above: DataFrame | None, tops: DataFrame | None, arity: int) -> DataFrame:
    """``runs`` with ``path``, that of the node that each became, and ``subroot``: from the level above, or,
    where that node is its key's root, from ``tops`` (None: nothing is above it)."""
    last = runs.where(F.col("n") <= arity)
    last = last.withColumns({"path": F.array().cast(PATH), "subroot": F.lit("")}) if tops is None else last.join(tops, "key")
    if above is None:
        return last
    return last.unionByName(runs.where(F.col("n") > arity).join(above.withColumnRenamed("idx", "run"), ["key", "run"]))


def _step(digests: Column, slot: Column, path: Column, arity: int) -> Column:
    """The path of a node: the digests before and after it in its run, then its parent's path."""
    slot = slot.cast("int")
    left, right = F.array_join(F.slice(digests, F.lit(1), slot), ""), F.array_join(F.slice(digests, slot + 2, F.lit(arity)), "")
    return F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), path)


def _down(levels: list[DataFrame], tops: DataFrame | None, arity: int, name: str) -> DataFrame | None:
    """(key, run, digests, path, subroot) of the lowest level's runs."""
    above = None
    for k in reversed(range(len(levels))):
        runs = _with_path(levels[k], above, tops, arity)
        if k == 0:
            return runs
        slots = runs.select("key", "run", "digests", "path", "subroot", F.posexplode("digests").alias("slot", "_d"))
        above = stage(slots.select("key", (F.col("run") * arity + F.col("slot")).alias("idx"), _step(F.col("digests"), F.col("slot"), F.col("path"), arity).alias("path"), "subroot"), f"{name}{k}")
    return None


def proofs(m: Manifest) -> DataFrame:
    """The manifest's leaves (id, kept, digest) with subroot, root and path: for each level from the leaf up
    the digests to its left and right in its run. Paths are laid from the root down, a run's once for all
    its nodes; only the last step goes to each leaf."""
    top = _down(m.top, None, m.arity, "down-top")
    if top is None:
        above = m.subroots.select("key", F.array().cast(PATH).alias("path"))
    else:
        slots = top.select("run", "digests", "path", F.posexplode("digests").alias("slot", "_d"))
        above = slots.select((F.col("run") * m.arity + F.col("slot")).alias("key"), _step(F.col("digests"), F.col("slot"), F.col("path"), m.arity).alias("path"))
    tops = stage(m.subroots.join(above, "key").select("key", "path", F.col("digest").alias("subroot")), "tops")
    lone = m.leaves.where("n = 1").join(tops, "key")
    runs = _down(m.levels, tops, m.arity, "down")
    if runs is not None:
        many = m.leaves.where("n > 1").withColumn("run", F.call_function("div", F.col("idx"), F.lit(m.arity).cast("long")))
        many = many.join(runs.drop("n"), ["key", "run"]).withColumn("path", _step(F.col("digests"), F.col("idx") % m.arity, F.col("path"), m.arity))
        lone = lone.unionByName(many.drop("run", "digests"))
    return lone.withColumn("root", F.lit(m.root)).drop("key", "idx", "n", "grp")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    changed = leaf_digest(*[F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = proofs(build(docs, keep={"changed": F.when(chosen, changed)}))
    fold = folded(F.coalesce("kept.changed", "digest"), F.col("path"))
    out = got.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 bit by bit: a byte is mixed in, then eight times one bit is shifted out.
_CRC = "list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, e: case when e >= 0 then xor(r, e) else xor(r // 2, 3988292384 * (r % 2)) end)"
_LEAF = " || ".join(f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
OP11_SQL = f"""
with recursive own as (
  select doc_id, source, sha256({_LEAF} || coalesce(cast(strlen(text) as varchar) || ':' || text, '-')) as leaf,
    case when xor({_CRC}, 4294967295) % 5 = 0 then sha256({_LEAF} || coalesce(cast(strlen(text) as varchar) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as changed
  from documents
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n, dense_rank() over (order by encode(source) nulls first) - 1 as key from own
), tree as (
  select 0 as level, key, idx, n, leaf as digest from leaves
  union all
  select max(level) + 1, key, idx // 16, max((n + 15) // 16), sha256(string_agg(digest, '' order by idx)) from tree where n > 1 group by key, idx // 16
), subroots as (select key, digest, count(*) over () as n from tree where n = 1),
upper_tree as (
  select 0 as level, key as idx, n, digest from subroots
  union all
  select max(level) + 1, idx // 16, max((n + 15) // 16), sha256(string_agg(digest, '' order by idx)) from upper_tree where n > 1 group by idx // 16
), sides as (
  select a.level, a.key, a.idx, string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx) as l, string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx) as r
  from tree a join tree b on a.level = b.level and a.key = b.key and a.idx // 16 = b.idx // 16 where a.n > 1 group by a.level, a.key, a.idx
), upper_sides as (
  select a.level, a.idx, string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx) as l, string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx) as r
  from upper_tree a join upper_tree b on a.level = b.level and a.idx // 16 = b.idx // 16 where a.n > 1 group by a.level, a.idx
), walk as (
  select l.doc_id, l.leaf, l.key, l.idx as leaf_idx, 0 as level, l.idx, coalesce(l.changed, l.leaf) as fold, '' as proof from leaves l
  union all
  select w.doc_id, w.leaf, w.key, w.leaf_idx, w.level + 1, w.idx // 16, sha256(coalesce(s.l, '') || w.fold || coalesce(s.r, '')), w.proof || coalesce(s.l, '') || coalesce(s.r, '')
  from walk w join sides s on w.level = s.level and w.key = s.key and w.idx = s.idx
), at_subroot as (select * from walk qualify row_number() over (partition by key, leaf_idx order by level desc) = 1),
upper_walk as (
  select doc_id, leaf, key, leaf_idx, 0 as level, key as idx, fold, proof from at_subroot
  union all
  select w.doc_id, w.leaf, w.key, w.leaf_idx, w.level + 1, w.idx // 16, sha256(coalesce(s.l, '') || w.fold || coalesce(s.r, '')), w.proof || coalesce(s.l, '') || coalesce(s.r, '')
  from upper_walk w join upper_sides s on w.level = s.level and w.idx = s.idx
), at_root as (select * from upper_walk qualify row_number() over (partition by key, leaf_idx order by level desc) = 1)
select a.doc_id, a.leaf, s.digest as subroot, t.digest as root, sha256(a.proof) as proof_sha256, a.fold as folded_root, a.fold = t.digest as verified
from at_root a join subroots s using (key) join upper_tree t on t.n = 1
"""
