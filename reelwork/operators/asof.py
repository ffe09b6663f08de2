"""Prefix scans over ordered streams, and as-of matching by them instead of range joins.

A scan carries sums and last values along the order of each key. In general one window does it: the rows
of a key are sorted in one task, which spills. A key may have too many rows for that. ``find_cuts`` counts
the rows of each key; those with more than ``most`` are cut at quantiles of their order, so that pieces are
even whatever the spacing, and a scan then works in pieces: one value per key and piece, a window over these
few, and the window within each piece. Only keys and values are read twice, rows are shuffled once, and
nothing is written. Rows with a null key or order are rows like others: the nulls are one key, and come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Rows of a key that one task sorts; the jobs cut keys with more.
MOST = 5_000_000
#: Pieces of a key at most, and rows that are sent to all executors at most.
PIECES, SENT = 1024, 200_000


@dataclass(frozen=True)
class Cuts:
    """table: _scan_k0, _scan_k1, ... and _scan_cuts, the values of ``order`` at which a key's pieces begin (but for the
    first), for each key that is cut."""

    table: DataFrame
    keys: tuple[str, ...]
    order: str
    rows: int

    def sent(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.rows <= SENT else table

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with _scan_cut (whether their key is cut) and _scan_piece, 0 where it isn't."""
        same = [F.col(k).eqNullSafe(F.col(f"_scan_k{i}")) for i, k in enumerate(self.keys)]
        out = rows.join(self.sent(self.table), _all(same), "left").withColumn("_scan_cut", F.col("_scan_cuts").isNotNull())
        piece = F.size(F.filter("_scan_cuts", lambda c: c <= F.col(self.order)))
        return out.withColumn("_scan_piece", F.when(F.col("_scan_cut"), piece).otherwise(0)).drop("_scan_cuts", *[f"_scan_k{i}" for i in range(len(self.keys))])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def find_cuts(rows: DataFrame, keys: list[str], order: str, most: int | None) -> Cuts | None:
    """Where keys with more than ``most`` rows are cut; None if there are none (or ``most`` is None), which
    one count of the keys tells. ``order`` is a whole number."""
    if most is None:
        return None
    named = [F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(keys)]
    counts = rows.select(*named, F.col(order).cast("bigint").alias("_scan_at"))
    hot = counts.groupBy(*[f"_scan_k{i}" for i in range(len(keys))]).agg(F.count("*").alias("_scan_n")).where(F.col("_scan_n") > most)
    found = hot.agg(F.count("*").alias("keys"), F.max("_scan_n").alias("most")).first()
    if not found["keys"]:
        return None
    pieces = min(PIECES, 2 * -(-found["most"] // most))
    same = _all([F.col(f"_scan_k{i}").eqNullSafe(F.col(f"_scan_h{i}")) for i in range(len(keys))])
    few = found["keys"] * pieces <= SENT
    of_hot = hot.select(*[F.col(f"_scan_k{i}").alias(f"_scan_h{i}") for i in range(len(keys))])
    only = counts.join(F.broadcast(of_hot) if few else of_hot, same, "left_semi")
    at = F.percentile_approx("_scan_at", [i / pieces for i in range(1, pieces)], 100 * PIECES)
    table = only.groupBy(*[f"_scan_k{i}" for i in range(len(keys))]).agg(F.coalesce(F.array_distinct(at), F.array().cast("array<bigint>")).alias("_scan_cuts"))
    return Cuts(stage(table, "cuts"), tuple(keys), order, found["keys"] * pieces)


def scan(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, str]], cuts: Cuts | None = None) -> DataFrame:
    """``rows`` with new columns, all in one pass along ``order`` within ``keys``. Each is named with what
    it holds and of which column: ("sum", c) the sum over all earlier rows, 0 for the first; ("max", c)
    the largest c of them; ("previous", c) the last of them that isn't null; ("last", c) the same, the row
    itself included. ``cuts``
    are those of the first of ``order`` and of ``keys`` or some of them."""
    upto = {"sum": -1, "max": -1, "previous": -1, "last": 0}

    def within(w: Window, what: str, of: str) -> Column:
        w = w.rowsBetween(Window.unboundedPreceding, upto[what])
        return F.sum(of).over(w) if what == "sum" else F.max(of).over(w) if what == "max" else F.last(of, ignorenulls=True).over(w)

    begun = lambda what, c: F.coalesce(c, F.lit(0)) if what == "sum" else c
    if cuts is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({n: begun(what, within(w, what, of)) for n, (what, of) in columns.items()})
    pieces = cuts.placed(rows)
    value = lambda what, of: F.sum(of) if what == "sum" else F.max(of) if what == "max" else F.max_by(of, F.when(F.col(of).isNotNull(), F.struct(*order)))
    each = pieces.where("_scan_cut").groupBy(*keys, "_scan_piece").agg(*[value(*c).alias(f"_scan_v{i}") for i, c in enumerate(columns.values())])
    earlier = Window.partitionBy(*keys).orderBy("_scan_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda i, what: F.sum(f"_scan_v{i}").over(earlier) if what == "sum" else F.max(f"_scan_v{i}").over(earlier) if what == "max" else F.last(f"_scan_v{i}", ignorenulls=True).over(earlier)
    carried = each.select(*[F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(keys)], F.col("_scan_piece").alias("_scan_p"), *[carry(i, what).alias(f"_scan_c{i}") for i, (what, _) in enumerate(columns.values())])
    same = _all([*[F.col(k).eqNullSafe(F.col(f"_scan_k{i}")) for i, k in enumerate(keys)], F.col("_scan_piece") == F.col("_scan_p")])
    out = pieces.join(cuts.sent(carried) if set(keys) == set(cuts.keys) else carried, same, "left")
    w = Window.partitionBy(*keys, "_scan_piece").orderBy(*order)
    new = {}
    for i, (n, (what, of)) in enumerate(columns.items()):
        own, before = begun(what, within(w, what, of)), begun(what, F.col(f"_scan_c{i}"))
        new[n] = own + before if what == "sum" else F.greatest(own, before) if what == "max" else F.coalesce(own, before)
    return out.withColumns(new).drop("_scan_cut", "_scan_piece", "_scan_p", *[f"_scan_k{i}" for i in range(len(keys))], *[f"_scan_c{i}" for i in range(len(columns))])


def last_known(rows: DataFrame, value: str, keys: list[str], order: list[str], cuts: Cuts | None = None) -> DataFrame:
    """``rows`` with ``value`` replaced by its last non-null one, at or before each row in order."""
    return scan(rows, keys, order, {value: ("last", value)}, cuts)


def previous(rows: DataFrame, values: list[str], keys: list[str], order: list[str], names: list[str], cuts: Cuts | None = None) -> DataFrame:
    """``rows`` with each of ``values`` of the last earlier row of the keys that has it, as ``names``."""
    return scan(rows, keys, order, {n: ("previous", v) for n, v in zip(names, values, strict=True)}, cuts)


def following(rows: DataFrame, value: str, keys: list[str], order: list[str], name: str, most: int | None = None) -> DataFrame:
    """``rows`` with ``value`` of the next row of the keys that has it; ``order`` are numbers."""
    back = [f"_back{i}" for i in range(len(order))]
    turned = rows.withColumns({b: -F.col(o).cast("bigint") for b, o in zip(back, order, strict=True)})
    return previous(turned, [value], keys, back, [name], find_cuts(turned, keys, back[0], most)).drop(*back)


def running_sum(rows: DataFrame, value: str, keys: list[str], order: list[str], name: str, cuts: Cuts | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the earlier rows of its keys (0 for the first)."""
    return scan(rows, keys, order, {name: ("sum", value)}, cuts)


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: Column, tie: str | None = None, most: int | None = None, cuts: Cuts | None = None) -> DataFrame:
    """Each row of ``left`` with column ``known``: ``value`` of the last row of ``right`` with the same keys
    and ``at`` no later (of equal ones that with the highest ``tie``), else null. It is a union of both
    sides and a scan. Keys with more than ``most`` rows on both sides are cut, or ``cuts`` given."""
    names = left.columns
    events = right.select(*keys, at, F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("_tie"), value.alias("known"))
    rest = [c for c in names if c not in (*keys, at)]
    blank = events.select("*", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest])
    asks = left.withColumns({"_side": F.lit(1), "_tie": F.lit(0).cast("bigint"), "known": F.lit(None).cast(events.schema["known"].dataType)})
    both = blank.unionByName(asks)
    cuts = cuts or find_cuts(left.select(*keys, at).unionByName(right.select(*keys, at)), keys, at, most)
    return last_known(both, "known", keys, [at, "_side", "_tie"], cuts).where("_side = 1").select(*names, "known")
