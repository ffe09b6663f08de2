"""Rows for all steps of long spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of one array.
STEPS = 4096


def stepped(rows: DataFrame, lo: Column, hi: Column, step: int, name: str) -> DataFrame:
    """``rows`` once for each of lo, lo + step, ... up to hi, which is column ``name``; none where hi is
    below lo or either is null. The steps are made as ranges of ranges, and the ranges spread over tasks,
    so that neither an array nor a task holds a whole span."""
    big, mid, one = (F.lit(step * STEPS**k).cast("bigint") for k in (2, 1, 0))
    rows = rows.withColumns({name: lo.cast("bigint"), "_hi": hi.cast("bigint")}).where(F.col(name) <= F.col("_hi"))
    within = lambda width: F.least(F.col("_hi"), F.col(name) + width - one)
    rows = rows.withColumn(name, F.explode(F.sequence(name, "_hi", big)))
    rows = rows.withColumn(name, F.explode(F.sequence(F.col(name), within(big), mid))).repartition(*rows.columns[:-1])
    return rows.withColumn(name, F.explode(F.sequence(F.col(name), within(mid), one))).drop("_hi")
