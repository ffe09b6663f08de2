"""Tables written once to the shared folder and read back, so that lineage and repeated work end there;
rows dealt so that a key's are in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where the session sets none, a temporary folder is
    set if all runs on one machine; on a cluster machines don't see each other's, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="reelwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with all rows of equal keys in one partition, for a fold over sorted partitions. The shuffle
    goes by a hash of the keys: one by the keys themselves is left out where the rows are already dealt by
    them, as below a join or a union of aggregates, and adaptive execution may then deal those anew, since
    a map over partitions doesn't ask for any."""
    return rows.repartition(F.xxhash64(*keys))
