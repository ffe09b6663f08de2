"""Every registered job of the media library against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from reelwork.jobs import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return float(x) if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 2**53 else x


def rows_of(rows, cols):
    return sorted(repr([plain(r[i]) for i in range(len(cols))]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.JOBS))
def test_job_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({registry.SQL[name]})").fetchall()
    found = rows_of(got.select(*[f"`{c}`" for c in cols]).collect(), cols)
    assert found == rows_of(want, cols) and found


@pytest.mark.parametrize("name", ["segment_summary", "splice_timeline", "sync_video_to_audio", "nms", "gain_ramp", "resample_audio", "mix_audio"])
def test_partitions_do_not_matter(spark, name):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = registry.QUERIES[name](spark, SF)
        results.append(rows_of(df.collect(), df.columns))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


@pytest.mark.parametrize("name", ["stream_probe_codec", "stream_segmenter"])
def test_ids_need_not_ascend_with_time(spark, name, tmp_path):
    c, copies = duckdb.connect(), "select * replace (event_id + 1000 * k as event_id) from (select * from src, range(3) r(k))"
    c.execute(f"create view src as select * from '{SF}/events.parquet'")
    # Ids dealt against time, and a month that each user has three times with later ids.
    for i, events in enumerate(["select * replace (event_id * 377 % 1000 as event_id) from src", f"select * exclude (k) from ({copies})"]):
        os.mkdir(tmp_path / str(i))
        c.execute(f"copy ({events}) to '{tmp_path}/{i}/events.parquet'")
        c.execute(f"create or replace view events as select * from '{tmp_path}/{i}/events.parquet'")
        got = registry.QUERIES[name](spark, f"{tmp_path}/{i}")
        want = c.execute(f"select {', '.join(chr(34) + x + chr(34) for x in got.columns)} from ({registry.SQL[name]})").fetchall()
        assert rows_of(got.collect(), got.columns) == rows_of(want, got.columns) and want
