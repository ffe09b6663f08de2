"""Media tables derived from the given star-schema, event and embedding tables.

Every rule is integer arithmetic (or exact rounding), so any SQL engine gives the same rows; the
same rules as SQL text are in ``reelwork.jobs.views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Microseconds of a timestamp without zone since 2024-01-01, whatever the session's zone.
MICROS = "(datediff(ts, date'2024-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(second from ts) * 1000000 as bigint))"
DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr(MICROS).alias("us"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    track = F.when(F.col("event_type").isin("view", "click"), 0).when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(2)
    return e.select(
        F.col("user_id").alias("stream_id"), track.alias("track_id"), F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("data")), track + 1).alias("kind"),
        F.col("event_id").alias("seq"), F.col("us").alias("pts"), F.col("us").alias("dts"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(33333).cast("bigint").alias("duration"),
        F.lit(1).alias("tb_num"), F.lit(1_000_000).alias("tb_den"), (F.col("event_type") != "click").alias("is_key"), F.round(F.col("value") * 100).cast("bigint").alias("size"),
    )


def packets_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    s = F.col("seq")
    return p.withColumns({
        "tb_den": F.when((s % 17 != 0) & (s % 23 == 0), 0).otherwise(F.col("tb_den")),
        "pts": F.when(s % 17 == 0, None).when(s % 23 == 0, F.col("pts")).when(s % 29 == 0, -F.col("pts")).when(s % 31 == 0, (1 << 63) - 1).otherwise(F.col("pts")),
    })


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stream and track that has packets."""
    return packets(spark, sf_dir).select("stream_id", "track_id", "kind").distinct()


def audio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 samples of one channel at 48 kHz per frame; pre-gain 4."""
    e = table(spark, sf_dir, "embeddings")
    idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("input"), "vec_id", idx.alias("frame_idx"), (F.col("label") % 2).alias("mix_id"), F.transform("embedding", lambda x: x.cast("double") * 4).alias("samples")).withColumn("pts", F.col("frame_idx").cast("bigint") * 64)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return li.select(
        F.col("l_orderkey").alias("frame_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order[1:])).cast("bigint").alias("det_id"), (F.col("l_suppkey") % 2).cast("int").alias("class_id"),
        F.round(F.col("l_extendedprice") / 110000, 6).alias("score"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"),
        (20 + F.col("l_suppkey") % 10).cast("double").alias("w"), (20 + F.col("l_partkey") % 10).cast("double").alias("h"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 frames; a last frame that isn't full is left out."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    full = F.count("*").over(Window.partitionBy("frame_id"))
    rows = p.select(
        F.floor(k / 64).cast("bigint").alias("frame_id"), F.floor(k % 64 / 8).cast("int").alias("row"), (k % 8).cast("int").alias("col"),
        ((37 * k) % 256).cast("int").alias("r"), ((91 * k + 5 * F.col("p_size")) % 256).cast("int").alias("g"), ((53 * k) % 256).cast("int").alias("b"), F.lit(255).alias("a"),
    )
    return rows.withColumn("_n", full).where("_n = 64").drop("_n")


CANVAS = (64, 36)


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("canvas_id"), k.alias("layer_id"), (k % 64 - 16).cast("int").alias("x"), ((7 * k) % 36 - 8).cast("int").alias("y"), (1 + (3 * k) % 40).cast("int").alias("w"), (1 + (5 * k) % 30).cast("int").alias("h"),
        (16 * (1 + k % 5)).cast("int").alias("src_w"), (9 * (1 + k % 4)).cast("int").alias("src_h"), (k % 4).cast("int").alias("z_index"), ((k % 5) / 4).alias("opacity"), (k % 6 != 0).alias("visible"),
        F.when(k % 3 == 0, "Stretch").when(k % 3 == 1, "Contain").otherwise("Cover").alias("fit"), ((37 * k) % 256).cast("int").alias("r"), ((91 * k) % 256).cast("int").alias("g"), ((53 * k) % 256).cast("int").alias("b"),
    )


def clock_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    wall = F.col("us") * 1000
    position = wall + (F.col("event_id") % 7 - 3) * 10_000_000
    priming = F.col("event_id") % 9 == 0
    return e.select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), wall.alias("wall_ns"), position.alias("position_ns"), (position + DAY * 1000).alias("submitted_ns"),
        (F.col("event_id") % 4 != 0).alias("running"), priming.alias("priming"), (~priming & (F.col("event_id") % 11 == 0)).alias("ended"),
    )


def clock_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type in ('view', 'click')")
    wall = F.col("us") * 1000
    return e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), wall.alias("wall_ns"), (wall + (F.col("event_id") % 5 - 2) * 20_000_000).alias("pts_ns"))


def bus_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type <> 'view'")
    kind = F.when(F.col("event_type") == "signup", "Eos").when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "click", "Dropped").otherwise("Seeked")
    asked = F.when(kind == "Seeked", F.floor("value").cast("bigint") * 1_000_000_000)
    landed = F.when(kind == "Seeked", F.floor(F.col("value") / 10).cast("bigint") * 10_000_000_000)
    return e.select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("user_id") % 30).alias("element_id"), kind.alias("event"), F.col("us").alias("at"), asked.alias("requested_ns"), landed.alias("landed_ns"))


def nodes_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One pipeline per region: region to nation to supplier, with some nations fed by two regions."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    one = lambda c, p: F.concat(F.lit(p), c.cast("string"))
    nodes = region.select(one(F.col("r_regionkey"), "r").alias("id"), F.lit("Source").alias("element_type"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(nation.select(one(F.col("n_nationkey"), "n").alias("id"), F.lit("Filter").alias("element_type"), F.col("n_name").alias("name")))
    nodes = nodes.unionByName(supplier.select(one(F.col("s_suppkey"), "s").alias("id"), F.lit("Sink").alias("element_type"), F.col("s_name").alias("name")))
    edges = nation.select(one(F.col("n_regionkey"), "r").alias("from_id"), one(F.col("n_nationkey"), "n").alias("to_id"))
    edges = edges.unionByName(nation.where("n_nationkey % 7 = 0").select(one((F.col("n_regionkey") + 1) % 5, "r").alias("from_id"), one(F.col("n_nationkey"), "n").alias("to_id")))
    edges = edges.unionByName(supplier.select(one(F.col("s_nationkey"), "n").alias("from_id"), one(F.col("s_suppkey"), "s").alias("to_id")))
    return nodes.withColumn("pipeline_id", F.lit(0)), edges.withColumn("pipeline_id", F.lit(0))


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type in ('signup', 'error')")
    return e.select(F.col("user_id").alias("file_id"), (F.col("event_id") % 3).cast("int").alias("track_id"), F.when(F.col("event_type") == "signup", "Eos").otherwise("Stop").alias("event"), F.col("us").alias("at"), "event_id")


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    i = F.row_number().over(Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderdate", "o_orderkey"))
    return o.select((F.col("o_custkey") % 50).alias("label"), i.alias("i"), F.col("o_totalprice").alias("value"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as log lines, one file per user; every signup logs a topology of two lines."""
    e = events(spark, sf_dir)
    ms = F.floor(F.col("us") / 1000)
    at = lambda unit, n, width: F.lpad((F.floor(ms / unit) % n).cast("string"), width, "0")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("us") / DAY).cast("int")), "yyyy-MM-dd")
    stamp = F.concat(day, F.lit("T"), at(3_600_000, 24, 2), F.lit(":"), at(60_000, 60, 2), F.lit(":"), at(1000, 60, 2), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("+00:00"))
    user, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    pipe = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit(" [pipeline_id="), (F.col("user_id") % 7).cast("string"), F.lit("]"))).otherwise("")
    message = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("run\nAppSource(source)#"), eid, F.lit("\n└── [out] → AppSink(sink)#"), eid))
        .when(F.col("event_type") == "view", F.lit("event=eos phase=received"))
        .when(F.col("event_type") == "click", F.lit("event=control control=Pause phase=received"))
        .when(F.col("event_type") == "purchase", F.lit("event=control control=Pause phase=completed outcome=ok"))
        .otherwise(F.concat(F.lit("event=eos phase=completed outcome=error error=code"), eid))
    )
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    text = F.concat(stamp, F.lit(" "), level, F.lit(" [thread=worker:"), (F.col("user_id") % 4).cast("string"), F.lit("]"), pipe, F.lit(" [element=Queue] [name=queue"), (F.col("user_id") % 9).cast("string"), F.lit("] "), message)
    return e.select(F.concat(F.lit("user"), user).alias("file"), "event_id", F.posexplode(F.split(text, "\n")).alias("_n", "line")).select("file", (F.col("event_id") * 10 + F.col("_n")).alias("line_no"), "line")


#: Well-formed sequence parameter sets (baseline profile) as hexadecimal text, and their widths.
SPS = [("6742001eda0a3640", 160), ("6742001eda0507e4", 320), ("6742001eda0280f640", 640), ("6742001eda014016e4", 1280)]


def nal_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four consecutive events of a user make one byte-stream payload. Every third signup carries a
    well-formed parameter set, the others a malformed one."""
    e = events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    kind = F.when(F.col("event_type") == "signup", "67").when(F.col("event_type") == "purchase", "68").when(F.col("event_type") == "view", "65").when(F.col("event_type") == "click", "41").otherwise("06")
    good = F.element_at(F.array(*[F.lit(x) for x, _ in SPS]), (F.col("event_id") % len(SPS)).cast("int") + 1)
    unit = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0), good).otherwise(F.concat(kind, F.hex(F.encode(F.col("event_id").cast("string"), "utf-8"))))
    unit = F.concat(F.lit("00000001"), unit)
    rows = e.select(F.col("user_id").alias("stream_id"), F.floor(n / 4).cast("bigint").alias("seq"), "event_id", "us", unit.alias("unit"))
    joined = rows.groupBy("stream_id", "seq").agg(F.max("us").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "unit"))), lambda x: x["unit"]), "").alias("hex"))
    # Every fifth stream changes its codec after each eighth payload.
    turn = F.when(F.col("stream_id") % 5 == 1, F.floor(F.col("seq") / 8)).otherwise(F.lit(0))
    codec = F.when((F.col("stream_id") + turn) % 3 != 0, "H264").otherwise("VP8")
    return joined.select("stream_id", "seq", codec.alias("codec"), F.unhex("hex").alias("payload"), "at")
